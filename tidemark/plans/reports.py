"""Linking, surprises, quantile reports and regressions over the project's own tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.text import clean_ticker, cusip8
from tidemark.operators.embed import diagnostics, dimension_stats, mean_pooled, model_year
from tidemark.operators.fundamentals import nearest_report, standard_quarters, surprises
from tidemark.operators.links import first_by, priority_link, version_dedup
from tidemark.operators.panel import clustered_ols, demeaned, iteratively_demeaned, pooled_ols, quarter_summary, quintile_spread
from tidemark.operators.quantiles import bin_by_cutoffs, exact_quantiles, hfl, quarter_number, quintile_within, rolling_members, with_quantiles, year_quarter, zscore
from tidemark.plans.known import day_text
from tidemark.sources import read_table, stored
from tidemark.sources.stores import profile

RETURNS = "abnormal_returns"


def identifiers_clean(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts")
    return calls.select("event_id", clean_ticker(F.col("ticker")).alias("ticker"), cusip8(F.col("cusip")).alias("cusip8"))


IDENTIFIERS_SQL = """select event_id, upper(regexp_replace(split_part(ticker, '^', 1), '\\.(OQ|N|A|PK|O|K|CB)$', '')) ticker, trim(substring(cusip, 1, 8)) cusip8 from transcripts"""


def dedup_versions(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts").where("company_id <> ''").withColumn("year", F.year("call_date"))
    kept = version_dedup(calls, ["year", "company_id", "start_date_str"], "last_update", "event_id")
    return kept.select("event_id", "company_id", "start_date_str", F.coalesce("last_update", F.lit("")).alias("last_update"))


DEDUP_SQL = """select event_id, company_id, start_date_str, coalesce(last_update, '') last_update from (
select *, row_number() over (partition by year(call_date), company_id, start_date_str order by coalesce(last_update, '') = '', coalesce(last_update, ''), event_id) r
from transcripts where company_id <> '' and coalesce(event_id, '') <> '') where r = 1"""


def interval_link_priority(spark: SparkSession, folder: str) -> DataFrame:
    """One permno per event: by cusip, else by ticker, among common stocks valid on the day of the call."""
    calls = read_table(spark, folder, "transcripts").where("event_id is not null and call_date is not null")
    calls = calls.select("event_id", F.to_date("call_date").alias("call_date"), cusip8(F.col("cusip")).alias("cusip8"), clean_ticker(F.col("ticker")).alias("tick")).distinct()
    names = read_table(spark, folder, "crsp_msenames").where(F.col("shrcd").isin(10, 11) & F.col("exchcd").isin(1, 2, 3))
    names = names.select("permno", "namedt", "nameendt", F.trim("ncusip").alias("ncusip"), F.upper(F.trim("ticker")).alias("ticker"))
    linked = priority_link(calls, "event_id", "call_date", names, "namedt", "nameendt", [("cusip8", "ncusip"), ("tick", "ticker")], [F.desc("namedt"), "permno"])
    return linked.select("event_id", "permno", "link_step")


LINK_SQL = """with ev as (select distinct event_id, cast(call_date as date) d, trim(substring(cusip, 1, 8)) c,
 upper(regexp_replace(split_part(ticker, '^', 1), '\\.(OQ|N|A|PK|O|K|CB)$', '')) t from transcripts where event_id is not null and call_date is not null),
n as (select permno, namedt, coalesce(nameendt, date '2099-12-31') e, trim(ncusip) c, upper(trim(ticker)) t from crsp_msenames where shrcd in (10, 11) and exchcd in (1, 2, 3)),
l as (select event_id, permno, namedt, 1 link_step from ev join n on ev.c = n.c and ev.c <> '' and d between namedt and e
 union all select event_id, permno, namedt, 2 from ev join n on ev.t = n.t and ev.t <> '' and d between namedt and e)
select event_id, permno, link_step from (select *, row_number() over (partition by event_id order by link_step, namedt desc, permno) r from l) where r = 1"""


def link_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts")
    words = F.coalesce("n_words_pres", F.lit(0)) + F.coalesce("n_words_qa", F.lit(0))
    calls = calls.select("event_id", words.alias("total_words"))
    return with_quantiles(calls, [], "total_words", [0.995], "cut").where("total_words <= cut[0]").select("event_id", "total_words")


LENGTH_SQL = """with c as (select event_id, coalesce(n_words_pres, 0) + coalesce(n_words_qa, 0) total_words from transcripts)
select event_id, total_words from c where total_words <= (select quantile_cont(total_words, 0.995) from c)"""


def _gvkey() -> Column:
    return F.trim("gvkey").try_cast("bigint")


def open_interval_link(spark: SparkSession, folder: str) -> DataFrame:
    """The first valid link of each event's firm on the event date; an open end is far in the future."""
    links = read_table(spark, folder, "crsp_ccmxpf_linktable").where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C"))
    links = links.select(_gvkey().alias("gvkey"), "lpermno", "linkdt", F.coalesce("linkenddt", F.lit("2099-12-31").cast("date")).alias("linkenddt"))
    events = read_table(spark, folder, RETURNS).select("event_id", "permno", F.to_date("event_date").alias("d"))
    valid = (F.col("permno") == F.col("lpermno")) & F.col("d").between(F.col("linkdt"), F.col("linkenddt"))
    return first_by(events.distinct().join(links, valid), ["event_id", "d"], [F.desc("linkdt"), F.desc("linkenddt"), "gvkey"]).select("event_id", day_text("d").alias("event_date"), "gvkey")


OPEN_LINK_SQL = """with l as (select cast(trim(gvkey) as bigint) gvkey, lpermno, linkdt, coalesce(linkenddt, date '2099-12-31') e from crsp_ccmxpf_linktable where linktype in ('LU', 'LC') and linkprim in ('P', 'C')),
ev as (select distinct event_id, permno, cast(event_date as date) d from abnormal_returns)
select event_id, strftime(d, '%Y-%m-%d') event_date, gvkey from (select *, row_number() over (partition by event_id, d order by linkdt desc, e desc, gvkey) r from ev join l on permno = lpermno and d between linkdt and e) where r = 1"""


def _quarters(spark: SparkSession, folder: str) -> DataFrame:
    return standard_quarters(read_table(spark, folder, "comp_fundq").withColumn("gvkey", _gvkey()))


def sue_lag4(spark: SparkSession, folder: str) -> DataFrame:
    return surprises(_quarters(spark, folder), "epspxq").select("gvkey", "fyearq", "fqtr", F.round("sue", 6).alias("sue"))


_QUARTERS_SQL = """q as (select * from (select *, cast(trim(gvkey) as bigint) g, row_number() over (partition by cast(trim(gvkey) as bigint), fyearq, fqtr
 order by rdq desc nulls last, datadate desc nulls last, epspxq desc nulls last, ibq desc nulls last) r from comp_fundq where indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C') where r = 1)"""
SUE_SQL = f"""with {_QUARTERS_SQL} select g gvkey, fyearq, fqtr, round(epspxq - lag(epspxq, 4) over (partition by g order by rdq nulls last, fyearq, fqtr), 6) sue from q"""


def nearest_report_any(spark: SparkSession, folder: str) -> DataFrame:
    events = open_interval_link(spark, folder)
    near = nearest_report(events, "event_id", "gvkey", "event_date", _quarters(spark, folder))
    return near.select("event_id", "event_date", "gvkey", "report.days", "report.fyearq", "report.fqtr")


NEAREST_SQL = f"""with k as ({OPEN_LINK_SQL}), {_QUARTERS_SQL},
n as (select k.event_id, k.event_date, k.gvkey, abs(date_diff('day', q.rdq, cast(k.event_date as date))) as days, q.fyearq, q.fqtr,
 row_number() over (partition by k.event_id, k.event_date order by abs(date_diff('day', q.rdq, cast(k.event_date as date))) nulls last, q.rdq, q.fyearq, q.fqtr) r from k left join q on q.g = k.gvkey and q.rdq is not null)
select event_id, event_date, gvkey, days, fyearq, fqtr from n where r = 1"""


def quarter_events(spark: SparkSession, folder: str) -> DataFrame:
    """One row per event with its quarter; of an event delivered twice the greatest figures."""
    events = read_table(spark, folder, RETURNS)
    return events.groupBy("event_id", "permno", F.to_date("event_date").alias("event_date")).agg(
        F.max("abnormal_return").alias("ar"), F.max(F.when(~F.col("ret").isin(-66.0, -77.0, -88.0, -99.0), F.col("ret"))).alias("ret")
    ).withColumns({"yq": year_quarter(F.col("event_date")), "q": quarter_number(F.col("event_date"))})


_QEV = """e as (select event_id, permno, cast(event_date as date) d, max(abnormal_return) ar, max(case when ret not in (-66, -77, -88, -99) then ret end) ret from abnormal_returns group by 1, 2, 3),
ev as (select *, year(d) || 'Q' || quarter(d) yq, year(d) * 4 + quarter(d) q from e)"""
_TEST_MEMBERS = """rk as (select q, row_number() over (order by q) r from (select distinct q from ev)),
mb as (select t.q test_q, s.q train_q from rk t join rk s on s.r between t.r - 8 and t.r - 1 where t.r > 8)"""


def quintile_in_quarter(spark: SparkSession, folder: str) -> DataFrame:
    return quintile_within(stored(quarter_events(spark, folder)), "yq", "ar").select("event_id", "yq", F.col("quintile").cast("double").alias("quintile"))


QUINTILE_SQL = f"""with {_QEV}, g as (select yq, list_distinct(quantile_cont(ar, [0.2, 0.4, 0.6000000000000001, 0.8])) edges, min(ar) lo from ev group by 1)
select event_id, ev.yq, case when ar is not null then 1 + len(list_filter(edges, lambda x: x < ar and x <> lo)) end::double quintile from ev join g using (yq)"""


def rolling_window_members(spark: SparkSession, folder: str) -> DataFrame:
    return rolling_members(quarter_events(spark, folder), "q")


MEMBERS_SQL = f"with {_QEV}, {_TEST_MEMBERS} select test_q test_quarter, train_q train_quarter from mb"


FIFTHS = (0.2, 0.4, 0.6, 0.8)


def _trained(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """The events, and those of each test quarter's training quarters."""
    events = stored(quarter_events(spark, folder))
    members = stored(rolling_members(events, "q"))
    return events, events.join(F.broadcast(members), F.col("q") == F.col("train_quarter"))  # eight rows per quarter


def quintile_train_cutoff(spark: SparkSession, folder: str) -> DataFrame:
    events, train = _trained(spark, folder)
    cuts = exact_quantiles(train, ["test_quarter"], "ar", FIFTHS, "cutoffs")
    return events.join(F.broadcast(cuts), F.col("q") == F.col("test_quarter")).select("event_id", "yq", bin_by_cutoffs(F.col("ar"), F.col("cutoffs")).cast("double").alias("quintile"))


CUTOFF_SQL = f"""with {_QEV}, {_TEST_MEMBERS}, c as (select test_q, quantile_cont(ar, [0.2, 0.4, 0.6, 0.8]) cutoffs from mb join ev on ev.q = train_q group by 1)
select event_id, yq, case when ar is not null then 1 + len(list_filter(cutoffs, lambda x: x < ar)) end::double quintile from ev join c on c.test_q = ev.q"""


def quintile_prior_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Cutoffs of the last eight quarters' scores, of the own quarter where those are fewer than 100."""
    events, train = _trained(spark, folder)
    sizes = train.groupBy("test_quarter").agg(F.count("ret").alias("n"))
    cuts = sizes.join(exact_quantiles(train, ["test_quarter"], "ret", FIFTHS, "prior"), "test_quarter", "left")
    joined = with_quantiles(events, ["q"], "ret", FIFTHS, "own").join(F.broadcast(cuts), F.col("q") == F.col("test_quarter"), "left")
    cutoffs = F.when(F.coalesce("n", F.lit(0)) < 100, F.col("own")).otherwise(F.col("prior"))
    return joined.select("event_id", "yq", bin_by_cutoffs(F.col("ret"), cutoffs).cast("double").alias("quintile"))


PRIOR_SQL = f"""with {_QEV}, {_TEST_MEMBERS}, c as (select test_q, count(ret) n, quantile_cont(ret, [0.2, 0.4, 0.6, 0.8]) prior from mb join ev on ev.q = train_q group by 1),
o as (select q, quantile_cont(ret, [0.2, 0.4, 0.6, 0.8]) own from ev group by 1)
select event_id, yq, case when ret is not null then 1 + len(list_filter(case when coalesce(n, 0) < 100 then own else prior end, lambda x: x < ret)) end::double quintile from ev join o using (q) left join c on c.test_q = ev.q"""


def hfl_category_window(spark: SparkSession, folder: str) -> DataFrame:
    events, train = _trained(spark, folder)
    cuts = exact_quantiles(train, ["test_quarter"], F.abs("ar"), [1 / 3], "cut")
    return events.join(F.broadcast(cuts), F.col("q") == F.col("test_quarter")).select("event_id", "yq", hfl(F.col("ar"), F.col("cut")[0]).alias("category"))


HFL_WINDOW_SQL = f"""with {_QEV}, {_TEST_MEMBERS}, c as (select test_q, quantile_cont(abs(ar), 1.0 / 3) cut from mb join ev on ev.q = train_q group by 1)
select event_id, yq, case when ar > cut then 'H' when ar < -cut then 'L' else 'F' end category from ev join c on c.test_q = ev.q"""


def _binned(spark: SparkSession, folder: str) -> DataFrame:
    return quintile_within(stored(quarter_events(spark, folder)), "yq", "ar").withColumns({"abs_ret": F.abs("ret"), "sq_ret": F.col("ret") * F.col("ret")})


_BINNED = QUINTILE_SQL.replace("select event_id, ev.yq, case", ", b as (select ev.*, abs(ret) abs_ret, ret * ret sq_ret, case").replace("from ev join g using (yq)", "from ev join g using (yq))")


def quintile_spreads(spark: SparkSession, folder: str) -> DataFrame:
    spread = quintile_spread(_binned(spark, folder), "quintile", ["ret", "abs_ret", "sq_ret"])
    return spread.select("horizon", F.round("spread", 8).alias("spread"))


SPREAD_SQL = _BINNED + """, s as (select avg(ret) filter (quintile = 5) - avg(ret) filter (quintile = 1) ret, avg(abs_ret) filter (quintile = 5) - avg(abs_ret) filter (quintile = 1) abs_ret,
 avg(sq_ret) filter (quintile = 5) - avg(sq_ret) filter (quintile = 1) sq_ret from b) select horizon, round(spread, 8) spread from (unpivot s on ret, abs_ret, sq_ret into name horizon value spread)"""


def quintile_means(spark: SparkSession, folder: str) -> DataFrame:
    return _binned(spark, folder).where("quintile is not null").groupBy(F.col("quintile").cast("double").alias("quintile")).agg(F.count("ret").alias("n"), F.round(F.avg("ret"), 8).alias("mean_ret"))


MEANS_SQL = _BINNED + " select quintile, count(ret) n, round(avg(ret), 8) mean_ret from b where quintile is not null group by 1"


def quarterly_summary(spark: SparkSession, folder: str) -> DataFrame:
    s = quarter_summary(_binned(spark, folder), "yq", "ret", "quintile")
    return s.select("yq", "n", *[F.round(c, 8).alias(c) for c in ("mean", "sd", "spread")])


SUMMARY_SQL = _BINNED + """ select yq, count(*) n, round(avg(ret), 8) mean, round(stddev_samp(ret), 8) sd,
 round(case when count(*) > 10 then avg(ret) filter (quintile = 5) - avg(ret) filter (quintile = 1) end, 8) spread from b group by 1"""


def pooled_regression(spark: SparkSession, folder: str) -> DataFrame:
    scored = zscore(quarter_events(spark, folder).where("ar is not null"), "ar")
    return pooled_ols(scored, "ret", "z").select("n", *[F.round(c, 8).alias(c) for c in ("intercept", "slope", "slope_se", "r2")], F.round("t", 5).alias("t"))


_Z = f"with {_QEV}, zs as (select ev.*, (ar - avg(ar) over ()) / stddev_samp(ar) over () z from ev where ar is not null), b as (select * from zs where ret is not null)"
POOLED_SQL = _Z + """, f as (select count(*) n, regr_intercept(ret, z) a, regr_slope(ret, z) s, regr_sxx(ret, z) sxx, regr_syy(ret, z) syy, regr_r2(ret, z) r2 from b)
select n, round(a, 8) intercept, round(s, 8) slope, round(sqrt(syy * (1 - r2) / (n - 2) / sxx), 8) slope_se, round(r2, 8) r2, round(s / sqrt(syy * (1 - r2) / (n - 2) / sxx), 5) t from f"""


def demeaned_regression(spark: SparkSession, folder: str) -> DataFrame:
    """Firm means, then quarter means, taken out once."""
    panel = quarter_events(spark, folder).where("ar is not null and ret is not null").select("permno", "yq", "ar", "ret")
    fit = pooled_ols(demeaned(panel, ["permno", "yq"], ["ar", "ret"]), "ret", "ar")
    return fit.select("n", F.round("slope", 8).alias("slope"), F.round("slope_se", 8).alias("slope_se"))


def _demean_sql(passes: int) -> str:
    sql = f"with {_QEV}, d0 as (select event_id, permno, yq, ar, ret from ev where ar is not null and ret is not null)"
    for i in range(2 * passes):
        key = ("permno", "yq")[i % 2]
        sql += f", d{i + 1} as (select event_id, permno, yq, ar - avg(ar) over (partition by {key}) ar, ret - avg(ret) over (partition by {key}) ret from d{i})"
    return sql


DEMEANED_SQL = _demean_sql(1) + """, f as (select count(*) n, regr_slope(ret, ar) s, regr_sxx(ret, ar) sxx, regr_syy(ret, ar) syy, regr_r2(ret, ar) r2 from d2)
select n, round(s, 8) slope, round(sqrt(syy * (1 - r2) / (n - 2) / sxx), 8) slope_se from f"""


def iterative_demean(spark: SparkSession, folder: str) -> DataFrame:
    panel = quarter_events(spark, folder).where("ar is not null and ret is not null").select("event_id", "permno", "yq", "ar", "ret")
    out = iteratively_demeaned(panel, ["permno", "yq"], ["ar", "ret"], passes=4, tolerance=None)
    return out.select("event_id", "permno", "yq", F.round("ar", 7).alias("ar"), F.round("ret", 7).alias("ret"))


ITERATIVE_SQL = _demean_sql(4) + " select event_id, permno, yq, round(ar, 7) ar, round(ret, 7) ret from d8"


def cluster_errors(spark: SparkSession, folder: str) -> DataFrame:
    fit = clustered_ols(quarter_events(spark, folder), "ret", "ar", ["permno", "yq"])
    return fit.select("n", F.round("slope", 8).alias("slope"), F.round("slope_se", 8).alias("slope_se"))


CLUSTER_SQL = f"""with {_QEV}, b as (select * from ev where ar is not null and ret is not null), f as (select count(*) n, regr_intercept(ret, ar) a, regr_slope(ret, ar) s, sum(ar) sx, sum(ar * ar) sxx from b),
r as (select permno, yq, ar x, ret - a - s * ar e from b, f),
k as (select 1 sg, permno g1, null g2, sum(e) s0, sum(e * x) s1 from r group by permno union all select 1, null, yq, sum(e), sum(e * x) from r group by yq
 union all select -1, permno, yq, sum(e), sum(e * x) from r group by permno, yq),
m as (select sum(sg * s0 * s0) m00, sum(sg * s0 * s1) m01, sum(sg * s1 * s1) m11 from k)
select n, round(s, 8) slope, round(sqrt((sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / ((n * sxx - sx * sx) * (n * sxx - sx * sx))), 8) slope_se from f, m"""


def zscores(spark: SparkSession, folder: str) -> DataFrame:
    return zscore(read_table(spark, folder, "events"), "value").select("event_id", F.round("z", 8).alias("z"))


ZSCORE_SQL = "select event_id, round((value - avg(value) over ()) / stddev_samp(value) over (), 8) z from events"


def transcript_profile(spark: SparkSession, folder: str) -> DataFrame:
    p = profile(read_table(spark, folder, "transcripts"), "event_id", "call_date", ["n_words_pres", "n_words_qa"], ["presentation_text", "qa_text"])
    return p.withColumns({c: F.date_format(c, "yyyy-MM-dd") for c in ("first_day", "last_day")} | {c: F.round(c, 8) for c in p.columns if c.startswith(("filled", "n_words"))})


PROFILE_SQL = """select count(*) n, count(distinct event_id) distinct_event_id, strftime(min(call_date), '%Y-%m-%d') first_day, strftime(max(call_date), '%Y-%m-%d') last_day,
 count(*) - count(call_date) null_call_date, count(*) - count(n_words_pres) null_n_words_pres, count(*) - count(n_words_qa) null_n_words_qa,
 count(*) - count(presentation_text) null_presentation_text, count(*) - count(qa_text) null_qa_text,
 round(avg(case when coalesce(len(presentation_text), 0) > 0 then 1.0 else 0.0 end), 8) filled_presentation_text, round(avg(case when coalesce(len(qa_text), 0) > 0 then 1.0 else 0.0 end), 8) filled_qa_text,
 round(quantile_cont(n_words_pres, 0.5), 8) n_words_pres_p5, round(quantile_cont(n_words_pres, 0.995), 8) n_words_pres_p995,
 round(quantile_cont(n_words_qa, 0.5), 8) n_words_qa_p5, round(quantile_cont(n_words_qa, 0.995), 8) n_words_qa_p995 from transcripts"""


def year_index(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "transcripts").where("call_date is not null").select("event_id", F.year("call_date").cast("string").alias("year")).distinct()


YEAR_SQL = "select distinct event_id, cast(year(call_date) as varchar) \"year\" from transcripts where call_date is not null"


def year_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "transcripts").groupBy(F.year("call_date").cast("double").alias("year")).count().withColumnRenamed("count", "n")


YEAR_COUNTS_SQL = 'select year(call_date)::double "year", count(*) n from transcripts group by 1'


def semi_join(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the firms that have events."""
    names = read_table(spark, folder, "crsp_msenames").select("permno", day_text("namedt").alias("namedt"), "ticker").distinct()
    return names.join(read_table(spark, folder, RETURNS), "permno", "left_semi")


def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """Names of the firms that have no link of type LU to accounts."""
    names = read_table(spark, folder, "crsp_msenames").select("permno", day_text("namedt").alias("namedt"), "ticker").distinct()
    return names.join(read_table(spark, folder, "crsp_ccmxpf_linktable").where("linktype = 'LU'").select(F.col("lpermno").alias("permno")), "permno", "left_anti")


def union_distinct(spark: SparkSession, folder: str) -> DataFrame:
    events = quarter_events(spark, folder).select("permno")
    return events.union(read_table(spark, folder, "crsp_ccmxpf_linktable").select("lpermno")).distinct()


_NAMES = "select distinct permno, strftime(namedt, '%Y-%m-%d') namedt, ticker from crsp_msenames"
SEMI_SQL = _NAMES + " where permno in (select permno from abnormal_returns)"
ANTI_SQL = _NAMES + " n where not exists (select 1 from crsp_ccmxpf_linktable l where l.lpermno = n.permno and l.linktype = 'LU')"
UNION_SQL = f"with {_QEV} select permno from ev union select lpermno from crsp_ccmxpf_linktable"


def pit_model_assign(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, RETURNS).select("event_id", day_text("event_date").alias("event_date"), model_year(F.col("event_date")).cast("double").alias("model_year"))


PIT_SQL = "select event_id, strftime(event_date, '%Y-%m-%d') event_date, case when year(event_date) > 2013 then least(year(event_date) - 1, 2024) end::double model_year from abnormal_returns"


def embedding_dims(spark: SparkSession, folder: str) -> DataFrame:
    return dimension_stats(read_table(spark, folder, "embeddings"), "embedding").select("dim", *[F.round(c, 7).alias(c) for c in ("max_abs", "mean", "sd")])


def embedding_diag(spark: SparkSession, folder: str) -> DataFrame:
    d = diagnostics(read_table(spark, folder, "embeddings"), "embedding")
    return d.select("n", "dims_over_10", "dims_over_100", "max_dim", *[F.round(c, 7).alias(c) for c in ("max_abs", "mean", "sd", "mean_norm")])


def mean_pool(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors as tokens of a document per (label, period), every fifth masked."""
    e = read_table(spark, folder, "embeddings").withColumn("period", F.col("vec_id") % 12)
    return mean_pooled(e, ["label", "period"], "embedding", (F.col("vec_id") % 5 != 0)).withColumn("x", F.round("x", 7))


_CELLS = "c as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 dim from embeddings)"
DIMS_SQL = f"with {_CELLS} select dim, round(max(abs(x)), 7) max_abs, round(avg(x), 7) mean, round(stddev_pop(x), 7) sd from c group by 1"
DIAG_SQL = f"""with {_CELLS}, d as (select dim, max(abs(x)) m from c group by 1), v as (select vec_id, sqrt(sum(x * x)) nm from c group by 1)
select (select count(*) from embeddings) n, count(*) filter (m > 10) dims_over_10, count(*) filter (m > 100) dims_over_100, (select dim from d order by m desc, dim limit 1) max_dim,
 round(max(m), 7) max_abs, (select round(avg(x), 7) from c) mean, (select round(stddev_pop(x), 7) from c) sd, (select round(avg(nm), 7) from v) mean_norm from d"""
POOL_SQL = f"""with {_CELLS} select label, vec_id % 12 period, dim, round(sum(case when vec_id % 5 <> 0 then x else 0 end) / greatest(sum(case when vec_id % 5 <> 0 then 1 else 0 end), 1e-9), 7) x from c group by 1, 2, 3"""

QUERIES = {
    "identifiers_clean": identifiers_clean, "version_dedup": dedup_versions, "interval_link_priority": interval_link_priority, "link_length_filter": link_length_filter,
    "open_interval_link": open_interval_link, "sue_lag4": sue_lag4, "nearest_report": nearest_report_any, "quintile_within": quintile_in_quarter,
    "rolling_window_members": rolling_window_members, "quintile_train_cutoff": quintile_train_cutoff, "quintile_prior_scores": quintile_prior_scores,
    "hfl_category_window": hfl_category_window, "quintile_spread": quintile_spreads, "quintile_means": quintile_means, "quarter_summary": quarterly_summary,
    "pooled_ols": pooled_regression, "demeaned_ols": demeaned_regression, "iterative_demean": iterative_demean, "cluster_se": cluster_errors, "zscore": zscores,
    "profile": transcript_profile, "year_index": year_index, "year_counts": year_counts, "semi_join": semi_join, "anti_join": anti_join, "union_distinct": union_distinct,
    "pit_model_assign": pit_model_assign, "embedding_dims": embedding_dims, "embedding_diag": embedding_diag, "mean_pool": mean_pool,
}
ORACLES = {
    "identifiers_clean": IDENTIFIERS_SQL, "version_dedup": DEDUP_SQL, "interval_link_priority": LINK_SQL, "link_length_filter": LENGTH_SQL,
    "open_interval_link": OPEN_LINK_SQL, "sue_lag4": SUE_SQL, "nearest_report": NEAREST_SQL, "quintile_within": QUINTILE_SQL,
    "rolling_window_members": MEMBERS_SQL, "quintile_train_cutoff": CUTOFF_SQL, "quintile_prior_scores": PRIOR_SQL, "hfl_category_window": HFL_WINDOW_SQL,
    "quintile_spread": SPREAD_SQL, "quintile_means": MEANS_SQL, "quarter_summary": SUMMARY_SQL, "pooled_ols": POOLED_SQL, "demeaned_ols": DEMEANED_SQL,
    "iterative_demean": ITERATIVE_SQL, "cluster_se": CLUSTER_SQL, "zscore": ZSCORE_SQL, "profile": PROFILE_SQL, "year_index": YEAR_SQL, "year_counts": YEAR_COUNTS_SQL,
    "semi_join": SEMI_SQL, "anti_join": ANTI_SQL, "union_distinct": UNION_SQL, "pit_model_assign": PIT_SQL, "embedding_dims": DIMS_SQL, "embedding_diag": DIAG_SQL, "mean_pool": POOL_SQL,
}
