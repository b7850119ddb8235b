"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.containers import fill_containers, token_sizes
from tidemark.llm.leaks import leaked_items
from tidemark.llm.linkage import link_entities
from tidemark.llm.nearest import nearest_in_time
from tidemark.llm.reading import reading_bands
from tidemark.llm.survivors import skyline_survivors
from tidemark.llm.terms import mark_terms, term_counts
from tidemark.llm.turns import speaker_turns
from tidemark.operators.asknown import as_known
from tidemark.plans.known import STAMPS_SQL, link_history, stamped_transcripts
from tidemark.sources import read_table


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    events = read_table(spark, folder, "abnormal_returns").select("event_id", "permno", "call_date", "event_date")
    linked = as_known(events, "permno", "call_date", {"link": link_history(spark, folder)}).withColumn("gvkey", F.col("link.gvkey"))
    quarters = (
        read_table(spark, folder, "comp_fundq")
        .where("indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C'")
        .withColumn("gvkey", F.trim("gvkey").try_cast("bigint"))
    )
    days = lambda c: F.unix_date(F.to_date(c))
    near = nearest_in_time(linked, quarters, ("gvkey", "gvkey"), (days("event_date"), days("rdq")), ["fyearq", "fqtr"], 7)
    return (
        near.where("nearest is not null")
        .select("event_id", "gvkey", *[F.col(f"nearest.{c}").cast("bigint").alias(c) for c in ("fyearq", "fqtr")])
        .distinct()
    )


P2_SQL = """
with ev as (select distinct event_id, permno, cast(call_date as date) d, cast(event_date as date) e from abnormal_returns where call_date is not null),
lk as (select e.event_id, e.e, max_by(cast(trim(l.gvkey) as bigint), l.linkdt) gvkey from ev e join crsp_ccmxpf_linktable l on l.lpermno = e.permno
       and (l.linkdt is null or l.linkdt <= e.d) and (l.linkenddt is null or l.linkenddt >= e.d)
       where l.linktype in ('LU', 'LC') and l.linkprim in ('P', 'C') group by 1, 2),
q as (select cast(trim(gvkey) as bigint) gvkey, cast(rdq as date) rdq, fyearq, fqtr from comp_fundq
      where indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C' and rdq is not null)
select distinct event_id, gvkey, cast(fyearq as bigint) fyearq, cast(fqtr as bigint) fqtr from (
  select lk.event_id, lk.gvkey, q.fyearq, q.fqtr,
         row_number() over (partition by lk.event_id order by abs(date_diff('day', q.rdq, lk.e)), q.rdq, q.fyearq, q.fqtr) r
  from lk join q on q.gvkey = lk.gvkey and abs(date_diff('day', q.rdq, lk.e)) <= 7) where r = 1
"""


def _call_text() -> Column:
    return F.concat_ws("\n", "presentation_text", "qa_text")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts").select("presentation_text", "qa_text")
    return mark_terms(term_counts(calls, _call_text()), calls).where("mark is not null").select("term", "mark")


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts").select("presentation_text", "qa_text")
    return term_counts(calls, _call_text()).select("term", "occurrences", "records")


_TERMS_SQL = """
with r as (select row_number() over () id, lower(concat_ws(chr(10), presentation_text, qa_text)) t from transcripts),
w as (select id, unnest(regexp_extract_all(t, '\\p{L}+')) term from r),
c as (select term, count(*) occurrences, count(distinct id) records from w group by 1)
"""
P3_COUNTS_SQL = _TERMS_SQL + "select term, occurrences, records from c"
P3_SQL = _TERMS_SQL + """
select term, case when records < 5 then 'rare' else 'common' end mark from c
where records < 5 or records > 0.5 * (select count(*) from transcripts)
"""


def company_key() -> Column:
    return F.regexp_replace("company_id", r"(?U)\s+", "").try_cast("bigint")


def _identifier(name: str) -> Column:
    value = F.regexp_replace(name, r"(?U)^\s+|\s+$", "")
    return F.when(~value.isin("", "N/A"), value)


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    calls = stamped_transcripts(spark, folder, ["event_id", "company_id", "ticker", "cusip", "story_version", "last_update"])
    calls = calls.where("utc is not null").select(
        company_key().alias("company_key"),
        F.date_format("utc", "yyyy-MM-dd HH:mm:ss").alias("start_utc"),
        "event_id",
        _identifier("ticker").alias("ticker"),
        _identifier("cusip").alias("cusip"),
        (F.lower(F.trim("story_version")) == "final").alias("final"),
        F.unix_timestamp(F.try_to_timestamp(F.trim("last_update"))).alias("updated"),
    )
    survivors = skyline_survivors(
        calls.where("company_key is not null"), ["company_key", "start_utc"], "event_id", ["ticker", "cusip"], F.col("final"), F.col("updated")
    )
    return survivors.where("n_records >= 2").select(
        "company_key", "start_utc", "event_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("ticker", "cusip")]
    )


P5_SQL = f"""with {STAMPS_SQL},
g as (select try_cast(regexp_replace(company_id, '\\s+', '', 'g') as bigint) company_key, strftime(u, '%Y-%m-%d %H:%M:%S') start_utc, event_id,
 nullif(nullif(trim(ticker), ''), 'N/A') ticker, nullif(nullif(trim(cusip), ''), 'N/A') cusip, coalesce(lower(trim(story_version)) = 'final', false) final, nullif(trim(last_update), '') updated from su where u is not null),
d as (select *, dense_rank() over (partition by company_key, start_utc order by final desc, updated desc nulls last, event_id) r from g where company_key is not null)
select company_key, start_utc, min_by(event_id, r) event_id, coalesce(min_by(ticker, (r, ticker)) filter (ticker is not null), '') ticker, coalesce(min_by(cusip, (r, cusip)) filter (cusip is not null), '') cusip
from d group by 1, 2 having count(*) >= 2"""


def p6_matches(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, permno, confidence. Every description, that is, the four attributes as they stand, is
    matched by itself; an event takes the surest match of its descriptions."""
    calls = read_table(spark, folder, "transcripts").select("event_id", "cusip", "ticker", "isin", "company_name").where("event_id is not null")
    told = ["cusip", "ticker", "isin", "company_name"]
    calls = calls.withColumn("unit", F.unhex(F.md5(F.to_json(F.struct(*told))))).distinct()
    names = read_table(spark, folder, "crsp_msenames").select(F.col("permno").alias("entity"), "ncusip", "ticker", "comnam")
    links = link_entities(calls.select("unit", *told).distinct(), names)
    surest = F.max_by(F.struct("entity", "confidence"), F.struct("confidence", -F.col("entity"))).alias("m")
    matched = calls.select("event_id", "unit").join(links, "unit").groupBy("event_id").agg(surest)
    return matched.select("event_id", F.col("m.entity").cast("bigint").alias("permno"), F.col("m.confidence").alias("confidence"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_matches(spark, folder).select("event_id", "permno")


def call_turns(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts").select("event_id", "presentation_text", "qa_text")
    return speaker_turns(calls, "event_id", {"presentation": "presentation_text", "qa": "qa_text"})


def p7_turns(spark: SparkSession, folder: str) -> DataFrame:
    return call_turns(spark, folder).withColumns({c: F.round(c, 3) for c in ("start_s", "end_s")})


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The same turns without their intervals and words."""
    return p7_turns(spark, folder).select("event_id", "section", "turn_no", "speaker", "n_words")


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    sizes = token_sizes(read_table(spark, folder, "documents"), "doc_id", "text")
    return fill_containers(sizes, 2048).withColumnRenamed("id", "doc_id")


def p9_leaks(spark: SparkSession, folder: str) -> DataFrame:
    found = leaked_items(
        read_table(spark, folder, "documents"), read_table(spark, folder, "eval_items"), ("doc_id", "text"), ("item_id", "passage")
    )
    return found.withColumnsRenamed({"doc": "doc_id", "item": "item_id"})


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_leaks(spark, folder).select("doc_id", "item_id")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    bands = reading_bands(read_table(spark, folder, "documents"), read_table(spark, folder, "reading_labels"), language="lang")
    return bands.select(F.col("id").alias("doc_id"), F.col("band").cast("bigint").alias("band"))


QUERIES = {"p2_found": p2_found, "p3_found": p3_found, "p3_counts": p3_counts, "p5_found": p5_found, "p6_found": p6_found, "p6_matches": p6_matches, "p7_found": p7_found, "p7_turns": p7_turns, "p8_containers": p8_containers, "p9_found": p9_found, "p9_leaks": p9_leaks, "p10_found": p10_found}
ORACLES = {"p2_found": P2_SQL, "p3_found": P3_SQL, "p3_counts": P3_COUNTS_SQL, "p5_found": P5_SQL}
