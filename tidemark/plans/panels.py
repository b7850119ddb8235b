"""Panels of events with their cumulative returns, and portfolios from the accounts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import portfolios
from tidemark.operators.fundamentals import standard_quarters
from tidemark.operators.links import first_by, valid_on
from tidemark.operators.panel import clustered_ols, iteratively_demeaned, quintile_spread
from tidemark.operators.quantiles import quintile_within, year_quarter
from tidemark.plans import reports, study
from tidemark.sources import read_table, stored

REPORTED = tuple(f"car_{h}d" for h in study.HORIZONS if h >= 63)


def binned_cars(spark: SparkSession, folder: str) -> DataFrame:
    """Events with the quintile of their abnormal return within the quarter, and their forward returns."""
    events = study.ar_one_factor(spark, folder).join(study.order_events(spark, folder).select("event_id", "call_date"), "event_id")
    events = stored(events.withColumn("yq", year_quarter(F.col("call_date"))))
    return quintile_within(events, "yq", "ar").join(study.car_summed(spark, folder).drop("permno"), "event_id", "left")


def car_spreads(spark: SparkSession, folder: str) -> DataFrame:
    spread = quintile_spread(binned_cars(spark, folder), "quintile", REPORTED)
    return spread.select("horizon", F.round("spread", 7).alias("spread"))


def car_quintiles(spark: SparkSession, folder: str) -> DataFrame:
    """Each quintile's mean forward return over 63 rows, and the number of events that have one."""
    binned = binned_cars(spark, folder).where("quintile is not null").groupBy(F.col("quintile").cast("double").alias("quintile"))
    return binned.agg(F.count("car_63d").alias("n"), F.round(F.avg("car_63d"), 7).alias("mean_car"))


_BINNED = f"""with a as ({study.ORACLES["ar_one_factor"]}), c as ({study.CAR_SQL}), e as (select a.*, year(o_orderdate) || 'Q' || quarter(o_orderdate) yq from a join orders on o_orderkey = event_id),
g as (select yq, list_distinct(quantile_cont(ar, [0.2, 0.4, 0.6000000000000001, 0.8])) edges, min(ar) lo from e group by 1),
b as (select e.*, c.* exclude (event_id, permno), case when ar is not null then 1 + len(list_filter(edges, lambda x: x < ar and x <> lo)) end quintile from e join g using (yq) left join c using (event_id))"""
SPREADS_SQL = _BINNED + f""", s as (select {', '.join(f"avg({h}) filter (quintile = 5) - avg({h}) filter (quintile = 1) {h}" for h in REPORTED)} from b)
select horizon, round(spread, 7) spread from (unpivot s on {', '.join(REPORTED)} into name horizon value spread)"""
QUINTILES_SQL = _BINNED + " select quintile::double quintile, count(car_63d) n, round(avg(car_63d), 7) mean_car from b where quintile is not null group by 1"


def demeaned_cluster_se(spark: SparkSession, folder: str) -> DataFrame:
    """Firm and quarter means taken out until nothing moves; errors clustered by firm and quarter."""
    panel = reports.quarter_events(spark, folder).where("ar is not null and ret is not null").select("permno", "yq", "ar", "ret")
    fit = clustered_ols(iteratively_demeaned(stored(panel), ["permno", "yq"], ["ar", "ret"]), "ret", "ar", ["permno", "yq"])
    return fit.select("n", F.round("slope", 7).alias("slope"), F.round("slope_se", 7).alias("slope_se"))


PASSES = 30
DEMEANED_CLUSTER_SQL = reports._demean_sql(PASSES) + f""", b as (select permno, yq, ar, ret from d{2 * PASSES}), f as (select count(*) n, regr_intercept(ret, ar) a, regr_slope(ret, ar) s, sum(ar) sx, sum(ar * ar) sxx from b),
r as (select permno, yq, ar x, ret - a - s * ar e from b, f),
k as (select 1 sg, permno g1, null g2, sum(e) s0, sum(e * x) s1 from r group by permno union all select 1, null, yq, sum(e), sum(e * x) from r group by yq
 union all select -1, permno, yq, sum(e), sum(e * x) from r group by permno, yq),
m as (select sum(sg * s0 * s0) m00, sum(sg * s0 * s1) m01, sum(sg * s1 * s1) m11 from k)
select n, round(s, 7) slope, round(sqrt((sx * sx * m00 - 2 * sx * n * m01 + n * n * m11) / ((n * sxx - sx * sx) * (n * sxx - sx * sx))), 7) slope_se from f, m"""


def account_years(spark: SparkSession, folder: str) -> DataFrame:
    """permno, year, me, be, bm, nyse: the market value at the firm's last accounts of the year, and the book
    equity of the fourth quarter of the fiscal year before. A firm that was ever listed there counts as nyse."""
    accounts = standard_quarters(read_table(spark, folder, "comp_fundq").withColumn("gvkey", F.trim("gvkey").try_cast("bigint")))
    links = read_table(spark, folder, "crsp_ccmxpf_linktable").where(F.col("linktype").isin("LU", "LC") & F.col("linkprim").isin("P", "C"))
    links = links.select(F.trim("gvkey").try_cast("bigint").alias("gvkey"), F.col("lpermno").alias("permno"), "linkdt", "linkenddt").distinct()
    linked = accounts.join(links, "gvkey").where(valid_on(F.col("datadate"), F.col("linkdt"), F.col("linkenddt")))
    linked = stored(first_by(linked, ["gvkey", "fyearq", "fqtr"], [F.desc("linkdt"), "permno"]))
    year = F.year("datadate")
    me = first_by(linked.where("mkvaltq > 0").withColumn("year", year), ["permno", "year"], [F.desc("datadate"), "gvkey", "fyearq", "fqtr"])
    be = linked.where("fqtr = 4 and ceqq is not null").withColumn("year", F.col("fyearq") + 1)
    be = first_by(be, ["permno", "year"], [F.desc("datadate"), "gvkey"]).select("permno", "year", F.col("ceqq").alias("be"))
    nyse = read_table(spark, folder, "crsp_msenames").groupBy("permno").agg(F.max(F.coalesce(F.col("exchcd") == 1, F.lit(False))).alias("nyse"))
    both = me.select("permno", "year", F.col("mkvaltq").alias("me")).join(be, ["permno", "year"], "left").join(nyse, "permno", "left")
    return both.withColumns({"bm": F.col("be") / F.col("me"), "nyse": F.coalesce("nyse", F.lit(False))})


def account_portfolios(spark: SparkSession, folder: str) -> DataFrame:
    return portfolios.assigned(account_years(spark, folder)).select("permno", F.col("year").cast("bigint").alias("year"), "portfolio")


ACCOUNTS_SQL = f"""with {reports._QUARTERS_SQL}, lk as (select distinct cast(trim(gvkey) as bigint) g, lpermno permno, linkdt, coalesce(linkenddt, date '2099-12-31') e from crsp_ccmxpf_linktable
 where linktype in ('LU', 'LC') and linkprim in ('P', 'C')),
l as (select * from (select q.* exclude (r), lk.permno, row_number() over (partition by q.g, fyearq, fqtr order by linkdt desc, permno) rr from q join lk on lk.g = q.g and datadate between linkdt and e) where rr = 1),
me as (select * from (select permno, year(datadate) y, mkvaltq me, row_number() over (partition by permno, year(datadate) order by datadate desc, g, fyearq, fqtr) n from l where mkvaltq > 0) where n = 1),
be as (select * from (select permno, fyearq + 1 y, ceqq be, row_number() over (partition by permno, fyearq order by datadate desc, g) n from l where fqtr = 4 and ceqq is not null) where n = 1),
ny as (select permno, bool_or(coalesce(exchcd = 1, false)) nyse from crsp_msenames group by 1),
fy as (select me.permno, me.y "year", me.me, be.be / me.me bm, coalesce(nyse, false) nyse from me left join be using (permno, y) left join ny using (permno)),
bp as (select "year", case when count(*) filter (nyse) < 10 then quantile_cont(me, 0.5) else quantile_cont(me, 0.5) filter (nyse) end m,
 case when count(*) filter (nyse) < 10 then quantile_cont(bm, 0.3) else quantile_cont(bm, 0.3) filter (nyse) end b3, case when count(*) filter (nyse) < 10 then quantile_cont(bm, 0.7) else quantile_cont(bm, 0.7) filter (nyse) end b7
 from fy where bm > 0 group by 1)
select permno, "year"::bigint "year", (case when me <= m then 'sm' else 'bi' end) || (case when bm <= b3 then 'lo' when bm <= b7 then 'me' else 'hi' end) portfolio from fy join bp using ("year") where bm > 0"""

QUERIES = {
    "car_spreads": car_spreads, "car_quintiles": car_quintiles, "demeaned_cluster_se": demeaned_cluster_se, "account_portfolios": account_portfolios,
}
ORACLES = {
    "car_spreads": SPREADS_SQL, "car_quintiles": QUINTILES_SQL, "demeaned_cluster_se": DEMEANED_CLUSTER_SQL, "account_portfolios": ACCOUNTS_SQL,
}
