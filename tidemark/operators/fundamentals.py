"""Quarterly accounts: surprises and the report nearest to an event."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.links import first_by


def standard_quarters(accounts: DataFrame) -> DataFrame:
    """Standard rows, one per (gvkey, fyearq, fqtr): the last announced, ties by the last datadate and figures."""
    kept = accounts.where("indfmt = 'INDL' and datafmt = 'STD' and popsrc = 'D' and consol = 'C'")
    return first_by(kept, ["gvkey", "fyearq", "fqtr"], [F.col("rdq").desc_nulls_last(), F.desc("datadate"), F.desc("epspxq"), F.desc("ibq")])


def surprises(quarters: DataFrame, value: str, lag: int = 4) -> DataFrame:
    """quarters plus sue: value minus the value `lag` rows earlier of the firm, by announcement day
    (nulls last). A firm's quarters are few."""
    by = Window.partitionBy("gvkey").orderBy(F.col("rdq").asc_nulls_last(), "fyearq", "fqtr")
    return quarters.withColumn("sue", F.col(value) - F.lag(value, lag).over(by))


def nearest_report(events: DataFrame, event_id: str, key: str, at: str, quarters: DataFrame) -> DataFrame:
    """Every event with the quarter announced nearest to it, before or after, without tolerance; null
    if its firm announced none. Requests are reduced to distinct (firm, day) first."""
    asked = events.select(F.col(key).alias("__k"), F.to_date(at).alias("__t")).where("__k is not null and __t is not null").distinct()
    told = quarters.where("rdq is not null").groupBy(F.col("gvkey").alias("__k"), F.to_date("rdq").alias("__t"))
    told = told.agg(F.min(F.struct("fyearq", "fqtr")).alias("__q")).select("__k", "__t", F.struct(F.col("__t").alias("rdq"), "__q.fyearq", "__q.fqtr").alias("__q"))
    both = told.unionByName(asked, allowMissingColumns=True)
    # the last announced on or before the day, and the first after it
    w = Window.partitionBy("__k").orderBy("__t", F.col("__q").isNull())
    sides = [F.last("__q", True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.first("__q", True).over(w.rowsBetween(0, Window.unboundedFollowing))]
    both = both.withColumns({f"__s{i}": side for i, side in enumerate(sides)}).where("__q is null")
    one = lambda s: F.when(F.col(s).isNotNull(), F.struct(F.abs(F.datediff(F.col(f"{s}.rdq"), "__t")).alias("days"), f"{s}.*"))
    nearest = both.select("__k", "__t", F.least(one("__s0"), one("__s1")).alias("report")).where("report is not null")
    same = F.col(key).eqNullSafe(F.col("__k")) & F.to_date(at).eqNullSafe(F.col("__t"))
    return events.join(nearest, same, "left").drop("__k", "__t")
