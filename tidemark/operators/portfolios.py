"""Size and value portfolios: yearly breakpoints, assignment, and lookup with fallback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import exact_quantiles, with_group_stats
from tidemark.sources import stored

#: Small or big by low, medium or high book-to-market.
CODES = ("smlo", "smme", "smhi", "bilo", "bime", "bihi")
DEFAULT = "smme"


def breakpoints(firm_years: DataFrame, least: int = 10) -> DataFrame:
    """year, me_median, bm_30, bm_70: of exchange-listed (nyse) firms, or of all if fewer than `least`."""
    counted = with_group_stats(firm_years, ["year"], __n=F.count_if("nyse")).where((F.col("__n") < least) | F.col("nyse"))
    size, value = exact_quantiles(counted, ["year"], "me", [0.5], "__me"), exact_quantiles(counted, ["year"], "bm", [0.3, 0.7], "__bm")
    both = size.join(value, "year", "full")
    return both.select("year", F.get("__me", F.lit(0)).alias("me_median"), F.get("__bm", F.lit(0)).alias("bm_30"), F.get("__bm", F.lit(1)).alias("bm_70"))


def assigned(firm_years: DataFrame, least: int = 10) -> DataFrame:
    """permno, year, portfolio of firm-years with a positive bm. Years are few: their breakpoints are broadcast."""
    kept = stored(firm_years.where("bm > 0 and me is not null"))
    size = F.when(F.col("me") <= F.col("me_median"), "sm").otherwise("bi")
    value = F.when(F.col("bm") <= F.col("bm_30"), "lo").when(F.col("bm") <= F.col("bm_70"), "me").otherwise("hi")
    return kept.join(breakpoints(kept, least), "year").select("permno", "year", F.concat(size, value).alias("portfolio"))


def assign_year(day: Column) -> Column:
    """Portfolios are formed in July."""
    return F.when(F.month(day) >= 7, F.year(day)).otherwise(F.year(day) - 1)


def portfolio_of(events: DataFrame, assignments: DataFrame, year: str) -> DataFrame:
    """events plus portfolio: of the year, else of the year before, else the default code."""
    for i, back in enumerate((0, 1)):
        own = assignments.select(F.col("permno").alias("__p"), (F.col("year") + back).alias("__y"), F.col("portfolio").alias(f"__a{i}"))
        events = events.join(own, (F.col("permno") == F.col("__p")) & (F.col(year) == F.col("__y")), "left").drop("__p", "__y")
    return events.withColumn("portfolio", F.coalesce("__a0", "__a1", F.lit(DEFAULT))).drop("__a0", "__a1")


def benchmark(portfolio: Column) -> Column:
    """The return column of a portfolio code, of an unknown one that of the default."""
    chosen = F.col(DEFAULT)
    for code in CODES:
        chosen = F.when(portfolio == code, F.col(code)).otherwise(chosen)
    return chosen
