"""Exact quantiles, bins and categories, within groups, over training windows and globally."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Inner quintile probabilities as a linspace from 0 to 1 gives them.
QUINTILE_EDGES = (0.2, 0.4, 0.6000000000000001, 0.8)


def year_quarter(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("Q"), F.quarter(day).cast("string"))


def quarter_number(day: Column) -> Column:
    return F.year(day) * 4 + F.quarter(day)


def _alike(left: DataFrame, own: DataFrame, group: Sequence[str], how: str) -> DataFrame:
    """left joined to one row per group; null groups match each other."""
    if not group:
        return left.join(F.broadcast(own))  # own is one row
    own = own.withColumnsRenamed({g: f"__g_{g}" for g in group})
    same = F.lit(True)
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"__g_{g}"))
    return left.join(own, same, how).drop(*[f"__g_{g}" for g in group])


def with_group_stats(df: DataFrame, group: Sequence[str], **stats: Column) -> DataFrame:
    """df plus statistics of its group. They are aggregated before they are joined back, so a large
    group is combined on the map side instead of being gathered in one window."""
    return _alike(df, df.groupBy(*group).agg(*[c.alias(n) for n, c in stats.items()]), group, "inner")


def exact_quantiles(df: DataFrame, group: Sequence[str], x: str | Column, probs: Sequence[float], into: str = "quantiles", accuracy: int = 10_000) -> DataFrame:
    """group, into: the exact quantiles of x, linearly interpolated, as an array; no row for groups
    without a value.

    The built-in exact percentile holds all of a group's distinct values in one task. Here a sketch
    brackets each quantile, and only the values within the brackets, about 4 in `accuracy` of a
    group's, are sorted; those below are counted on the way. So groups may be of any size.
    """
    value = F.col(x) if isinstance(x, str) else x
    base = df.select(*group, value.cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    slack = 3 / accuracy
    probes = [min(1.0, max(0.0, p + d)) for p in probs for d in (-slack, slack)]
    sketch = base.groupBy(*group).agg(F.count("*").alias("__n"), F.percentile_approx("__x", probes, accuracy).alias("__b"))
    # in a small group the neighbours of a quantile may lie farther than the slack: all of it is sorted
    everything = F.array(*[F.lit(float("-inf")), F.lit(float("inf"))] * len(probs))
    sketch = sketch.withColumn("__b", F.when(F.col("__n") <= accuracy, everything).otherwise(F.col("__b")))
    bracketed = _alike(base, sketch, group, "inner")
    v, b, i, n, seen = F.col("__x"), F.col("__b"), F.col("__i"), F.col("__n"), F.col("__seen")
    told = F.array(*[F.when(v <= b[2 * k + 1], F.struct(F.lit(k).alias("__i"), F.when(v >= b[2 * k], v).alias("__v"))) for k in range(len(probs))])
    counts = bracketed.select(*group, "__n", F.inline(F.filter(told, lambda t: t.isNotNull())))
    counts = counts.groupBy(*group, "__n", "__i", "__v").agg(F.count("*").alias("__c"))
    ranked = counts.withColumn("__seen", F.sum("__c").over(Window.partitionBy(*group, "__i").orderBy(F.col("__v").asc_nulls_first())))
    at = (n - 1) * F.array(*map(F.lit, probs))[i]
    lower = F.min(F.when(seen - 1 >= F.floor(at), F.col("__v")))
    upper = F.min(F.when(seen - 1 >= F.ceil(at), F.col("__v")))
    share = F.max(at - F.floor(at))
    each = ranked.groupBy(*group, "__i").agg(((1 - share) * lower + share * upper).alias("__q"))
    return each.groupBy(*group).agg(F.array(*[F.max(F.when(i == k, F.col("__q"))) for k in range(len(probs))]).alias(into))


def with_quantiles(df: DataFrame, group: Sequence[str], x: str | Column, probs: Sequence[float], into: str = "quantiles") -> DataFrame:
    """df plus the exact quantiles of its group; null for groups without a value."""
    own = exact_quantiles(df, group, x, probs, into)
    if not group:  # one row even if there is no value at all
        own = own.agg(F.first(into).alias(into))
    return _alike(df, own, group, "left")


def quintile_within(df: DataFrame, group: str, x: str, into: str = "quintile") -> DataFrame:
    """Right-closed quintile bins by linearly interpolated edges of the group; edges that coincide
    make one bin fewer; null for null."""
    df = with_quantiles(with_group_stats(df, [group], __least=F.min(x)), [group], x, QUINTILE_EDGES, "__edges")
    v = F.col(x)
    below = F.filter(F.array_distinct("__edges"), lambda e: (e < v) & (e != F.col("__least")))
    return df.withColumn(into, F.when(v.isNotNull(), F.size(below) + 1)).drop("__edges", "__least")


def bin_by_cutoffs(x: Column, cutoffs: Column) -> Column:
    """1 + the number of cutoffs less than x."""
    return F.when(x.isNotNull(), F.size(F.filter(cutoffs, lambda c: c < x)) + 1)


def rolling_members(df: DataFrame, quarter: str, length: int = 8) -> DataFrame:
    """test_quarter, train_quarter: every observed quarter with the `length` observed quarters before
    it; quarters with fewer are left out. quarter is a number that orders. A table of quarters."""
    seen = df.select(F.col(quarter).alias("q")).where("q is not null").distinct()
    # one row per quarter: a single small task
    ranked = seen.withColumn("r", F.row_number().over(Window.orderBy("q")))
    test = ranked.select(F.col("q").alias("test_quarter"), F.explode(F.sequence(F.col("r") - length, F.col("r") - 1)).alias("r")).where("r > 0")
    members = test.join(ranked.withColumnRenamed("q", "train_quarter"), "r").drop("r")
    full = members.groupBy("test_quarter").count().where(F.col("count") == length).select("test_quarter")
    return members.join(full, "test_quarter", "left_semi")


def hfl(x: Column, cutoff: Column) -> Column:
    """H above the cutoff, L below its negative, else F; null counts as F."""
    return F.when(x > cutoff, "H").when(x < -cutoff, "L").otherwise("F")


def zscore(df: DataFrame, x: str, into: str = "z") -> DataFrame:
    stats = df.agg(F.avg(x).alias("__m"), F.stddev_samp(x).alias("__s"))
    return df.join(F.broadcast(stats)).withColumn(into, (F.col(x) - F.col("__m")) / F.col("__s")).drop("__m", "__s")  # stats is one row
