"""Spreads and regressions over panels of events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.quantiles import with_group_stats
from tidemark.sources import stored


def quintile_spread(df: DataFrame, quintile: str, horizons: Sequence[str]) -> DataFrame:
    """horizon, spread: mean of the fifth quintile minus mean of the first."""
    q = F.col(quintile)
    means = df.agg(*[(F.avg(F.when(q == 5, F.col(h))) - F.avg(F.when(q == 1, F.col(h)))).alias(h) for h in horizons])
    return means.unpivot([], list(horizons), "horizon", "spread")


def pooled_ols(df: DataFrame, y: str, x: str) -> DataFrame:
    """One row: n, intercept, slope, slope_se, t, r2 of y on x with homoskedastic errors."""
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    a = both.agg(
        F.count("*").alias("n"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_slope(y, x).alias("slope"),
        F.regr_sxx(y, x).alias("sxx"),
        F.regr_syy(y, x).alias("syy"),
        F.regr_r2(y, x).alias("r2"),
    )
    se = F.sqrt(F.col("syy") * (1 - F.col("r2")) / (F.col("n") - 2) / F.col("sxx"))
    return a.withColumn("slope_se", se).withColumn("t", F.col("slope") / F.col("slope_se")).drop("sxx", "syy")


def demeaned(df: DataFrame, groups: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Group means taken out, one group after the other; columns of the same names."""
    for group in groups:
        df = with_group_stats(df, [group], **{f"__m_{c}": F.avg(c) for c in columns})
        df = df.withColumns({c: F.col(c) - F.col(f"__m_{c}") for c in columns}).drop(*[f"__m_{c}" for c in columns])
    return df


def iteratively_demeaned(df: DataFrame, groups: Sequence[str], columns: Sequence[str], passes: int = 100, tolerance: float | None = 1e-8) -> DataFrame:
    """demeaned until no value moves by more than the tolerance, or for `passes` passes. Lineage is cut
    after each pass, in the shared folder."""
    for _ in range(passes):
        before = {f"__b_{c}": F.col(c) for c in columns}
        df = stored(demeaned(df.withColumns(before), groups, columns))
        if tolerance is not None:
            moved = df.agg(F.greatest(*[F.max(F.abs(F.col(c) - F.col(f"__b_{c}"))) for c in columns], F.lit(0.0))).first()[0]
        df = df.drop(*before)
        if tolerance is not None and moved < tolerance:
            break
    return df


def clustered_ols(df: DataFrame, y: str, x: str, clusters: Sequence[str]) -> DataFrame:
    """One row: n, slope, se of y on (1, x) with errors clustered by two keys (V1 + V2 - V12), without
    small-sample correction. Each cluster gives the sums of its scores; only those are combined."""
    both = df.where(F.col(y).isNotNull() & F.col(x).isNotNull())
    fit = both.agg(
        F.count("*").alias("n"), F.regr_intercept(y, x).alias("a"), F.regr_slope(y, x).alias("b"),
        F.sum(x).alias("sx"), F.sum(F.col(x) * F.col(x)).alias("sxx"),
    )
    e = F.col(y) - F.col("a") - F.col("b") * F.col(x)
    scored = both.select(*clusters, F.col(x).alias("x"), F.col(y).alias(y), x).join(F.broadcast(fit)).withColumns({"e": e})  # fit is one row
    meats = []
    for sign, keys in ((1, clusters[:1]), (1, clusters[1:]), (-1, clusters)):
        sums = scored.groupBy(*keys).agg(F.sum("e").alias("s0"), F.sum(F.col("e") * F.col("x")).alias("s1"))
        meats.append(
            sums.agg(*[(sign * F.sum(F.col(i) * F.col(j))).alias(f"m{i[1]}{j[1]}") for i, j in (("s0", "s0"), ("s0", "s1"), ("s1", "s1"))])
        )
    meat = meats[0].unionByName(meats[1]).unionByName(meats[2]).agg(*[F.sum(c).alias(c) for c in ("m00", "m01", "m11")])
    n, sx, sxx = F.col("n"), F.col("sx"), F.col("sxx")
    det = n * sxx - sx * sx
    # second row of (X'X)^-1 is (-sx, n) / det
    variance = (sx * sx * F.col("m00") - 2 * sx * n * F.col("m01") + n * n * F.col("m11")) / (det * det)
    return fit.join(F.broadcast(meat)).select("n", F.col("b").alias("slope"), F.sqrt(variance).alias("slope_se"))


def quarter_summary(df: DataFrame, quarter: str, y: str, quintile: str, least: int = 10) -> DataFrame:
    """Per quarter: n, mean, sd, and the spread of the outer quintiles (null for `least` rows or fewer)."""
    q = F.col(quintile)
    spread = F.avg(F.when(q == 5, F.col(y))) - F.avg(F.when(q == 1, F.col(y)))
    return df.groupBy(quarter).agg(
        F.count("*").alias("n"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("sd"), F.when(F.count("*") > least, spread).alias("spread")
    )
