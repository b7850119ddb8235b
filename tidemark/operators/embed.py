"""Embeddings: diagnostics, pooling, point-in-time model choice, and a pluggable embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dimension_stats(df: DataFrame, vector: str) -> DataFrame:
    """Per dimension (from 0): the largest absolute value, mean and population sd, over all rows."""
    cells = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    return cells.groupBy("dim").agg(F.max(F.abs("x")).alias("max_abs"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd"))


def diagnostics(df: DataFrame, vector: str) -> DataFrame:
    """One row: n, dims beyond 10 and 100, largest value, its dimension (the lowest of several), mean
    and population sd over all cells, mean norm."""
    cells = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    by_dim = cells.groupBy("dim").agg(F.max(F.abs("x")).alias("m"), F.count("x").alias("c"), F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("ss"))
    total = by_dim.agg(
        F.count_if(F.col("m") > 10).alias("dims_over_10"), F.count_if(F.col("m") > 100).alias("dims_over_100"), F.max("m").alias("max_abs"),
        F.max_by("dim", F.struct("m", -F.col("dim"))).alias("max_dim"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.sum("ss").alias("ss"),
    )
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    norms = df.agg(F.count("*").alias("n"), F.avg(norm).alias("mean_norm"))
    mean = F.col("s") / F.col("c")
    return total.join(F.broadcast(norms)).select(  # one row each
        "n", "dims_over_10", "dims_over_100", "max_abs", "max_dim", mean.alias("mean"), F.sqrt(F.col("ss") / F.col("c") - mean * mean).alias("sd"), "mean_norm"
    )


def mean_pooled(df: DataFrame, group: Sequence[str], vector: str, weight: Column) -> DataFrame:
    """Weighted mean vector per group, in long form: group, dim, x. Masked rows have weight 0."""
    cells = df.select(*group, weight.cast("double").alias("w"), F.posexplode(vector).alias("dim", "v"))
    return cells.groupBy(*group, "dim").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.greatest(F.sum("w"), F.lit(1e-9))).alias("x"))


def rms_normed(vector: Column, epsilon: float = 1e-6) -> Column:
    """The vector over the root of its mean square."""
    squares = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.transform(vector, lambda x: x.cast("double") / F.sqrt(squares / F.size(vector) + epsilon))


def model_year(day: Column, first: int = 2013, last: int = 2024) -> Column:
    """The latest model trained strictly before the day's year; null if there is none."""
    return F.when(F.year(day) > first, F.least(F.year(day) - 1, F.lit(last)))


def embedded(df: DataFrame, text: str, embedder: Callable[[list[str]], list[list[float]]], into: str = "embedding", batch: int = 256) -> DataFrame:
    """df plus the embedder's vector of each text, computed batch by batch inside the tasks; null and
    empty texts are embedded as the empty string. The embedder is any picklable callable."""

    @F.pandas_udf("array<float>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in series:
            texts = part.fillna("").tolist()
            yield pd.Series([v for i in range(0, len(texts), batch) for v in embedder(texts[i : i + batch])], dtype=object)

    return df.withColumn(into, run(F.col(text)))
