"""Matching records by nearest time.

Expanding rings: left and right records of an entity meet in adjacent buckets of a fine width. A
match no farther than that width is provably the nearest, since everything unseen is farther, and
is accepted. Left records without one go on to buckets of twice the width, up to the tolerance.
Both sides are reduced to distinct (entity, time) before they meet, so repeated rows cost nothing
and a hot entity is spread over its buckets.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import stored


def ring_widths(first: int, tolerance: int) -> list[int]:
    """first, doubled until it covers the tolerance."""
    widths = [first]
    while widths[-1] < tolerance:
        widths.append(widths[-1] * 2)
    return widths


def nearest_in_time(
    left: DataFrame,
    right: DataFrame,
    key: tuple[str, str],
    at: tuple[Column, Column],
    payload: list[str],
    tolerance: int,
    first: int = 1,
    into: str = "nearest",
) -> DataFrame:
    """left plus the struct `into` (distance, at, and the payload columns of right), or null.

    at gives the time of either side as a whole number (days, seconds, ...), tolerance and first are
    in the same unit. Of two right records equally far the earlier counts, of several at one time
    the one with the smallest payload (nulls first). Null entities or times match nothing. Every left
    row comes out once, repeated rows repeated; a column named like `into` is replaced. An empty
    right side gives nulls. The join's work is bounded by the distinct times in three buckets.
    """
    if tolerance < 0 or first < 1:
        raise ValueError("tolerance must not be negative and first must be positive")
    left = left.drop(into).withColumns({"__k": F.col(key[0]), "__t": at[0].cast("bigint")})
    asked = left.select("__k", "__t").where("__k is not null and __t is not null").distinct()
    offered = (
        right.select(F.col(key[1]).alias("__k"), at[1].cast("bigint").alias("__r"), F.struct(*payload).alias("__p"))
        .where("__k is not null and __r is not null")
        .groupBy("__k", "__r")
        .agg(F.min("__p").alias("__p"))
    )
    offered, open_, answers = stored(offered), stored(asked), []
    widths = ring_widths(first, tolerance)
    for width in widths:
        bucket = lambda t, w=width: F.floor(F.col(t) / w)
        around = offered.withColumn("__b", F.explode(F.array(*[bucket("__r") + i for i in (-1, 0, 1)])))
        reach = min(width, tolerance)
        met = (
            open_.withColumn("__b", bucket("__t"))
            .join(around, ["__k", "__b"])
            .withColumn("__d", F.abs(F.col("__r") - F.col("__t")))
            .where(F.col("__d") <= reach)
            .groupBy("__k", "__t")
            .agg(F.min(F.struct("__d", "__r", "__p")).alias("__m"))
        )
        answered = stored(met)
        answers.append(answered)
        if width != widths[-1]:
            open_ = stored(open_.join(answered, ["__k", "__t"], "left_anti"))
    found = reduce(DataFrame.unionByName, answers).select(
        F.col("__k").alias("__fk"),
        F.col("__t").alias("__ft"),
        F.struct(F.col("__m.__d").alias("distance"), F.col("__m.__r").alias("at"), "__m.__p.*").alias(into),
    )
    return left.join(found, F.col("__k").eqNullSafe(F.col("__fk")) & F.col("__t").eqNullSafe(F.col("__ft")), "left").drop(
        "__k", "__t", "__fk", "__ft"
    )
