"""Mixed timestamp formats and time zones, brought to one UTC instant.

Stamps that name a zone are converted at once. For the others the offset is estimated, per source
and period, from what each row says about its own instant (it can't be later than its ingestion; it
must fall on the day noted beside it; ...): every candidate offset gets the number of rows that it
would contradict, and the history of offsets with the fewest contradictions is taken. Leaving the
default offset, or changing from one period to the next, must save min_gain of the source's rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.stamps import with_stamp
from tidemark.sources import stored

#: Minutes east of UTC that a clock without zone may run at.
CANDIDATES = tuple(60 * h for h in range(-10, 13)) + (330,)


def _history(min_gain: float, least: float, default: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def least_contradicted(counts: pd.DataFrame) -> pd.DataFrame:
        """Dynamic programming over the periods of one source: a table of periods x candidates."""
        wrong = counts.pivot_table(index="period", columns="minutes", values="wrong", aggfunc="sum", fill_value=0).sort_index()
        offsets = wrong.columns.to_numpy()
        price = max(least, min_gain * counts.groupby("period")["n"].max().sum())
        cost, back = np.where(offsets == default, 0.0, price), []
        for row in wrong.to_numpy(float):
            stay, best = cost, int(np.argmin(cost))
            change = cost[best] + price < stay
            back.append(np.where(change, best, np.arange(len(offsets))))
            cost = np.where(change, cost[best] + price, stay) + row
        # of equally good histories the one nearest to the default
        at = int(np.lexsort((np.abs(offsets - default), cost))[0])
        taken = []
        for step in reversed(back):
            taken.append(at)
            at = int(step[at])
        return pd.DataFrame({"source": counts["source"].iloc[0], "period": wrong.index, "minutes": offsets[taken[::-1]]})

    return least_contradicted


def normalise_stamps(
    df: DataFrame,
    stamp: str,
    into: str = "utc",
    source: Column | None = None,
    contradictions: Callable[[Column], Sequence[Column]] = lambda utc: [],
    period: Callable[[Column], Column] = F.year,
    min_gain: float = 0.1,
    least: float = 3.0,
    default: int = 0,
) -> DataFrame:
    """df plus the column `into` (timestamp_ntz in UTC), null where stamp tells no day or no clock time.

    contradictions gives, for a supposed instant, conditions that the row would contradict; nulls
    contradict nothing. source separates feeds whose clocks may differ (default: the spelling).
    Without evidence the default offset holds. Rows and other columns stay as they are; a column
    named like `into` is replaced. Null, empty or unreadable stamps give null.
    """
    read = with_stamp(df.drop(into), stamp, "__stamp")
    clock = F.col("__stamp.clock")
    source = F.coalesce((source if source is not None else F.col("__stamp.spelling")).cast("string"), F.lit(""))
    # read twice, and its patterns are dear: written once
    read = stored(read.withColumns({"__source": source, "__period": period(clock).cast("int")}))
    zoneless = read.where(F.col("__stamp").isNotNull() & F.col("__stamp.utc").isNull())
    supposed = lambda minutes: clock - F.make_dt_interval(mins=minutes)
    wrong = sum((F.coalesce(c.cast("int"), F.lit(0)) for c in contradictions(supposed(F.col("minutes")))), F.lit(0))
    counts = (
        zoneless.withColumn("minutes", F.explode(F.array(*map(F.lit, CANDIDATES))))
        .groupBy(F.col("__source").alias("source"), F.col("__period").alias("period"), "minutes")
        .agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"))
    )
    offsets = counts.groupBy("source").applyInPandas(
        _history(min_gain, least, default), "source string, period int, minutes int"
    )
    offsets = offsets.withColumnsRenamed({"source": "__source", "period": "__period", "minutes": "__minutes"})
    return (
        read.join(offsets, ["__source", "__period"], "left")
        .withColumn(into, F.coalesce(F.col("__stamp.utc"), supposed(F.coalesce("__minutes", F.lit(default)))))
        .drop("__stamp", "__source", "__period", "__minutes")
    )
