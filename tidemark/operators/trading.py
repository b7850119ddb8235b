"""Trading calendars: positions, as-of matches and frames of rows.

A daily table has one row per firm and day, so a firm's series is bounded by the calendar however
many trades or events a firm has; windows over a firm are safe. Events meet it as distinct
(firm, day) requests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def positions(daily: DataFrame, firm: str = "permno", day: str = "dt") -> DataFrame:
    """daily plus pos (from 0, by day) and n_days of the firm."""
    w = Window.partitionBy(firm)
    return daily.withColumns({"pos": F.row_number().over(w.orderBy(day)) - 1, "n_days": F.count("*").over(w)})


def asof_position(events: DataFrame, daily: DataFrame, at: str, direction: str = "backward", firm: str = "permno", day: str = "dt") -> DataFrame:
    """events plus pos: the firm's last trading row on or before `at`, or (forward) the first on or
    after it; null if there is none or a key is null. daily has firm, day and pos. No tolerance."""
    asked = events.select(F.col(firm), F.to_date(at).alias(day)).where(f"{firm} is not null and {day} is not null").distinct()
    both = daily.select(firm, day, "pos").unionByName(asked.withColumn("pos", F.lit(None).cast("int")))
    # of a request and a row on one day the row must count as seen
    if direction == "backward":
        w = Window.partitionBy(firm).orderBy(day, F.col("pos").isNull())
        seen = F.last("pos", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    else:
        w = Window.partitionBy(firm).orderBy(day, F.col("pos").isNotNull())
        seen = F.first("pos", True).over(w.rowsBetween(0, Window.unboundedFollowing))
    found = both.withColumn("__seen", seen).where("pos is null").select(F.col(firm).alias("__f"), F.col(day).alias("__d"), F.col("__seen").alias("pos"))
    same = F.col(firm).eqNullSafe(F.col("__f")) & F.to_date(at).eqNullSafe(F.col("__d"))
    return events.join(found, same, "left").drop("__f", "__d")


def shift_after_close(before_close: Column, pos: Column, n_days: Column) -> Column:
    """The next trading row if the event is known to come after the close and there is a next row."""
    return F.when(~F.coalesce(before_close, F.lit(True)) & (pos + 1 < n_days), pos + 1).otherwise(pos)


def forward_frame(firm: str, day: str, days: int):
    return Window.partitionBy(firm).orderBy(day).rowsBetween(1, days)
