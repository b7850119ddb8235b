"""Linking by identifiers that are valid for a while, and choosing one row of several."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """One row per key: the first in the given total order. Null keys form groups of their own."""
    by = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__first", F.row_number().over(by)).where("__first = 1").drop("__first")


def valid_on(at: Column, start: Column, end: Column) -> Column:
    """Whether a validity interval, both ends included and a null end open, holds the day."""
    return (at >= start) & (at <= F.coalesce(end, F.lit("2099-12-31").cast("date")))


def interval_link(events: DataFrame, event_key: str, at: str, history: DataFrame, history_key: str, start: str, end: str) -> DataFrame:
    """events with the columns of every history row of the same key that is valid on `at` (inner).
    Blank keys match nothing. The equality carries the join; validity is checked within it."""
    keyed = events.where(F.col(event_key) != "")
    meets = (F.col(event_key) == F.col(history_key)) & valid_on(F.col(at), F.col(start), F.col(end))
    return keyed.join(history, meets)


def priority_link(
    events: DataFrame, event_id: str, at: str, history: DataFrame, start: str, end: str, keys: Sequence[tuple[str, str]], order: Sequence[Column | str]
) -> DataFrame:
    """One linked row per event: by the first pair of keys if it finds any, else by the next.
    order breaks ties among several valid rows."""
    tried = [interval_link(events, ek, at, history, hk, start, end).withColumn("link_step", F.lit(i + 1)) for i, (ek, hk) in enumerate(keys)]
    linked = tried[0]
    for more in tried[1:]:
        linked = linked.unionByName(more)
    return first_by(linked, [event_id], ["link_step", *order])


def version_dedup(events: DataFrame, keys: Sequence[str], updated: str, event_id: str) -> DataFrame:
    """The earliest version of each event: a version with an update stamp before one without, then the
    smallest stamp and id, both compared as text. Rows with a blank id are dropped."""
    stamped = F.coalesce(F.col(updated), F.lit(""))
    return first_by(events.where(F.coalesce(F.col(event_id), F.lit("")) != ""), keys, [stamped == "", stamped, event_id])
