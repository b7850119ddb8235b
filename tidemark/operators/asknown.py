"""Attributes as known at event time.

A history holds, per key, records that are valid from one day to another. Every event gets the
record that was valid on its own day, and never one that begins later.

The history is materialised in the shared folder as periodic snapshots plus a change log: for each
(key, period) in which an event falls, the records open on the period's first day (snapshot) and
those that begin within the period (changes). An event meets the snapshot that precedes it and
replays the changes from there up to its own day. Events are reduced to distinct (key, day)
requests before any shuffle, so a hot key costs at most one request a day, and the pairs that meet
are bounded by the days of a period.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import stored


@dataclass(frozen=True)
class History:
    """Records valid from one day to another, both included; a null bound is open."""

    records: DataFrame
    key: str
    valid_from: str
    valid_to: str
    attributes: list[str] = field(default_factory=list)


def _month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day) - 1


def _period_start(period: Column, months: int) -> Column:
    first = period * months
    return F.make_date(F.floor(first / 12).cast("int"), (first % 12 + 1).cast("int"), F.lit(1))


def snapshots_and_changes(requests: DataFrame, history: History, months: int) -> DataFrame:
    """The rows (k, p, kind, f, u, a) of the periods asked for; kind is `snapshot` or `change`."""
    records = history.records.select(
        F.col(history.key).alias("k"),
        F.coalesce(F.to_date(history.valid_from), F.to_date(F.lit("0001-01-01"))).alias("f"),
        F.coalesce(F.to_date(history.valid_to), F.to_date(F.lit("9999-12-31"))).alias("u"),
        F.struct(*history.attributes).alias("a"),
    )
    records = records.where("k is not null and f <= u").distinct()
    periods = (
        requests.select("k", "p")
        .distinct()
        .withColumn("start", _period_start(F.col("p"), months))
        .withColumn("next", F.add_months("start", months))
    )
    return (
        periods.join(records, "k")
        .where("f < next and u >= start")
        .select("k", "p", F.when(F.col("f") <= F.col("start"), "snapshot").otherwise("change").alias("kind"), "f", "u", "a")
    )


def as_known(events: DataFrame, key: str, at: str, histories: dict[str, History], months: int = 3) -> DataFrame:
    """events plus one struct column per history: the attributes valid on the day `at`, or null.

    If several records are valid, the latest valid_from counts, then the latest valid_to, then the
    largest attributes. Nothing is known where the key or the day is null. Rows are neither lost nor
    repeated; a column of events that has a history's name is replaced. An empty history or table of
    events gives nulls or no rows. months is the length of a snapshot's period.
    """
    events = events.drop(*histories)
    day = F.to_date(F.col(at))
    requests = (
        events.select(F.col(key).alias("k"), day.alias("t"))
        .where("k is not null and t is not null")
        .distinct()
        .withColumn("p", F.floor(_month_number(F.col("t")) / months).cast("int"))
    )
    known = requests.select("k", "t")
    for name, history in histories.items():
        state = stored(snapshots_and_changes(requests, history, months))
        snapshot, log = (state.where(F.col("kind") == kind) for kind in ("snapshot", "change"))
        preceding = requests.join(snapshot, ["k", "p"]).where("t <= u")
        replayed = requests.join(log, ["k", "p"]).where("f <= t and t <= u")
        latest = (
            preceding.unionByName(replayed)
            .groupBy("k", "t")
            .agg(F.max(F.struct("f", "u", "a")).getField("a").alias(f"__{name}"))
        )
        known = known.join(latest, ["k", "t"], "left")
    known = known.withColumnsRenamed({"k": "__k", "t": "__t"})
    return (
        events.join(known, F.col(key).eqNullSafe(F.col("__k")) & day.eqNullSafe(F.col("__t")), "left")
        .drop("__k", "__t")
        .withColumnsRenamed({f"__{name}": name for name in histories})
    )
