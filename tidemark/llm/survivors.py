"""Best representative of each duplicate group by skyline selection.

Records of a group are compared on completeness (how many fields they hold), trust and recency.
Recency is a total order: of equally recent records the one with the smaller id comes first. The
undominated records form the first layer, those undominated among the rest the next, and so on.
The lexicographic policy (trust, then recency) picks the survivor, and for every field its value;
what the first layer leaves null, or fills worse by the policy than a later layer could, is filled
from the next layers.

Who is at most as trusted and as complete as another and comes later is dominated, so of each pair of
trust and completeness only the first by recency can be in a layer: a layer is an aggregate that
combines before the shuffle, whatever the size of a group, and at most 2 (fields + 1) records of each
group are compared. After a layer only those records go on that could still improve some field, that
is, hold it and come earlier by the policy than what fills it. The policy's first record among them is
undominated, and settles at least one field of its group for good. So fields + 1 layers are always
enough, and the loop ends by itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import stored

_KEY = "__g"
_LAST = -(2**62)


def _undominated(front: Column) -> Column:
    """Of a group's best by trust and completeness, those that no other dominates."""
    beats = lambda o, r: (o["trust"] >= r["trust"]) & (o["size"] >= r["size"]) & (o["first"] <= r["first"]) & (o != r)
    return F.filter(front, lambda r: ~F.exists(front, lambda o: beats(o, r)))


def layer(rest: DataFrame) -> DataFrame:
    """__g, front: the undominated records of every group."""
    cells = rest.groupBy(_KEY, "trust", "size").agg(F.min(F.struct("first", "v")).alias("r"))
    fronts = cells.groupBy(_KEY).agg(F.collect_list(F.struct("trust", "size", "r.first", "r.v")).alias("front"))  # at most 2 (fields + 1)
    return fronts.withColumn("front", _undominated(F.col("front")))


def skyline_survivors(
    records: DataFrame, group: Sequence[str], record_id: str, fields: Sequence[str], trust: Column, recency: Column
) -> DataFrame:
    """One row per group: the group columns, record_id of the survivor, every field, n_records, and
    n_layers, the number of dominance layers that were looked at.

    trust is a condition (null is false), recency a number (null comes last); the larger is better.
    A field counts as held if it is not null; clean blanks before. Groups of one record survive as
    they are. Rows with a null group column form groups of their own null value. Rows that tie in trust,
    recency and id are one record, with the smallest value of each field; they, and exact copies, all
    count in n_records. An empty table gives no rows; other columns are left out.
    """
    fields = list(fields)
    rows = records.select(
        F.struct(*group).alias(_KEY),
        F.coalesce(trust.cast("int"), F.lit(0)).alias("trust"),
        F.struct((-F.coalesce(recency.cast("bigint"), F.lit(_LAST))).alias("late"), F.col(record_id).alias("id")).alias("first"),
        *[F.col(f).alias(f"__{f}") for f in fields],
    )
    rows = rows.groupBy(_KEY, "trust", "first").agg(F.count("*").alias("copies"), F.struct(*[F.min(f"__{f}").alias(f) for f in fields]).alias("v"))
    rows = stored(rows.withColumn("size", sum((F.col(f"v.{f}").isNotNull().cast("int") for f in fields), F.lit(0))))
    sizes = rows.groupBy(_KEY).agg(F.sum("copies").alias("n_records"))

    # what fills a slot: the policy's key of its record, and the value; every record fills the slot of the survivor
    held = lambda r, f: F.lit(True) if f == "id" else r["v"][f].isNotNull()

    def policy(r: Column) -> Column:
        return F.struct((-r["trust"]).alias("t"), r["first"].alias("f"))

    def filled(front: Column, f: str) -> Column:
        value = lambda r: F.lit(None).cast("string") if f == "id" else r["v"][f]
        holders = F.filter(front, lambda r: held(r, f))
        return F.array_min(F.transform(holders, lambda r: F.struct(policy(r).alias("p"), value(r).alias("x")))).alias(f"b_{f}")

    slots = [f"b_{f}" for f in ("id", *fields)]
    r = F.struct("trust", "first", "v")
    useful = F.lit(False)
    for f in ("id", *fields):
        useful = useful | (held(r, f) & (F.col(f"b_{f}").isNull() | (policy(r) < F.col(f"b_{f}.p"))))
    rest, best = rows, None
    for depth in range(1, len(fields) + 2):
        more = layer(rest).select(_KEY, *[filled(F.col("front"), f) for f in ("id", *fields)])
        if best is None:
            best = more.withColumn("n_layers", F.lit(depth))
        else:
            later = more.withColumnsRenamed({s: f"m_{s}" for s in slots})
            better = lambda s: F.least(s, f"m_{s}")
            best = best.join(later, _KEY, "left").select(
                _KEY, *[better(s).alias(s) for s in slots], F.when(F.coalesce(*[f"m_{s}" for s in slots]).isNotNull(), depth).otherwise(F.col("n_layers")).alias("n_layers")
            )
        best = stored(best)
        if depth == len(fields) + 1:
            break
        rest = stored(rest.join(best.drop("n_layers"), _KEY).where(useful).select(*rows.columns))
        if rest.isEmpty():
            break
    return best.join(sizes, _KEY).select(
        f"{_KEY}.*", F.col("b_id.p.f.id").alias(record_id), *[F.col(f"b_{f}.x").alias(f) for f in fields], "n_records", "n_layers"
    )
