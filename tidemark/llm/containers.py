"""Filling fixed-capacity containers.

The plan is made over the histogram of lengths, never over documents: there are at most `capacity`
different lengths, however many documents. Best fit, longest first, runs over counts and yields slot
ranges "the items of this length from rank a to b lie k to a container from container c on". Items
then get their rank within their length (in salted parts, so that a frequent length is no single
task) and take their slot by joining on length and rank.
"""

from __future__ import annotations

import base64
import bisect
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import stored

#: Where the public tokenizer's ranks lie on every machine, and how it splits text before merging.
RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _counter(ranks: str, split: str):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("public", pat_str=split, mergeable_ranks=table, special_tokens={})
        for batch in batches:
            counts = [len(encoding.encode_ordinary(text)) if text else 0 for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=["id", "n_tokens"])

    return sizes


def token_sizes(documents: DataFrame, doc_id: str, text: str, ranks: str = RANKS, split: str = SPLIT) -> DataFrame:
    """id, n_tokens of every document; null and empty texts have 0 tokens. Whole texts are counted."""
    kind = documents.schema[doc_id].dataType.simpleString()
    return documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).mapInArrow(_counter(ranks, split), f"id {kind}, n_tokens bigint")


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Slot ranges (length, from rank, to rank, first container, items a container, place in it)."""
    # runs of equal containers by the space left in them: (first container, how many)
    left: dict[int, list[tuple[int, int]]] = defaultdict(list)
    spaces: list[int] = []
    slots, opened = [], 0

    def put(space: int, first: int, many: int) -> None:
        if many and space:
            if not left[space]:
                bisect.insort(spaces, space)
            left[space].append((first, many))

    for length in sorted(histogram, reverse=True):
        rank, todo = 0, histogram[length]
        if length == 0:
            slots.append((0, 0, todo, 0, max(todo, 1), 0))
            opened = max(opened, 1)
            continue
        while todo:
            at = bisect.bisect_left(spaces, length)
            if at < len(spaces):
                space = spaces[at]
                first, many = left[space].pop()
                if not left[space]:
                    spaces.pop(at)
            else:
                space, first, many = capacity, opened, -(-todo // (capacity // length))
                opened += many
            each = space // length
            full = min(many, todo // each)
            if full:
                slots.append((length, rank, rank + full * each, first, each, capacity - space))
                put(space - each * length, first, full)
                rank, todo = rank + full * each, todo - full * each
            if todo and many > full:
                slots.append((length, rank, rank + todo, first + full, todo, capacity - space)) if todo < each else None
                if todo < each:
                    put(space - todo * length, first + full, 1)
                    rank, todo, full = rank + todo, 0, full + 1
            put(space, first + full, many - full)
    return slots


def fill_containers(sizes: DataFrame, capacity: int = 2048, part: int = 200_000) -> DataFrame:
    """One row per piece: id, piece, n_tokens, container, place (the first token's position in it).

    sizes has id and n_tokens. Items longer than the capacity are cut into full containers and one
    rest; no other item is cut. Items without tokens take no room, at place 0 of container 0. Null
    sizes count as 0. Repeated ids are items of their own. An empty table gives no rows. Lengths with
    more than `part` pieces are ranked in parts of about that many, drawn at random and written down.
    """
    n = F.coalesce("n_tokens", F.lit(0))
    pieces = sizes.select("id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(n / capacity) - 1, F.lit(0)))).alias("piece"))
    pieces = pieces.select("id", F.col("piece").cast("bigint").alias("piece"), F.least(F.lit(capacity), F.col("n") - F.col("piece") * capacity).cast("int").alias("length"))
    pieces = stored(pieces.withColumn("draw", F.rand()))
    histogram = {row.length: row.n for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity + 1 rows
    slots: dict[int, list[tuple]] = {}
    for length, *slot in best_fit(histogram, capacity):
        slots.setdefault(length, []).append(tuple(slot))
    plan = sizes.sparkSession.createDataFrame(
        [(length, -(-histogram[length] // part), own) for length, own in slots.items()],
        "length int, parts bigint, slots array<struct<lo:bigint,hi:bigint,first:bigint,each:bigint,start:bigint>>",
    )
    # a row for each of at most capacity + 1 lengths
    salted = pieces.join(F.broadcast(plan), "length").withColumn("salt", F.floor(F.col("draw") * F.col("parts")))
    counts = salted.groupBy("length", "salt").count()
    before = F.sum("count").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("length", "salt", F.coalesce(before, F.lit(0)).alias("before"))
    within = F.row_number().over(Window.partitionBy("length", "salt").orderBy("id", "piece")) - 1
    ranked = salted.withColumn("within", within).join(offsets, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within"))
    ranked = ranked.withColumn("slot", F.element_at(F.filter("slots", lambda s: s["lo"] <= F.col("rank")), -1))
    at = F.col("rank") - F.col("slot.lo")
    return ranked.select(
        "id",
        "piece",
        F.col("length").cast("bigint").alias("n_tokens"),
        (F.col("slot.first") + F.floor(at / F.col("slot.each"))).alias("container"),
        (F.col("slot.start") + at % F.col("slot.each") * F.col("length")).alias("place"),
    )
