"""Frequency of every distinct term, heavy and light.

A first pass over all records finds the heavy terms: each task counts in a bounded summary that
drops no term occurring in more than 1/slots of its tokens. Whether a term counts as heavy changes
the way it is counted, never its counts. The second pass broadcasts the heavy terms (at most
`heavy`, a fixed bound) and counts them exactly in local arrays, one per task, so that only arrays'
totals leave the task; all other terms are counted locally in bounded tables and shuffled. Both
tables are united.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a longest run of letters of any script.
LETTERS = r"\p{L}+"

_COUNTS = "term string, occurrences bigint, records bigint"


_PLAIN, _NEARLY = re.compile("[a-z]+"), re.compile(r"[^\W\d_]+")


def _finder(pattern: str) -> Callable[[str | None], list[str]]:
    """What gives a text's terms in lower case. Letters are found by faster patterns where these give the same."""
    exact = regex.compile(pattern).findall

    def letters(text: str | None) -> list[str]:
        if not text:
            return []
        if text.isascii():
            return _PLAIN.findall(text.lower())
        found = _NEARLY.findall(text)
        # the faster pattern also takes numerals such as a raised two
        return [t.lower() for t in (found if all(map(str.isalpha, found)) else exact(text))]

    return letters if pattern == LETTERS else lambda text: [t.lower() for t in exact(text)] if text else []


def _summary(slots: int, pattern: str):
    def heavy_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Misra-Gries over batches: merge, then subtract the (slots+1)-th count from all."""
        terms, kept = _finder(pattern), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                kept.update(terms(text))
                if len(kept) > 8 * slots:
                    kept = _cut(kept, slots)
        kept = _cut(kept, slots)
        yield pa.RecordBatch.from_pydict({"term": list(kept), "least": list(kept.values())}, schema=pa.schema([("term", pa.string()), ("least", pa.int64())]))

    return heavy_of_task


def _cut(counts: Counter, slots: int) -> Counter:
    if len(counts) <= slots:
        return counts
    floor = np.partition(np.fromiter(counts.values(), np.int64, len(counts)), len(counts) - slots - 1)[len(counts) - slots - 1]
    return Counter({t: n - int(floor) for t, n in counts.items() if n > floor})


def _counter(index, pattern: str, room: int):
    schema = pa.schema([("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])

    def counts_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, places = _finder(pattern), index.value
        total, held = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        light: dict[str, list[int]] = {}

        def flushed() -> pa.RecordBatch:
            rows = [list(light), [n for n, _ in light.values()], [n for _, n in light.values()]]
            light.clear()
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(rows, schema, strict=True)], schema=schema)

        for batch in batches:
            for text in batch.column(0).to_pylist():
                for term, n in Counter(terms(text)).items():
                    if (at := places.get(term)) is not None:
                        total[at] += n
                        held[at] += 1
                    elif (seen := light.get(term)) is not None:
                        seen[0] += n
                        seen[1] += 1
                    else:
                        light[term] = [n, 1]
                if len(light) > room:
                    yield flushed()
        yield flushed()
        used = np.flatnonzero(held)
        names = list(places)
        yield pa.RecordBatch.from_arrays([pa.array([names[i] for i in used], pa.string()), pa.array(total[used]), pa.array(held[used])], schema=schema)

    return counts_of_task


def term_counts(records: DataFrame, text: Column, heavy: int = 1024, pattern: str = LETTERS, room: int = 100_000) -> DataFrame:
    """One row per distinct term: term, occurrences, records (that hold it), heavy.

    text is the record's whole text; null and empty texts hold no term, repeated rows count each.
    Terms are in lower case. An empty table gives no rows. heavy bounds the number of broadcast
    terms, room the entries of a task's table between two flushes.
    """
    texts = records.select(text.alias("text"))
    summary = texts.mapInArrow(_summary(heavy, pattern), "term string, least bigint")
    top = summary.groupBy("term").agg(F.sum("least").alias("least")).orderBy(F.desc("least"), "term").limit(heavy)
    names = sorted(row.term for row in top.collect())  # at most `heavy` rows
    index = records.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(names)})
    counted = texts.mapInArrow(_counter(index, pattern, room), _COUNTS)
    return (
        counted.groupBy("term")
        .agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))
        .withColumn("heavy", F.col("term").isin(names) if len(names) <= 16 else F.array_contains(F.lit(names), F.col("term")))
    )


def mark_terms(counts: DataFrame, records: DataFrame, least: int = 5, most: float = 0.5) -> DataFrame:
    """counts plus mark: `rare` for terms in fewer than `least` records, `common` for terms in more
    than the share `most` of all records, else null. A term that is both is rare."""
    total = records.agg(F.count("*").alias("__total"))
    mark = F.when(F.col("records") < least, "rare").when(F.col("records") > most * F.col("__total"), "common")
    return counts.join(F.broadcast(total)).withColumn("mark", mark).drop("__total")
