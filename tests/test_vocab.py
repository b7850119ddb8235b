"""Term counts within a row, and the nearest report by neighbours, against brute force."""

import random
from collections import Counter
from datetime import date, timedelta

from pyspark.sql import functions as F

from tidemark.operators.fundamentals import nearest_report
from tidemark.operators.vocab import term_table


def test_terms_of_a_document_are_counted_in_its_row(spark):
    rows = [("a", ["x", "y", "x"]), ("b", []), ("c", None), (None, ["x"]), ("d", ["z"] * 1000)]
    docs = spark.createDataFrame(rows, "id string, w array<string>")
    got = {(r.id, r.term): r.tf for r in term_table(docs, "id", F.col("w")).collect()}
    assert got == {(i, t): n for i, w in rows if i and w for t, n in Counter(w).items()}
    some = spark.createDataFrame([("x",)], "term string")
    assert {(r.id, r.term) for r in term_table(docs, "id", F.col("w"), some).collect()} == {("a", "x")}
    assert "Exchange hashpartitioning" not in term_table(docs, "id", F.col("w"))._jdf.queryExecution().toString()


def test_nearest_report(spark):
    rng = random.Random(3)
    day = lambda: date(2010, 1, 1) + timedelta(rng.randrange(200))
    quarters = [(rng.randrange(4), rng.choice([None, day(), day(), day()]), rng.randrange(2008, 2010), rng.randrange(1, 5)) for _ in range(60)]
    events = [(i, rng.choice([None, 0, 1, 2, 3, 9]), rng.choice([None, day()])) for i in range(80)]
    q = spark.createDataFrame(quarters, "gvkey int, rdq date, fyearq int, fqtr int")
    e = spark.createDataFrame(events, "event_id int, gvkey int, d date")
    got = {r.event_id: r.report and tuple(r.report) for r in nearest_report(e, "event_id", "gvkey", "d", q).collect()}
    for i, key, at in events:
        best = min(((abs((at - r).days), r, y, n) for k, r, y, n in quarters if k == key and r), default=None) if at and key is not None else None
        assert got[i] == best
