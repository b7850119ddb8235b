import datetime as dt
import random

from tidemark.operators.asknown import History, as_known

D = lambda n: dt.date(2010, 1, 1) + dt.timedelta(days=n)


def brute(events, history):
    out = []
    for key, day in events:
        best = None
        for k, f, u, name in history:
            f, u = f or dt.date(1, 1, 1), u or dt.date(9999, 12, 31)
            if key is not None and day is not None and k == key and f <= day <= u and (best is None or (f, u, name) > best):
                best = (f, u, name)
        out.append((key, day, best and best[2]))
    return sorted(out, key=str)


def run(spark, events, history, **options):
    e = spark.createDataFrame(events, "k int, day date")
    h = spark.createDataFrame(history, "k int, f date, u date, name string")
    got = as_known(e, "k", "day", {"known": History(h, "k", "f", "u", ["name"])}, **options)
    return sorted(((r.k, r.day, r.known and r.known.name) for r in got.collect()), key=str)


def test_against_brute_force(spark):
    rng = random.Random(1)
    history = []
    for i in range(300):
        f = rng.randrange(-900, 900)
        history.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([D(f), D(f), D(f), None]), rng.choice([None, D(f + rng.randrange(-5, 400))]), f"n{i}"))
    history += history[:20]
    events = [(rng.choice([1, 1, 2, 3, 4, None]), rng.choice([D(rng.randrange(-1000, 1000)), None])) for _ in range(400)]
    events += events[:50]
    expected = brute(events, history)
    assert run(spark, events, history) == expected
    assert run(spark, events, history, months=1) == expected
    assert run(spark, events, history, months=24) == expected


def test_ends_are_included_and_later_records_are_unknown(spark):
    history = [(1, D(0), D(10), "a"), (1, D(11), None, "b")]
    got = run(spark, [(1, D(-1)), (1, D(0)), (1, D(10)), (1, D(11)), (1, D(5000))], history)
    assert [x[2] for x in got] == [None, "a", "a", "b", "b"]


def test_empty_tables_and_clashing_names(spark):
    assert run(spark, [], [(1, D(0), None, "a")]) == []
    assert run(spark, [(1, D(0))], []) == [(1, D(0), None)]
    e = spark.createDataFrame([(1, D(0), "x", "y", 7)], "k int, day date, known string, f string, t int")
    h = spark.createDataFrame([(1, D(0), None, "a", 3)], "k int, f date, u date, name string, t int")
    row = as_known(e, "k", "day", {"known": History(h, "k", "f", "u", ["name", "t"])}).first()
    assert (row.k, row.f, row.t, row.known.name, row.known.t) == (1, "y", 7, "a", 3)
