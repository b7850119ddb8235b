import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.survivors import layer, skyline_survivors

FIELDS = ("a", "b", "c")
SCHEMA = "g int, id string, ok boolean, at bigint, a string, b string, c string, n_layers int"


def key(r):
    return (not r[2], 2**62 if r[3] is None else -r[3], r[1])


def brute(rows):
    """The policy's first record, and the policy's first holder of every field; of ties the smallest value."""
    out = {}
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=key)
        first = lambda i: min(((key(r), r[i]) for r in own if r[i] is not None), default=(None, None))[1]  # noqa: E731, B023
        out[g] = (own[0][1], *[first(i) for i in (4, 5, 6)], len(own))
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    got = skyline_survivors(df, ["g"], "id", list(FIELDS), F.col("ok"), F.col("at")).collect()
    assert len({r.g for r in got}) == len(got)
    return {r.g: (r.id, r.a, r.b, r.c, r.n_records) for r in got}, {r.g: r.n_layers for r in got}


def rows_of(seed, n=160):
    rng = random.Random(seed)
    value = lambda i: rng.choice([None, None, f"v{i}"])
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), f"{rng.randrange(1000):04}x{i}", rng.choice([True, False, None]), rng.choice([None, rng.randrange(6)]), value(i), value(i), value(i)) for i in range(n)]
    return rows + rows[:10]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_against_brute_force(spark, seed):
    rows = rows_of(seed)
    got, layers = run(spark, rows)
    assert got == brute(rows) and max(layers.values()) <= len(FIELDS) + 1


def test_later_layers_fill(spark):
    """The second record is dominated by the first, which lacks its field; the third by both."""
    rows = [(1, "x", True, 9, "a9", None, None), (1, "y", True, 8, None, "b8", None), (1, "z", False, 7, None, None, "c7")]
    assert run(spark, rows) == ({1: ("x", "a9", "b8", "c7", 3)}, {1: 3})
    # a better value may lie in a deeper layer: of two trusted records the older one holds b, an untrusted newer one too
    rows = [(1, "x", True, 5, "a5", None, None), (1, "y", True, 4, None, "b4", None), (1, "z", False, 9, "a9", "b9", None)]
    assert run(spark, rows) == ({1: ("x", "a5", "b4", None, 3)}, {1: 2})


def test_a_layer_is_what_nothing_dominates(spark):
    rows = rows_of(9)
    rows = list({(r[0], r[1]): r for r in rows}.values())
    df = spark.createDataFrame([(*r, 0) for r in rows], SCHEMA)
    df = df.select(
        F.struct("g").alias("__g"), F.coalesce(F.col("ok").cast("int"), F.lit(0)).alias("trust"), F.struct((-F.coalesce("at", F.lit(-(2**62)))).alias("late"), "id").alias("first"),
        F.struct(*FIELDS).alias("v"), sum((F.col(f).isNotNull().cast("int") for f in FIELDS), F.lit(0)).alias("size"),
    )
    point = lambda r: (bool(r[2]), sum(x is not None for x in r[4:7]), key(r)[1:])
    beats = lambda o, r: o != r and o[0] >= r[0] and o[1] >= r[1] and o[2] <= r[2]
    expected = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        expected[g] = {r[1] for r in own if not any(beats(point(o), point(r)) for o in own)}
    got = {r["__g"].g: {x["first"].id for x in r.front} for r in layer(df).collect()}
    assert got == expected


def test_one_group_with_most_of_the_rows(spark):
    """Copies of one record, and a long chain of records each newer than the last."""
    rows = [(1, "same", True, 3, None, "b", None)] * 500 + [(1, f"{i:04}", False, i, f"a{i}", None, None) for i in range(500)] + [(2, "x", None, None, None, None, "c")]
    got, layers = run(spark, rows)
    assert got == brute(rows) and layers[1] <= 2


def test_single_and_empty(spark):
    assert run(spark, [(1, "x", None, None, None, None, None)]) == ({1: ("x", None, None, None, 1)}, {1: 1})
    assert run(spark, []) == ({}, {})
