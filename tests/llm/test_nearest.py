import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.nearest import nearest_in_time, ring_widths


def brute(left, right, tolerance):
    out = []
    for k, t in left:
        near = [(abs(r - t), r, p) for rk, r, p in right if k is not None and t is not None and r is not None and rk == k and abs(r - t) <= tolerance]
        best = min(near, default=None, key=lambda x: (x[0], x[1], (x[2] is not None, x[2])))
        out.append((k, t, best))
    return sorted(out, key=str)


def run(spark, left, right, tolerance, first=1):
    a = spark.createDataFrame(left, "k int, t int")
    b = spark.createDataFrame(right, "k int, r int, p string")
    got = nearest_in_time(a, b, ("k", "k"), (F.col("t"), F.col("r")), ["p"], tolerance, first).collect()
    return sorted(((r.k, r.t, r.nearest and (r.nearest.distance, r.nearest.at, r.nearest.p)) for r in got), key=str)


@pytest.mark.parametrize("tolerance,first", [(7, 1), (0, 1), (20, 3), (5, 8)])
def test_against_brute_force(spark, tolerance, first):
    rng = random.Random(tolerance)
    left = [(rng.choice([1, 1, 1, 2, None]), rng.choice([rng.randrange(-300, 300), None])) for _ in range(300)]
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice([rng.randrange(-300, 300)] * 9 + [None]), rng.choice(["a", "b", None])) for _ in range(80)]
    left += left[:30]
    right += right[:30]
    assert run(spark, left, right, tolerance, first) == brute(left, right, tolerance)


def test_ring_widths():
    assert ring_widths(1, 7) == [1, 2, 4, 8] and ring_widths(1, 0) == [1] and ring_widths(4, 4) == [4]


def test_empty_clashing_and_invalid(spark):
    assert run(spark, [], [(1, 1, "a")], 3) == []
    assert run(spark, [(1, 1)], [], 3) == [(1, 1, None)]
    a = spark.createDataFrame([(1, 5, "mine", "x")], "k int, t int, p string, nearest string")
    b = spark.createDataFrame([(1, 6, "theirs", 0)], "k int, r int, p string, distance int")
    row = nearest_in_time(a, b, ("k", "k"), (F.col("t"), F.col("r")), ["p"], 2).first()
    assert row.p == "mine" and (row.nearest.p, row.nearest.distance) == ("theirs", 1)
    with pytest.raises(ValueError):
        run(spark, [(1, 1)], [(1, 1, "a")], -1)
