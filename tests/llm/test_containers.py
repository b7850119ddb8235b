import math
import random

import pytest

from tidemark.llm.containers import best_fit, fill_containers, token_sizes


def placed(spark, sizes, capacity):
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "id bigint, n_tokens bigint")
    return fill_containers(df, capacity, part=5).collect()


@pytest.mark.parametrize("seed", range(3))
def test_nothing_overlaps_and_nothing_is_lost(spark, seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 7, 7, 7, rng.randrange(60), rng.randrange(400)]) for _ in range(800)] + [None]
    got = placed(spark, sizes, 100)
    by, total = {}, {}
    for r in got:
        total[r.id] = total.get(r.id, 0) + r.n_tokens
        assert 0 <= r.place and r.place + r.n_tokens <= 100
        assert r.n_tokens == 100 or r.piece == math.ceil((sizes[r.id] or 0) / 100) - 1 or not sizes[r.id]
        if r.n_tokens:
            by.setdefault(r.container, []).append((r.place, r.place + r.n_tokens))
    assert total == {i: n or 0 for i, n in enumerate(sizes)}
    for spans in by.values():
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    assert sorted(by) == list(range(len(by)))
    assert len(by) <= math.ceil(sum(n or 0 for n in sizes) / 100) * 1.03 + 1


def containers_of_items(sizes, capacity):
    """Best fit, longest first, item by item."""
    left = []
    for n in sorted(sizes, reverse=True):
        fit = [i for i, space in enumerate(left) if space >= n]
        if fit:
            left[min(fit, key=lambda i: left[i])] -= n
        else:
            left.append(capacity - n)
    return len(left)


@pytest.mark.parametrize("seed", range(20))
def test_counts_pack_as_well_as_items(seed):
    rng = random.Random(seed)
    sizes = [rng.randrange(1, 51) for _ in range(rng.randrange(1, 200))]
    histogram = {n: sizes.count(n) for n in set(sizes)}
    slots = best_fit(histogram, 50)
    assert sum(hi - lo for _, lo, hi, *_ in slots) == len(sizes)
    used = {c for n, lo, hi, first, each, _ in slots for c in range(first, first + -(-(hi - lo) // each))}
    assert len(used) == containers_of_items(sizes, 50)


def test_empty_and_all_empty(spark):
    assert placed(spark, [], 10) == []
    assert [(r.container, r.place, r.n_tokens) for r in placed(spark, [0, 0], 10)] == [(0, 0, 0)] * 2


def test_token_sizes(spark):
    df = spark.createDataFrame([(1, "Hello world, hello <|endoftext|>"), (2, None), (3, ""), (4, "a" * 20_000)], "doc bigint, text string")
    got = {r.id: r.n_tokens for r in token_sizes(df, "doc", "text").collect()}
    assert got[2] == got[3] == 0 and 5 <= got[1] <= 14 and got[4] > 1000
