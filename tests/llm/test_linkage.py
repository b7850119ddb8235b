import random

import numpy as np

from tidemark.llm.linkage import LabelModel, blocked_pairs, link_entities

LEFT = "unit string, cusip string, ticker string, isin string, company_name string, entity string"
RIGHT = "entity int, ncusip string, ticker string, comnam string"
WORDS = ["MOTORS", "PAPER", "WATER", "MEDIA", "FOODS", "MARINE"]


def world(n=60, seed=0):
    rng = random.Random(seed)
    letters = "BCDFGHJKLMNPRSTVWXZ"
    stem = lambda: "".join(rng.choice(letters) + rng.choice("AEIU") for _ in range(4))
    firms = [(i, f"{rng.randrange(10**6):06}10", "".join(rng.choices(letters, k=4)), f"{stem()} {rng.choice(WORDS)} INC") for i in range(n)]
    right = [(e, c, t, name) for e, c, t, name in firms] + firms[:5]
    left, truth = [], {}
    for e, c, t, name in firms[: n - 10]:
        unit = f"u{e}"
        truth[unit] = e
        for _ in range(rng.randrange(1, 5)):
            typo = list(name)
            if rng.random() < 0.3:
                i = rng.randrange(1, 6)
                typo[i], typo[i + 1] = typo[i + 1], typo[i]
            left.append((unit, rng.choice([c + "3", c, None, c.replace("1", "I")]), rng.choice([t, t + ".OQ", t.lower(), ""]), rng.choice([None, f"US{c}35"]), "".join(typo).title(), "x"))
    for i in range(15):  # others, some with a listed firm's ticker or stem
        e, c, t, name = firms[i]
        left.append((f"o{i}", f"{rng.randrange(10**6):06}20", t + ".L" if i % 2 else None, f"GB{rng.randrange(10**6):06}2012", (name.split()[0] if i % 3 == 0 else stem()).title() + " Zinc plc", "x"))
    return left, right, truth


def test_finds_the_firms_and_none_for_others(spark):
    left, right, truth = world()
    got = link_entities(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT)).collect()
    assert len({r.unit for r in got}) == len(got)
    found = {r.unit: r.entity for r in got}
    wrong = {u for u, e in found.items() if truth.get(u) != e}
    assert not wrong and len(found) >= 0.95 * len(truth)
    assert all(0.5 <= r.confidence <= 1 for r in got)


def test_heavy_blocks_keep_all_pairs(spark):
    units = [(f"u{i}", f"k{i % 3}") for i in range(30)] * 2
    entities = [(i, "k0" if i < 40 else f"k{i % 3}") for i in range(60)] * 2
    expected = {(u, e) for u, k in units for e, o in entities if k == o}
    u, e = spark.createDataFrame(units, "unit string, key string"), spark.createDataFrame(entities, "entity int, key string")
    for most in (1, 7, 256):
        got = [tuple(r) for r in blocked_pairs(u, e, most).collect()]
        assert set(got) == expected and len(got) == len(expected)


def test_nulls_and_empty_tables(spark):
    right = spark.createDataFrame([(1, None, None, None), (None, "1", "A", "B"), (2, "", " ", "N/A")], RIGHT)
    left = spark.createDataFrame([("u", None, None, None, None, None), (None, "1", "A", None, "B", None), ("v", "", "N/A", "x", "  ", None)], LEFT)
    assert link_entities(left, right).count() == 0
    assert link_entities(left.where("false"), right).count() == 0
    assert link_entities(left, right.where("false")).count() == 0


def test_model_joins_dependent_matchers():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.4
    noisy = lambda p: np.where(rng.random(4000) < p, y, ~y)
    first = noisy(0.9)
    votes = np.column_stack([first, np.where(rng.random(4000) < 0.95, first, ~first), noisy(0.85), noisy(0.85)]) * 3
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    model = LabelModel()
    post = model.fit(patterns, n)
    assert [0, 1] in model.blocks
    _, code = np.unique(votes, axis=0, return_inverse=True)
    assert ((post[code.ravel()] > 0.5) == y).mean() > 0.9
