import random

from tidemark.llm.leaks import leaked_items, longest_common, plain_words, template

PASSAGES = [
    (1, "The fifth trustee of Caldessa reclassified the irrevocable tender mislabelled as 33 crates of enamel tiles although the northern greenhouse near Norrvik Sound reopened in 2004 after 12 days."),
    (2, "During the audit, a chief concierge in Mistelbridge quietly disputed 20 handwritten escrows because Marraxis Logistics found 38 sacks of roasted chicory behind the abandoned old warehouse gate."),
]
FILL = "Management expects stable gross profit through the summer and sees no change in demand. " * 4


def run(spark, docs, items=PASSAGES, **options):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    i = spark.createDataFrame(items, "item_id bigint, passage string")
    got = leaked_items(d, i, ("doc_id", "text"), ("item_id", "passage"), **options).collect()
    assert len({(r.doc, r.item) for r in got}) == len(got)
    return {(r.doc, r.item): r for r in got}


def test_leaks_in_many_dresses(spark):
    one, two = PASSAGES[0][1], PASSAGES[1][1]
    words = one.split()
    changed = " ".join("xyz" if i % 9 == 4 else w for i, w in enumerate(words))
    renamed = one.replace("Caldessa", "Ostermoor").replace("33", "71").replace("Norrvik Sound", "Kastrel Bay").replace("2004", "2015").replace("12", "40")
    docs = [
        (1, FILL + one + FILL), (2, FILL + one.upper()), (3, "<div>" + one.replace(" ", "\n ") + "</div>"), (4, FILL + changed), (5, " ".join(words[: len(words) * 6 // 10]) + FILL),
        (6, " ".join(words[: len(words) // 3]) + FILL), (7, one + two), (8, FILL), (9, None), (10, ""), (11, one), (11 + 1, renamed), (13, "Why was the irrevocable tender affected? " + FILL), (14, FILL * 500 + two),
        (15, " ".join(w + " and more of the same words here" for w in words)),
    ]
    docs = [(i, t, "clash") for i, t in docs]
    got = run(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (7, 1), (7, 2), (11, 1), (12, 1), (14, 2)}
    assert got[1, 1].kind == "verbatim" and got[1, 1].share == 1 and got[12, 1].kind == "reparameterised"
    # in blocks of one passage, with few or many rare parts, and with little room, the same
    for options in ({"block": 1}, {"spare": 0.1}, {"spare": 1.0}, {"room": 1}):
        assert set(run(spark, docs, **options)) == set(got)


def test_empty_tables(spark):
    assert run(spark, []) == {} and run(spark, [(1, FILL, "")], []) == {} and run(spark, [(1, FILL, "")], [(1, None), (2, "")]) == {}


def test_template_and_words():
    assert plain_words("<b>It’s</b> 5&nbsp;ﬁrms­") == ["It", "s", "5", "firms"]
    parts, starts = template(["In", "Norrvik", "Sound", "5", "tons", "x"], frozenset({"norrvik", "sound"}))
    assert (parts, starts) == (["in", "@", "#", "%", "x"], [0, 1, 3, 4, 5])
    masks = [[1 << i for i, c in enumerate("abcab") if c == w] for w in "xcba"]
    assert longest_common([sum(m) for m in masks], 5) == 2


def brute(document, passage, share=0.5, stretch=2):
    """Whether some stretch has enough of the words in order, by the textbook recurrence."""
    said, asked = ([w.lower() for w in plain_words(t)] for t in (document, passage))
    for start in range(len(said)):
        row = [0] * (len(asked) + 1)
        for word in said[start : start + int(stretch * len(asked))]:
            new = [0]
            for i, other in enumerate(asked):
                new.append(row[i] + 1 if word == other else max(new[i], row[i + 1]))
            row = new
        if row[-1] >= share * len(asked):
            return True
    return False


def test_every_kth_word_changed_at_every_offset(spark):
    """Also with words added or left out; no candidate may be missed wherever the passage begins."""
    words = PASSAGES[1][1].split()
    docs = []
    for k in (2, 3, 4, 5, 6, 7, 9):
        for offset in range(16):
            lead = " ".join(FILL.split()[:offset])
            edits = [
                ["xyz" if i % k == 0 else w for i, w in enumerate(words)],
                [x for i, w in enumerate(words) for x in ([w, "xyz"] if i % k == 0 else [w])],
                [w for i, w in enumerate(words) if i % k],
            ]
            docs += [(len(docs) + n, " ".join([lead, *e, FILL]), "") for n, e in enumerate(edits)]
    expected = {(i, 2) for i, text, _ in docs if brute(text, PASSAGES[1][1])}
    assert len(expected) > len(docs) * 0.9
    assert set(run(spark, docs, PASSAGES[1:])) == expected


def test_half_of_the_words_in_twice_the_length(spark):
    """Exactly half of the words, in exactly twice the length, at all of 16 offsets; one word less or further is none."""
    words = plain_words(PASSAGES[0][1])
    half = words[::2][: (len(words) + 1) // 2]
    docs, expected = [], set()
    for offset in range(16):
        for missing, extra in ((0, 0), (1, 0), (0, 1)):
            own = half[missing:]
            gap = ["zz"] * (2 * len(words) - len(own) + extra)
            text = " ".join(["yy"] * offset + own[:-1] + gap + own[-1:] + ["xx"] * 5)
            if not missing and not extra:
                expected.add((len(docs), 1))
            docs.append((len(docs), text, ""))
    assert {(i, 1) for i, text, _ in docs if brute(text, PASSAGES[0][1])} == expected
    assert set(run(spark, docs, PASSAGES[:1])) == expected


def test_against_brute_force_on_random_edits(spark):
    rng = random.Random(7)
    pool = [w for _, p in PASSAGES for w in plain_words(p)] + FILL.split()[:8]
    items = [(i, " ".join(rng.choice(pool) for _ in range(rng.randrange(8, 30)))) for i in range(12)]
    docs = []
    for i in range(150):
        words = plain_words(rng.choice(items)[1])
        kept = []
        for w in words:
            r = rng.random()
            kept += [] if r < 0.2 else [rng.choice(pool)] if r < 0.4 else [w, rng.choice(pool)] if r < 0.6 else [w]
        docs.append((i, " ".join(rng.choices(pool, k=rng.randrange(20)) + kept + rng.choices(pool, k=rng.randrange(20))), ""))
    expected = {(d, i) for d, text, _ in docs for i, p in items if brute(text, p)}
    assert 30 < len(expected) < len(docs) * len(items) // 2
    assert set(run(spark, docs, items)) == expected
