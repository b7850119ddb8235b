import random

from tidemark.llm.reading import FUNCTION_WORDS, boundary, function_words, is_english, reading_bands, words_of
import numpy as np

GLUE = "the of and to in is that for with on".split()
OWN = {1: "cat dog milk toy shop pen sun cup".split(), 2: "factory winter price locker monthly garden".split(), 3: "sequential utilisation inventory visibility adjusted".split(), 4: "heteroskedasticity semiparametric indemnification orthogonality".split()}


def text(band, rng, n=80):
    words = []
    for _ in range(n):
        source = band if rng.random() < 0.85 else rng.choice(list(OWN))
        words += [rng.choice(GLUE), rng.choice(OWN[source])]
    return " ".join(words)


def world(n=200, seed=0):
    rng = random.Random(seed)
    truth = {i: rng.randrange(1, 5) for i in range(n)}
    docs = [(i, text(b, rng), "de") for i, b in truth.items()]
    labels = []
    for i in range(0, n, 2):
        band = truth[i] if rng.random() < 0.9 else max(1, truth[i] - 1)
        labels += [(i, "g", band)] * rng.choice([1, 2])
    return docs, labels + [(1, "g", None), (None, "g", 2), (10_000, "g", 3)], truth


def run(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id bigint, text string, band string")
    l = spark.createDataFrame(labels, "doc_id bigint, grader string, band int")
    got = reading_bands(d, l).collect()
    return {r.id: r.band for r in got}


def test_held_out_accuracy(spark):
    docs, labels, truth = world()
    got = run(spark, docs, labels)
    assert set(got) == set(truth)
    held_out = [i for i in truth if i % 2]
    assert sum(got[i] == truth[i] for i in held_out) >= 0.97 * len(held_out)


def test_only_english_of_some_length(spark):
    docs, labels, _ = world(60)
    german = "der die das und ist von zu den mit sich auf für nicht ein eine dem im wird sind auch " * 4
    docs += [(100, german, ""), (101, "the cat and the dog", ""), (102, None, ""), (103, "", ""), (104, " ".join(["the", "cat"] * 20), ""), (105, "the dog of the shop " * 50_000, "")]
    got = run(spark, docs, labels)
    assert {i for i in got if i >= 100} == {104, 105} and got[104] == got[105] == 1


def test_few_or_no_labels(spark):
    docs, labels, _ = world(20)
    assert run(spark, docs, []) == {}
    assert set(run(spark, docs, [(0, "g", 3), (2, "g", 3)]).values()) == {3}
    assert run(spark, [], labels) == {}


def test_helpers():
    assert words_of("<p>The ﬁrm’s 5 Dogs</p>") == ["the", "firm", "s", "dogs"]
    assert is_english("the cat is in the house and it was there".split()) and not is_english("le chat est dans la maison et les".split()) and not is_english([])
    at, bound = boundary(np.array([[1.0, 1], [1, 2], [2, 8], [1, 9]]), np.array([False, False, True, True]))
    assert at == 1 and bound == 5


def test_function_words_are_learned_from_labels(spark):
    """A language the fixed lists don't know is told apart; labels unevenly written, some wrong, null or blank."""
    rng = random.Random(3)
    docs, labels, truth = world(120)
    ours = "zum ix qor vel anta the in".split()
    strange = [(1000 + i, " ".join(rng.choices(ours, k=60)), rng.choice(["xx", "XX-yy", " xx ", "en", None])) for i in range(80)]
    docs = [(i, t, rng.choice(["en", "English", "EN-us", "xx", None, ""]) if i % 5 else "eng") for i, t, _ in docs] + strange
    docs += [(2000, None, "en"), (2001, "", "xx"), (2002, "rare", "zz")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, lang string")
    known = function_words(d, "text", "lang", 1_000)
    assert set(known) == {"en", "xx"} and known["xx"]["qor"] > known["en"].get("qor", 0) and known["en"]["of"] > known["xx"].get("of", 0)
    got = {r.id for r in reading_bands(d, spark.createDataFrame(labels, "doc_id bigint, grader string, band int"), language="lang").collect()}
    assert got == set(truth)
    assert function_words(d.where("lang = 'xx'"), "text", "lang", 1_000) is FUNCTION_WORDS
