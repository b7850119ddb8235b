import random
from collections import Counter

import regex
from pyspark.sql import functions as F

from tidemark.llm import terms
from tidemark.llm.terms import mark_terms, term_counts


def brute(texts):
    occurrences, records = Counter(), Counter()
    for t in texts:
        words = [w.lower() for w in regex.findall(r"\p{L}+", t or "")]
        occurrences.update(words)
        records.update(set(words))
    return {w: (occurrences[w], records[w]) for w in occurrences}


def run(spark, texts, **options):
    df = spark.createDataFrame([(t,) for t in texts], "t string").repartition(5)
    got = term_counts(df, F.col("t"), **options).collect()
    assert len({r.term for r in got}) == len(got)
    return {r.term: (r.occurrences, r.records) for r in got}


def test_exact_for_any_number_of_heavy_terms(spark):
    rng = random.Random(3)
    words = ["the", "The", "été", "ß", "Ω", "слово", "x1y", "don't", "語", *[f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]]
    texts = [" ".join(rng.choices(words, weights=[200, 50] + [1] * (len(words) - 2), k=rng.randrange(0, 60))) for _ in range(300)]
    texts += [None, "", "123 ...", "a" * 100_000, texts[0], texts[0], "word " * 50_000]
    expected = brute(texts)
    for heavy, room in ((1024, 100_000), (3, 10), (1, 1)):
        assert run(spark, texts, heavy=heavy, room=room) == expected


def test_marks(spark):
    texts = ["all one"] * 4 + ["all two"] * 3 + ["all"] * 3 + [None] * 2
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.term: r.mark for r in mark_terms(term_counts(df, F.col("t")), df, least=4).collect()}
    assert got == {"all": "common", "one": None, "two": "rare"}


def test_empty(spark):
    assert run(spark, []) == {} and run(spark, [None, ""]) == {}


def test_faster_patterns_give_the_same_terms():
    odd = ["", "Plain TEXT, 3rd-party_name's", "x² ½cup Ⅷ a①b", "İstanbul Straße ΣΑΣ naïve e\u0301t\u0301e", "١٢ عدد 漢字かな ǅ", "ﬁrm\u00a0of\u200bone", "ªº ʰa"]
    exact = regex.compile(terms.LETTERS)
    for text in odd:
        assert terms._finder(terms.LETTERS)(text) == [t.lower() for t in exact.findall(text)]
    assert terms._finder(r"\S+")("A b² C") == ["a", "b²", "c"] and terms._finder(terms.LETTERS)(None) == []
