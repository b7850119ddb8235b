import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.links import first_by, version_dedup
from tidemark.operators.panel import iteratively_demeaned
from tidemark.operators.portfolios import portfolio_of
from tidemark.operators.quantiles import exact_quantiles, quintile_within, rolling_members
from tidemark.operators.returns import abnormal_returns, drop_sentinels, forward_sums, trailing_moments, winsorized
from tidemark.operators.trading import asof_position, positions, shift_after_close
from tidemark.operators.vocab import rolling_vocabulary, term_totals, top_terms

D = lambda n: dt.date(2010, 1, 1) + dt.timedelta(days=int(n))


def daily(spark, n=400, seed=0, singular=False):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 2)) * 0.01
    if singular:
        x[:, 1] = 2 * x[:, 0]
    y = 0.001 + x @ [0.5, 1.5] + rng.normal(size=n) * 0.01
    rows = [(1, D(i * 2), float(y[i]), float(x[i, 0]), None if i % 37 == 5 else float(x[i, 1])) for i in range(n)]
    return rows, spark.createDataFrame(rows, "permno int, dt date, y double, a double, b double")


@pytest.mark.parametrize("singular", [False, True])
def test_rolling_regression_equals_lstsq(spark, singular):
    rows, df = daily(spark, singular=singular)
    fitted = abnormal_returns(trailing_moments(positions(df), "y", ("a", "b")), "y", ("a", "b"))
    got = {r.pos: r.ar for r in fitted.collect()}
    seen = 0
    for i, (_, _, y, a, b) in enumerate(rows):
        window = [r for r in rows[max(0, i - 257) : max(0, i - 5)] if r[4] is not None]
        if len(window) < 60:
            assert i not in got
            continue
        if b is None:
            assert got[i] is None
            continue
        beta = np.linalg.lstsq(np.array([[1, r[3], r[4]] for r in window]), np.array([r[2] for r in window]), rcond=None)[0]
        assert got[i] == pytest.approx(y - beta @ [1, a, b], abs=1e-9)
        seen += 1
    assert seen > 200


def test_exactly_sixty_observations(spark):
    _, df = daily(spark, 66)
    df = df.withColumn("b", F.lit(0.5) * F.rand(1))
    fitted = abnormal_returns(trailing_moments(positions(df), "y", ("a", "b")), "y", ("a", "b"))
    assert [r.pos for r in fitted.collect()] == [65]


def test_asof_and_shift(spark):
    days = positions(spark.createDataFrame([(1, D(0)), (1, D(3)), (1, D(7)), (2, D(1))], "permno int, dt date"))
    events = spark.createDataFrame([(1, D(-1)), (1, D(0)), (1, D(5)), (1, D(5)), (1, D(9)), (3, D(1)), (None, D(1)), (2, None)], "permno int, d date")
    back = asof_position(events, days, "d").toPandas()
    assert len(back) == 8
    assert sorted(back[back.permno == 1].pos.fillna(-1)) == [-1, 0, 1, 1, 2]
    ahead = asof_position(events, days, "d", "forward").toPandas()
    assert sorted(ahead[ahead.permno == 1].pos.fillna(-1)) == [-1, 0, 0, 2, 2]
    cases = spark.createDataFrame([(False, 1, 3, 2), (False, 2, 3, 2), (True, 1, 3, 1), (None, 1, 3, 1)], "b boolean, pos int, n int, expected int")
    assert all(r.x == r.expected for r in cases.withColumn("x", shift_after_close(F.col("b"), F.col("pos"), F.col("n"))).collect())


def test_forward_sum_needs_half_of_the_days(spark):
    rows = [(1, D(i), None if i in (2, 3) else 1.0) for i in range(6)]
    got = forward_sums(spark.createDataFrame(rows, "permno int, dt date, x double"), {"s": (F.col("x"), 4)}).orderBy("dt").collect()
    assert [r.s for r in got] == [2.0, 2.0, 2.0, 2.0, None, None]


def test_sentinels_and_winsor_keep_nulls(spark):
    df = spark.createDataFrame([("0.5",), ("-99",), ("-66.0",), ("x",), (None,), ("NaN",)], "r string")
    assert [r.r for r in drop_sentinels(df, "r").collect()] == [0.5]
    x = pd.Series([1.0, 2, 3, 4, 100, None])
    got = winsorized(spark.createDataFrame([(None if pd.isna(v) else v,) for v in x], "x double"), "x", 0.1, 0.9).toPandas().x
    expected = x.clip(x.quantile(0.1), x.quantile(0.9))
    assert np.allclose(np.sort(got.dropna()), np.sort(expected.dropna())) and got.isna().sum() == 1


@pytest.mark.parametrize("seed", range(4))
def test_quintiles_equal_qcut(spark, seed):
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 6 + 10 * seed, 60).astype(float) if seed % 2 == 0 else rng.normal(size=60)
    pdf = pd.DataFrame({"g": "a", "i": range(60), "x": x})
    pdf["expected"] = pd.qcut(pdf.x, 5, labels=False, duplicates="drop") + 1
    got = quintile_within(spark.createDataFrame(pdf), "g", "x").toPandas()
    assert (got.quintile == got.expected).all()


def test_rolling_members_are_observed_quarters(spark):
    quarters = [1, 2, 3, 5, 8, 9, 10, 12, 20, 21]
    got = rolling_members(spark.createDataFrame([(q,) for q in quarters] * 3, "q int"), "q").collect()
    assert sorted({r.test_quarter for r in got}) == [20, 21]
    assert sorted(r.train_quarter for r in got if r.test_quarter == 21) == quarters[1:9]


def test_version_dedup_and_first_by(spark):
    rows = [("e2", "c", "s", "2010"), ("e1", "c", "s", ""), ("e3", "c", "s", "2009"), ("e0", "c", "s", None), ("", "c", "s", "2000"), ("e9", "d", None, None)]
    df = spark.createDataFrame(rows, "event_id string, c string, s string, u string")
    assert sorted(r.event_id for r in version_dedup(df, ["c", "s"], "u", "event_id").collect()) == ["e3", "e9"]
    assert first_by(df.where("false"), ["c"], ["event_id"]).count() == 0


def test_demeaning_converges(spark):
    rng = np.random.default_rng(0)
    pdf = pd.DataFrame({"f": rng.integers(0, 5, 80), "t": rng.integers(0, 4, 80), "x": rng.normal(size=80)})
    got = iteratively_demeaned(spark.createDataFrame(pdf), ["f", "t"], ["x"], passes=60).toPandas()
    assert got.groupby("f").x.mean().abs().max() < 1e-7 and got.groupby("t").x.mean().abs().max() < 1e-7


def test_portfolio_fallback(spark):
    events = spark.createDataFrame([(1, 2010), (2, 2010), (3, 2010)], "permno int, y int")
    known = spark.createDataFrame([(1, 2010, "bihi"), (1, 2009, "smlo"), (2, 2009, "bilo")], "permno int, year int, portfolio string")
    assert {r.permno: r.portfolio for r in portfolio_of(events, known, "y").collect()} == {1: "bihi", 2: "bilo", 3: "smme"}


def test_sections_in_every_order(spark):
    p, q = "=====\nPresentation\n-----\n", "=====\nQuestions and Answers\n-----\n"
    cases = {p + "a" + q + "b": ("a", "b"), p + "a": ("a", ""), "x" + q + "b": ("x", "b"), "plain": ("plain", ""), q + "b" + p + "a": ("", "b" + p + "a"), "": ("", "")}
    df = spark.createDataFrame([(k,) for k in cases], "t string").withColumn("s", T.sections(F.col("t")))
    assert {r.t: (r.s.presentation.strip(), r.s.qa.strip()) for r in df.collect()} == cases


def test_text_functions(spark):
    row = spark.createDataFrame([("Revenue of 1,000.50 rose. Été a#b $x q# ", "PRT.OQ^F17", "12345678 9")], "t string, k string, c string").select(
        T.mask_numbers(F.col("t")).alias("m"), T.tokens(T.mask_numbers(F.col("t"))).alias("w"), T.clean_ticker(F.col("k")).alias("k"), T.cusip8(F.col("c")).alias("c"),
        T.bigrams(F.split(F.lit("a b c"), " ")).alias("b"), T.bigrams(F.split(F.lit("a"), " ")).alias("none"), T.word_count(F.lit(" a  b c ")).alias("n"),
        T.clean_speech(F.lit("Operator\n ----- [3] Hello \n\n  there")).alias("s"),
    ).first()
    assert row.m == "revenue of #,# rose. été a#b $x q# "
    assert row.w == ["revenue", "of", "rose", "été", "a#b", "x", "q"]
    assert (row.k, row.c, row.b, row.none, row.n, row.s) == ("PRT", "12345678", ["a b", "b c"], [], 3, "Hello there")


def test_vocabulary_uses_training_quarters_only(spark):
    docs = spark.createDataFrame([(1, "a a a"), (1, "b b b"), (2, "c c c c c"), (2, "a"), (2, None), (2, "")], "q int, t string")
    words = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit("[a-z]"), F.lit(0))
    totals = term_totals(docs, words)
    assert [tuple(r) for r in top_terms(totals, 2).collect()] == [("c", 5, 1), ("a", 4, 2)]
    terms = term_totals(docs, words, "q")
    members = spark.createDataFrame([(2, 1)], "test_quarter int, train_quarter int")
    assert sorted(r.term for r in rolling_vocabulary(terms, "q", members, 10, 1).collect()) == ["a", "b"]


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_exact_quantiles(spark, accuracy):
    rng = np.random.default_rng(0)
    x = np.where(rng.random(3000) < 0.3, 1.0, rng.normal(size=3000))
    pdf = pd.DataFrame({"g": [None if i % 5 == 0 else "ab"[i % 2] for i in range(3000)], "x": np.where(rng.random(3000) < 0.02, np.nan, x)})
    df = spark.createDataFrame([(g, None if np.isnan(v) else float(v)) for g, v in pdf.values], "g string, x double").repartition(4)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.995, 1.0]
    got = {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "x", probs, accuracy=accuracy).collect()}
    for g in (None, "a", "b"):
        own = pdf.x[pdf.g.isna() if g is None else pdf.g == g].dropna()
        assert np.allclose(got[g], own.quantile(probs), rtol=1e-12, atol=1e-15)
    assert np.allclose(exact_quantiles(df, [], "x", [0.5]).first().quantiles, pdf.x.quantile(0.5))
    assert exact_quantiles(df.where("x is null"), ["g"], "x", [0.5]).count() == 0
