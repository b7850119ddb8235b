"""Text models: feature blocks, windows and penalties on small cases."""

import numpy as np
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from tests.harness import DATA
from tidemark.operators.model import elastic_net, inverse_penalties, lambda_path, log_odds_score, logit_score, rolling_scores
from tidemark.plans import models


def _dense(df, *keys):
    return {tuple(r[k] for k in keys): r.features.toArray() for r in df.collect()}


def test_features_of_both_sections(spark):
    texts = [(i, "the margin rose", None) for i in range(5)] + [(i, None, "We saw growth, growth of 5 stores") for i in range(5, 10)] + [(10, "", "")]
    calls = models.with_blocks(spark.createDataFrame(texts, "event_id int, presentation_text string, qa_text string"))
    got = _dense(models._ngram_features(calls), "event_id")
    # presentation: margin, rose | margin rose; questions: growth, saw, stores | growth growth, growth stores, saw growth
    assert np.allclose(got[(0,)], [np.log(2)] * 3 + [0] * 6)
    assert np.allclose(got[(7,)], [0] * 3 + [np.log(3)] + [np.log(2)] * 5)
    assert not got[(10,)].any()


def test_a_block_without_terms_is_one_column_of_zeros(spark):
    calls = models.with_blocks(spark.createDataFrame([(i, "rose", None) for i in range(5)], "event_id int, presentation_text string, qa_text string"))
    assert np.allclose(_dense(models._ngram_features(calls), "event_id")[(0,)], [np.log(2), 0, 0, 0])


def test_vocabulary_and_cutoff_of_the_training_years_only(spark):
    """A word of the test year or of a year before the window is no feature; the cutoff is the window's."""
    said = {2001: "ancient", 2002: "margin", 2003: "margin", 2004: "future"}
    texts = [(f"{y}-{i}", y, float(i + 1) * (1000 if y in (2001, 2004) else 1), w, w) for y, w in said.items() for i in range(6)]
    calls = models.with_blocks(spark.createDataFrame(texts, "event_id string, year int, ar double, presentation_text string, qa_text string")).withColumns({"label": F.lit(0.0), "known": F.col("year")})
    members = spark.createDataFrame([(2003, 2001), (2003, 2002), (2004, 2002), (2004, 2003)], "test_quarter int, train_quarter int")
    featured, own = models._window_features(calls, members)
    got = own(featured, 2004)
    x = _dense(got, "event_id")
    # margin in the presentation, margin in the questions
    assert np.allclose(x[("2002-0",)], [np.log(2)] * 2) and not x[("2004-0",)].any() and not x[("2001-0",)].any()
    cut = np.quantile([*range(1, 7)] * 2, 1 / 3)
    labels = {r.event_id: r.label for r in got.where("year = 2003").collect()}
    assert labels == {f"2003-{i}": 2.0 if i + 1 > cut else 1.0 for i in range(6)}
    assert {len(v) for v in _dense(own(featured, 2003), "event_id").values()} == {4}


def _three_classes(spark, n=150):
    rng = np.random.default_rng(1)
    y = rng.integers(0, 3, n)
    x = rng.normal(size=(n, 4)) * [1, 10, 1, 1]
    x[:, 0] += 0.5 * y
    return spark.createDataFrame([(float(a), [float(v) for v in b]) for a, b in zip(y, x, strict=True)], "label double, x array<double>").select("label", array_to_vector("x").alias("features")), x, y


def test_lambda_path_begins_where_the_first_feature_comes_in(spark):
    train, _, _ = _three_classes(spark)
    path = lambda_path(train)
    assert len(path) == 100 and np.isclose(path[-1] / path[0], 1e-4)
    used = lambda x: np.abs(elastic_net(train, [x]).coefficientMatrix.toArray()).max()
    assert used(path[0] * 1.01) < 1e-9 < used(path[0] * 0.9)


def test_penalty_is_chosen(spark):
    train, _, _ = _three_classes(spark)
    # a penalty that leaves nothing in the model comes first: it must not win
    for how in ({"folds": 3}, {"folds": 1}, {"folds": 1, "metric": "accuracy"}, {"folds": 3, "standardization": False}):
        assert np.abs(elastic_net(train, [5.0, 0.01], **how).coefficientMatrix.toArray()).max() > 0.01
    assert np.allclose(inverse_penalties(train, [0.1, 10]), [1 / 15, 1 / 1500])


def test_rolling_windows_cross_validate(spark, monkeypatch):
    """The queries ask for ten folds over the path, and pass no penalty of their own."""
    asked = []
    monkeypatch.setattr(models, "rolling_scores", lambda events, members, quarter, *a, **k: asked.append((a, k.get("folds"), k.get("least_train", 100))) or events.withColumn("rawPrediction", F.col(features_of(events))))
    features_of = lambda e: "all_features" if "all_features" in e.columns else "features"
    models.rolling_score(spark, DATA), models.embedding_score(spark, DATA)
    assert asked == [((), 10, 100)] * 2


def test_fit_meets_the_optimality_conditions(spark):
    """The gradient of the mean loss and the penalty cancel out, on features as they are."""
    train, x, y = _three_classes(spark)
    lam, alpha = 0.05, 0.5
    m = elastic_net(train, [lam], alpha, standardization=False, iterations=500)
    w, b = m.coefficientMatrix.toArray(), m.interceptVector.toArray()
    link = x @ w.T + b
    p = np.exp(link - link.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    gradient = (p - np.eye(3)[y]).T @ x / len(y) + lam * (1 - alpha) * w
    assert np.allclose(gradient[w != 0], -lam * alpha * np.sign(w[w != 0]), atol=1e-3)
    assert (np.abs(gradient[w == 0]) <= lam * alpha + 1e-3).all() and (w == 0).any() and (w != 0).any()
    got = m.transform(train).select(log_odds_score(F.col("rawPrediction")).alias("odds"), logit_score(F.col("probability")).alias("logit")).toPandas()
    assert np.allclose(got["odds"], np.log(p[:, 2]) - np.log(p[:, 0]), atol=1e-6)
    assert np.allclose(got["logit"], np.log(p[:, 2] / (1 - p[:, 2])) - np.log(p[:, 0] / (1 - p[:, 0])), atol=1e-6)


def test_nothing_of_the_test_year_changes_a_score(spark):
    """Neither its words, nor its returns, nor a return of a training call that is known only then."""
    rng = np.random.default_rng(2)
    words = "margin growth loss charge demand price backlog".split()
    rows = [
        (f"{y}-{i}", y, y, float(rng.normal()), " ".join(rng.choice(words, 6)), " ".join(rng.choice(words, 6))) for y in (2001, 2002, 2003) for i in range(60)
    ]
    late = [("late", 2002, 2003, 99.0, "margin loss", "price")]

    def scores(rows):
        calls = models.with_blocks(spark.createDataFrame(rows, "event_id string, year int, known int, ar double, presentation_text string, qa_text string")).withColumn("label", F.lit(0.0))
        members = spark.createDataFrame([(2003, 2001), (2003, 2002)], "test_quarter int, train_quarter int")
        featured, own = models._window_features(calls, members)
        scored = rolling_scores(featured, members, "year", [0.02], own=own)
        return {r.event_id: r.s for r in scored.select("event_id", log_odds_score(F.col("rawPrediction")).alias("s")).collect()}

    base = scores(rows + late)
    assert len(base) == 60 and len(set(base.values())) > 10
    told = [(e, y, k, -ar if y == 2003 else ar, "unheard of " * 50 if e == "2003-0" else p, q) for e, y, k, ar, p, q in rows]
    again = scores(told + [("late", 2002, 2003, -99.0, "margin loss", "price")])
    assert {e for e in base if abs(base[e] - again[e]) > 1e-9} <= {"2003-0"}


def test_embedder_reads_windows_of_whole_texts():
    one, other, both, empty = models.hashed_words(["margin growth growth", "backlog", "margin growth growth backlog", " ?! "], size=1024)
    mixed = np.array(one) * np.sqrt(np.log1p(1) ** 2 + np.log1p(2) ** 2) + np.array(other) * np.log1p(1)
    assert np.allclose(both, mixed / np.linalg.norm(mixed)) and not np.any(empty)
    # a word far behind the first window counts, and a window's counts are damped by themselves
    long, short = models.hashed_words(["a " * 512 + "b " * 512, "a b"])
    assert np.allclose(long, short) and models.hashed_words([]) == []


def test_embedding_windows_learn_from_what_was_known(spark):
    rows = [(f"{y}-{i}", y, known, ar) for y, known in ((2001, 2001), (2002, 2003)) for i, ar in enumerate((-3.0, 0.1, 3.0))] + [("t", 2003, 2003, 9.0)]
    calls = spark.createDataFrame(rows, "event_id string, year int, known int, ar double")
    own = models._window_labels(calls, spark.createDataFrame([(2003, 2001), (2003, 2002)], "test_quarter int, train_quarter int"))
    got = {r.event_id: r.label for r in own(calls, 2003).collect()}
    assert got == {"2001-0": 0.0, "2001-1": 1.0, "2001-2": 2.0, "t": 2.0}
