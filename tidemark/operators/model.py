"""Elastic-net multinomial models over rolling windows, and their scores."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.sources import stored

#: The class indices of low, flat and high abnormal returns.
CLASSES = {"L": 0.0, "F": 1.0, "H": 2.0}


def class_index(category: Column) -> Column:
    return F.create_map(*[F.lit(x) for pair in CLASSES.items() for x in pair])[category]


def lambda_path(train: DataFrame, alpha: float = 0.5, standardization: bool = True, n: int = 100) -> list[float]:
    """n penalties in even ratios, from the least that leaves no feature in the model down to a ten
    thousandth of it, or a hundredth if there are fewer rows than features."""
    both = train.groupBy("label").agg(F.count("*").alias("n"), Summarizer.mean(F.col("features")).alias("mean")).collect()  # three rows
    rows = sum(r.n for r in both)
    mean = sum(r.n / rows * r.mean.toArray() for r in both)
    # the gradient of the mean loss where all coefficients are zero, for each class and feature
    gradient = np.array([r.n / rows * (r.mean.toArray() - mean) for r in both])
    if standardization:
        sd = train.agg(Summarizer.std(F.col("features")).alias("sd")).first().sd.toArray()
        gradient = np.divide(gradient, sd, out=np.zeros_like(gradient), where=sd > 0)
    most = np.abs(gradient).max() / alpha
    return (most * np.geomspace(1, 0.01 if rows < len(mean) else 1e-4, n)).tolist() if most > 0 else [0.0]


def inverse_penalties(train: DataFrame, cs: Sequence[float]) -> list[float]:
    """The penalties of a loss that is summed, not averaged, and multiplied by C."""
    n = train.count()
    return [1 / (c * n) for c in cs]


def elastic_net(
    train: DataFrame, lambdas: Sequence[float] | None = None, alpha: float = 0.5, folds: int = 1, seed: int = 42, iterations: int = 50,
    standardization: bool = True, metric: str = "logLoss", parallelism: int = 8, penalties: int = 10,
):
    """A multinomial model; with several lambdas the one of best cross-validated metric (least log loss,
    greatest accuracy), or of best metric on the training rows if folds is 1. Without lambdas, `penalties` of lambda_path."""
    # a task for about every 10,000 rows: of a small window's, an iteration is one task and not one per core
    train = train.coalesce(1 + train.count() // 10_000)
    lambdas = lambda_path(train, alpha, standardization, penalties) if lambdas is None else list(lambdas)
    lr = LogisticRegression(family="multinomial", elasticNetParam=alpha, standardization=standardization, maxIter=iterations, regParam=lambdas[0])
    if len(lambdas) == 1:
        return lr.fit(train)
    measure = MulticlassClassificationEvaluator(metricName=metric)
    if folds < 2:
        fits = [lr.copy({lr.regParam: x}).fit(train) for x in lambdas]
        found = [measure.evaluate(m.transform(train)) for m in fits]
        return fits[int(np.argmax(found) if measure.isLargerBetter() else np.argmin(found))]
    grid = ParamGridBuilder().addGrid(lr.regParam, lambdas).build()
    return CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=measure, numFolds=folds, seed=seed, parallelism=parallelism).fit(train).bestModel


def log_odds_score(raw: Column) -> Column:
    """ln P(H) - ln P(L): the difference of the links."""
    link = vector_to_array(raw)
    return link[2] - link[0]


def logit_score(probability: Column) -> Column:
    """logit P(H) - logit P(L), probabilities kept off 0 and 1."""
    p = vector_to_array(probability)
    clipped = lambda i: F.least(F.greatest(p[i], F.lit(1e-10)), F.lit(1 - 1e-10))
    return F.ln(clipped(2) / (1 - clipped(2))) - F.ln(clipped(0) / (1 - clipped(0)))


def rolling_scores(
    events: DataFrame, members: DataFrame, quarter: str, lambdas: Sequence[float] | None = None, least_train: int = 100, own: Callable[[DataFrame, int], DataFrame] | None = None, **fit
) -> DataFrame:
    """Each test quarter's events scored by a model of its training quarters only.

    events has features, label (class index) and the quarter; or own gives, for a test quarter, events
    with the features and labels of its window. A window without 100 rows or without all
    of the classes H and L is skipped, and so are empty test quarters. Windows are few (a quarter
    each): the driver loops over them, the work of each is Spark's.
    """
    windows: dict[int, list[int]] = {}
    for row in members.collect():  # eight rows per quarter
        windows.setdefault(row.test_quarter, []).append(row.train_quarter)
    events = stored(events)
    scored = []
    for test, train in sorted(windows.items()):
        window = own(events, test) if own else events
        trained, tested = window.where(F.col(quarter).isin(train)), window.where(F.col(quarter) == test)
        n = dict.fromkeys(CLASSES.values(), 0) | {r[0]: r[1] for r in trained.groupBy("label").count().collect()}  # three rows
        if sum(n.values()) < least_train or not n[CLASSES["H"]] or not n[CLASSES["L"]] or tested.isEmpty():
            continue
        scored.append(elastic_net(trained, lambdas, **fit).transform(tested))
    if not scored:
        model_columns = {"rawPrediction": F.col("features"), "probability": F.col("features"), "prediction": F.col("label")}
        return (own(events, 0) if own else events).withColumns(model_columns).where("false")
    return reduce(DataFrame.unionByName, scored)
