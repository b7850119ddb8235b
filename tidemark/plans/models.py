"""Text surprise: models over rolling windows, on n-grams and on embeddings."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from zlib import crc32

import numpy as np
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler, VectorSlicer
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.embed import embedded
from tidemark.operators.links import version_dedup
from tidemark.operators.model import CLASSES, class_index, elastic_net, inverse_penalties, log_odds_score, logit_score, rolling_scores
from tidemark.operators.quantiles import exact_quantiles, hfl, rolling_members
from tidemark.operators.trading import asof_position, positions
from tidemark.operators.vocab import rolling_vocabulary, term_totals, top_terms
from tidemark.plans.reports import interval_link_priority, quarter_events
from tidemark.sources import read_table, stored

#: The feature blocks, each with a vocabulary of its own.
BLOCKS = ("pres_words", "pres_pairs", "qa_words", "qa_pairs")


def with_blocks(texts: DataFrame) -> DataFrame:
    """The words of both sections without stop words, and their neighbouring pairs, in place of the texts."""
    words = lambda c: T.without(T.tokens(T.mask_numbers(F.col(c))))
    texts = texts.withColumns({"pres_words": words("presentation_text"), "qa_words": words("qa_text")})
    return texts.withColumns({"pres_pairs": T.bigrams(F.col("pres_words")), "qa_pairs": T.bigrams(F.col("qa_words"))}).drop("presentation_text", "qa_text")


def labelled_texts(spark: SparkSession, folder: str, within: int = 366) -> DataFrame:
    """Linked calls with both texts, and the abnormal return of the firm's first event on or after the call, if it is at most `within` days away. known is the year of that event: only from then
    on the return can be learned from. label is the class by the cutoff over all."""
    days = quarter_events(spark, folder).where("ar is not null").groupBy("permno", F.col("event_date").alias("dt")).agg(F.avg("ar").alias("ar"))
    days = stored(positions(days).select("permno", "dt", "pos", "ar"))
    calls = read_table(spark, folder, "transcripts").where("call_date is not null and coalesce(event_id, '') <> ''")
    # one version of each call; its texts are not needed to choose it
    kept = version_dedup(calls.select("event_id", "last_update", "call_date", "n_words_pres", "n_words_qa"), ["event_id"], "last_update", "event_id")
    linked = kept.join(interval_link_priority(spark, folder).select("event_id", "permno"), "event_id")
    placed = asof_position(linked, days, "call_date", "forward").join(days, ["permno", "pos"]).where(F.datediff("dt", "call_date") <= within)
    placed = stored(placed.select("event_id", "permno", "last_update", F.year("call_date").alias("year"), F.year("dt").alias("known"), "ar"))
    cut = exact_quantiles(placed, [], F.abs("ar"), [1 / 3], "cut")  # one row
    labelled = placed.join(F.broadcast(cut)).withColumn("label", class_index(hfl(F.col("ar"), F.col("cut")[0]))).drop("cut")
    # both sections of one version; of versions with one stamp the longest
    longest = F.max_by(F.struct("presentation_text", "qa_text"), F.struct(F.length(F.concat_ws("", "presentation_text", "qa_text")).alias("n"), F.xxhash64("presentation_text", "qa_text").alias("h")))
    same = (F.col("event_id") == F.col("__e")) & F.col("last_update").eqNullSafe(F.col("__u"))
    wanted = labelled.select(F.col("event_id").alias("__e"), F.col("last_update").alias("__u"))
    texts = calls.select("event_id", "last_update", "presentation_text", "qa_text").join(wanted, same, "left_semi").groupBy("event_id").agg(longest.alias("s")).select("event_id", "s.*")
    return labelled.drop("last_update").join(texts, "event_id")


def labelled_calls(spark: SparkSession, folder: str) -> DataFrame:
    """labelled_texts with words and pairs in place of the texts."""
    return with_blocks(labelled_texts(spark, folder))


def _log1p(v):
    return SparseVector(v.size, v.indices, np.log1p(v.values)) if isinstance(v, SparseVector) else DenseVector(np.log1p(v.toArray()))


def _block_features(df: DataFrame, vocabularies: dict[str, list[str]]) -> DataFrame:
    """df plus features: log1p of the counts of each block's terms, side by side. A block without terms
    is one column of zeros."""
    for b in BLOCKS:
        # no token is the empty word
        df = CountVectorizerModel.from_vocabulary(vocabularies[b] or [""], inputCol=b, outputCol=f"__{b}").transform(df)
    counts = VectorAssembler(inputCols=[f"__{b}" for b in BLOCKS], outputCol="__counts").transform(df)
    return counts.withColumn("features", F.udf(_log1p, VectorUDT())("__counts")).drop("__counts", *BLOCKS, *[f"__{b}" for b in BLOCKS])


def _ngram_features(df: DataFrame, terms: int = 1000, min_df: int = 5) -> DataFrame:
    df = stored(df)
    # 1,000 terms a block
    vocabularies = {b: [r.term for r in top_terms(term_totals(df, F.col(b)), terms, min_df).collect()] for b in BLOCKS}
    # written once: fitting reads it many times
    return stored(_block_features(df, vocabularies))


def en_multinomial_score(spark: SparkSession, folder: str) -> DataFrame:
    """In-sample scores; the penalty by cross-validated log loss."""
    calls = _ngram_features(labelled_calls(spark, folder))
    model = elastic_net(calls, folds=10)
    return model.transform(calls).select("event_id", "permno", log_odds_score(F.col("rawPrediction")).alias("score"))


def logit_score_v1(spark: SparkSession, folder: str) -> DataFrame:
    """In-sample scores; C from a grid by five folds, features as they are."""
    calls = _ngram_features(labelled_calls(spark, folder))
    model = elastic_net(calls, inverse_penalties(calls, np.logspace(-3, 1, 10).tolist()), folds=5, standardization=False)
    return model.transform(calls).select("event_id", "permno", logit_score(F.col("probability")).alias("score"))


def _window_labels(calls: DataFrame, members: DataFrame) -> Callable[[DataFrame, int], DataFrame]:
    """What gives a window's rows: those of its test year and later, those whose return was known before
    it, and as label the class by the cutoff of its training calls."""
    trained = calls.join(F.broadcast(members), F.col("year") == F.col("train_quarter")).where("known < test_quarter")  # members: eight rows per year
    cuts = {r.test_quarter: r.cut[0] for r in exact_quantiles(trained, ["test_quarter"], F.abs("ar"), [1 / 3], "cut").collect()}  # a row per year

    def own(df: DataFrame, test: int) -> DataFrame:
        # a return that is known only in the test year, or later, can't be learned from
        learned = df.where((F.col("year") >= test) | (F.col("known") < test))
        return learned.withColumn("label", class_index(hfl(F.col("ar"), F.lit(cuts.get(test)).cast("double"))))

    return own


def _window_features(calls: DataFrame, members: DataFrame, terms: int = 1000, min_df: int = 5) -> tuple[DataFrame, Callable[[DataFrame, int], DataFrame]]:
    """calls with features over the terms of all windows, and what gives a window's own: the features over
    the vocabularies of its training years, the labels by the cutoff of its training calls.

    So each call's terms are counted once, and a window picks its columns."""
    best: dict[int, dict[str, list[str]]] = {}
    for b in BLOCKS:
        of_block = rolling_vocabulary(term_totals(calls, F.col(b), "year"), "year", members, terms, min_df)
        for row in of_block.groupBy("test_quarter").agg(F.sort_array(F.collect_list("term")).alias("terms")).collect():  # a row of 1,000 terms per year
            best.setdefault(row.test_quarter, {})[b] = row.terms
    every = {b: sorted({t for w in best.values() for t in w.get(b, [])}) for b in BLOCKS}
    at, columns = {}, 0
    for b in BLOCKS:
        at |= {(b, t): columns + i for i, t in enumerate(every[b])}
        columns += max(1, len(every[b]))
    labelled = _window_labels(calls, members)

    def own(featured: DataFrame, test: int) -> DataFrame:
        kept = [at[b, t] for b in BLOCKS for t in best.get(test, {}).get(b, [])] or [0]
        sliced = VectorSlicer(inputCol="all_features", outputCol="features", indices=kept).transform(featured)
        return labelled(sliced.drop("all_features"), test)

    return _block_features(calls.drop("label"), every).withColumnRenamed("features", "all_features"), own


def rolling_score(spark: SparkSession, folder: str) -> DataFrame:
    """Each year's calls, scored by a model of the eight years before; vocabularies and class cutoff are those years' too."""
    calls = stored(labelled_calls(spark, folder))
    members = rolling_members(calls, "year", 8)
    featured, own = _window_features(calls, members)
    scored = rolling_scores(featured, members, "year", own=own, folds=10)
    return scored.select("event_id", "year", log_odds_score(F.col("rawPrediction")).alias("score"))


def embedding_score(spark: SparkSession, folder: str) -> DataFrame:
    """Vectors instead of n-grams: class by label, a period per vector."""
    e = read_table(spark, folder, "embeddings")
    e = e.select("vec_id", (F.col("vec_id") % 12).alias("period"), F.element_at(F.array(*map(F.lit, CLASSES.values())), (F.col("label") % 3 + 1).cast("int")).alias("label"), array_to_vector("embedding").alias("features"))
    scored = rolling_scores(e, rolling_members(e, "period", 8), "period", folds=10)
    return scored.select("vec_id", "period", log_odds_score(F.col("rawPrediction")).alias("score"))


def hashed_words(texts: list[str], size: int = 128, window: int = 512) -> list[list[float]]:
    """An embedder without a model: words hashed with a sign into `size` places, log1p of a window's
    counts per word, the windows of at most 512 words pooled by their mean, the vector brought to length
    one. Texts are read whole; one without words is all zeros."""
    places: dict[str, tuple[int, float]] = {}
    vectors = np.zeros((len(texts), size))
    for vector, text in zip(vectors, texts, strict=True):
        words = re.findall(r"\w+", text.lower())
        for begin in range(0, len(words), window):
            for word, n in Counter(words[begin : begin + window]).items():
                if word not in places:
                    code = crc32(word.encode())
                    places[word] = code % size, 1.0 if code & 1 << 31 else -1.0
                at, sign = places[word]
                vector[at] += sign * np.log1p(n)
    # the mean's divisor falls out with the length
    lengths = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, lengths, out=vectors, where=lengths > 0).tolist()


def call_embedding_score(spark: SparkSession, folder: str) -> DataFrame:
    """rolling_score with an embedding of both sections as features."""
    calls = labelled_texts(spark, folder).drop("label").withColumn("said", T.joined(F.col("presentation_text"), F.col("qa_text")))
    calls = embedded(calls.drop("presentation_text", "qa_text"), "said", hashed_words).drop("said")
    calls = stored(calls.withColumn("features", array_to_vector("embedding")).drop("embedding"))
    members = rolling_members(calls, "year", 8)
    scored = rolling_scores(calls, members, "year", own=_window_labels(calls, members), folds=10)
    return scored.select("event_id", "year", log_odds_score(F.col("rawPrediction")).alias("score"))


def embed_udf(spark: SparkSession, folder: str) -> DataFrame:
    return embedded(read_table(spark, folder, "documents").select("doc_id", "text"), "text", hashed_words).select("doc_id", "embedding")


QUERIES = {
    "en_multinomial_score": en_multinomial_score, "logit_score_v1": logit_score_v1, "rolling_score": rolling_score, "embedding_score": embedding_score, "call_embedding_score": call_embedding_score,
    "embed_udf": embed_udf,
}
ORACLES: dict[str, str] = {}
