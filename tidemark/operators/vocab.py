"""Vocabularies and term features as relations (document, term, count)."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = [Counter(w) if w else {} for w in batch.column(1).to_pylist()]
        where = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        terms = pa.array([t for c in counts for t in c], pa.string())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(where)), terms, pa.array([n for c in counts for n in c.values()], pa.int64())], names=["doc", "term", "tf"])


def term_table(docs: DataFrame, doc: str, words: Column, vocabulary: DataFrame | None = None) -> DataFrame:
    """doc, term, tf; of the vocabulary's terms only, if there is one. A row is a document, and its
    terms are counted within it: nothing is shuffled. Null ids and words give no rows."""
    rows = docs.select(F.col(doc).alias("doc"), words.alias("words")).where("doc is not null")
    counts = rows.mapInArrow(_counted, f"doc {rows.schema['doc'].dataType.simpleString()}, term string, tf bigint").withColumnRenamed("doc", doc)
    return counts.join(vocabulary.select("term"), "term", "left_semi") if vocabulary is not None else counts


def term_totals(docs: DataFrame, words: Column, *by: str) -> DataFrame:
    """by, term, tf, df. Each document gives its words and, apart, its distinct words, so that both
    counts combine on the map side by term alone and no (document, term) table is shuffled."""
    one = lambda tf, df: lambda w: F.struct(w.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df"))
    both = docs.withColumn("__w", words).select(*by, F.inline(F.concat(F.transform("__w", one(1, 0)), F.transform(F.array_distinct("__w"), one(0, 1)))))
    return both.groupBy(*by, "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))


def top_terms(totals: DataFrame, k: int = 1000, min_df: int = 1) -> DataFrame:
    """The k most frequent terms among those in at least min_df documents; ties by term."""
    return totals.where(F.col("df") >= min_df).orderBy(F.desc("tf"), "term").limit(k)


def rolling_vocabulary(quarterly: DataFrame, quarter: str, members: DataFrame, k: int = 1000, min_df: int = 5) -> DataFrame:
    """test_quarter, term, tf, df: per test quarter the k most frequent terms of its training quarters.

    quarterly has the totals of each quarter, so that eight overlapping windows read eight small tables
    and not eight times the documents."""
    trained = quarterly.join(F.broadcast(members), F.col(quarter) == F.col("train_quarter"))  # members: 8 rows per quarter
    counts = trained.groupBy("test_quarter", "term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
    best = Window.partitionBy("test_quarter").orderBy(F.desc("tf"), "term")
    return counts.where(F.col("df") >= min_df).withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def log_features(terms: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """The document terms that the vocabulary holds, with log1p of their counts."""
    return terms.join(vocabulary.select("term"), "term", "left_semi").withColumn("x", F.log1p("tf"))
