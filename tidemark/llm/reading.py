"""Reading level of each document.

Graded texts tell at which grade a word is acquired: its mean band over the bands' shares of texts
that use it. A document's level is read from the quantiles of its known words' grades, calibrated
on the graded documents. Language is decided by function words, whatever the record says; which
words those are is learned from the records' own, unreliable, labels.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator, Mapping
from itertools import repeat
from math import log

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.sources import stored

#: Function words that tell languages apart where no labels do, all of one weight.
FUNCTION_WORDS = {
    "en": dict.fromkeys("the of and to in is that it for was on are with as at be this have from or had by but not what were we there can an they which you will if more when so no our has its us than how did does do them their these those his her my your i he she".split(), 1.0),
    "de": dict.fromkeys("der die das und ist von zu den mit sich des auf für nicht ein eine einer dem im wird sind auch als wir uns nach bei aus wie werden wurde haben hat war durch über noch einen oder am zum zur".split(), 1.0),
    "fr": dict.fromkeys("le la les de des et est en un une du que qui dans pour par sur au aux avec ce cette ces nous vous il elle sont été plus ne pas se son sa ses notre nos mais ou ont leur".split(), 1.0),
    "es": dict.fromkeys("el la los las de y en que es un una del por con para su sus al se no lo como más pero fue ha han son este esta estos estas nuestro nuestra nos entre sobre desde también".split(), 1.0),
}
QUANTILES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)

_TAG = regex.compile(r"<[^<>\n]{1,60}>")
_WORD, _PLAIN_WORD = regex.compile(r"\p{L}+"), re.compile("[a-z]+")


def words_of(text: str) -> list[str]:
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if text.isascii():
        return _PLAIN_WORD.findall(text.lower())
    return [w.lower() for w in _WORD.findall(unicodedata.normalize("NFKC", text))]


def quantiles_of(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """The quantiles of a few values, between neighbours by their distance; for small arrays numpy's own are dear."""
    values = np.sort(values)
    at = cuts * (len(values) - 1)
    low = at.astype(np.int64)
    below = values[low]
    return below + (at - low) * (values[np.minimum(low + 1, len(values) - 1)] - below)


def is_english(words: list[str], known: Mapping[str, Mapping[str, float]] = FUNCTION_WORDS) -> bool:
    """Whether English function words are frequent, and weigh more than those of each other language."""
    weight = {lang: sum(map(own.get, words, repeat(0.0))) for lang, own in known.items()}
    frequent = sum(map(known["en"].__contains__, words)) >= 0.08 * len(words)
    return frequent and all(weight["en"] > w for lang, w in weight.items() if lang != "en")


def _explode_words(kind: pa.DataType):
    def distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bands, words = [], []
            for text, band in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = sorted(set(words_of(text or "")))
                words += own
                bands += [band] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(bands, pa.int32()), pa.array(words, pa.string())], names=["band", "word"])

    return distinct_words


def _profile(grades, languages, least_words: int, least_pieces: int, schema: pa.Schema):
    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, spoken, cuts = grades.value, languages.value, np.array(QUANTILES)
        middle = float(np.median(list(known.values()))) if known else 0.0
        for batch in batches:
            ids, rows = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text or len(text.split()) < least_pieces:
                    continue
                words = words_of(text)
                if not is_english(words, spoken):
                    continue
                own = np.array([g for g in map(known.get, words) if g is not None])
                ids.append(key)
                rows.append((quantiles_of(own, cuts) if len(own) >= least_words else np.full(len(cuts), middle)).tolist())
            yield pa.RecordBatch.from_arrays([pa.array(ids, schema.field(0).type), pa.array(rows, schema.field(1).type)], schema=schema)

    return profiles


def boundary(quantiles: np.ndarray, above: np.ndarray) -> tuple[int, float]:
    """The quantile, and the value in the middle of its widest gap, that contradict the fewest graders."""
    best = None
    for at in range(quantiles.shape[1]):
        order = np.argsort(quantiles[:, at], kind="stable")
        values, up = quantiles[order, at], above[order]
        wrong = np.cumsum(up)[:-1] + (np.sum(~up) - np.cumsum(~up)[:-1])
        gaps = np.diff(values)
        wrong = np.where(gaps > 0, wrong, len(values) + 1)
        if not len(gaps):
            continue
        i = int(np.lexsort((-gaps, wrong))[0])
        found = (int(wrong[i]), abs(at - quantiles.shape[1] // 2), -float(gaps[i]), at, float((values[i] + values[i + 1]) / 2))
        best = min(best, found) if best else found
    return (best[3], best[4]) if best else (0, np.inf)


def function_words(documents: DataFrame, text: str, language: str, most: int, per_language: int = 300, least_share: float = 0.02, least_docs: int = 20) -> Mapping[str, Mapping[str, float]]:
    """Per language the words that the largest share of its documents hold, each with the logarithm of that
    share over least_share as weight, so that wrong labels only lessen the weights; learned from at most `most` labelled documents, those first by hash.

    A label counts up to its first sign that is no letter, in any case; all labels beginning with "en" are
    one language. Languages of fewer than least_docs documents in the sample are left out. Without enough
    English ones the fixed lists hold."""
    name = F.regexp_extract(F.lower(F.trim(language)), r"^\p{L}+", 0)
    name = F.when(name.startswith("en"), "en").otherwise(name)
    labelled = documents.select(F.xxhash64(text).alias("h"), F.col(text).alias("text"), name.alias("lang")).where("lang <> '' and text is not null")
    # the hashes first, so that the sample is drawn without its texts
    drawn = stored(labelled.select("h", "lang").distinct().orderBy("h", "lang").limit(most))
    sizes = drawn.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).orderBy(F.desc("n"), "lang").collect()  # at most `most` / least_docs rows
    codes = {r.lang: i for i, r in enumerate(sizes)}
    if "en" not in codes:
        return FUNCTION_WORDS
    code = F.create_map(*[F.lit(x) for pair in codes.items() for x in pair])[F.col("lang")].cast("int")
    texts = labelled.join(F.broadcast(drawn), ["h", "lang"], "left_semi").dropDuplicates(["h", "lang"]).select("text", code.alias("code")).where("code is not null")
    held = texts.mapInArrow(_explode_words(pa.int32()), "band int, word string").groupBy("band", "word").count()
    first = Window.partitionBy("band").orderBy(F.desc("count"), "word")
    rows = held.withColumn("r", F.row_number().over(first)).where(F.col("r") <= per_language).collect()  # per_language rows a language
    learned: dict[str, dict[str, float]] = {lang: {} for lang in codes}
    for row in rows:
        lang, docs = sizes[row.band]
        if row["count"] > least_share * docs:
            learned[lang][row.word] = log(row["count"] / docs / least_share)
    return learned


def graded_documents(labels: DataFrame, doc_id: str, band: str, most: int) -> DataFrame:
    """id, band: the band most graders gave (ties: none), of at most `most` documents, those first by hash."""
    votes = labels.where(f"{doc_id} is not null and {band} is not null").distinct().groupBy(F.col(doc_id).alias("id"), F.col(band).cast("int").alias("band")).count()
    order = Window.partitionBy("id").orderBy(F.desc("count"))
    first = votes.withColumns({"r": F.row_number().over(order), "next": F.lead("count").over(order)})
    agreed = first.where("r = 1 and (next is null or next < count)").select("id", "band")
    return agreed.orderBy(F.xxhash64("id")).limit(most)


def word_grades(graded: DataFrame, most_words: int, least_docs: int) -> DataFrame:
    """word, grade: the mean band, every band's documents weighing alike; graded has text and band."""
    sizes = graded.groupBy("band").agg(F.count("*").alias("docs"))
    held = graded.select("text", "band").mapInArrow(_explode_words(pa.int32()), "band int, word string").groupBy("word", "band").count()
    shares = held.join(F.broadcast(sizes), "band").withColumn("share", F.col("count") / F.col("docs"))
    grades = shares.groupBy("word").agg(
        (F.sum(F.col("band") * F.col("share")) / F.sum("share")).alias("grade"), F.sum("count").alias("n")
    )
    return grades.where(F.col("n") >= least_docs).orderBy(F.desc("n"), "word").limit(most_words).select("word", "grade")


def reading_bands(
    documents: DataFrame,
    labels: DataFrame,
    doc: tuple[str, str] = ("doc_id", "text"),
    label: tuple[str, str] = ("doc_id", "band"),
    least_pieces: int = 40,
    least_words: int = 10,
    most_labels: int = 50_000,
    most_words: int = 500_000,
    least_docs: int = 2,
    language: str | None = None,
    most_labelled: int = 5_000,
) -> DataFrame:
    """id, band of every English document of at least least_pieces pieces between white space.

    The model is fitted on at most most_labels graded documents and knows at most most_words words,
    those in most of them; every document is graded. Null or empty texts have no band. Documents with
    fewer than least_words known words count as of the middle grade. Labels are votes: null bands
    are skipped, copies count once, graders that tie say nothing. Without labels, or with labels of a
    single band, that band (or none) is given. language names a column of language labels, from at most
    most_labelled of which the function words are learned; without it fixed lists hold. Copies of a document each come out; ids must be unique.
    """
    spark = documents.sparkSession
    texts = documents.select(F.col(doc[0]).alias("id"), F.col(doc[1]).alias("text"))
    agreed = stored(graded_documents(labels, *label, most_labels))
    grades = word_grades(texts.join(agreed, "id"), most_words, least_docs)
    known = {row.word: row.grade for row in grades.collect()}  # at most most_words rows
    from pyspark.sql.pandas.types import to_arrow_type

    kind = texts.schema["id"].dataType
    schema = pa.schema([("id", to_arrow_type(kind)), ("q", pa.list_(pa.float64()))])
    spoken = function_words(documents, doc[1], language, most_labelled) if language else FUNCTION_WORDS
    profile = _profile(spark.sparkContext.broadcast(known), spark.sparkContext.broadcast(spoken), least_words, least_pieces, schema)
    profiles = texts.mapInArrow(profile, f"id {kind.simpleString()}, q array<double>")
    seen = texts.join(agreed, "id", "left_semi").mapInArrow(profile, f"id {kind.simpleString()}, q array<double>").join(agreed, "id")
    rows = seen.select("q", "band").collect()  # at most most_labels rows
    bands = sorted({row.band for row in rows})
    if not bands:
        return profiles.select("id", F.lit(None).cast("int").alias("band")).where("band is not null")
    quantiles, given = np.array([row.q for row in rows]), np.array([row.band for row in rows])
    band = F.lit(bands[0])
    for low, high in zip(bands, bands[1:]):
        at, bound = boundary(quantiles, given > low)
        band = band + F.when(F.get("q", F.lit(at)) > bound, high - low).otherwise(0)
    return profiles.select("id", band.cast("int").alias("band"))
