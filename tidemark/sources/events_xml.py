"""Event documents: XML files, plain or in zip archives, into typed rows."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.stamps import with_stamp
from tidemark.functions.text import clean_speech, sections, word_count
from tidemark.operators.links import version_dedup

#: The fields of a row, and the tags of the documents they are read from.
_FIELDS = "event_id string, last_update string, story_version string, headline string, body string, company_name string, ticker string, company_id string, start_date_str string, cusip string, isin string"
_TAGS = {"company_name": "companyName", "ticker": "companyTicker", "company_id": "companyId", "start_date_str": "startDate", "cusip": "CUSIP", "isin": "ISIN"}


def _event(xml: bytes | str | None) -> dict | None:
    """The fields of one earnings call, or None for other events, blank bodies and broken files."""
    try:
        root = ElementTree.fromstring(xml)
        story = root.find(".//EventStory")
        body = story.find("Body") if story is not None else None
        if root.get("eventTypeId") != "1" or body is None:
            return None
        said = " ".join(body.itertext())
        if not said.strip():
            return None
        text = lambda node: (node.text or "").strip() if node is not None else ""
        own = {name: text(root.find(f".//{tag}")) for name, tag in _TAGS.items()}
        return own | {
            "event_id": root.get("Id", ""), "last_update": root.get("lastUpdate", ""), "story_version": story.get("version", ""),
            "headline": text(story.find("Headline")), "body": said,
        }
    except (ElementTree.ParseError, TypeError, ValueError):
        return None


def _events(xml: pd.Series) -> pd.DataFrame:
    names = [f.split()[0] for f in _FIELDS.split(", ")]
    return pd.DataFrame([_event(x) or dict.fromkeys(names) for x in xml], columns=names)


def parsed_event(xml: Column | str) -> Column:
    """The event of an XML text as a struct; all its fields are null for whatever is no earnings call."""
    return F.pandas_udf(_events, _FIELDS)(xml)


def xml_files(spark: SparkSession, path: str) -> DataFrame:
    """path, xml of every *_T.xml file below the path."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*_T.xml", recursiveFileLookup=True)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("xml"))


def zipped_xml_files(spark: SparkSession, path: str) -> DataFrame:
    """path, xml of every *_T.xml member of the zip archives below the path; nothing is unpacked to disk."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", True).load(path)

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for where, content in zip(pdf["path"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for name in archive.namelist():
                        if name.endswith("_T.xml"):
                            yield pd.DataFrame({"path": [f"{where}!{name}"], "xml": [archive.read(name).decode("utf-8", "replace")]})

    return archives.select("path", "content").mapInPandas(members, "path string, xml string")


def start_in_new_york(df: DataFrame, stamp: str = "start_date_str", headline: str = "headline") -> DataFrame:
    """df plus call_date and is_before_close. A stamp whose zone is EST or EDT keeps its wall clock;
    one without zone or labelled GMT or ET counts as UTC, one with another zone is taken at its word;
    both are moved to New York. Without a readable stamp
    the day comes from the headline and the hour stays unknown."""
    s = F.upper(F.trim(F.coalesce(stamp, F.lit(""))))
    bare = F.regexp_replace(s, r"\s*\b(GMT|EST|EDT|ET)$", "")
    df = with_stamp(df.withColumn("__bare", bare), "__bare", "__read")
    clock = F.col("__read.clock")
    there = F.when(s.rlike(r"\b(EST|EDT)\b"), clock).otherwise(
        F.convert_timezone(F.lit("UTC"), F.lit("America/New_York"), F.coalesce("__read.utc", clock))
    )
    df = df.withColumn("__there", there)
    noted = F.regexp_extract(F.coalesce(headline, F.lit("")), r"(\d{1,2}-\w{3}-\d{2,4})\s+\d{1,2}:\d{2}", 1)
    spelled = F.regexp_replace(F.regexp_extract(F.coalesce(headline, F.lit("")), r"([A-Za-z]+ \d{1,2},?\s+\d{4})", 1), r",?\s+(?=\d{4}$)", " ")
    tries = [(noted, "d-MMM-yy"), (noted, "d-MMM-yyyy"), (spelled, "MMMM d yyyy"), (spelled, "MMM d yyyy")]
    fallback = F.coalesce(*[F.try_to_timestamp(day, F.lit(form)) for day, form in tries]).cast("date")
    return df.withColumns(
        {"call_date": F.coalesce(F.to_date("__there"), fallback), "is_before_close": F.hour("__there") < 12}
    ).drop("__bare", "__read", "__there")


def headline_ticker(ticker: Column, headline: Column) -> Column:
    return F.when(F.coalesce(ticker, F.lit("")) != "", ticker).otherwise(F.regexp_extract(F.coalesce(headline, F.lit("")), r"(?i)of\s+(\S+)\s+earnings", 1))


def headline_company(company: Column, headline: Column) -> Column:
    return F.when(F.coalesce(company, F.lit("")) != "", company).otherwise(F.regexp_extract(F.coalesce(headline, F.lit("")), r"(?i)Transcript of\s+(.+?)\s+earnings", 1))


def is_preliminary(headline: Column, version: Column) -> Column:
    return F.lower(F.coalesce(headline, F.lit(""))).contains("preliminary") | (F.coalesce(version, F.lit("")) != "Final")


def transcripts(files: DataFrame) -> DataFrame:
    """Typed rows of all earnings calls among the files, the earliest version of each (per year folder)."""
    events = files.select("path", parsed_event("xml").alias("e")).where("e.event_id is not null").select("path", "e.*")
    events = start_in_new_york(events)
    said = sections(F.col("body"))
    events = events.withColumn("__s", said).withColumns(
        {"presentation_text": clean_speech(F.col("__s.presentation")), "qa_text": clean_speech(F.col("__s.qa")), "year": F.regexp_extract("path", r"(\d{4})(?:/|\.zip)[^/]*(?:/[^/]*)?$", 1)}
    )
    events = events.where("presentation_text <> '' or qa_text <> ''").drop("__s", "body")
    events = events.withColumns({"n_words_pres": word_count(F.col("presentation_text")), "n_words_qa": word_count(F.col("qa_text"))})
    return version_dedup(events.where("company_id <> ''"), ["year", "company_id", "start_date_str"], "last_update", "event_id").drop("path")
