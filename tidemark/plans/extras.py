"""Smaller queries on calls, their headlines and their texts."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.embed import mean_pooled, rms_normed
from tidemark.operators.quantiles import with_quantiles
from tidemark.plans.known import day_text
from tidemark.plans.reports import LINK_SQL, interval_link_priority
from tidemark.sources import read_table, shared_dir, stored
from tidemark.sources.events_xml import headline_company, headline_ticker, is_preliminary
from tidemark.sources.stores import write_by
from tidemark.sources.tables import read_parts


def call_lookup(spark: SparkSession, folder: str) -> DataFrame:
    """Both texts of every linked call as one, presentation first."""
    calls = read_table(spark, folder, "transcripts").select("event_id", "presentation_text", "qa_text")
    said = T.joined(F.col("presentation_text"), F.col("qa_text"))
    linked = interval_link_priority(spark, folder).select("event_id")
    return calls.join(linked, "event_id", "left_semi").select("event_id", F.length(said).alias("n_chars"), F.md5(said.cast("binary")).alias("said"))


LOOKUP_SQL = f"""with k as ({LINK_SQL}), t as (select event_id, regexp_replace(coalesce(presentation_text, '') || ' ' || coalesce(qa_text, ''), '^\\s+|\\s+$', '', 'g') t from transcripts
where event_id in (select event_id from k)) select event_id, length(t) n_chars, md5(t) said from t"""


def first_texts(spark: SparkSession, folder: str) -> DataFrame:
    """What the embedding diagnostics look at: the first 200 documents by id, cut to 2,000 characters."""
    docs = read_table(spark, folder, "documents").select("doc_id", F.substring(F.coalesce("text", F.lit("")), 1, 2000).alias("t"))
    return docs.orderBy("doc_id").limit(200).select("doc_id", F.length("t").alias("n_chars"), F.md5(F.col("t").cast("binary")).alias("head"))


FIRST_SQL = """select doc_id, length(t) n_chars, md5(t) head from (select doc_id, left(coalesce(text, ''), 2000) t from documents order by doc_id limit 200)"""


def parts_by_year(spark: SparkSession, folder: str) -> DataFrame:
    """Calls written in a folder per year, and those of this century's years read again by a pattern."""
    calls = read_table(spark, folder, "transcripts").select("event_id", "ticker", F.year("call_date").alias("year")).where("year is not null")
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    write_by(calls, path, "year")
    return read_parts(spark, path, "year=20*").groupBy(F.col("year").cast("bigint").alias("year")).agg(F.count("*").alias("n"), F.countDistinct("ticker").alias("tickers"))


PARTS_SQL = """select year(call_date) "year", count(*) n, count(distinct ticker) tickers from transcripts where year(call_date) between 2000 and 2099 group by 1"""


def linked_length_filter(spark: SparkSession, folder: str) -> DataFrame:
    """The linked rows that are not longer than all but the longest half per cent of them."""
    words = F.coalesce("n_words_pres", F.lit(0)) + F.coalesce("n_words_qa", F.lit(0))
    calls = read_table(spark, folder, "transcripts").select("event_id", words.alias("total_words"))
    linked = stored(calls.join(interval_link_priority(spark, folder).select("event_id", "permno"), "event_id"))
    return with_quantiles(linked, [], "total_words", [0.995], "cut").where("total_words <= cut[0]").select("event_id", "permno", "total_words")


LINKED_LENGTH_SQL = f"""with k as ({LINK_SQL}), c as (select event_id, permno, coalesce(n_words_pres, 0) + coalesce(n_words_qa, 0) total_words from transcripts join k using (event_id))
select event_id, permno, total_words from c where total_words <= (select quantile_cont(total_words, 0.995) from c)"""

#: The days between which events belong to the study.
UNIVERSE = ("2008-01-01", "2019-12-31")


def universe_events(spark: SparkSession, folder: str, days: tuple[str, str] = UNIVERSE) -> DataFrame:
    """The events within the universe's days, both included; the filter reaches the scan."""
    first, last = (F.lit(d).cast("timestamp_ntz") for d in days)
    events = read_table(spark, folder, "abnormal_returns").where((F.col("event_date") >= first) & (F.col("event_date") < last + F.make_dt_interval(days=F.lit(1))))
    return events.select("event_id", "permno", day_text("event_date").alias("event_date"))


UNIVERSE_SQL = f"select event_id, permno, strftime(event_date, '%Y-%m-%d') event_date from abnormal_returns where cast(event_date as date) between date '{UNIVERSE[0]}' and date '{UNIVERSE[1]}'"


def headline_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Ticker and company, from the headline where their own fields are blank, and whether the story is preliminary."""
    calls = read_table(spark, folder, "transcripts")
    return calls.select(
        "event_id", "headline", headline_ticker(F.col("ticker"), F.col("headline")).alias("ticker"), headline_company(F.col("company_name"), F.col("headline")).alias("company"),
        is_preliminary(F.col("headline"), F.col("story_version")).alias("preliminary"),
    )


HEADLINE_SQL = """select event_id, headline, case when coalesce(ticker, '') <> '' then ticker else regexp_extract(coalesce(headline, ''), '(?i)of\\s+(\\S+)\\s+earnings', 1) end ticker,
case when coalesce(company_name, '') <> '' then company_name else regexp_extract(coalesce(headline, ''), '(?i)Transcript of\\s+(.+?)\\s+earnings', 1) end company,
lower(coalesce(headline, '')) like '%preliminary%' or coalesce(story_version, '') <> 'Final' preliminary from transcripts"""


def long_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Words of two characters at least, numbers masked."""
    w: Column = T.long_tokens(T.mask_numbers(F.col("text")))
    return read_table(spark, folder, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.md5(F.array_join(w, " ").cast("binary")).alias("tokens"))


LONG_TOKENS_SQL = r"""select doc_id, len(w) n_tokens, md5(array_to_string(w, ' ')) tokens from (select doc_id,
regexp_extract_all(regexp_replace(lower(coalesce(text, '')), '\p{Nd}+\.?\p{Nd}*', '#', 'g'), '[\p{L}\p{M}\p{Nd}\p{Pc}]{2,}') w from documents)"""


def mean_pool_rms(spark: SparkSession, folder: str) -> DataFrame:
    """As mean_pool, of vectors brought to a root mean square of one."""
    e = read_table(spark, folder, "embeddings").withColumn("period", F.col("vec_id") % 12).withColumn("v", rms_normed(F.col("embedding")))
    return mean_pooled(e, ["label", "period"], "v", (F.col("vec_id") % 5 != 0)).withColumn("x", F.round("x", 6))


RMS_SQL = """with c as (select vec_id, label, unnest(embedding)::double x, generate_subscripts(embedding, 1) - 1 dim from embeddings),
n as (select vec_id, label, dim, x / sqrt(avg(x * x) over (partition by vec_id) + 1e-6) x from c)
select label, vec_id % 12 period, dim, round(sum(case when vec_id % 5 <> 0 then x else 0 end) / greatest(sum(case when vec_id % 5 <> 0 then 1 else 0 end), 1e-9), 6) x from n group by 1, 2, 3"""

QUERIES = {
    "call_lookup": call_lookup, "first_texts": first_texts, "parts_by_year": parts_by_year, "linked_length_filter": linked_length_filter, "universe_events": universe_events,
    "headline_fields": headline_fields, "long_tokens": long_tokens, "mean_pool_rms": mean_pool_rms,
}
ORACLES = {
    "call_lookup": LOOKUP_SQL, "first_texts": FIRST_SQL, "parts_by_year": PARTS_SQL, "linked_length_filter": LINKED_LENGTH_SQL, "universe_events": UNIVERSE_SQL,
    "headline_fields": HEADLINE_SQL, "long_tokens": LONG_TOKENS_SQL, "mean_pool_rms": RMS_SQL,
}
