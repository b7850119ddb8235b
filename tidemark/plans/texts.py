"""Queries on text: parsing, sections, cleaning, tokens and vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators.quantiles import quarter_number, rolling_members
from tidemark.operators.vocab import log_features, rolling_vocabulary, term_table, term_totals, top_terms
from tidemark.plans.known import STAMPS_SQL
from tidemark.sources import read_table
from tidemark.sources.events_xml import parsed_event, start_in_new_york


def _text(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(""))


def _marked(presentation: Column, qa: Column) -> Column:
    """A body put together with section markers."""
    rule, dash = F.lit("\n=====\n"), F.lit("\n-----\n")
    return F.concat(F.lit("Heading"), rule, F.lit("Presentation"), dash, presentation, rule, F.lit("Questions and Answers"), dash, qa)


def section_split(spark: SparkSession, folder: str) -> DataFrame:
    """Bodies put together with section markers, and cut again."""
    calls = read_table(spark, folder, "transcripts")
    cut = calls.select("event_id", "last_update", T.sections(_marked(_text("presentation_text"), _text("qa_text"))).alias("s"))
    return cut.select("event_id", "last_update", *[F.md5(T.stripped(F.col(f"s.{c}")).cast("binary")).alias(c) for c in ("presentation", "qa")])


_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SECTION_SQL = f"""select event_id, last_update, md5({_STRIP.format("coalesce(presentation_text, '')")}) presentation, md5({_STRIP.format("coalesce(qa_text, '')")}) qa from transcripts"""


def clean_text(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts")
    clean = {c: T.clean_speech(F.col(f"{c}_text")) for c in ("presentation", "qa")}
    # through explode, so that each text is cleaned once
    calls = calls.select("event_id", "last_update", F.explode(F.array(F.struct(*[x.alias(c) for c, x in clean.items()]))).alias("c"))
    return calls.select("event_id", "last_update", *[F.md5(F.col(f"c.{c}").cast("binary")).alias(c) for c in clean], (F.length("c.presentation") + F.length("c.qa")).alias("n"))


_CLEANED = """array_to_string(list_filter(list_transform(string_split(regexp_replace(coalesce({c}, ''), '-{{5,}}|={{5,}}|\\[\\d+\\]', '', 'g'), chr(10)),
 lambda x: {strip}), lambda x: x not in ('', 'Operator', 'OPERATOR')), ' ')"""
CLEAN_SQL = f"""with c as (select event_id, last_update, {_CLEANED.format(c="presentation_text", strip=_STRIP.format("x"))} p, {_CLEANED.format(c="qa_text", strip=_STRIP.format("x"))} q from transcripts)
select event_id, last_update, md5(p) presentation, md5(q) qa, length(p) + length(q) n from c"""


def word_counts(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", T.word_count(F.col("text")).alias("n_words"))


WORDS_SQL = r"select doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\t\n\v\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+')) n_words from documents"


def number_mask(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").select("doc_id", F.md5(T.mask_numbers(F.col("text")).cast("binary")).alias("masked"))


_MASK = r"regexp_replace(lower(coalesce({}, '')), '\p{{Nd}}+\.?\p{{Nd}}*', '#', 'g')"
MASK_SQL = f"select doc_id, md5({_MASK.format('text')}) masked from documents"


def _words(c: str) -> Column:
    return T.tokens(T.mask_numbers(F.col(c)))


_WORD = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+(?:[#$]+[\p{L}\p{M}\p{Nd}\p{Pc}]+)*"
_TOKENS = f"regexp_extract_all({_MASK}, '{_WORD.replace('{', '{{').replace('}', '}}')}')"


def tokens(spark: SparkSession, folder: str) -> DataFrame:
    w = _words("text")
    return read_table(spark, folder, "documents").select("doc_id", F.size(w).alias("n_tokens"), F.md5(F.array_join(w, " ").cast("binary")).alias("tokens"))


TOKENS_SQL = f"with t as (select doc_id, {_TOKENS.format('text')} w from documents) select doc_id, len(w) n_tokens, md5(array_to_string(w, ' ')) tokens from t"


def bigrams_nostop(spark: SparkSession, folder: str) -> DataFrame:
    docs = read_table(spark, folder, "documents").select("doc_id", T.without(_words("text")).alias("w"))
    return term_table(docs.withColumn("b", T.bigrams(F.col("w"))), "doc_id", F.col("b"))


BIGRAMS_SQL = f"""with t as (select doc_id, list_filter({_TOKENS.format('text')}, lambda x: x not in ({', '.join(f"'{w}'" for w in T.STOP_WORDS)})) w from documents),
b as (select doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) term from t) select doc_id, term, count(*) tf from b group by 1, 2"""


def _dated(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "documents").withColumn("q", quarter_number(F.col("published_at")))


def term_freq_top1000(spark: SparkSession, folder: str) -> DataFrame:
    return top_terms(term_totals(read_table(spark, folder, "documents"), _words("text")), 1000, 5)


_TERMS = f"""w as (select doc_id, year(published_at) * 4 + quarter(published_at) q, unnest({_TOKENS.format('text')}) term from documents), tt as (select doc_id, any_value(q) q, term, count(*) tf from w group by 1, 3)"""
TOP_SQL = f"with {_TERMS} select term, sum(tf)::bigint tf, count(*) df from tt group by 1 having count(*) >= 5 order by tf desc, term limit 1000"


def rolling_vocab(spark: SparkSession, folder: str) -> DataFrame:
    docs = _dated(spark, folder)
    return rolling_vocabulary(term_totals(docs, _words("text"), "q"), "q", rolling_members(docs, "q"), 500, 5)


ROLLING_SQL = f"""with {_TERMS}, rk as (select q, row_number() over (order by q) r from (select distinct year(published_at) * 4 + quarter(published_at) q from documents where published_at is not null)),
mb as (select t.q test_quarter, s.q train from rk t join rk s on s.r between t.r - 8 and t.r - 1 where t.r > 8),
c as (select test_quarter, term, sum(tf)::bigint tf, count(*) df from mb join tt on tt.q = train group by 1, 2 having count(*) >= 5)
select test_quarter, term, tf, df from (select *, row_number() over (partition by test_quarter order by tf desc, term) r from c) where r <= 500"""


def log_tf(spark: SparkSession, folder: str) -> DataFrame:
    """The features of all documents over the vocabulary of all."""
    docs = read_table(spark, folder, "documents")
    return log_features(term_table(docs, "doc_id", _words("text")), top_terms(term_totals(docs, _words("text")), 200, 5)).select("doc_id", "term", F.round("x", 8).alias("x"))


LOG_SQL = f"""with {_TERMS}, v as (select term from tt group by 1 having count(*) >= 5 order by sum(tf) desc, term limit 200)
select doc_id, term, round(ln(1 + tf), 8) x from tt where term in (select term from v)"""


def fixed_vocab(spark: SparkSession, folder: str) -> DataFrame:
    """A vocabulary of the documents of 2008 and 2009, counted in all documents."""
    docs = _dated(spark, folder)
    early = docs.where((F.col("q") >= 2008 * 4 + 1) & (F.col("q") <= 2009 * 4 + 4))
    vocabulary = top_terms(term_totals(early, _words("text")), 500, 2)
    return term_table(docs, "doc_id", _words("text"), vocabulary).select("doc_id", "term", "tf")


FIXED_SQL = f"""with {_TERMS}, v as (select term from tt where q between 8033 and 8040 group by 1 having count(*) >= 2 order by sum(tf) desc, term limit 500)
select doc_id, term, tf from tt where term in (select term from v)"""


def parse_xml(spark: SparkSession, folder: str) -> DataFrame:
    """Event documents with both sections written from the table, parsed again, cut and cleaned; those
    of which no section is left are dropped."""
    calls = read_table(spark, folder, "transcripts").where("coalesce(presentation_text, '') || coalesce(qa_text, '') <> '' and event_id is not null")
    escaped = lambda c: F.replace(F.replace(_text(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), escaped(c), F.lit(f"</{name}>"))
    body = F.replace(_marked(_text("presentation_text"), _text("qa_text")), F.lit("]]>"), F.lit("]]]]><![CDATA[>"))
    xml = F.concat(
        F.lit('<Event eventTypeId="1" Id="'), escaped("event_id"), F.lit('" lastUpdate="'), escaped("last_update"), F.lit('"><EventStory version="'), escaped("story_version"),
        F.lit('">'), tag("Headline", "headline"), F.lit("<Body><![CDATA["), body, F.lit("]]></Body></EventStory>"),
        tag("companyName", "company_name"), tag("companyTicker", "ticker"), tag("companyId", "company_id"), tag("startDate", "start_date_str"), tag("CUSIP", "cusip"), tag("ISIN", "isin"), F.lit("</Event>"),
    )
    # through explode, as a filter on the result would be pushed down and parse or cut each document again
    once = lambda x: F.explode(F.array(x))
    e = calls.select(once(parsed_event(xml)).alias("e")).where("e.event_id is not null").select("e.*")
    e = e.withColumn("s", once(T.sections(F.col("body"))))
    e = e.withColumn("c", once(F.struct(*[T.clean_speech(F.col(f"s.{c}")).alias(c) for c in ("presentation", "qa")]))).where("c.presentation <> '' or c.qa <> ''")
    return e.select(
        "event_id", "last_update", "ticker", "company_id", "company_name", F.length("body").alias("n_chars"), *[F.md5(F.col(f"c.{c}").cast("binary")).alias(c) for c in ("presentation", "qa")]
    )


#: A body has 68 characters besides its two texts.
PARSE_SQL = f"""with c as (select *, {_CLEANED.format(c="presentation_text", strip=_STRIP.format("x"))} p, {_CLEANED.format(c="qa_text", strip=_STRIP.format("x"))} q from transcripts where event_id is not null)
select event_id, coalesce(last_update, '') last_update, {_STRIP.format("coalesce(ticker, '')")} ticker, {_STRIP.format("coalesce(company_id, '')")} company_id,
 {_STRIP.format("coalesce(company_name, '')")} company_name, length(coalesce(presentation_text, '')) + length(coalesce(qa_text, '')) + 68 n_chars, md5(p) presentation, md5(q) qa from c where p <> '' or q <> ''"""


def start_date_et(spark: SparkSession, folder: str) -> DataFrame:
    calls = read_table(spark, folder, "transcripts").select("event_id", "start_date_str", "headline")
    return start_in_new_york(calls).select("event_id", "start_date_str", F.date_format("call_date", "yyyy-MM-dd").alias("call_date"), "is_before_close")


START_SQL = f"""with {STAMPS_SQL}, n as (select *, case when z in ('EST', 'EDT') then t else timezone('America/New_York', timezone('UTC', case when z in ('GMT', 'EST', 'EDT', 'ET') then t else u end)) end w,
 regexp_extract(coalesce(headline, ''), '(\\d{{1,2}}-\\w{{3}}-\\d{{2,4}})\\s+\\d{{1,2}}:\\d{{2}}', 1) h from su)
select event_id, start_date_str, strftime(coalesce(cast(w as date), cast(try_strptime(h, ['%d-%b-%y', '%d-%b-%Y']) as date)), '%Y-%m-%d') call_date, hour(w) < 12 is_before_close from n"""

QUERIES = {
    "section_split": section_split, "clean_text": clean_text, "word_counts": word_counts, "number_mask": number_mask, "tokens": tokens, "bigrams_nostop": bigrams_nostop,
    "term_freq_top1000": term_freq_top1000, "rolling_vocab": rolling_vocab, "log_tf": log_tf, "fixed_vocab": fixed_vocab, "parse_xml": parse_xml, "start_date_et": start_date_et,
}
ORACLES = {
    "section_split": SECTION_SQL, "clean_text": CLEAN_SQL, "word_counts": WORDS_SQL, "number_mask": MASK_SQL, "tokens": TOKENS_SQL, "bigrams_nostop": BIGRAMS_SQL,
    "term_freq_top1000": TOP_SQL, "rolling_vocab": ROLLING_SQL, "log_tf": LOG_SQL, "fixed_vocab": FIXED_SQL, "parse_xml": PARSE_SQL, "start_date_et": START_SQL,
}
