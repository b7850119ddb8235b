"""Text functions built from Spark's own string and regex expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PRESENTATION = r"(?i)={5,}\s*\n\s*Presentation\s*\n\s*-{5,}"
_QUESTIONS = r"(?i)={5,}\s*\n\s*Questions\s+and\s+Answers\s*\n\s*-{5,}"

#: Exchange parts of a ticker that are dropped.
EXCHANGES = ("OQ", "N", "A", "PK", "O", "K", "CB")

#: The English stop words that the n-gram features leave out.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its itself "
    "they them their theirs themselves what which who whom this that these those am is are was were be been being have has had having "
    "do does did doing a an the and but if or because as until while of at by for with about against between through during before after "
    "above below to from up down in out on off over under again further then once here there when where why how all both each few more most "
    "other some such no nor not only own same so than too very s t can will just don should now d ll m o re ve y ain aren couldn didn doesn "
    "hadn hasn haven isn ma mightn mustn needn shan shouldn wasn weren won wouldn"
).split()


def _span(body: Column, pattern: str) -> tuple[Column, Column]:
    """Where the first match begins and ends (1-based, end exclusive); 0 and 0 without one."""
    start = F.regexp_instr(body, F.lit(pattern))
    return start, F.when(start > 0, start + F.length(F.regexp_substr(body, F.lit(pattern)))).otherwise(0)


def _between(body: Column, start: Column, end: Column) -> Column:
    return F.when(end > start, F.substring(body, start, end - start)).otherwise(F.lit(""))


def sections(body: Column) -> Column:
    """struct(presentation, qa) of a body with section markers. Without markers all is presentation;
    with the second marker only, what stands before it. If the markers stand in the other order the
    presentation is empty."""
    text = F.coalesce(body, F.lit(""))
    p_start, p_end = _span(text, _PRESENTATION)
    q_start, q_end = _span(text, _QUESTIONS)
    after = F.length(text) + 1
    presentation = (
        F.when((p_start > 0) & (q_start > 0), _between(text, p_end, q_start))
        .when(p_start > 0, _between(text, p_end, after))
        .when(q_start > 0, _between(text, F.lit(1), q_start))
        .otherwise(text)
    )
    qa = F.when(q_start > 0, _between(text, q_end, after)).otherwise(F.lit(""))
    return F.struct(presentation.alias("presentation"), qa.alias("qa"))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean_speech(text: Column) -> Column:
    """Without rules, bracketed numbers, blank lines and lines that only say Operator; one line."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"-{5,}|={5,}|\[\d+\]", "")
    lines = F.transform(F.split(bare, "\n"), stripped)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.isin("Operator", "OPERATOR")), " ")


def word_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\S+"), F.lit(0)))


def mask_numbers(text: Column) -> Column:
    """Lower case, with every number as #."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\d+\.?\d*", "#")


def tokens(masked: Column) -> Column:
    """Word runs; # and $ survive inside a word."""
    return F.regexp_extract_all(masked, F.lit(r"(?U)\b[\w#$]+\b"), F.lit(0))


def long_tokens(masked: Column) -> Column:
    """Word runs of two characters at least."""
    return F.regexp_extract_all(masked, F.lit(r"(?U)\b\w\w+\b"), F.lit(0))


def joined(presentation: Column, qa: Column) -> Column:
    """Both sections of a call as one text; null counts as empty."""
    return stripped(F.concat(F.coalesce(presentation, F.lit("")), F.lit(" "), F.coalesce(qa, F.lit(""))))


def without(words: Column, stop_words: list[str] = STOP_WORDS) -> Column:
    return F.filter(words, lambda w: ~w.isin(*stop_words)) if stop_words else words


def bigrams(words: Column) -> Column:
    """Neighbouring pairs; none of fewer than two words."""
    return F.when(F.size(words) < 2, F.array().cast("array<string>")).otherwise(
        F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))
    )


def clean_ticker(ticker: Column) -> Column:
    """The part before ^, without a known exchange part, in upper case."""
    return F.upper(F.regexp_replace(F.split(ticker, r"\^")[0], rf"\.({'|'.join(EXCHANGES)})$", ""))


def cusip8(cusip: Column) -> Column:
    return F.trim(F.substring(cusip, 1, 8))
