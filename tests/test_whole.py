"""Queries that once left out rows, against the whole job."""

import os

from tests.harness import DATA, assert_same, sql_rows
from tidemark.plans import reports, study, texts


def test_event_portfolio_uses_every_assignment(spark):
    """Against SQL over the whole table of assignments; firms whose number is divisible by three have them too."""
    sql = f"""with {study._EVENTS}, {study._YEARS}, {study._PORTFOLIO} select event_id, e.permno, form_year, coalesce(a.portfolio, b.portfolio, 'smme') portfolio from evp e
    left join pf a on a.permno = e.permno and a."year" = form_year left join pf b on b.permno = e.permno and b."year" = form_year - 1"""
    assert_same(spark, study.event_portfolio, sql)
    thirds = study.event_portfolio(spark, DATA).where("permno % 3 = 0")
    assert thirds.where("portfolio <> 'smme'").count() > 0


def test_parse_xml_writes_and_reads_both_sections(spark):
    """Also calls with a Q&A text only; both sections cut and cleaned. A body has 68 characters besides its texts."""
    clean = texts._CLEANED.format(c="qa_text", strip=texts._STRIP.format("x"))
    trim = lambda c: texts._STRIP.format(f"coalesce({c}, '')")
    sql = f"""with c as (select *, {clean.replace("qa_text", "presentation_text")} p, {clean} q from transcripts where event_id is not null)
    select event_id, coalesce(last_update, '') last_update, {trim("ticker")} ticker, {trim("company_id")} company_id, {trim("company_name")} company_name,
     length(coalesce(presentation_text, '')) + length(coalesce(qa_text, '')) + 68 n_chars, md5(p) presentation, md5(q) qa from c where p <> '' or q <> ''"""
    folder = os.path.join(os.path.dirname(DATA), "sf0.01")
    assert sql_rows("select count(*) n from transcripts where coalesce(presentation_text, '') = '' and qa_text <> ''", folder).n[0] > 0
    assert_same(spark, texts.parse_xml, sql, folder)


def test_union_holds_firms_of_odd_quarters(spark, monkeypatch):
    monkeypatch.setattr(reports, "quarter_events", lambda *_: spark.createDataFrame([(1, 8041), (2, 8040)], "permno bigint, q int"))
    monkeypatch.setattr(reports, "read_table", lambda *_: spark.createDataFrame([(2,), (3,)], "lpermno bigint"))
    assert sorted(r.permno for r in reports.union_distinct(spark, DATA).collect()) == [1, 2, 3]
