"""The subpackage's queries on the smallest data: against SQL where there is one, else their columns and keys."""

import pytest

from tests.harness import DATA, assert_same
from tidemark.llm import catalogue

KEYS = {
    "p2_found": ["event_id", "gvkey"],
    "p3_found": ["term"],
    "p5_found": ["company_key", "start_utc"],
    "p6_found": ["event_id", "permno"],
    "p7_found": ["event_id", "section", "turn_no"],
    "p8_containers": ["doc_id", "piece"],
    "p9_found": ["doc_id", "item_id"],
    "p10_found": ["doc_id"],
}
COLUMNS = {
    "p2_found": {"event_id": "string", "gvkey": "bigint", "fyearq": "bigint", "fqtr": "bigint"},
    "p3_found": {"term": "string", "mark": "string"},
    "p5_found": {"company_key": "bigint", "start_utc": "string", "event_id": "string", "ticker": "string", "cusip": "string"},
    "p6_found": {"event_id": "string", "permno": "bigint"},
    "p7_found": {"event_id": "string", "section": "string", "turn_no": "bigint", "speaker": "string", "n_words": "bigint"},
    "p9_found": {"doc_id": "bigint", "item_id": "bigint"},
    "p10_found": {"doc_id": "bigint", "band": "bigint"},
}


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_equals_sql(spark, name):
    assert_same(spark, catalogue.QUERIES[name], catalogue.ORACLES[name])


@pytest.mark.parametrize("name", sorted(KEYS))
def test_rows_are_unique(spark, name):
    df = catalogue.QUERIES[name](spark, DATA)
    if name in COLUMNS:
        assert dict(df.dtypes) == COLUMNS[name]
    rows = df.collect()
    assert rows and len({tuple(r[k] for k in KEYS[name]) for r in rows}) == len(rows)


def test_found_rows_are_those_of_the_full_results(spark):
    for found, full in (("p6_found", "p6_matches"), ("p7_found", "p7_turns"), ("p9_found", "p9_leaks")):
        one, all_of = (catalogue.QUERIES[n](spark, DATA) for n in (found, full))
        assert sorted(map(tuple, one.collect())) == sorted(map(tuple, all_of.select(one.columns).collect()))


def test_turns_say_what_they_count(spark):
    rows = catalogue.QUERIES["p7_turns"](spark, DATA).collect()
    texts = {r.event_id for r in spark.read.parquet(f"{DATA}/transcripts.parquet").where("length(coalesce(presentation_text, qa_text)) > 0").collect()}
    assert texts == {r.event_id for r in rows}
    for r in rows:
        assert len(r.utterance.split(" ")) == r.n_words and "[" not in r.utterance
        assert r.start_s is None or r.end_s is None or r.start_s <= r.end_s


def test_matches_and_leaks(spark):
    assert all(0.5 <= r.confidence <= 1 for r in catalogue.QUERIES["p6_matches"](spark, DATA).collect())
    leaks = catalogue.QUERIES["p9_leaks"](spark, DATA).collect()
    assert all(0.5 <= r.share <= 1 and 0 <= r.consistency <= 1 and r.kind in ("verbatim", "reparameterised") for r in leaks)
    assert any(r.kind == "verbatim" for r in leaks)
