"""Every query of the core against its SQL, or, for models, its keys and values."""

import math
import os
import subprocess
import sys

import pytest

from tests.harness import DATA, assert_same
from tidemark.plans import registry

QUERIES, ORACLES = registry.queries(), registry.oracles()
SCORES = ("en_multinomial_score", "logit_score_v1", "rolling_score", "embedding_score", "call_embedding_score")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    assert_same(spark, QUERIES[name], ORACLES[name])


def test_only_models_and_the_embedder_have_no_sql():
    assert set(QUERIES) - set(ORACLES) == {*SCORES, "embed_udf"}


@pytest.mark.parametrize("name", ["logit_score_v1", "embedding_score"])
def test_scores(spark, name):
    """A finite score for every key. Not all alike where there is enough to learn from: of the smallest
    data's 14 calls the model without features is the best."""
    rows = [r.asDict() for r in QUERIES[name](spark, DATA).collect()]
    keys = [tuple(v for k, v in r.items() if k != "score") for r in rows]
    assert rows and len(set(keys)) == len(keys) and all(math.isfinite(r["score"]) for r in rows)
    assert name == "logit_score_v1" or len({r["score"] for r in rows}) > 1


def test_embedder(spark):
    """Vectors of length one, or zeros, of every document; documents of the same words in other places have one vector."""
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    rows = QUERIES["embed_udf"](spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(docs)
    for r in rows:
        norm = math.sqrt(sum(x * x for x in r.embedding))
        assert len(r.embedding) == 128 and math.isclose(norm, 1 if any(c.isalnum() for c in docs[r.doc_id]) else 0, abs_tol=1e-5)


def test_stored_needs_a_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tidemark.sources import shared_dir

    unset = SimpleNamespace(get=lambda key, default=None: default, set=lambda *_: None)
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="spark://there:7077")))
    assert shared_dir(SimpleNamespace(conf=unset, sparkContext=SimpleNamespace(master="local[4]"))).startswith("file:")


def test_core_lists_its_queries_where_the_subpackage_cannot_be_imported():
    code = "import sys; sys.modules['tidemark.llm.catalogue'] = None; import __spark_entry__ as e; print(len(e.queries()), 'p7_found' in e.queries())"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=os.path.dirname(os.path.dirname(os.path.abspath(__file__)))).stdout.split()
    assert int(out[0]) == len(QUERIES) and out[1] == "False"


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_found_columns(spark):
    expected = {
        "p1_found": {"event_id": "string", "permno": "bigint", "namedt": "string", "gvkey": "bigint"},
        "p4_found": {"event_id": "string", "start_utc": "string", "call_day": "string", "before_noon": "bigint"},
    }
    for name, columns in expected.items():
        rows = QUERIES[name](spark, DATA)
        assert dict(rows.dtypes) == columns and rows.count() == rows.distinct().count() > 0
