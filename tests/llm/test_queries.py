"""The queries of the subpackage: SQL where there is some, contracts of columns, and the pipeline as a whole."""

import sys
from pathlib import Path

import pytest
from loomspark.llm import queries

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
from parity import SF, check  # noqa: E402


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    if name in queries.ORACLES:
        check(spark, queries.QUERIES[name], queries.ORACLES[name])
    else:
        assert queries.QUERIES[name](spark, SF).count() > 0


def test_pipeline(spark):
    import corpus_pipeline

    docs, before = spark.read.parquet(f"{SF}/documents.parquet"), None
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        ids = {r.doc_id for r in out.select("doc_id").collect()}
        assert ids <= (before or ids)
        before, docs = ids, out
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == before
