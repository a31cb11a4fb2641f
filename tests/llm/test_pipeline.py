"""The pipeline and the registered queries on the smallest tables."""

from pathlib import Path

import pytest

import corpus_pipeline
from fieldweave.llm import queries
from tests.test_queries import assert_same

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_twin(spark, name):
    assert_same(spark, name, queries.QUERIES[name], queries.ORACLES[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "MinHash near-dedup", "substring dedup", "secret scans", "packing"]
    packed = corpus_pipeline.run(spark, str(SF)).collect()
    assert 0 < len(packed) <= docs.count() and len({r["doc_id"] for r in packed}) == len(packed)


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, step in corpus_pipeline.STAGES:
        docs = step(spark, docs, str(SF))
    assert docs.count() == 0
