"""Queries with SQL against that SQL; the pipeline's and the registry's shape."""

import os
import re

import pytest
from conftest import SMALL

import __spark_entry__ as entry
import corpus_pipeline
from tidemark.llm import registry
from verification.compare import compare, connect


def test_every_operator_is_registered():
    numbers = [int(m[1]) for n in entry.queries() if (m := re.match(r"op(\d+)_", n))]
    assert sorted(numbers) == list(range(1, 14)) and "pipeline" in entry.queries()
    assert set(registry.ORACLE_SQL) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = connect(SMALL)
    assert compare(con, registry.QUERIES[name](spark, SMALL), registry.ORACLE_SQL[name]) == []


def test_pipeline_runs_all_stages(spark):
    docs = spark.read.parquet(os.path.join(SMALL, "documents.parquet"))
    out = corpus_pipeline.run(spark, SMALL)
    assert out.columns == [*docs.columns, "ids", "n_tokens"]
    assert 0 < out.count() < docs.count()
    assert out.select("doc_id").distinct().count() == out.count()
