"""The registered queries of the subpackage over the driver's tables."""

from __future__ import annotations

import pytest
from compare import compare, connect

import __spark_entry__ as entry
from sparkguard.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("key", sorted(SQL))
def test_against_sql(spark, con, key):
    ok, text = compare(spark, con, SF, key, QUERIES[key], SQL[key])
    assert ok, text


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(SQL) - {"op11_whitening"}))
def test_a_row_per_document(spark, key):
    ids = [r.doc_id for r in QUERIES[key](spark, SF).select("doc_id").distinct().collect()]
    assert len(ids) == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_are_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
