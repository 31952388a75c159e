"""What must not appear in any plan."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkguard.operators.joining import null_safe_join
from sparkguard.plans import catalogue  # noqa: F401
from sparkguard.plans.registry import Inputs, builders

QUERIES = builders()


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(k for k in QUERIES if not k.startswith("stream_")))
def test_no_cross_join_and_no_python(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    for word in ("CartesianProduct", "NestedLoop", "PythonUDF", "FlatMapGroups"):
        assert word not in plan, plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["transform_filter"](spark, SF))
    assert "GreaterThan(o_totalprice,300000.0)" in plan
    assert "o_custkey" not in plan.split("ReadSchema")[1]
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan_of(QUERIES["retention_filter"](spark, SF))


def test_no_plan_holds_a_secret(spark):
    from sparkguard.plans.masking_queries import KEY
    from sparkguard.plans.table_queries import BACKUP_KEY
    from sparkguard.sources.backups import encrypted_rows, restored

    for key in ("mask_dataset", "mask_hash", "mask_email", "text_pii_mask", "replica_mask", "table_sample"):
        assert KEY not in QUERIES[key](spark, SF)._jdf.queryExecution().toString()
    rows = encrypted_rows(spark.range(3), BACKUP_KEY, dt.datetime(2001, 1, 1))
    for df in (rows, restored(rows, "id long", BACKUP_KEY)):
        text = df._jdf.queryExecution().toString()
        assert BACKUP_KEY not in text and BACKUP_KEY.encode().hex() not in text.lower()


def test_null_safe_join_keeps_null_keys(spark):
    a = spark.createDataFrame([(None, 1), ("x", 2)], "k string, v int")
    b = spark.createDataFrame([(None, 10), ("x", 20)], "k string, w int")
    rows = {tuple(r) for r in null_safe_join(a, b, ["k"]).collect()}
    assert rows == {(None, 1, 10), ("x", 2, 20)}


def test_retention_prunes_by_plain_comparison(spark):
    from sparkguard.plans.table_queries import AS_OF
    from sparkguard.operators.lifecycle import retained

    df = retained(Inputs(spark, SF).table("orders"), "o_orderdate", AS_OF, 90).select(F.count(F.lit(1)))
    assert "PushedFilters: [IsNotNull(o_orderdate), GreaterThan(o_orderdate" in plan_of(df)
