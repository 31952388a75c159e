"""Files written and read back, transformations, and access checks."""

from __future__ import annotations

import datetime as dt

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkguard.functions.network import ip_number
from sparkguard.operators import access, costs, setops, sync, transforms
from sparkguard.plans.registry import Inputs
from sparkguard.sources import backups, catalogs, logs, tables

NOW = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def inputs(spark):
    return Inputs(spark, SF)


def test_chunks_are_bounded_and_complete(spark, inputs, folder):
    orders = inputs.table("orders")
    tables.write_chunks(orders, folder("chunks"), 100)
    sizes = spark.read.parquet(folder("chunks")).groupBy(F.input_file_name()).count().agg(F.max("count"), F.sum("count")).head()
    assert sizes[0] <= 100 and sizes[1] == orders.count()


def test_backup_needs_its_key(spark, inputs, folder):
    customer = inputs.table("customer")
    schema = "c_custkey bigint, c_name string"
    backups.write_backup(customer.select("c_custkey", "c_name"), folder("b"), "0123456789abcdef", NOW, "customer")
    assert backups.read_backup(spark, folder("b"), schema, "0123456789abcdef", "customer").count() == customer.count()
    with pytest.raises(Exception, match="AES|aes|crypt"):
        backups.read_backup(spark, folder("b"), schema, "another-key-4567", "customer").collect()


def test_default_limit(inputs):
    orders = inputs.table("orders")
    assert tables.first_rows(orders, 25).count() == 25
    assert tables.find(orders, {}, ["o_orderkey"], 1000).count() == 1000
    assert tables.find(orders, {}, ["o_orderkey"]).count() == orders.count()


def test_artifact_folders(spark, folder):
    rows = spark.createDataFrame([("u", "s", "202401", i) for i in range(5)], "user_id string, session_id string, ts_prefix string, n int")
    backups.write_artifacts(rows, folder("a"))
    assert spark.read.parquet(folder("a") + "/user_id=u/session_id=s/ts_prefix=202401").count() == 5


def test_broken_lines_are_kept(spark, folder):
    spark.createDataFrame([('{"session_id": "s", "type": "QUERY"}',), ("{broken",)], "value string").write.text(folder("l"))
    rows = logs.read_audit(spark, folder("l")).orderBy("session_id").collect()
    assert rows[0]["_corrupt"] == "{broken" and rows[1]["event_type"] == "QUERY"


def test_inferred_documents(spark):
    docs = ['{"_id": 1, "a": 1, "b": "x", "c": {"d": 1}}', '{"_id": 2, "a": "1", "b": null}', '{"_id": 3, "e": [1]}']
    rows = {r["field"]: r for r in catalogs.infer_documents(spark.createDataFrame([(d,) for d in docs], "doc string"), "doc").collect()}
    assert {f: r["type"] for f, r in rows.items()} == {"_id": "int", "a": "mixed", "b": "mixed", "c": "dict", "e": "list"}
    assert rows["_id"]["primary_key"] and not rows["a"]["primary_key"]


def test_types_by_substring(spark):
    names = ["bigint", "point", "VARCHAR(10)", "longtext", "real", "bit", "datetime", "decimal", "blob"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "t string").select(catalogs.target_type(F.col("t"))).collect()]
    assert got == ["Integer", "Integer", "String(255)", "Text", "Float", "Boolean", "DateTime", "String(255)", "String(255)"]


def test_unknown_transformation(inputs):
    with pytest.raises(ValueError, match="unknown"):
        transforms.apply_all(inputs.table("region"), [{"type": "eval"}])


def test_access(spark):
    grants = spark.createDataFrame(
        [
            ("p", "r", ["read"], None, None),
            ("p", "q", ["read", "write"], dt.datetime(2023, 12, 31), None),
            ("p", "s", ["read"], NOW, "true"),
        ],
        "principal string, resource string, permissions array<string>, expires_at timestamp_ntz, mfa string",
    )
    asked = [("p", "r", "read", "false", True), ("p", "r", "write", "true", False), ("p", "q", "read", "true", False)]
    asked += [("p", "s", "read", "true", True), ("p", "s", "read", "false", False), ("p", "s", "read", None, False), ("x", "r", "read", "true", False)]
    requests = spark.createDataFrame(asked, "principal string, resource string, permission string, mfa string, want boolean")
    out = access.check_access(requests, grants, NOW, ["mfa"])
    assert out.count() == len(asked) and out.where(F.col("allowed") != F.col("want")).count() == 0


def test_access_with_listed_values(spark):
    grants = spark.createDataFrame(
        [("p", "r", ["read"], None, ["office", "vpn"]), ("q", "r", ["read"], None, None)],
        "principal string, resource string, permissions array<string>, expires_at timestamp_ntz, place array<string>",
    )
    asked = [("p", "vpn", True), ("p", "cafe", False), ("p", None, False), ("q", "cafe", True)]
    requests = spark.createDataFrame([(p, "r", "read", x, w) for p, x, w in asked], "principal string, resource string, permission string, place string, want boolean")
    out = access.check_access(requests, grants, NOW, ["place"])
    assert out.count() == 4 and out.where(F.col("allowed") != F.col("want")).count() == 0


def test_allow_lists(spark):
    ips = spark.createDataFrame([("10.0.0.5",), ("10.0.1.5",), ("not an ip",), ("10.0.0.5",)], "ip string")
    flags = [r["allowed"] for r in access.match_allow_list(ips, "ip", ["10.0.0.0/24"]).collect()]
    assert flags == [True, False, False, True]
    assert all(r["allowed"] for r in access.match_allow_list(ips, "ip", []).collect())
    assert all(r["allowed"] for r in access.match_allow_list(ips, "ip", ["10.9.9.9", "0.0.0.0"]).collect())
    ranges = spark.createDataFrame([(24, 10 * 256**3), (32, 10 * 256**3 + 256 + 5)], "prefix int, network bigint")
    assert sorted(r["allowed"] for r in access.match_ranges(ips, "ip", ranges).collect()) == [False, True, True, True]
    assert all(r["allowed"] for r in access.match_ranges(ips, "ip", ranges.limit(0)).collect())
    assert ips.select(ip_number(F.col("ip"))).head()[0] == 10 * 256**3 + 5


def test_merge_modes(spark):
    s = spark.createDataFrame([(1, None), (2, "s")], "k int, v string")
    t = spark.createDataFrame([(1, "t"), (3, "t")], "k int, v string")
    got = {m: {r["k"]: r["v"] for r in sync.merge(s, t, ["k"], m).collect()} for m in sync.MODES}
    assert got["source_wins"] == {1: None, 2: "s", 3: "t"}
    assert got["target_wins"] == {1: "t", 2: "s", 3: "t"}
    assert got["merge"] == {1: "t", 2: "s", 3: "t"}
    assert {r["k"]: r["change"] for r in setops.diff(s, t, ["k"]).collect()} == {1: "changed", 2: "new", 3: "gone"}


def test_the_mark_moves_and_stays(spark, inputs, folder):
    orders = inputs.table("orders").select("o_orderkey", "o_orderdate")
    assert sync.read_mark(spark, folder("mark")) is None
    assert sync.incremental(orders, "o_orderdate", folder("mark"), None, folder("out"), "r1").count() == orders.count()
    assert sync.incremental(orders, "o_orderdate", folder("mark"), None, folder("out"), "r2").count() == 0
    assert sync.read_mark(spark, folder("mark")) == orders.agg(F.max("o_orderdate")).head()[0]


def test_savings_defaults(spark):
    rows = [("a", "compute", 1.0, None, None), ("b", "compute", 1.0, 9, None), ("c", "storage", 1.0, None, 91), ("d", "storage", None, None, 99)]
    df = spark.createDataFrame(rows, "identifier string, resource_type string, cost_per_hour double, cpu_utilization int, last_access_days int")
    got = {r["identifier"]: r["monthly_savings"] for r in costs.savings(df).collect()}
    assert got == {"a": 0.0, "b": 360.0, "c": pytest.approx(504.0)}


def test_ranges_of_all_lengths_count(spark):
    ips = spark.createDataFrame([("10.1.2.3",), ("10.2.2.3",), ("10.3.0.9",), (None,), ("no address",)], "ip string")
    ranges = spark.createDataFrame([(16, 0x0A010000), (24, 0x0A020200), (None, 5)], "prefix int, network long")
    assert {r["ip"]: r["allowed"] for r in access.match_ranges(ips, "ip", ranges).collect()} == {
        "10.1.2.3": True, "10.2.2.3": True, "10.3.0.9": False, None: False, "no address": False,
    }
    every = spark.createDataFrame([(0, 0)], "prefix int, network long")
    assert [r["allowed"] for r in access.match_ranges(ips.limit(3), "ip", every).collect()] == [True] * 3


def test_requests_without_context(spark):
    grants = spark.createDataFrame([("p", "r", ["read"], None, "true")], "principal string, resource string, permissions array<string>, expires_at timestamp, mfa string")
    requests = spark.createDataFrame([(1, "p", "r", "read", None), (2, "p", "r", "read", "false"), (3, "p", "r", "write", None)], "id int, principal string, resource string, permission string, mfa string")
    allowed = lambda **k: {r["id"]: r["allowed"] for r in access.check_access(requests, grants, NOW, ["mfa"], **k).collect()}
    assert allowed() == {1: False, 2: False, 3: False}
    assert allowed(without_context=True) == {1: True, 2: False, 3: False}


def test_only_a_missing_mark_starts_over(spark, folder):
    path = folder("not-a-mark")
    spark.range(1).write.parquet(path)  # no column called mark
    with pytest.raises(Exception, match="mark"):
        sync.read_mark(spark, path)
    assert sync.read_mark(spark, folder("nothing")) is None


def test_absent_stores_are_named(spark):
    absent: dict[str, str] = {}
    stores = {"a": lambda: spark.range(2), "b": lambda: spark.table("no_such_table"), "c": lambda: spark.range(1).withColumn("x", F.lit(1))}
    assert setops.federated(stores, absent).count() == 3 and absent == {"b": "TABLE_OR_VIEW_NOT_FOUND"}
    with pytest.raises(ValueError, match="no store"):
        setops.federated({"b": stores["b"]})
