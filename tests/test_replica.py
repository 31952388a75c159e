"""Copies of related tables."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkguard.operators import replica as R
from sparkguard.plans.registry import Inputs
from sparkguard.plans.replica_queries import _ALL, BY_NAME, CUSTOMER, ORDERS, RELATED

KEY = "k"


@pytest.fixture(scope="module")
def tables(spark):
    t = Inputs(spark, SF)
    return {n: t.table(n) for n in _ALL}


def test_no_orphans_and_keys_stay(spark, tables, tmp_path_factory):
    copies = R.replicate(tables, RELATED, str(tmp_path_factory.mktemp("copy")), KEY, 40)
    for info in RELATED:
        copy = copies[info.name]
        assert copy.count() == min(40, tables[info.name].count())
        assert copy.schema.simpleString() == tables[info.name].schema.simpleString()
        for fk in info.foreign_keys:
            parent = copies[fk.parent].select(F.col(fk.parent_column).alias("p"))
            assert copy.join(parent, copy[fk.column] == parent["p"], "left_anti").count() == 0
        if info.name != "lineitem":
            assert copy.join(tables[info.name], list(info.primary_key), "left_anti").count() == 0


def test_masked_names_differ(tables):
    out = R.mask(tables["customer"], CUSTOMER, KEY).join(tables["customer"].select("c_custkey", F.col("c_name").alias("old")), "c_custkey")
    assert out.where(F.col("c_name") == F.col("old")).count() == 0


def test_samples_repeat_and_depend_on_the_key(tables):
    a, b, c = (
        {r["o_orderkey"] for r in R.sample(tables["orders"], ORDERS, k, 30).select("o_orderkey").collect()} for k in ("x", "x", "y")
    )
    assert a == b != c


def test_samples_of_every_size_are_the_least_digests(tables):
    orders = tables["orders"]
    order = ["_d", "o_orderkey"]
    drawn = orders.withColumn("_d", R.digest(F.col("o_orderkey").cast("string"), KEY, "orders"))
    listed = [r["o_orderkey"] for r in drawn.orderBy(*order).collect()]
    for rows in (1, 10, 700, len(listed), len(listed) + 5):
        assert [r["o_orderkey"] for r in R.sample(orders, ORDERS, KEY, rows).collect()] == listed[:rows]


def test_a_sample_looks_at_few_rows(tables):
    plan = R.sample(tables["orders"], ORDERS, KEY, 20)._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" in plan.split("Sort")[1] and "scalar-subquery" in plan


def test_shuffle_joins_give_the_same_rows(spark, tables):
    fk = ORDERS.foreign_keys[0]

    def run():
        parents = R.sample(tables["customer"], CUSTOMER, KEY, 60)
        fixed = R.fix_foreign_key(tables["orders"], fk, parents, KEY)
        return sorted(map(tuple, fixed.collect())), sorted(map(tuple, R.keep_with_parents(tables["orders"], fk, parents).collect()))

    small = run()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert run() == small
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("most", [500, R.ARRAY_KEYS + 1])
def test_the_same_key_is_drawn_from_an_array_and_by_ranges(spark, most):
    """Few keys are an array in the plan: one join, no window, no checkpoint. Many are numbered in ranges."""
    fk = R.ForeignKey("p", "parent", "id")
    keys = [7 * i for i in range(500)]
    parents = spark.createDataFrame([(k,) for k in [*keys, *keys[:50], None]], "id bigint").repartition(8)
    child = spark.createDataFrame([(i, 7 * i + 1) for i in range(300)], "c int, p bigint")
    fixed = R.fix_foreign_key(child, fk, parents, KEY, most)
    plan = fixed._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan
    if most <= R.ARRAY_KEYS:
        assert plan.count("Join") == 1 and "Window" not in plan and "RDD scan" not in plan.replace("LogicalRDD", "") and "_part" not in plan
    drawn = child.select("c", (R.slot(R.digest(F.col("p").cast("string"), KEY, "p"), 0) % len(keys)).alias("i")).collect()
    assert {r["c"]: r["p"] for r in fixed.collect()} == {r["c"]: keys[r["i"]] for r in drawn}


def test_more_keys_than_promised_is_an_error(spark):
    fk = R.ForeignKey("p", "parent", "id")
    parents = spark.range(11).toDF("id")
    child = spark.createDataFrame([(1, 77)], "c int, p bigint")
    assert R.fix_foreign_key(child, fk, parents, KEY, 11).head()["p"] < 11
    with pytest.raises(Exception, match="more keys than the 10"):
        R.fix_foreign_key(child, fk, parents, KEY, 10).collect()


def test_an_empty_table_has_an_empty_sample(tables):
    assert R.sample(tables["orders"].limit(0), ORDERS, KEY, 10).count() == 0


def test_tables_of_a_level_are_copied_side_by_side(spark, tables, tmp_path, monkeypatch):
    """Never a table before its parents, and an error in one ends the run."""
    begun, done = [], []
    plain = R.sample
    monkeypatch.setattr(R, "sample", lambda df, info, *rest: (begun.append((info.name, tuple(done))), plain(df, info, *rest))[1])
    write = R.mask
    monkeypatch.setattr(R, "mask", lambda df, info, key: (done.append(info.name), write(df, info, key))[1])
    R.replicate(tables, RELATED, str(tmp_path / "a"), KEY, 20)
    level = R.levels(RELATED)
    for name, before in begun:
        assert {n for n in level if level[n] < level[name]} <= set(before)
    with pytest.raises(Exception, match="missing"):
        R.replicate(tables, [R.TableInfo("region", ("missing",)), BY_NAME["part"]], str(tmp_path / "b"), KEY, 20)


def test_no_parents_gives_null_and_a_missing_parent_changes_nothing(spark, tables, tmp_path):
    fk = ORDERS.foreign_keys[0]
    empty = tables["customer"].limit(0)
    assert R.fix_foreign_key(tables["orders"], fk, empty, KEY).where(F.col("o_custkey").isNotNull()).count() == 0
    copies = R.replicate({"orders": tables["orders"]}, [BY_NAME["orders"]], str(tmp_path), KEY, 25)
    assert copies["orders"].join(tables["orders"], ["o_orderkey", "o_custkey"], "left_anti").count() == 0


def test_null_keys_are_replaced(spark, tables):
    fk = R.ForeignKey("p", "parent", "id")
    child = spark.createDataFrame([(1, 7), (2, None), (3, 9)], "c int, p bigint")
    parents = spark.createDataFrame([(7,)], "id bigint")
    assert {r["p"] for r in R.fix_foreign_key(child, fk, parents, KEY).collect()} == {7}


def test_order_with_self_reference_and_cycle():
    a = R.TableInfo("a", ("id",), (R.ForeignKey("x", "a", "id"),))
    b = R.TableInfo("b", ("id",), (R.ForeignKey("x", "a", "id"), R.ForeignKey("y", "c", "id")))
    c = R.TableInfo("c", ("id",), (R.ForeignKey("x", "a", "id"),))
    assert [t.name for t in R.processing_order([b, c, a])] == ["a", "c", "b"]
    d = R.TableInfo("d", ("id",), (R.ForeignKey("x", "e", "id"),))
    e = R.TableInfo("e", ("id",), (R.ForeignKey("x", "d", "id"),))
    assert {t.name for t in R.processing_order([d, e, a])} == {"a", "d", "e"}
