"""Copies of the driver's related tables."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.operators import replica as R
from sparkguard.plans import twin_masks as S
from sparkguard.plans.metrics_queries import rounded
from sparkguard.plans.registry import Inputs, query

KEY = S.KEY
ROWS = R.SAMPLE_ROWS

REGION = R.TableInfo("region", ("r_regionkey",))
NATION = R.TableInfo("nation", ("n_nationkey",), (R.ForeignKey("n_regionkey", "region", "r_regionkey"),))
CUSTOMER = R.TableInfo("customer", ("c_custkey",), (R.ForeignKey("c_nationkey", "nation", "n_nationkey"),))
SUPPLIER = R.TableInfo("supplier", ("s_suppkey",), (R.ForeignKey("s_nationkey", "nation", "n_nationkey"),))
PART = R.TableInfo("part", ("p_partkey",))
ORDERS = R.TableInfo("orders", ("o_orderkey",), (R.ForeignKey("o_custkey", "customer", "c_custkey"),))
LINEITEM = R.TableInfo(
    "lineitem",
    ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
    (
        R.ForeignKey("l_orderkey", "orders", "o_orderkey"),
        R.ForeignKey("l_partkey", "part", "p_partkey"),
        R.ForeignKey("l_suppkey", "supplier", "s_suppkey"),
    ),
)
RELATED = [REGION, NATION, CUSTOMER, SUPPLIER, PART, ORDERS, LINEITEM]
BY_NAME = {i.name: i for i in RELATED}


# ---- SQL text of the copies ------------------------------------------------------------------


def sample_sql(info: R.TableInfo, rows: int, key: str = KEY, columns: str = "*") -> str:
    text = " || '|' || ".join(f"cast({c} as varchar)" for c in info.primary_key)
    order = ", ".join(info.primary_key)
    return f"select {columns} from {info.name} order by md5('{S.own_key(info.name, key)}:' || {text}), {order} limit {rows}"


def fixed_sql(fk: R.ForeignKey, parent_cte: str, key: str = KEY) -> str:
    n = f"(select count(distinct {fk.parent_column}) from {parent_cte})"
    idx = f"{S.slot(f"md5('{S.own_key(fk.column, key)}:' || cast({fk.column} as varchar))", 0)} % {n}"
    return (
        f"case when {fk.column} in (select {fk.parent_column} from {parent_cte}) then {fk.column} else "
        f"(select list(distinct {fk.parent_column} order by {fk.parent_column}) from {parent_cte})[cast(1 + {idx} as bigint)] end"
    )


def copy_ctes(tables: list[str], rows: int, key: str = KEY) -> str:
    """One CTE ``r_<table>`` per copied table, parents first."""
    out = []
    names = {"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name"}
    for name in tables:
        info = BY_NAME[name]
        repl = []
        if name in names:
            c = names[name]
            repl.append(S.text_mask("fake_name", c, c).replace(S.own_key(c), S.own_key(c, key)) + f" as {c}")
        for fk in info.foreign_keys:
            if fk.parent in tables:
                repl.append(fixed_sql(fk, f"r_{fk.parent}", key) + f" as {fk.column}")
        shown = f"select * replace ({', '.join(repl)})" if repl else "select *"
        out.append(f"s_{name} as ({sample_sql(info, rows, key)}), r_{name} as materialized ({shown} from s_{name})")
    return ", ".join(out)


# ---- queries ---------------------------------------------------------------------------------


def _replicate(t: Inputs, tables: list[str], rows: int = ROWS, key: str = KEY, path: str | None = None) -> dict[str, DataFrame]:
    infos = [BY_NAME[n] for n in tables]
    return R.replicate({n: t.table(n) for n in tables}, infos, path or t.scratch("replica"), key, rows)


_LEVEL = {"region": 0, "part": 0, "nation": 1, "customer": 2, "supplier": 2, "orders": 3, "lineitem": 4}
_EDGES = ", ".join(f"('{i.name}', '{fk.parent}')" for i in RELATED for fk in i.foreign_keys)
_WALK = f"""with recursive e(child, parent) as (values {_EDGES}), walk(table_name, level) as (
  select unnest([{", ".join(f"'{i.name}'" for i in RELATED)}]), 0 union all select e.child, w.level + 1 from walk w join e on e.parent = w.table_name where w.level < {len(RELATED)})"""
_ROWCOUNT = " union all ".join(f"select '{i.name}' as table_name, count(*) as row_count from {i.name}" for i in RELATED)


def _stored_sample(t: Inputs, info: R.TableInfo, rows: int) -> DataFrame:
    """A sample written once, as the copies of a replica are, so that its readers do not draw it again."""
    path = t.scratch(f"sample-{info.name}")
    out = R.sample(t.table(info.name), info, KEY, rows)
    out.write.parquet(path)
    return t.spark.read.schema(out.schema).parquet(path)


def _row_counts(t: Inputs) -> DataFrame:
    return R.run_log({i.name: t.table(i.name) for i in RELATED}, "source").select("table_name", F.col("rows_copied").alias("row_count"))


@query(
    "dependency_order",
    f"{_WALK} select w.table_name, max(level) as level, max(row_count) as row_count from walk w join ({_ROWCOUNT}) n on n.table_name = w.table_name group by 1",
)
def dependency_order(t: Inputs):
    return R.dependency_levels(t.spark, RELATED).join(_row_counts(t), "table_name")


_ORPHANS = " union all ".join(
    f"select '{i.name}' as table_name, count(*) as unresolved from {i.name} where {fk.column} not in (select {fk.parent_column} from {fk.parent})"
    for i in RELATED
    for fk in i.foreign_keys
)


@query(
    "replica_order",
    f"""{_WALK}, lv as (select table_name, max(level) as level from walk group by 1), o as (select table_name, sum(unresolved)::bigint as unresolved from ({_ORPHANS}) group by 1)
    select row_number() over (order by level, lv.table_name)::int as position, lv.table_name, coalesce(unresolved, 0) as unresolved_keys from lv left join o on o.table_name = lv.table_name""",
)
def replica_order(t: Inputs):
    """Processing order with the foreign keys of each source table that resolve nowhere."""
    order = R.processing_order(RELATED)
    out = None
    for n, info in enumerate(order):
        missing = None
        for fk in info.foreign_keys:
            keys = t.table(fk.parent).select(F.col(fk.parent_column).alias("_pk"))
            child = t.table(info.name)
            lost = child.join(keys, child[fk.column] == keys["_pk"], "left_anti").agg(F.count(F.lit(1)).alias("n"))
            missing = lost if missing is None else missing.unionByName(lost)
        base = missing if missing is not None else t.table(info.name).limit(0).agg(F.count(F.lit(1)).alias("n"))
        one = base.agg(F.sum("n").alias("unresolved_keys")).select(F.lit(n + 1).alias("position"), F.lit(info.name).alias("table_name"), "unresolved_keys")
        out = one if out is None else out.unionByName(one)
    return out


@query("table_sample", f"select 'orders' as t, o_orderkey as k from ({sample_sql(ORDERS, 1000)}) union all select 'nation', n_nationkey from nation")
def table_sample(t: Inputs):
    orders = R.sample(t.table("orders"), ORDERS, KEY, 1000).select(F.lit("orders").alias("t"), F.col("o_orderkey").alias("k"))
    nation = R.sample(t.table("nation"), NATION, KEY, 1000).select(F.lit("nation").alias("t"), F.col("n_nationkey").cast("long").alias("k"))
    return orders.unionByName(nation)


_FK = f"""with r_customer as materialized ({sample_sql(CUSTOMER, ROWS)})"""


@query("fk_left_join", f"{_FK} select o_orderkey, o_custkey as old_key, {fixed_sql(ORDERS.foreign_keys[0], 'r_customer')} as new_key from orders")
def fk_left_join(t: Inputs):
    """The whole child table against a sample of its parents."""
    parents = _stored_sample(t, CUSTOMER, ROWS)
    child = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("old_key"), "o_custkey")
    fixed = R.fix_foreign_key(child, ORDERS.foreign_keys[0], parents, KEY)
    return fixed.select("o_orderkey", "old_key", F.col("o_custkey").alias("new_key"))


@query("fk_semi_sample", f"{_FK} select o_orderkey, o_custkey from orders where o_custkey in (select c_custkey from r_customer)")
def fk_semi_sample(t: Inputs):
    parents = R.sample(t.table("customer"), CUSTOMER, KEY, ROWS)
    return R.keep_with_parents(t.table("orders"), ORDERS.foreign_keys[0], parents).select("o_orderkey", "o_custkey")


_LINEITEM_FIXED = ", ".join(f"{fixed_sql(fk, f'r_{fk.parent}')} as {fk.column}" for fk in LINEITEM.foreign_keys)


@query(
    "replica_fk_fix",
    f"""with r_orders as materialized ({sample_sql(ORDERS, ROWS)}), r_part as materialized ({sample_sql(PART, ROWS)}), r_supplier as materialized ({sample_sql(SUPPLIER, ROWS)})
    select l_linenumber, l_extendedprice, {_LINEITEM_FIXED} from lineitem""",
)
def replica_fk_fix(t: Inputs):
    """Three foreign keys of the whole line items against samples of their parents."""
    out = t.table("lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    with ThreadPoolExecutor(R.CONCURRENT_TABLES) as pool:
        parents = list(pool.map(lambda fk: _stored_sample(t, BY_NAME[fk.parent], ROWS), LINEITEM.foreign_keys))
    for fk, parent in zip(LINEITEM.foreign_keys, parents, strict=True):
        out = R.fix_foreign_key(out, fk, parent, KEY)
    return out


@query(
    "replica_mask",
    f"select c_custkey, {S.text_mask('fake_name', 'c_name', 'c_name')} as c_name, c_nationkey, c_acctbal, c_mktsegment from customer",
)
def replica_mask(t: Inputs):
    return R.mask(t.table("customer"), CUSTOMER, KEY)


_ALL = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem"]
_CTES = copy_ctes(_ALL, ROWS)


@query(
    "replicate_schema",
    f"""with {_CTES} select 'orders' as t, o_orderkey as k, o_custkey as fk1, -1 as fk2, -1 as fk3, round(o_totalprice, 2) as amount from r_orders
    union all select 'lineitem', l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_extendedprice, 2) from r_lineitem""",
)
def replicate_schema(t: Inputs):
    copies = _replicate(t, _ALL)
    orders = copies["orders"].select(
        F.lit("orders").alias("t"),
        F.col("o_orderkey").alias("k"),
        F.col("o_custkey").alias("fk1"),
        F.lit(-1).cast("long").alias("fk2"),
        F.lit(-1).cast("long").alias("fk3"),
        F.col("o_totalprice").alias("amount"),
    )
    lines = copies["lineitem"].select(
        F.lit("lineitem").alias("t"),
        F.col("l_orderkey").alias("k"),
        F.col("l_linenumber").cast("long").alias("fk1"),
        F.col("l_partkey").alias("fk2"),
        F.col("l_suppkey").alias("fk3"),
        F.col("l_extendedprice").alias("amount"),
    )
    return rounded(orders.unionByName(lines), "amount", places=2)


@query("replica_sink", f"with {copy_ctes(['region', 'nation', 'customer'], ROWS)} select c_custkey, c_name, c_nationkey, n_name, r_name from r_customer join r_nation on c_nationkey = n_nationkey join r_region on n_regionkey = r_regionkey")
def replica_sink(t: Inputs):
    """Written copies join without losing a row."""
    c = _replicate(t, ["region", "nation", "customer"])
    joined = c["customer"].join(c["nation"], F.col("c_nationkey") == F.col("n_nationkey")).join(c["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("c_custkey", "c_name", "c_nationkey", "n_name", "r_name")


@query(
    "replica_refresh",
    f"""with {copy_ctes(['region', 'nation', 'customer'], ROWS, 'next-key')} select 'customer' as table_name, count(*) as rows_copied, sum(c_custkey)::bigint as key_sum from r_customer
    union all select 'nation', count(*), sum(n_nationkey)::bigint from r_nation union all select 'region', count(*), sum(r_regionkey)::bigint from r_region""",
)
def replica_refresh(t: Inputs):
    """A second run replaces the copies of the first."""
    tables = ["region", "nation", "customer"]
    path = t.scratch("refresh")
    _replicate(t, tables, path=path)
    copies = _replicate(t, tables, key="next-key", path=path)
    out = None
    for name in tables:
        one = copies[name].agg(F.count(F.lit(1)).alias("rows_copied"), F.sum(BY_NAME[name].primary_key[0]).alias("key_sum"))
        one = one.select(F.lit(name).alias("table_name"), "rows_copied", "key_sum")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "replica_segment_totals",
    f"""with {_CTES} select c_mktsegment, count(distinct o_orderkey) as orders, count(l_linenumber) as line_items, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue
    from r_customer join r_orders on o_custkey = c_custkey join r_lineitem on l_orderkey = o_orderkey group by 1""",
)
def replica_segment_totals(t: Inputs):
    """Flagship: the copies are related, so they join and total like the originals."""
    c = _replicate(t, _ALL)
    joined = c["customer"].join(c["orders"], F.col("o_custkey") == F.col("c_custkey")).join(c["lineitem"], F.col("l_orderkey") == F.col("o_orderkey"))
    out = joined.groupBy("c_mktsegment").agg(
        F.countDistinct("o_orderkey").alias("orders"),
        F.count("l_linenumber").alias("line_items"),
        F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"),
    )
    return rounded(out, "revenue", places=2)


@query(
    "replication_status",
    """with l as (select agent_type as run, task_id as rows_copied, started_at, completed_at as ended_at from fx_tasks where completed_at is not null),
    s as (select run, count(*) as tables_processed, sum(rows_copied)::bigint as rows_copied, (epoch_us(max(ended_at)) - epoch_us(min(started_at))) / 1000000.0 as duration_seconds from l group by 1)
    select run, tables_processed, rows_copied, duration_seconds::double as duration_seconds, round(tables_processed / duration_seconds, 8) as tables_per_second, round(rows_copied / duration_seconds, 6) as rows_per_second from s""",
    fx="tasks",
)
def replication_status(t: Inputs):
    """A run log with one line per finished task."""
    log = t.fx("tasks").where(F.col("completed_at").isNotNull())
    log = log.select(F.col("agent_type").alias("run"), F.col("task_id").alias("rows_copied"), "started_at", F.col("completed_at").alias("ended_at"))
    return rounded(rounded(R.replication_status(log), "tables_per_second", places=8), "rows_per_second", places=6)
