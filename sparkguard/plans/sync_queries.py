"""Synchronisation and streams."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.functions.series import series_key
from sparkguard.operators import sync
from sparkguard.plans import audit_queries as AQ
from sparkguard.plans import twin_masks as S
from sparkguard.plans.metrics_queries import _STATS, ALERTS, STEP, _alert_rows, episodes_sql, rounded
from sparkguard.plans.registry import Inputs, query
from sparkguard.streaming import jobs

MARK = dt.datetime(2000, 6, 1)


@query("sync_full", "select o_orderkey as id, o_custkey, o_totalprice from orders where o_totalprice > 200000")
def sync_full(t: Inputs):
    steps = [{"type": "rename", "mapping": {"o_orderkey": "id"}}, {"type": "filter", "expression": "o_totalprice > 200000"}]
    source = t.table("orders").select("o_orderkey", "o_custkey", "o_totalprice")
    return t.spark.read.parquet(sync.full(source, steps, t.scratch("sync-full"), dt.datetime(2001, 9, 1)))


@query(
    "sync_incremental",
    """select 'first' as run, o_orderkey, o_orderdate from orders where o_orderstatus = 'F' and o_orderdate <= timestamp '2000-06-01'
    union all select 'second', o_orderkey, o_orderdate from orders where o_orderstatus = 'F' and o_orderdate > (select max(o_orderdate) from orders where o_orderstatus = 'F' and o_orderdate <= timestamp '2000-06-01')""",
)
def sync_incremental(t: Inputs):
    """The first run sees the orders up to a day, the second only what came after its mark."""
    orders = t.table("orders").select("o_orderkey", "o_orderdate", "o_orderstatus")
    path, mark = t.scratch("sync-inc"), t.scratch("sync-mark")
    early = orders.where(F.col("o_orderdate") <= F.lit("2000-06-01 00:00:00").cast("timestamp_ntz"))
    first = sync.incremental(early, "o_orderdate", mark, {"o_orderstatus": "F"}, path, "first")
    second = sync.incremental(orders, "o_orderdate", mark, {"o_orderstatus": "F"}, path, "second")
    wanted = ["o_orderkey", "o_orderdate"]
    return first.select(F.lit("first").alias("run"), *wanted).unionByName(second.select(F.lit("second").alias("run"), *wanted))


def _source(t: Inputs) -> DataFrame:
    return t.table("customer").where("c_mktsegment <> 'MACHINERY'").withColumn("c_name", F.when(F.col("c_custkey") % 7 != 0, F.col("c_name")))


_SRC = "s as (select c_custkey, case when c_custkey % 7 <> 0 then c_name end as c_name, c_nationkey, c_acctbal, c_mktsegment from customer where c_mktsegment <> 'MACHINERY')"
_COLS = ["c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]


def _merge_sql(mode: str) -> str:
    if mode == "merge":
        cols = ", ".join(f"coalesce(s.{c}, g.{c}) as {c}" for c in _COLS)
    else:
        a, b = ("s", "g") if mode == "source_wins" else ("g", "s")
        cols = ", ".join(f"case when {a}.c_custkey is not null then {a}.{c} else {b}.{c} end as {c}" for c in _COLS)
    return f"select '{mode}' as mode, coalesce(s.c_custkey, g.c_custkey) as c_custkey, {cols} from s full join fx_sync_target g on s.c_custkey = g.c_custkey"


@query("sync_merge", f"with {_SRC} " + " union all ".join(_merge_sql(m) for m in sync.MODES), fx="sync_target")
def sync_merge(t: Inputs):
    source, target = _source(t), t.fx("sync_target")
    out = None
    for mode in sync.MODES:
        one = sync.merge(source, target, ["c_custkey"], mode).select(F.lit(mode).alias("mode"), "c_custkey", *_COLS)
        out = one if out is None else out.unionByName(one)
    return out


def _print_sql(table: str) -> str:
    text = " || '|' || ".join(
        [
            "coalesce(cast(c_custkey as varchar), '~')",
            "coalesce(c_name, '~')",
            "coalesce(cast(c_nationkey as varchar), '~')",
            "coalesce(cast(cast(c_acctbal as decimal(38,6)) as varchar), '~')",
            "coalesce(c_mktsegment, '~')",
        ]
    )
    return f"(select count(*) as n, cast(sum({S.slot(f'md5({text})', 0)}) as varchar) as d from {table})"


@query(
    "sync_validate",
    f"""select 'copy' as pair, a.n as source_rows, a.d as source_digest, a.n as target_rows, a.d as target_digest, true as valid from {_print_sql('customer')} a
    union all select 'target', a.n, a.d, b.n, b.d, false from {_print_sql('customer')} a, {_print_sql('fx_sync_target')} b""",
    fx="sync_target",
)
def sync_validate(t: Inputs):
    customer = t.table("customer")
    path = t.scratch("sync-copy")
    customer.write.parquet(path)
    return sync.validate({"copy": (customer, t.spark.read.parquet(path)), "target": (customer, t.fx("sync_target").select(*customer.columns))})


# ---- streams ---------------------------------------------------------------------------------


def _events(t: Inputs) -> DataFrame:
    """All events as a bounded stream."""
    events = t.table("events")
    series = [F.col("event_type"), F.col("user_id") % 10]
    return jobs.files(t.spark, t.sf_dir, "events.parquet", events.schema).unionByName(jobs.ending(events, series, t.scratch("ending")))


def _points(t: Inputs) -> DataFrame:
    """The metric projection over the event stream."""
    name = F.concat(F.lit("app."), "event_type")
    tags = F.create_map(F.lit("user"), (F.col("user_id") % 10).cast("string"))
    return _events(t).select(F.col("event_id").alias("point_id"), name.alias("name"), tags.alias("tags"), series_key(name, tags).alias("series_key"), "ts", "value")


def _sink(t: Inputs, stream: DataFrame, label: str) -> DataFrame:
    path = t.scratch(label)
    jobs.run_to_files(stream, path, t.scratch(f"{label}-checkpoint")).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(path)


@query(
    "stream_metric_windows",
    f"""with w as (select series_key, value, unnest(range(date_trunc('minute', ts) - interval 4 minute, date_trunc('minute', ts) + interval 1 minute, interval 1 minute)) as window_start from fx_metrics)
    select window_start, window_start + interval 5 minute as window_end, series_key, {_STATS} from w group by window_start, series_key""",
    fx="metrics",
)
def stream_metric_windows(t: Inputs):
    return rounded(_sink(t, jobs.metric_windows(_points(t)), "windows"), "sum", "avg", "stddev")


@query(
    "stream_tumbling_rate",
    """select make_timestamp(epoch_us(ts) // 7200000000 * 7200000000) as window_start, user_id % 3 as client, count(*) as requests, count(*) - 12 as over_limit
      from events group by 1, 2 having count(*) > 12""",
)
def stream_tumbling_rate(t: Inputs):
    requests = _events(t).select("ts", (F.col("user_id") % 3).alias("client"))
    return _sink(t, jobs.request_counts(requests, ["client"], "7200 seconds", 12), "rates")


@query(
    "stream_sessions",
    """with g as (select user_id, ts, case when ts >= lag(ts) over (partition by user_id order by ts) + interval 3600 second or lag(ts) over (partition by user_id order by ts) is null then 1 else 0 end as fresh from events),
    r as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as run from g)
    select min(ts) as session_start, max(ts) + interval 3600 second as session_end, user_id, count(*) as events from r group by user_id, run""",
)
def stream_sessions(t: Inputs):
    return _sink(t, jobs.activity_sessions(_events(t).select("ts", "user_id"), ["user_id"]), "sessions")


@query(
    "stream_alerts",
    f"""with {_alert_rows()}, {episodes_sql(STEP)}, v as (select alert_id, slot, cv from g),
    x as (select alert_id, 'firing' as event, triggered_at as sent from ep union all select alert_id, 'resolved', resolved_at from ep where resolved_at is not null)
    select x.alert_id, event, sent as "at", cv as value from x join v on v.alert_id = x.alert_id and v.slot = epoch(sent)::bigint""",
    fx="metrics",
)
def stream_alerts(t: Inputs):
    events = t.scratch("alert-events")
    jobs.alerts_to_files(_points(t), ALERTS, events, t.scratch("alert-checkpoint"), STEP).awaitTermination()
    return t.spark.read.schema(jobs.ALERT_EVENTS).parquet(events)


_LOG_COLUMNS = ["event_id", "query_type", "safety_level", "decision", "reason"]


@query(
    "stream_audit",
    f"with {AQ._G} select event_id, qtype as query_type, level as safety_level, case when allowed then 'ALLOWED' else 'BLOCKED' end as decision, reason from g",
    fx="query_log",
)
def stream_audit(t: Inputs):
    """The statements arrive as files; both sinks together hold every decision once."""
    source, blocked, allowed = t.scratch("log"), t.scratch("blocked"), t.scratch("allowed")
    log = t.fx("query_log")
    log.write.parquet(source)
    stream = t.spark.readStream.schema(log.schema).parquet(source)
    jobs.audit_to_sinks(stream, blocked, allowed, t.scratch("audit-checkpoint")).awaitTermination()
    both = t.spark.read.option("mergeSchema", "false").parquet(blocked).unionByName(t.spark.read.parquet(allowed))
    return both.select(*_LOG_COLUMNS)


@query(
    "stream_mask",
    f"select c_custkey, {S.text_mask('fake_name', 'full_name', 'full_name')} as full_name, c_mktsegment from (select c_custkey, c_name as full_name, c_mktsegment from customer)",
)
def stream_mask(t: Inputs):
    rows = jobs.files(t.spark, t.sf_dir, "customer.parquet", t.table("customer").schema)
    named = rows.select("c_custkey", F.col("c_name").alias("full_name"), "c_mktsegment")
    return _sink(t, jobs.masked(named, S.KEY, threshold=0.4), "masked")


@query(
    "sync_stream",
    """select c.c_custkey, coalesce(g.c_name, c.c_name) as c_name, coalesce(g.c_acctbal, c.c_acctbal) as c_acctbal, case when g.c_custkey is null then 1 else 2 end as version
    from customer c left join fx_sync_target g on g.c_custkey = c.c_custkey""",
    fx="sync_target",
)
def sync_stream(t: Inputs):
    """Two versions of the customers arrive; the state holds the newest of each."""
    source, path = t.scratch("sync-source"), t.scratch("sync-changes")
    first = t.table("customer").select("c_custkey", "c_name", "c_acctbal", F.lit(1).alias("version"))
    second = t.fx("sync_target").select("c_custkey", "c_name", "c_acctbal", F.lit(2).alias("version"))
    first.write.parquet(source)
    second.write.mode("append").parquet(source)
    stream = t.spark.readStream.schema(first.schema).option("maxFilesPerTrigger", 1).parquet(source)
    jobs.sync_to_changes(stream, path, t.scratch("sync-checkpoint"), ["c_custkey"], ["version"]).awaitTermination()
    return jobs.current(jobs.changes(t.spark, path, first.schema), ["c_custkey"], ["version"])
