"""Scans, sinks, filters and transformations."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from sparkguard.operators import counting
from sparkguard.operators import transforms as X
from sparkguard.plans.metrics_queries import rounded
from sparkguard.plans.registry import TABLES, Inputs, query
from sparkguard.sources import backups, catalogs, logs
from sparkguard.sources import tables as S

AS_OF = dt.datetime(2001, 9, 1)
BACKUP_KEY = "0123456789abcdef"

# ---- scans and sinks -------------------------------------------------------------------------


@query("scan_tables", "select l_orderkey, l_linenumber, cast(l_quantity as bigint) as l_quantity, l_shipdate from lineitem")
def scan_tables(t: Inputs):
    wanted = {"l_orderkey": "bigint", "l_linenumber": "int", "l_quantity": "bigint", "l_shipdate": "timestamp_ntz"}
    return S.scan(t.spark, f"{t.sf_dir}/lineitem.parquet", wanted)


@query(
    "document_find",
    "select doc_id, source, n_chars from documents where lang = 'en' and source = (select min(source) from documents) order by doc_id limit 1000",
)
def document_find(t: Inputs):
    docs = t.table("documents").select("doc_id", "lang", "source", "n_chars")
    same = docs.where(F.col("source") == docs.agg(F.min("source")).scalar())
    return S.find(same, {"lang": "en"}, ["doc_id"], S.FIND_LIMIT).select("doc_id", "source", "n_chars")


@query(
    "read_audit_jsonl",
    """select event_id, session_id, type as event_type, status, case when event_id % 2 = 0 then 'gate' else 'session' end as shape from fx_audit where event_id % 50 <> 7
    union all select -1, '', '', '', 'broken' from fx_audit where event_id % 50 = 7""",
    fx="audit",
)
def read_audit_jsonl(t: Inputs):
    """Both line shapes and some broken lines, written and read back."""
    a = t.fx("audit").withColumn("message", F.col("event_id").cast("string"))
    gate = F.to_json(F.struct(F.col("ts").alias("timestamp"), "session_id", "type", "status", "message"))
    session = F.to_json(
        F.struct(
            F.col("ts").alias("timestamp"), F.col("type").alias("event_type"), "session_id", "status", F.create_map(F.lit("id"), "message").alias("extra")
        )
    )
    line = F.when(F.col("event_id") % 50 == 7, F.lit('{"timestamp": ')).when(F.col("event_id") % 2 == 0, gate).otherwise(session)
    path = t.scratch("audit")
    a.select(line.alias("value")).write.text(path)
    back = logs.read_audit(t.spark, path)
    broken = F.col("_corrupt").isNotNull()
    return back.select(
        F.when(broken, -1).otherwise(F.coalesce("message", F.col("extra")["id"]).cast("long")).alias("event_id"),
        F.coalesce("session_id", F.lit("")).alias("session_id"),
        F.coalesce("event_type", F.lit("")).alias("event_type"),
        F.coalesce("status", F.lit("")).alias("status"),
        F.when(broken, "broken").when(F.col("message").isNotNull(), "gate").otherwise("session").alias("shape"),
    )


@query("read_metric_csv", "select ts, name, value from fx_metrics", fx="metrics")
def read_metric_csv(t: Inputs):
    path = t.scratch("metric-lines")
    line = F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), "name", F.col("value").cast("string"))
    t.fx("metrics").select(line).write.text(path)
    return logs.read_metric_lines(t.spark, path)


@query(
    "sandbox_metadata_roundtrip",
    """select sandbox_id, 'sb' || cast(sandbox_id as varchar) as name, sandbox_type, state, created_at, last_refreshed, auto_refresh, refresh_hours, storage_mb, error_count::int as error_count, tags from fx_sandboxes""",
    fx="sandboxes",
)
def sandbox_metadata_roundtrip(t: Inputs):
    boxes = t.fx("sandboxes").withColumn("name", F.concat(F.lit("sb"), F.col("sandbox_id").cast("string")))
    boxes = boxes.withColumn("tags", F.split("tags", ","))
    path = t.scratch("sandboxes")
    logs.write_sandboxes(boxes, path)
    back = logs.read_sandboxes(t.spark, path).withColumn("tags", F.array_join("tags", ","))
    return back.select(
        "sandbox_id", "name", "sandbox_type", "state", "created_at", "last_refreshed", "auto_refresh", "refresh_hours", "storage_mb", "error_count", "tags"
    )


_COUNTS = " union all ".join(f"select '{n}' as table_name, count(*) as row_count from {n}" for n in TABLES)


@query(
    "discover_tables",
    f"""select 'main' as schema_name, c.table_name, column_name, ordinal_position::int as ordinal,
    case data_type when 'VARCHAR' then 'string' when 'INTEGER' then 'int' when 'TIMESTAMP' then 'timestamp_ntz' when 'FLOAT[]' then 'array<float>' else lower(data_type) end as data_type,
    true as nullable, row_count from information_schema.columns c join ({_COUNTS}) n on c.table_name = n.table_name""",
)
def discover_tables(t: Inputs):
    return catalogs.discover(t.spark, "main", {n: t.table(n) for n in TABLES})


_UNIFIED = """select provider, format, database_name, table_name, string_agg(column_name || ':' || data_type, ',' order by ordinal) as columns from (
  select 'aws' as provider, 'mysql' as format, database_name, table_name, column_name, data_type, ordinal from fx_columns where column_id % 3 <> 0
  union all select 'fabric', 'delta', database_name, table_name, column_name, data_type, ordinal from fx_columns where column_id % 3 = 0) u group by all"""


@query("unified_catalog", _UNIFIED, fx="columns")
def unified_catalog(t: Inputs):
    cols = t.fx("columns")
    aws = cols.where(F.col("column_id") % 3 != 0)
    fabric = cols.where(F.col("column_id") % 3 == 0).withColumn("location", F.concat(F.lit("Tables/"), "table_name")).drop("nullable")
    out = catalogs.unified({"aws": (aws, "mysql"), "fabric": (fabric, "delta")})
    text = F.array_join(F.transform("columns", lambda c: F.concat_ws(":", c["column_name"], c["data_type"])), ",")
    return out.withColumn("columns", text)


@query(
    "table_schema_lookup",
    """select 'db1.tbl4' as asked, database_name, table_name, ordinal, column_name, data_type from fx_columns where database_name = 'db1' and table_name = 'tbl4'
    union all select 'tbl3', database_name, table_name, ordinal, column_name, data_type from fx_columns where database_name = 'db0' and table_name = 'tbl3'""",
    fx="columns",
)
def table_schema_lookup(t: Inputs):
    cols = t.fx("columns")
    wanted = ["database_name", "table_name", "ordinal", "column_name", "data_type"]
    full = catalogs.lookup(cols, "db1.tbl4").select(F.lit("db1.tbl4").alias("asked"), *wanted)
    bare = catalogs.lookup(cols, "tbl3", default_schema="db0").select(F.lit("tbl3").alias("asked"), *wanted)
    return full.unionByName(bare)


@query("external_table", "select c_custkey, c_name, c_acctbal from customer")
def external_table(t: Inputs):
    columns = {"c_custkey": "bigint", "c_name": "string", "c_acctbal": "double"}
    return S.external_table(t.spark, "external_customer", columns, f"{t.sf_dir}/customer.parquet")


@query("chunked_export", "select l_orderkey, l_linenumber, l_quantity, l_extendedprice from lineitem")
def chunked_export(t: Inputs):
    """Written in chunks, read back whole."""
    path = t.scratch("chunks")
    S.write_chunks(t.table("lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice"), path)
    return t.spark.read.parquet(path)


@query(
    "encrypted_backup",
    "select 'customer' as source, '20010901_000000' as backup_ts, true as encrypted, count(*) as rows, 0::bigint as readable_rows from customer",
)
def encrypted_backup(t: Inputs):
    path = t.scratch("backup")
    backups.write_backup(t.table("customer"), path, BACKUP_KEY, AS_OF, "customer")
    back = t.spark.read.parquet(path).groupBy(F.col("source"), F.col("backup_ts").cast("string").alias("backup_ts"), "encrypted")
    readable = F.coalesce(F.unbase64("payload").cast("string"), F.lit("")).contains("c_custkey")
    return back.agg(F.count(F.lit(1)).alias("rows"), F.count_if(readable).alias("readable_rows"))


@query("encrypted_restore", "select c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment from customer")
def encrypted_restore(t: Inputs):
    """Half of the rows were never encrypted; both halves come back."""
    customer = t.table("customer")
    path = t.scratch("restore")
    backups.write_backup(customer.where("c_acctbal >= 0"), path, BACKUP_KEY, AS_OF, "customer")
    backups.write_backup(customer.where("c_acctbal < 0"), path, BACKUP_KEY, AS_OF, "customer", encrypt=False)
    return backups.read_backup(t.spark, path, customer.schema.simpleString()[7:-1].replace(":", " "), BACKUP_KEY, "customer")


@query(
    "artifact_layout",
    """select user_id % 20 as user_id, 's' || cast(user_id % 40 as varchar) as session_id, strftime(ts, '%Y%m') as ts_prefix, count(*) as artifacts, round(sum(value), 4) as total
    from events group by 1, 2, 3""",
)
def artifact_layout(t: Inputs):
    e = t.table("events").select(
        "event_id",
        "value",
        (F.col("user_id") % 20).alias("user_id"),
        F.concat(F.lit("s"), (F.col("user_id") % 40).cast("string")).alias("session_id"),
        F.date_format("ts", "yyyyMM").alias("ts_prefix"),
    )
    path = t.scratch("artifacts")
    backups.write_artifacts(e, path)
    back = t.spark.read.schema("event_id bigint, value double, user_id bigint, session_id string, ts_prefix string").parquet(path)
    return rounded(back.groupBy("user_id", "session_id", "ts_prefix").agg(F.count(F.lit(1)).alias("artifacts"), F.sum("value").alias("total")), "total")


@query("table_export_limit", "select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 10")
def table_export_limit(t: Inputs):
    return S.first_rows(t.table("orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey"), S.ADHOC_LIMIT)


@query(
    "docs_schema_infer",
    """with d as (select event_id, value, event_type from events), f as (
      select '_id' as field, 'int' as type, event_id from d
      union all select 'k', 'int', event_id from events
      union all select 'v', case when event_id % 2 = 0 then 'float' else 'str' end, event_id from d
      union all select 'flag', 'bool', event_id from d where event_id % 3 = 0
      union all select 'tags', 'list', event_id from d)
    select field, case when count(distinct type) = 1 then max(type) else 'mixed' end as type, true as nullable, field = '_id' as primary_key, count(*) as documents from f group by field""",
)
def docs_schema_infer(t: Inputs):
    """Event properties as documents of differing shape."""
    e = t.table("events")
    v = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('"v": '), F.format_string("%.3f", F.col("value") + 0.001))).otherwise(
        F.concat(F.lit('"v": "'), "event_type", F.lit('"'))
    )
    flag = F.when(F.col("event_id") % 3 == 0, F.lit('"flag": true')).otherwise(F.lit(None))
    k = F.concat(F.lit('"k": '), F.get_json_object("props", "$.k"))
    body = F.concat_ws(", ", F.concat(F.lit('"_id": '), F.col("event_id").cast("string")), k, v, flag, F.lit('"tags": [1, 2]'))
    return catalogs.infer_documents(e.select(F.concat(F.lit("{"), body, F.lit("}")).alias("doc")), "doc")


# ---- filters ---------------------------------------------------------------------------------


@query(
    "table_include_exclude",
    """select column_id, table_name, column_name from fx_columns where table_name in ('tbl1', 'tbl2', 'tbl5', 'tbl8', 'tbl13') and table_name not in ('tbl5', 'tbl21')""",
    fx="columns",
)
def table_include_exclude(t: Inputs):
    return catalogs.pick_tables(t.fx("columns"), ["tbl1", "tbl2", "tbl5", "tbl8", "tbl13"], ["tbl5", "tbl21"]).select(
        "column_id", "table_name", "column_name"
    )


@query(
    "map_types",
    """with x as (select *, case data_type when 'varchar' then 'VARCHAR(255)' when 'decimal' then 'point' when 'text' then 'longtext' else data_type end as source_type from fx_columns)
    select column_id, source_type, case when contains(lower(source_type), 'int') then 'Integer' when contains(lower(source_type), 'char') then 'String(255)'
      when contains(lower(source_type), 'text') then 'Text' when contains(lower(source_type), 'float') or contains(lower(source_type), 'real') then 'Float'
      when contains(lower(source_type), 'bool') or contains(lower(source_type), 'bit') then 'Boolean'
      when contains(lower(source_type), 'date') or contains(lower(source_type), 'time') then 'DateTime' else 'String(255)' end as target_type from x""",
    fx="columns",
)
def map_types(t: Inputs):
    d = F.col("data_type")
    source = F.when(d == "varchar", "VARCHAR(255)").when(d == "decimal", "point").when(d == "text", "longtext").otherwise(d)
    return t.fx("columns").select("column_id", source.alias("source_type"), catalogs.target_type(source).alias("target_type"))


@query(
    "audit_filter",
    """select event_id, ts, type from fx_audit where ts >= timestamp '2024-01-10 00:00:00' and ts <= timestamp '2024-01-20 00:00:00' and type in ('BLOCKED', 'SUSPICIOUS')""",
    fx="audit",
)
def audit_filter(t: Inputs):
    from sparkguard.operators.lifecycle import audit_between

    return audit_between(t.fx("audit"), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), ["BLOCKED", "SUSPICIOUS"]).select("event_id", "ts", "type")


@query(
    "sandbox_list",
    "select sandbox_id, state, sandbox_type from fx_sandboxes where state = 'active' and sandbox_type = 'postgres' and list_has_any(str_split(tags, ','), ['ml', 'team1'])",
    fx="sandboxes",
)
def sandbox_list(t: Inputs):
    from sparkguard.operators.lifecycle import list_sandboxes

    boxes = t.fx("sandboxes").withColumn("tags", F.split("tags", ","))
    return list_sandboxes(boxes, "active", "postgres", ["ml", "team1"]).select("sandbox_id", "state", "sandbox_type")


@query("equality_filters", "select o_orderkey, o_custkey from orders where o_orderstatus = 'F' and o_orderpriority = '1-URGENT'")
def equality_filters(t: Inputs):
    return t.table("orders").where(S.all_equal({"o_orderstatus": "F", "o_orderpriority": "1-URGENT"})).select("o_orderkey", "o_custkey")


@query("transform_rename", "select c_custkey as customer_id, c_name as customer_name from customer")
def transform_rename(t: Inputs):
    return X.rename(t.table("customer").select("c_custkey", "c_name"), {"c_custkey": "customer_id", "c_name": "customer_name"})


@query("transform_filter", "select o_orderkey, o_totalprice from orders where o_totalprice > 300000 and o_orderdate >= timestamp '1998-01-01'")
def transform_filter(t: Inputs):
    return X.filter_rows(t.table("orders"), "o_totalprice > 300000 and o_orderdate >= timestamp_ntz '1998-01-01'").select("o_orderkey", "o_totalprice")


@query(
    "transform_aggregate",
    "select o_orderstatus, o_orderpriority, round(sum(o_totalprice), 2) as o_totalprice, count(o_orderkey) as o_orderkey, max(o_custkey) as o_custkey from orders group by 1, 2",
)
def transform_aggregate(t: Inputs):
    out = X.aggregate(
        t.table("orders"), ["o_orderstatus", "o_orderpriority"], {"o_totalprice": "sum", "o_orderkey": "count", "o_custkey": "max"}
    )
    return rounded(out, "o_totalprice", places=2)


@query(
    "transform_pipeline",
    """select status, round(sum(price), 2) as price, count(id) as id from (select o_orderkey as id, o_orderstatus as status, o_totalprice * 1.1::double as price from orders where o_totalprice > 100000) group by 1""",
)
@query(
    "transform_chain",
    """select status, round(sum(price), 2) as price, count(id) as id from (select o_orderkey as id, o_orderstatus as status, o_totalprice * 1.1::double as price from orders where o_totalprice > 100000) group by 1""",
)
def transform_chain(t: Inputs):
    """The ordered list of rename, filter, custom and aggregate steps."""
    X.register("with_tax", lambda df: df.withColumn("price", F.col("price") * 1.1))
    steps = [
        {"type": "rename", "mapping": {"o_orderkey": "id", "o_orderstatus": "status", "o_totalprice": "price"}},
        {"type": "filter", "expression": "price > 100000"},
        {"type": "custom", "function": "with_tax"},
        {"type": "aggregate", "group_by": ["status"], "aggregations": {"price": "sum", "id": "count"}},
    ]
    return rounded(X.apply_all(t.table("orders"), steps), "price", places=2)


@query(
    "audit_grep_recent",
    """select event_id, ts, type, status from fx_audit where regexp_matches(type || ' ' || status, 'BLOCKED|DENIED|FAILED') order by ts desc, event_id desc limit 20""",
    fx="audit",
)
def audit_grep_recent(t: Inputs):
    hit = F.concat_ws(" ", "type", "status").rlike("BLOCKED|DENIED|FAILED")
    return counting.latest(t.fx("audit").where(hit), 20).select("event_id", "ts", "type", "status")


@query("open_incidents", "select incident_id, threat_level, remediation_status from fx_incidents where remediation_status <> 'resolved'", fx="incidents")
def open_incidents(t: Inputs):
    return t.fx("incidents").where(F.col("remediation_status") != "resolved").select("incident_id", "threat_level", "remediation_status")
