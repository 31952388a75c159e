"""Joins, aggregates, top-k, set operations, scoring and life cycle."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.functions.network import networks
from sparkguard.operators import access, audit, costs, counting, lifecycle, ranking, security, setops, tasks
from sparkguard.plans.audit_queries import _A
from sparkguard.plans.metrics_queries import rounded
from sparkguard.plans.registry import Inputs, query

AS_OF = dt.datetime(2001, 9, 1)
NOW = "timestamp '2001-09-01 00:00:00'"

# ---- joins -----------------------------------------------------------------------------------


def _grants(t: Inputs) -> DataFrame:
    return t.fx("grants").withColumn("permissions", F.split("permissions", ",")).withColumnRenamed("require_mfa", "mfa")


@query(
    "acl_check",
    f"""select r.request_id, exists (select 1 from fx_grants g where g.principal = r.principal and g.resource = r.resource
      and list_contains(str_split(g.permissions, ','), r.permission) and (g.expires_at is null or g.expires_at >= {NOW})
      and (g.require_mfa is null or g.require_mfa = r.mfa)) as allowed from fx_requests r""",
    fx="grants requests",
)
def acl_check(t: Inputs):
    return access.check_access(t.fx("requests"), _grants(t), AS_OF, ["mfa"]).select("request_id", "allowed")


_ALLOWED = ["10.0.0.0/17", "10.1.16.0/20", "10.2.7.7", "10.3.128.0/24", "192.168.0.0/16"]
_IP = "(split_part(source_ip, '.', 1)::bigint * 16777216 + split_part(source_ip, '.', 2)::bigint * 65536 + split_part(source_ip, '.', 3)::bigint * 256 + split_part(source_ip, '.', 4)::bigint)"
_INSIDE = " or ".join(f"{_IP} between {net} and {net + 2 ** (32 - p) - 1}" for p, net in networks(_ALLOWED))


@query("cidr_match", f"select event_id, source_ip, {_INSIDE} as allowed from fx_connections", fx="connections")
def cidr_match(t: Inputs):
    return access.match_allow_list(t.fx("connections"), "source_ip", _ALLOWED).select("event_id", "source_ip", "allowed")


@query(
    "cidr_match_table",
    f"""with r as (select distinct 167772160 + (c_nationkey % 4) * 65536 + (c_custkey % 256) * 256 as lo, 255 as n from customer where c_acctbal > 5000
      union select 167772160 + (c_custkey % 4) * 65536 + (c_custkey % 16) * 4096, 4095 from customer where c_acctbal < -900)
    select event_id, source_ip, exists (select 1 from r where {_IP} between lo and lo + n) as allowed from fx_connections""",
    fx="connections",
)
def cidr_match_table(t: Inputs):
    """The allow-list as a table of /24 and /20 networks."""
    network = F.lit(167772160) + (F.col("c_nationkey") % 4) * 65536 + (F.col("c_custkey") % 256) * 256
    wide = F.lit(167772160) + (F.col("c_custkey") % 4) * 65536 + (F.col("c_custkey") % 16) * 4096
    customers = t.table("customer")
    ranges = customers.where("c_acctbal > 5000").select(F.lit(24).alias("prefix"), network.cast("long").alias("network"))
    ranges = ranges.unionByName(customers.where("c_acctbal < -900").select(F.lit(20).alias("prefix"), wide.cast("long").alias("network")))
    return access.match_ranges(t.fx("connections"), "source_ip", ranges).select("event_id", "source_ip", "allowed")


@query(
    "orphan_resources",
    """select 'c' || cast(event_id as varchar) as container_id, user_id from events where user_id not in (select c_custkey from customer where c_mktsegment <> 'BUILDING')""",
)
def orphan_resources(t: Inputs):
    containers = t.table("events").select(F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("container_id"), "user_id")
    sessions = t.table("customer").where("c_mktsegment <> 'BUILDING'")
    return access.orphans(containers, sessions, "user_id", "c_custkey")


def _tasks(t: Inputs) -> DataFrame:
    """Tasks with up to two dependencies and a result for most of the completed ones."""
    k = F.col("task_id")
    deps = F.array_distinct(F.array_compact(F.array("dependency", F.when(k >= 3, F.floor(k / 3)))))
    result = F.when((F.col("status") == "completed") & (k % 5 != 0), F.concat(F.lit("r"), k.cast("string")))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("e"), (k % 3).cast("string")))
    return t.fx("tasks").withColumn("dependencies", deps).withColumn("result", result).withColumn("error", error)


_TASKS = """tk as (select *, list_distinct(list_filter([dependency::bigint, case when task_id >= 3 then floor(task_id / 3)::bigint end], lambda d: d is not null)) as dependencies,
  case when status = 'completed' and task_id % 5 <> 0 then 'r' || cast(task_id as varchar) end as result, case when status = 'failed' then 'e' || cast(task_id % 3 as varchar) end as error from fx_tasks)"""


@query(
    "task_ready",
    f"""with {_TASKS}, n as (select task_id, unnest(dependencies) as d from tk where status = 'pending')
    select task_id, agent_type from tk where status = 'pending' and task_id not in
      (select n.task_id from n left join tk p on p.task_id = n.d where p.status is null or p.status <> 'completed')""",
    fx="tasks",
)
def task_ready(t: Inputs):
    return tasks.ready(_tasks(t)).select("task_id", "agent_type")


@query(
    "task_dependency_results",
    f"""with {_TASKS}, n as (select task_id, unnest(dependencies) as d from tk)
    select n.task_id, string_agg(cast(n.d as varchar) || '=' || p.result, ',' order by n.d) as results from n join tk p on p.task_id = n.d where p.result is not null group by 1""",
    fx="tasks",
)
def task_dependency_results(t: Inputs):
    out = tasks.dependency_results(_tasks(t))
    text = F.array_join(F.transform(F.map_entries("results"), lambda e: F.concat_ws("=", e["key"].cast("string"), e["value"])), ",")
    return out.select("task_id", text.alias("results"))


# ---- costs -----------------------------------------------------------------------------------

START, END = dt.datetime(1997, 1, 1), dt.datetime(1998, 12, 31)
_SPAN = "ts between timestamp '1997-01-01 00:00:00' and timestamp '1998-12-31 00:00:00'"


@query(
    "cost_report",
    f"select provider, service, date_trunc('day', ts)::timestamp as day, round(sum(cost), 6) as cost from fx_costs where {_SPAN} group by 1, 2, 3",
    fx="costs",
)
def cost_report(t: Inputs):
    return rounded(costs.report(t.fx("costs"), START, END, ["provider", "service"]), "cost", places=6)


@query("cost_report_detail", f"select cost_id, ts, provider, service, cost from fx_costs where {_SPAN}", fx="costs")
def cost_report_detail(t: Inputs):
    return costs.report(t.fx("costs"), START, END).select("cost_id", "ts", "provider", "service", "cost")


@query(
    "cost_daily",
    """with d as (select unnest(range(timestamp '1995-01-01', timestamp '2002-01-01', interval 1 day)) as day),
    s as (select date_trunc('day', ts)::timestamp as day, sum(cost) as cost from fx_costs group by 1)
    select d.day, round(coalesce(cost, 0), 6) as cost from d left join s on d.day = s.day""",
    fx="costs",
)
def cost_daily(t: Inputs):
    return rounded(costs.daily(t.fx("costs"), dt.datetime(1995, 1, 1), dt.datetime(2001, 12, 31)), "cost", places=6)


@query(
    "cost_by_service",
    """select coalesce(service, 'TOTAL') as service, round(sum(cost), 2) as cost, grouping(service)::int as is_total from fx_costs group by rollup (service)""",
    fx="costs",
)
def cost_by_service(t: Inputs):
    return rounded(costs.by_service(t.fx("costs")), "cost", places=2).withColumn("service", F.coalesce("service", F.lit("TOTAL")))


@query("service_cost_rank", "select service, round(sum(cost), 2) as cost from fx_costs group by 1", fx="costs")
def service_cost_rank(t: Inputs):
    return rounded(costs.rank_services(t.fx("costs")), "cost", places=2)


@query(
    "cost_explode",
    """select cost_id, strftime(ts, '%Y-%m-%d') as date, service, provider as project, cost, cost * 2 as usage from fx_costs
    union all select cost_id, strftime(ts, '%Y-%m-%d'), service || '-support', 'untagged', cost / 10, 0 from fx_costs""",
    fx="costs",
)
def cost_explode(t: Inputs):
    """Nested responses with one tagged group and one without project or usage."""
    amount = F.col("cost")
    tagged = F.struct(F.array("service", "provider").alias("keys"), amount.alias("cost"), (amount * 2).alias("usage"))
    plain = F.struct(
        F.array(F.concat("service", F.lit("-support"))).alias("keys"), (amount / 10).alias("cost"), F.lit(None).cast("double").alias("usage")
    )
    day = F.struct(F.date_format("ts", "yyyy-MM-dd").alias("start"), F.array(tagged, plain).alias("groups"))
    return costs.explode_response(t.fx("costs").select("cost_id", F.array(day).alias("results")))


@query(
    "budget_tracking",
    """with d as (select date_trunc('day', ts)::timestamp as day, sum(cost) as cost from fx_costs group by 1),
    s as (select *, sum(cost) over (partition by date_trunc('month', day) order by day) as spent from d)
    select day, round(cost, 6) as cost, round(spent, 6) as spent, round(spent / 20000 * 100, 9) as used_percent, spent >= 16000 as alert from s""",
    fx="costs",
)
def budget_tracking(t: Inputs):
    return rounded(rounded(costs.budget(t.fx("costs"), 20_000.0), "cost", "spent", places=6), "used_percent", places=9)


@query(
    "track_cost",
    """select cost_id, name, round(cost, 6) as value, name || ':currency=' || currency || ',provider=' || provider || ',service=' || service as series_key, currency as unit
    from fx_costs, (values ('cloud.cost'), ('cloud.daily_cost')) n(name)""",
    fx="costs",
)
def track_cost(t: Inputs):
    from sparkguard.functions.series import series_key

    out = costs.track(t.fx("costs"))
    return rounded(out.select("cost_id", "name", "value", series_key(F.col("name"), F.col("tags")).alias("series_key"), "unit"), "value", places=6)


_SAVE = """select identifier, cost_per_hour * 720 as monthly_cost,
  case when resource_type = 'compute' and coalesce(cpu_utilization, 100) < 10 then 'downsize or terminate' when resource_type = 'storage' and last_access_days > 90 then 'move to cold storage' end as action,
  case when resource_type = 'compute' and coalesce(cpu_utilization, 100) < 10 then cost_per_hour * 720 * 0.5 when resource_type = 'storage' and last_access_days > 90 then cost_per_hour * 720 * 0.7 else 0 end as monthly_savings
  from fx_resources where cost_per_hour is not null"""


@query("optimize_costs", f"select identifier, round(monthly_cost, 3) as monthly_cost, action, round(monthly_savings, 3) as monthly_savings from ({_SAVE}) s where action is not null", fx="resources")
def optimize_costs(t: Inputs):
    out = costs.savings(t.fx("resources")).where(F.col("action").isNotNull())
    return rounded(out.select("identifier", "monthly_cost", "action", "monthly_savings"), "monthly_cost", "monthly_savings", places=3)


@query(
    "optimize_costs_total",
    f"select round(sum(monthly_cost), 2) as total_monthly_cost, round(sum(monthly_savings), 2) as potential_savings, count(action) as recommendations from ({_SAVE}) s",
    fx="resources",
)
def optimize_costs_total(t: Inputs):
    return rounded(costs.savings_total(t.fx("resources")), "total_monthly_cost", "potential_savings", places=2)


# ---- counts ----------------------------------------------------------------------------------


@query(
    "resource_breakdown",
    """select 'provider' as dimension, provider as item, count(*) as n from fx_resources group by 2 union all select 'resource_type', resource_type, count(*) from fx_resources group by 2
    union all select 'status', status, count(*) from fx_resources group by 2 union all select 'total', 'all', count(*) from fx_resources""",
    fx="resources",
)
def resource_breakdown(t: Inputs):
    return counting.breakdown(t.fx("resources"), ["provider", "resource_type", "status"])


@query(
    "sandbox_stats",
    """with c as (select 'state' as dimension, state as item, count(*) as n from fx_sandboxes group by 2 union all select 'sandbox_type', sandbox_type, count(*) from fx_sandboxes group by 2
      union all select 'total', 'all', count(*) from fx_sandboxes)
    select c.*, round(s.mb, 4) as total_storage_mb, round(s.mb / 1024, 6) as total_storage_gb, 100.0::double as storage_limit_gb, 50 as sandbox_limit from c, (select sum(storage_mb) as mb from fx_sandboxes) s""",
    fx="sandboxes",
)
def sandbox_stats(t: Inputs):
    boxes = t.fx("sandboxes")
    counts = counting.breakdown(boxes, ["state", "sandbox_type"])
    out = counts.withColumn("mb", boxes.agg(F.sum("storage_mb")).scalar())
    return out.select(
        "dimension",
        "item",
        "n",
        F.round("mb", 4).alias("total_storage_mb"),
        F.round(F.col("mb") / 1024, 6).alias("total_storage_gb"),
        F.lit(100.0).alias("storage_limit_gb"),
        F.lit(50).alias("sandbox_limit"),
    )


@query("operation_breakdown", f"with {_A} select op as operation, count(*) as n from (select unnest(ops) as op from a) group by 1", fx="query_log")
def operation_breakdown(t: Inputs):
    return counting.operation_counts(audit.analyse(t.fx("query_log")))


@query(
    "audit_success_stats",
    """select count(*) as total_queries, count(*) filter (success) as successful_queries, count(*) filter (not success) as failed_queries
    from (select * from fx_query_log order by ts desc, event_id desc limit 100)""",
    fx="query_log",
)
def audit_success_stats(t: Inputs):
    return counting.recent_success(t.fx("query_log"), 100)


@query("health_summary", "select count(*) filter (status = 'healthy') as healthy, count(*) filter (status <> 'healthy') as not_healthy from fx_resources", fx="resources")
def health_summary(t: Inputs):
    ok = F.col("status") == "healthy"
    return t.fx("resources").agg(F.count_if(ok).alias("healthy"), F.count_if(~ok).alias("not_healthy"))


@query(
    "agent_type_usage",
    """select agent_type, count(*) as active, max(case agent_type when 'code_generator' then 1.5 else 2.0 end)::double as cpu_cores, max(case agent_type when 'code_generator' then 3.0 else 4.0 end)::double as memory_gb,
    max(case agent_type when 'code_generator' then 15.0 else 20.0 end)::double as disk_gb, sum(case agent_type when 'code_generator' then 1.5 else 2.0 end)::double as total_cpu_cores,
    sum(case agent_type when 'code_generator' then 3.0 else 4.0 end)::double as total_memory_gb from fx_tasks where status = 'running' group by 1""",
    fx="tasks",
)
def agent_type_usage(t: Inputs):
    return tasks.type_usage(t.fx("tasks"))


@query(
    "agent_report",
    """select count(*) filter (status = 'running') as active_agents, 10::bigint as max_agents, count(*) filter (status = 'pending') as queued_tasks,
    count(*) filter (status = 'completed') as completed_tasks from fx_tasks""",
    fx="tasks",
)
def agent_report(t: Inputs):
    return tasks.agent_report(t.fx("tasks"))


@query(
    "security_status",
    """select 4 as policies, (select count(*) from fx_incidents where remediation_status <> 'resolved') as active_incidents, (select count(*) from fx_keys) as keys_total,
    (select count(*) from fx_keys where status = 'active') as keys_active, (select count(distinct resource) from fx_grants) as resources, (select count(*) from fx_grants) as total_grants,
    (select count(*) from fx_audit) as audit_log_size""",
    fx="incidents keys grants audit",
)
def security_status(t: Inputs):
    return counting.one_row(
        [
            t.fx("incidents").agg(
                F.lit(len(security.POLICIES)).alias("policies"), F.count_if(F.col("remediation_status") != "resolved").alias("active_incidents")
            ),
            t.fx("keys").agg(F.count(F.lit(1)).alias("keys_total"), F.count_if(F.col("status") == "active").alias("keys_active")),
            t.fx("grants").agg(F.countDistinct("resource").alias("resources"), F.count(F.lit(1)).alias("total_grants")),
            t.fx("audit").agg(F.count(F.lit(1)).alias("audit_log_size")),
        ]
    )


# ---- audit trail, top-k, paging --------------------------------------------------------------


@query(
    "audit_connection_sessions",
    """with s as (select session_id, min(ts) filter (type = 'CONNECTION') as started_at, max(ts) filter (type = 'DISCONNECTION') as e, count(*) filter (type = 'QUERY') as queries,
      count(*) filter (type = 'BLOCKED') as blocked from fx_audit group by 1)
    select session_id, started_at, case when e >= started_at then e end as ended_at, queries, blocked,
      round((epoch_us(case when e >= started_at then e end) - epoch_us(started_at)) / 1000000.0, 3) as duration_seconds from s where started_at is not null""",
    fx="audit",
)
def audit_connection_sessions(t: Inputs):
    return rounded(lifecycle.connection_sessions(t.fx("audit")), "duration_seconds", places=3)


@query("recent_queries", "select event_id, ts, substr(query, 1, 50) as shown_query, query from fx_query_log order by ts desc, event_id desc limit 5", fx="query_log")
def recent_queries(t: Inputs):
    latest = counting.latest(t.fx("query_log"), 5)
    return latest.select("event_id", "ts", F.substring("query", 1, 50).alias("shown_query"), "query")


@query("audit_tail", "select event_id, ts, session_id, type, status from fx_audit order by ts desc, event_id desc limit 100", fx="audit")
def audit_tail(t: Inputs):
    return counting.latest(t.fx("audit"), 100).select("event_id", "ts", "session_id", "type", "status")


@query(
    "paged_read",
    "select o_orderkey, o_custkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 10000) as bigint) as page from orders",
)
def paged_read(t: Inputs):
    """Page numbers come from exact positions, not from one sorted task."""
    placed = ranking.positions(t.table("orders").select("o_orderkey", "o_custkey"), [], ["o_orderkey"])
    return placed.select("o_orderkey", "o_custkey", F.floor(F.col("before") / 10_000).alias("page"))


@query(
    "top_recommendations",
    """select subject_id, array_to_string(list_slice(list_filter([case when password_length < 12 then 'Password must be at least 12 characters' end, case when not mfa_enabled then 'Multi-factor authentication is required' end,
      case when not encrypted_at_rest then 'Data must be encrypted at rest' end, case when public_access then 'Resources should not be publicly accessible' end,
      case when not encryption_in_transit then 'Network traffic must be encrypted' end, case when list_contains(str_split(allowed_ports, ','), '23') then 'Port 23 is considered risky and should not be exposed' end],
      lambda x: x is not null), 1, 5), '; ') as top_five from fx_subjects""",
    fx="subjects",
)
def top_recommendations(t: Inputs):
    subjects = _subjects(t)
    one = {"all": {k: v for p in security.POLICIES.values() for k, v in p.items()}}
    both = security.check_network(security.evaluate_policies(subjects, one))
    return both.select("subject_id", F.array_join(F.slice(F.concat("violations", "issues"), 1, 5), "; ").alias("top_five"))


# ---- set operations --------------------------------------------------------------------------


@query(
    "federated_union",
    """select 'aws' as provider, c_custkey as id, c_name as name, null as nation from customer
    union all select 'fabric', s_suppkey, s_name, cast(s_nationkey as varchar) from supplier""",
)
def federated_union(t: Inputs):
    """A store that fails to answer is left out, and missing columns are null."""

    def broken():
        return t.table("no_such_table")

    stores = {
        "aws": lambda: t.table("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")),
        "fabric": lambda: t.table("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_nationkey").cast("string").alias("nation")),
        "azure": broken,
    }
    return setops.federated(stores)


@query(
    "resource_union",
    """select 'aws:rds:' || s_name as identifier, 'aws' as provider, 'database' as resource_type, s_name as name, 'us-east-1' as region, 'available' as status, 'engine=mysql' as metadata from supplier
    union all select 'aws:s3:' || p_brand || cast(p_partkey as varchar), 'aws', 'storage', p_brand || cast(p_partkey as varchar), 'us-east-1', 'available', '' from part
    union all select 'fabric:table:dbo.' || c_name, 'fabric', 'analytics', 'dbo.' || c_name, 'global', 'available', 'columns=' || cast(c_nationkey as varchar) || ',format=delta' from customer""",
)
def resource_union(t: Inputs):
    databases = t.table("supplier").select(F.col("s_name").alias("name"), F.create_map(F.lit("engine"), F.lit("mysql")).alias("metadata"))
    buckets = t.table("part").select(F.concat("p_brand", F.col("p_partkey").cast("string")).alias("name"))
    lake = t.table("customer").select(
        F.concat(F.lit("dbo."), "c_name").alias("name"),
        F.create_map(F.lit("format"), F.lit("delta"), F.lit("columns"), F.col("c_nationkey").cast("string")).alias("metadata"),
    )
    out = setops.resources(
        [
            setops.Listing("aws", "rds", "database", "us-east-1", databases),
            setops.Listing("aws", "s3", "storage", "us-east-1", buckets),
            setops.Listing("fabric", "table", "analytics", "global", lake),
        ]
    )
    pairs = F.array_join(F.transform(F.array_sort(F.map_entries("metadata")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return out.withColumn("metadata", F.coalesce(pairs, F.lit("")))


@query(
    "sync_diff",
    """select coalesce(s.c_custkey, g.c_custkey) as c_custkey, case when g.c_custkey is null then 'new' when s.c_custkey is null then 'gone'
      when s.c_name is distinct from g.c_name or s.c_nationkey is distinct from g.c_nationkey or s.c_acctbal is distinct from g.c_acctbal or s.c_mktsegment is distinct from g.c_mktsegment then 'changed' else 'same' end as change
    from (select * from customer where c_mktsegment <> 'MACHINERY') s full join fx_sync_target g on s.c_custkey = g.c_custkey""",
    fx="sync_target",
)
def sync_diff(t: Inputs):
    return setops.diff(t.table("customer").where("c_mktsegment <> 'MACHINERY'"), t.fx("sync_target"), ["c_custkey"])


# ---- scoring ---------------------------------------------------------------------------------


def _subjects(t: Inputs) -> DataFrame:
    return t.fx("subjects").withColumn("allowed_ports", F.transform(F.split("allowed_ports", ","), lambda p: p.cast("int")))


@query(
    "policy_eval",
    """select subject_id, 'password_policy' as policy, password_length >= 12 as passed, case when password_length < 12 then 'Password must be at least 12 characters' else '' end as violations from fx_subjects
    union all select subject_id, 'mfa_policy', mfa_enabled, case when not mfa_enabled then 'Multi-factor authentication is required' else '' end from fx_subjects
    union all select subject_id, 'encryption_policy', encrypted_at_rest, case when not encrypted_at_rest then 'Data must be encrypted at rest' else '' end from fx_subjects
    union all select subject_id, 'network_security_policy', true, '' from fx_subjects""",
    fx="subjects",
)
def policy_eval(t: Inputs):
    out = security.evaluate_policies(_subjects(t))
    return out.select("subject_id", "policy", "passed", F.array_join("violations", "; ").alias("violations"))


@query(
    "network_config_check",
    """select subject_id, not public_access and encryption_in_transit and not list_contains(str_split(allowed_ports, ','), '23') as valid,
    array_to_string(list_filter([case when public_access then 'Resources should not be publicly accessible' end, case when not encryption_in_transit then 'Network traffic must be encrypted' end,
      case when list_contains(str_split(allowed_ports, ','), '23') then 'Port 23 is considered risky and should not be exposed' end], lambda x: x is not null), '; ') as issues from fx_subjects""",
    fx="subjects",
)
def network_config_check(t: Inputs):
    return security.check_network(_subjects(t)).select("subject_id", "valid", F.array_join("issues", "; ").alias("issues"))


def _rule_results(t: Inputs) -> DataFrame:
    """Results per subject: an encryption rule, an access rule, and a retention rule that always passes."""
    s = _subjects(t)

    def result(framework, rule_id, passed):
        return F.struct(F.lit(framework).alias("framework"), F.lit(rule_id).alias("rule_id"), passed.alias("passed"))

    results = F.array(
        result("soc2", "soc2-encryption", F.col("encrypted_at_rest") | (F.col("password_length") >= 0)),
        result("soc2", "soc2-transit", F.col("encryption_in_transit")),
        result("hipaa", "hipaa-access-control", F.col("mfa_enabled")),
        result("gdpr", "gdpr-data-retention", F.lit(True)),
    )
    return s.select(F.explode(results).alias("r")).select("r.*")


_COMPLIANCE = """rr as (select 'soc2' as framework, 'soc2-encryption' as rule_id, encrypted_at_rest or password_length >= 0 as passed from fx_subjects
    union all select 'soc2', 'soc2-transit', encryption_in_transit from fx_subjects union all select 'hipaa', 'hipaa-access-control', mfa_enabled from fx_subjects
    union all select 'gdpr', 'gdpr-data-retention', true from fx_subjects),
  rl as (select framework, rule_id, bool_and(passed) as passed from rr group by 1, 2),
  fw as (select f.framework, count(rule_id) as total_rules, count(rule_id) filter (passed) as passed_rules, case when count(rule_id) = 0 then 100 else count(rule_id) filter (passed) / count(rule_id) * 100 end as score,
    coalesce(string_agg(case when not passed then rule_id end, ',' order by rule_id), '') as violations from (values ('soc2'), ('hipaa'), ('gdpr'), ('nist')) f(framework) left join rl on rl.framework = f.framework group by 1)"""


@query(
    "compliance_score",
    f"""with {_COMPLIANCE} select framework, total_rules, passed_rules, round(score, 4) as score, violations from fw
    union all select 'overall', sum(total_rules)::bigint, sum(passed_rules)::bigint, round(avg(score), 4), coalesce(string_agg(nullif(violations, ''), ',' order by violations), '') from fw""",
    fx="subjects",
)
def compliance_score(t: Inputs):
    return rounded(security.compliance_scores(_rule_results(t), ["soc2", "hipaa", "gdpr", "nist"]), "score")


@query(
    "compliance_violations",
    f"""with {_COMPLIANCE} select framework, rule_id, count(*) as failures, case rule_id when 'hipaa-access-control' then 'Access must be role-based with audit logging' else '' end as description,
    case rule_id when 'hipaa-access-control' then 'critical' else 'medium' end as severity from rr where not passed group by 1, 2""",
    fx="subjects",
)
def compliance_violations(t: Inputs):
    return security.compliance_violations(_rule_results(t))


@query(
    "vulnerability_flags",
    """select 'r-' || resource_type || '-' || identifier as resource, 'Unencrypted database connections' as vulnerability, 'high' as severity,
    'Enable SSL/TLS for all database connections' as remediation from fx_resources where contains(lower(resource_type), 'database')""",
    fx="resources",
)
def vulnerability_flags(t: Inputs):
    named = t.fx("resources").withColumn("resource_name", F.concat_ws("-", F.lit("r"), "resource_type", "identifier"))
    return security.vulnerabilities(named, "resource_name")


_DAYS = f"floor(epoch({NOW} - created_at) / 86400)::bigint"


@query("keys_due_rotation", f"select key_id, {_DAYS} as age_days from fx_keys where status = 'active' and {_DAYS} > rotation_days", fx="keys")
def keys_due_rotation(t: Inputs):
    return security.keys_due(t.fx("keys"), AS_OF).select("key_id", "age_days")


_KEYS = f"(select count(*) as total, count(*) filter (status = 'active') as active, count(*) filter (status = 'active' and {_DAYS} > rotation_days) as due from fx_keys)"
_GRANTS = "(select count(distinct resource) as res, count(*) filter (require_mfa = 'true') as mfa, count(expires_at) as expiry from fx_grants)"
_INC = "(select count(*) as total, count(*) filter (remediation_status = 'resolved') as resolved, count(*) filter (threat_level = 'critical') as critical from fx_incidents)"
_KEY_ROW = f"""select 'encryption' as category, (100 - case when due > 0 then 15 else 0 end - case when active / total < 0.8 then 10 else 0 end)::double as score,
  list_filter([case when due > 0 then 'Rotate ' || cast(due as varchar) || ' encryption keys' end, case when active / total < 0.8 then 'Review and clean up deprecated encryption keys' end], lambda x: x is not null) as recs from {_KEYS}"""
_ACCESS_ROW = f"""select 'access_control' as category, (100 - case when mfa / res * 100 < 90 then 20 else 0 end - case when expiry / res * 100 < 50 then 10 else 0 end)::double as score,
  list_filter([case when mfa / res * 100 < 90 then 'Enable MFA for all critical resources' end, case when expiry / res * 100 < 50 then 'Set expiration dates for temporary access grants' end], lambda x: x is not null) as recs from {_GRANTS}"""
_INC_ROW = f"""select 'incident_response' as category, (100 - case when resolved / total * 100 < 95 then 20 else 0 end - case when critical > 0 then 10 else 0 end)::double as score,
  list_filter([case when resolved / total * 100 < 95 then 'Improve incident resolution rate' end, case when critical > 0 then 'Review ' || cast(critical as varchar) || ' critical incidents' end], lambda x: x is not null) as recs from {_INC}"""


def _texts(df: DataFrame) -> DataFrame:
    return rounded(df, "score").withColumn("recommendations", F.array_join("recommendations", "; "))


def _posture_sql(row: str) -> str:
    return f"select category, score, array_to_string(recs, '; ') as recommendations from ({row})"


@query("key_posture", _posture_sql(_KEY_ROW), fx="keys")
def key_posture(t: Inputs):
    return _texts(security.key_posture(t.fx("keys"), AS_OF))


@query("access_posture", _posture_sql(_ACCESS_ROW), fx="grants")
def access_posture(t: Inputs):
    return _texts(security.access_posture(t.fx("grants")))


@query("incident_posture", _posture_sql(_INC_ROW), fx="incidents")
def incident_posture(t: Inputs):
    return _texts(security.incident_posture(t.fx("incidents")))


@query(
    "security_posture",
    f"""with {_COMPLIANCE}, c as (select avg(score) as score, sum(total_rules - passed_rules) as bad from fw where framework in ('soc2', 'hipaa')),
    x as ({_KEY_ROW} union all {_ACCESS_ROW} union all {_INC_ROW} union all select 'network_security', 85.0, []
      union all select 'compliance', score, case when bad > 0 then ['Address ' || cast(bad::bigint as varchar) || ' compliance violations'] else [] end from c),
    y as (select category, score, case when score < 80 then recs else [] end as recs from x)
    select category, round(score, 4) as score, array_to_string(recs, '; ') as recommendations from y
    union all select 'overall', round(avg(score), 4), array_to_string(list_sort(flatten(list(recs))), '; ') from y""",
    fx="keys grants incidents subjects",
)
def security_posture(t: Inputs):
    compliance = security.compliance_scores(_rule_results(t), ["soc2", "hipaa"])
    grants = t.fx("grants")
    out = security.security_posture(
        [
            security.key_posture(t.fx("keys"), AS_OF),
            security.access_posture(grants),
            security.incident_posture(t.fx("incidents")),
            security.network_posture(grants),
            security.compliance_posture(compliance),
        ]
    )
    return _texts(out)


# ---- life cycle ------------------------------------------------------------------------------


@query(
    "lifecycle_tier",
    f"""with a as (select o_orderkey, date_diff('day', o_orderdate, {NOW})::int as age_days from orders)
    select *, case when age_days >= 365 then 'EXPIRE' when age_days >= 90 then 'GLACIER' when age_days >= 30 then 'STANDARD_IA' else 'STANDARD' end as tier from a""",
)
def lifecycle_tier(t: Inputs):
    return lifecycle.storage_tier(t.table("orders"), "o_orderdate", AS_OF).select("o_orderkey", "age_days", "tier")


@query("retention_filter", "select o_orderkey, o_orderdate from orders where o_orderdate > timestamp '2001-09-01 00:00:00' - interval 90 day")
def retention_filter(t: Inputs):
    return lifecycle.retained(t.table("orders"), "o_orderdate", AS_OF, lifecycle.RETENTION_DAYS["audit"]).select("o_orderkey", "o_orderdate")


@query(
    "sandbox_cleanup",
    f"""with a as (select *, auto_cleanup and floor(epoch({NOW} - created_at) / 86400) > max_age_days as too_old, state = 'failed' and error_count > 3 as too_many_failures from fx_sandboxes)
    select sandbox_id, too_old, too_many_failures from a where too_old or too_many_failures""",
    fx="sandboxes",
)
def sandbox_cleanup(t: Inputs):
    return lifecycle.due_for_cleanup(t.fx("sandboxes"), AS_OF).select("sandbox_id", "too_old", "too_many_failures")


@query(
    "sandbox_refresh_due",
    f"""with a as (select *, epoch({NOW} - coalesce(last_refreshed, created_at)) / 3600 as h from fx_sandboxes)
    select sandbox_id, round(h, 4) as hours_since_refresh from a where auto_refresh and state = 'active' and h >= refresh_hours""",
    fx="sandboxes",
)
def sandbox_refresh_due(t: Inputs):
    return rounded(lifecycle.due_for_refresh(t.fx("sandboxes"), AS_OF).select("sandbox_id", "hours_since_refresh"), "hours_since_refresh")


SESSION_NOW = dt.datetime(2024, 1, 15)
_SN = "timestamp '2024-01-15 00:00:00'"


@query(
    "session_expired",
    f"""with s as (select *, 'c' || cast(session_id as varchar) as cid from fx_sessions where status = 'active'),
    c as (select 'c' || cast(event_id as varchar) as cid, case when value > 60 then 'exited' else 'running' end as cs from events where event_type <> 'signup')
    select session_id, case when expires_at < {_SN} then 'expired' else 'container' end as reason from s left join c on s.cid = c.cid where expires_at < {_SN} or coalesce(cs, 'gone') <> 'running'""",
    fx="sessions",
)
def session_expired(t: Inputs):
    sessions = t.fx("sessions").withColumn("container_id", F.concat(F.lit("c"), F.col("session_id").cast("string")))
    containers = (
        t.table("events")
        .where("event_type <> 'signup'")
        .select(
            F.concat(F.lit("c"), F.col("event_id").cast("string")).alias("container_id"),
            F.when(F.col("value") > 60, "exited").otherwise("running").alias("container_status"),
        )
    )
    return lifecycle.expired_sessions(sessions, containers, SESSION_NOW).select("session_id", "reason")


@query(
    "session_remaining",
    f"""select session_id, round(greatest(0, epoch(expires_at - {_SN})), 6) as remaining_seconds,
    case when status = 'active' then {_SN} + interval 1 second * least(session_id % 9000, 7200) end as extended_to from fx_sessions""",
    fx="sessions",
)
def session_remaining(t: Inputs):
    out = lifecycle.session_times(t.fx("sessions"), SESSION_NOW, F.col("session_id") % 9000)
    return rounded(out.select("session_id", "remaining_seconds", "extended_to"), "remaining_seconds", places=6)


@query("user_session_limit", "select user_id, count(*) as active_sessions from fx_sessions where status = 'active' group by 1 having count(*) >= 50", fx="sessions")
def user_session_limit(t: Inputs):
    return lifecycle.users_at_limit(t.fx("sessions"), 50)


@query(
    "container_usage",
    """select event_id, case when event_id % 10 = 0 then 0.0 when event_id % 13 = 0 then 0.0 else round(value * 7 / (1009 + event_id % 2 * 4) * 100, 2) end as cpu_percent,
    case when event_id % 11 = 0 then 0.0 else round((event_id % 512) / 1024.0::double * 100, 2) end as memory_percent from events""",
)
def container_usage(t: Inputs):
    """Readings with missing parts: no earlier reading, no progress of the clock, no memory."""
    e, v = F.col("event_id"), F.col("value")
    reading = t.table("events").select(
        "event_id",
        F.struct((v * 7 + 5).alias("total"), (1009 + e % 2 * 4 + 50).cast("double").alias("system")).alias("cpu"),
        F.when(
            e % 10 != 0,
            F.struct(F.lit(5.0).alias("total"), F.when(e % 13 == 0, 1009 + e % 2 * 4 + 50).otherwise(50).cast("double").alias("system")),
        ).alias("precpu"),
        F.when(e % 11 != 0, F.struct((e % 512).alias("usage"), F.lit(1024).cast("long").alias("limit"))).alias("memory"),
    )
    return lifecycle.container_usage(reading).select("event_id", "cpu_percent", "memory_percent")


@query(
    "workflow_results",
    f"with {_TASKS} select task_id, status, result, error, epoch(completed_at - started_at)::double as duration from tk",
    fx="tasks",
)
def workflow_results(t: Inputs):
    return tasks.workflow_results(_tasks(t))


@query(
    "task_cleanup",
    "select task_id, status from fx_tasks where status in ('completed', 'failed', 'timeout') and completed_at < timestamp '2001-01-01 00:00:00' - interval 24 hour",
    fx="tasks",
)
def task_cleanup(t: Inputs):
    return tasks.due_for_cleanup(t.fx("tasks"), dt.datetime(2001, 1, 1)).select("task_id", "status")


# ---- windows over requests -------------------------------------------------------------------


def _limits_sql(seconds: int, limit: int) -> str:
    slot = f"make_timestamp(epoch_us(ts) // {seconds * 1_000_000} * {seconds * 1_000_000})"
    return f"select {slot} as window_start, user_id % 3 as client, count(*) as requests, count(*) - {limit} as over_limit from events group by 1, 2 having count(*) > {limit}"


@query("rate_limit_violations", _limits_sql(7200, 12))
def rate_limit_violations(t: Inputs):
    from sparkguard.operators.limits import violations

    requests = t.table("events").select("ts", (F.col("user_id") % 3).alias("client"))
    return violations(requests, ["client"], "7200 seconds", 12).select("window_start", "client", "requests", "over_limit")


_LIMIT_ROWS = "values (100, 60), (1000, 60), (5, 1), (10, 1)"


@query(
    "rate_limit_peaks",
    f"""with w as (select max_requests, seconds, user_id % 3 as client, epoch_us(ts) // (seconds * 1000000) as slot, count(*) as n from events, ({_LIMIT_ROWS}) l(max_requests, seconds) group by 1, 2, 3, 4)
    select max_requests, seconds, client, max(n) as peak, count(*) filter (n > max_requests) as violations from w group by 1, 2, 3""",
)
def rate_limit_peaks(t: Inputs):
    from sparkguard.operators.limits import peaks

    return peaks(t.table("events").select("ts", (F.col("user_id") % 3).alias("client")), ["client"])


@query(
    "error_rate_alert",
    """with w as (select make_timestamp(epoch_us(ts) // 3600000000 * 3600000000) as window_start, count(*) as requests, count(*) filter (not success) as errors, max(execution_time) as slowest,
      avg(execution_time) as average from fx_query_log group by 1)
    select window_start, requests, errors, round(errors / requests, 8) as error_rate, round(average, 8) as average, errors / requests > 0.05 or average > 5 as alert from w""",
    fx="query_log",
)
def error_rate_alert(t: Inputs):
    from sparkguard.operators.limits import error_rates

    out = error_rates(t.fx("query_log"), "1 hour")
    return rounded(out, "error_rate", "average", places=8).select("window_start", "requests", "errors", "error_rate", "average", "alert")
