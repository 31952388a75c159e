"""Query-log audit over the query-log projection."""

from __future__ import annotations

from pyspark.sql import functions as F

from sparkguard.functions import querytext as Q
from sparkguard.operators import audit as A
from sparkguard.plans.registry import Inputs, query


def _q(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


# Fixed values of the twins: statement words, patterns, and rules as (rule set, name, level, pattern, blocked in production, dev and sandbox, words that excuse, description).
_LEADING = "select|insert|update|delete|create|drop|alter|truncate|execute|exec|call"
_OPERATIONS = "select|insert|update|delete|create|drop|alter|truncate"
_KEYWORDS = ("drop", "truncate", "delete", "exec", "execute", "xp_cmdshell", "sp_configure", "openrowset", "opendatasource", "bulk", "backup", "restore", "shutdown", "waitfor")
_OBJECTS = ("sys", "information_schema", "master", "model", "msdb", "tempdb", "mysql", "performance_schema", "pg_catalog", "pg_toast")
_REVIEW = ("into", "set", "values", "modify", "cascade", "constraint", "index", "trigger", "procedure")
_CALLS = [
    ("find", "select"), ("findOne", "select"), ("aggregate", "select"), ("count", "select"), ("distinct", None), ("insertOne", "insert"),
    ("insertMany", "insert"), ("updateOne", "update"), ("updateMany", "update"), ("deleteOne", "delete"), ("deleteMany", "delete"),
    ("replaceOne", "update"), ("createIndex", "create"), ("dropIndex", "drop"), ("drop", "drop"), ("createCollection", "create"),
]
_WRITES = [
    r"(?i)^\s*(insert|update|delete|replace|merge)\s+",
    r"(?i)^\s*(truncate|drop|create|alter)\s+",
    r"(?i)^\s*(grant|revoke|deny)\s+",
    r"(?i)^\s*(backup|restore)\s+",
    r"(?i)^\s*(exec|execute|call)\s+.*_(insert|update|delete|create|drop)",
    r"(?i)(insert|update|delete|drop|create|remove)\s*\(",
    r"(?i)\$(set|unset|push|pull|inc)",
    r"(?i)^\s*(shutdown|kill)\s+",
]
_BODIES = [
    r"INSERT\s+INTO",
    r"(?s)UPDATE\s+.*\s+SET",
    r"DELETE\s+FROM",
    r"DROP\s+TABLE",
    r"CREATE\s+TABLE",
    r"ALTER\s+TABLE",
    r"EXEC\s*\(",
    r"UNION\s+SELECT",
]
_RULES = [
    ("builtin", "drop_or_truncate", "critical", r"\b(drop|truncate)\s+(table|database|schema)", (True, True, True), (), "DROP/TRUNCATE operations are destructive"),
    ("builtin", "command_shell", "critical", r"\bxp_cmdshell\b", (True, True, True), (), "Command execution via xp_cmdshell"),
    ("builtin", "bulk_access", "dangerous", r"\b(bulk\s+insert|openrowset|opendatasource)\b", (True, True, False), (), "Bulk data operations can affect performance"),
    ("builtin", "unsafe_delete", "dangerous", r"\bdelete\s+from\s+\w+", (True, True, False), ("where",), "DELETE without WHERE clause"),
    ("builtin", "unsafe_update", "dangerous", r"\bupdate\s+\w+\s+set\s+", (True, True, False), ("where",), "UPDATE without WHERE clause"),
    ("builtin", "system_access", "moderate", r"\b(sys|information_schema|master|msdb)\.", (True, False, False), (), "System table/schema access"),
    ("config", "block_drop_operations", "critical", r"\b(drop|truncate)\s+(table|database|schema|collection)", (True, True, True), (), "DROP/TRUNCATE operations are destructive"),
    ("config", "block_system_commands", "critical", r"\b(xp_cmdshell|sp_configure|openrowset|opendatasource)\b", (True, True, True), (), "System command execution"),
    ("config", "unsafe_deletes", "dangerous", r"\bdelete\s+from\s+\w+", (True, True, False), ("where",), "DELETE without WHERE clause"),
    ("config", "unsafe_updates", "dangerous", r"\bupdate\s+\w+\s+set\s+", (True, True, False), ("where",), "UPDATE without WHERE clause"),
    ("config", "system_table_access", "moderate", r"\b(sys|information_schema|master|msdb)\.", (True, False, False), (), "System table/schema access"),
    ("config", "bulk_operations", "moderate", r"\b(bulk\s+insert|load\s+data)\b", (True, True, False), (), "Bulk data operations"),
    ("deployed", "block_drop_operations", "critical", r"\b(drop|truncate)\s+(table|database|schema|collection)\b", (True, True, True), (), "DROP/TRUNCATE operations are destructive and irreversible"),
    ("deployed", "block_system_commands", "critical", r"\b(xp_cmdshell|sp_configure|openrowset|opendatasource|exec\s+xp_|execute\s+xp_)\b", (True, True, True), (), "System command execution via stored procedures"),
    ("deployed", "block_bulk_operations", "critical", r"\b(bulk\s+insert|load\s+data|restore\s+database|backup\s+database)\b", (True, True, True), (), "Bulk operations can affect system performance"),
    ("deployed", "unsafe_deletes", "dangerous", r"\bdelete\s+from\s+\w+", (True, True, False), ("where",), "DELETE statements without WHERE clause can remove all data"),
    ("deployed", "unsafe_updates", "dangerous", r"\bupdate\s+\w+\s+set\s+", (True, True, False), ("where",), "UPDATE statements without WHERE clause affect all rows"),
    ("deployed", "dynamic_sql_injection", "dangerous", r"\b(exec|execute)\s*\(\s*@|\bexec\s+sp_executesql\b", (True, True, False), (), "Dynamic SQL execution can be vulnerable to injection"),
    ("deployed", "system_table_access", "moderate", r"\b(sys|information_schema|master|model|msdb|tempdb)\.\b", (True, False, False), (), "Access to system tables and schemas"),
    ("deployed", "admin_functions", "moderate", r"\b(db_owner|db_securityadmin|db_ddladmin|sysadmin)\b", (True, False, False), (), "Administrative database functions"),
    ("deployed", "large_table_scans", "moderate", r"\bselect\s+\*\s+from\s+\w+", (True, False, False), ("where", "limit", "top"), "SELECT * without WHERE/LIMIT can cause performance issues"),
    ("deployed", "mongodb_unsafe_operations", "dangerous", r"\.(drop|dropDatabase|dropIndex)\s*\(", (True, True, False), (), "MongoDB drop operations"),
    ("deployed", "mongodb_bulk_write", "moderate", r"\.(bulkWrite|insertMany|deleteMany)\s*\(", (True, False, False), (), "MongoDB bulk operations can affect performance"),
]

_NORM = (
    "trim(regexp_replace(regexp_replace(regexp_replace(query, '(?m)--.*$', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g'), '\\s+', ' ', 'g'))"
)
_FIRST = f"regexp_extract(lower(norm), '^({_LEADING})\\b', 1)"
_TYPE = f"case {_FIRST} when '' then 'unknown' when 'exec' then 'execute' else {_FIRST} end"
_FOUND = f"regexp_extract_all(lower(norm), '\\b({_OPERATIONS})\\b', 1)"
_MONGO_HITS = "list_filter(" + _q(c for c, _ in _CALLS) + ", lambda o: contains(norm, '.' || o || '('))"
_MONGO_MAP = "map {" + ", ".join(f"'{c}': '{k}'" for c, k in _CALLS if k) + "}"
_MONGO_OPS = f"list_filter(list_transform({_MONGO_HITS}, lambda o: {_MONGO_MAP}[o]), lambda z: z is not null)"

# Statements with their type, operations and level, read by the twins below.
_A = f"""a0 as (select *, lower(database_type) = 'mongodb' as doc, case when lower(database_type) = 'mongodb' then trim(query) else {_NORM} end as norm from fx_query_log),
a1 as (select *, case when doc then coalesce({_MONGO_OPS}[1], 'unknown') else {_TYPE} end as qtype,
  case when doc then {_MONGO_OPS} when len({_FOUND}) > 0 then {_FOUND} else [{_TYPE}] end as ops from a0),
a as (select *, case when list_has_any(ops, ['drop', 'truncate']) then 'critical' when list_has_any(ops, ['delete', 'execute']) then 'dangerous'
  when list_has_any(ops, ['insert', 'update', 'create', 'alter']) then 'moderate' when qtype = 'select' then 'safe' else 'moderate' end as level from a1)"""


def _analysed(t: Inputs):
    return A.analyse(t.fx("query_log"))


def _joined(name: str, sep: str = ","):
    return F.array_join(name, sep)


@query("sql_normalize", f"select event_id, {_NORM} as normalized from fx_query_log", fx="query_log")
def sql_normalize(t: Inputs):
    return t.fx("query_log").select("event_id", Q.normalized(F.col("query")).alias("normalized"))


@query("sql_query_type", f"with {_A} select event_id, qtype as query_type from a", fx="query_log")
def sql_query_type(t: Inputs):
    return _analysed(t).select("event_id", "query_type")


@query("sql_operations", f"with {_A} select event_id, array_to_string(ops, ',') as operations from a", fx="query_log")
def sql_operations(t: Inputs):
    return _analysed(t).select("event_id", _joined("operations").alias("operations"))


@query(
    "sql_tables",
    f"""with {_A} select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(norm, '(?i)\\b(?:from|join|into|update|table)\\s+([\\w.]+)', 1))), ',') as tables
    from a where not doc""",
    fx="query_log",
)
def sql_tables(t: Inputs):
    a = _analysed(t).where(~A.is_document_store(F.col("database_type")))
    return a.select("event_id", F.array_join(F.array_sort(Q.tables(F.col("normalized"))), ",").alias("tables"))


@query(
    "sql_functions",
    f"with {_A} select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(norm, '(\\w+)\\(', 1))), ',') as functions from a where not doc",
    fx="query_log",
)
def sql_functions(t: Inputs):
    a = _analysed(t).where(~A.is_document_store(F.col("database_type")))
    return a.select("event_id", F.array_join(F.array_sort(Q.called_functions(F.col("normalized"))), ",").alias("functions"))


@query("sql_safety_level", f"with {_A} select event_id, qtype as query_type, level as safety_level from a", fx="query_log")
def sql_safety_level(t: Inputs):
    return _analysed(t).select("event_id", "query_type", "safety_level")


_RISKS = (
    "list_sort(list_concat("
    f"list_transform(list_filter({_q(_KEYWORDS)}, lambda w: contains(lower(norm), w)), lambda w: 'Contains dangerous keyword: ' || w), "
    f"list_transform(list_filter({_q(_OBJECTS)}, lambda w: contains(lower(norm), w)), lambda w: 'Accesses system object: ' || w), "
    "case when list_contains(ops, 'delete') and not contains(lower(norm), 'where') then ['DELETE without WHERE clause'] else [] end, "
    "case when list_contains(ops, 'update') and not contains(lower(norm), 'where') then ['UPDATE without WHERE clause'] else [] end, "
    "case when regexp_matches(lower(norm), 'select\\s+\\*\\s+from') then ['SELECT * may return large dataset'] else [] end))"
)
_MONGO_RISKS = (
    "list_sort(list_concat("
    "case when contains(norm, '.drop(') then ['DROP operation can delete entire collection'] else [] end, "
    "case when contains(norm, '.deleteMany(') and not contains(norm, '$where') then ['deleteMany without specific filter'] else [] end, "
    "case when contains(norm, '.find(') and not contains(norm, 'limit(') then ['find() without limit may return large dataset'] else [] end))"
)


@query(
    "sql_risk_factors",
    f"with {_A} select event_id, array_to_string({_RISKS}, '; ') as risk_factors from a where not doc",
    fx="query_log",
)
def sql_risk_factors(t: Inputs):
    a = A.risks(_analysed(t)).where(~A.is_document_store(F.col("database_type")))
    return a.select("event_id", _joined("risk_factors", "; ").alias("risk_factors"))


@query(
    "sql_potential_issues",
    f"""with {_A} select event_id, array_to_string(list_sort(list_concat(
      case when contains(lower(norm), 'order by') and not contains(lower(norm), 'limit') then ['ORDER BY without LIMIT may be slow'] else [] end,
      case when len(list_distinct(regexp_extract_all(norm, '(?i)\\b(?:from|join|into|update|table)\\s+([\\w.]+)', 1))) > 5 then ['Query accesses many tables - potential performance impact'] else [] end,
      case when regexp_matches(norm, '''.*''') then ['String literals present - check for SQL injection'] else [] end)), '; ') as issues from a where not doc""",
    fx="query_log",
)
def sql_potential_issues(t: Inputs):
    a = _analysed(t).where(~A.is_document_store(F.col("database_type")))
    return a.select("event_id", F.array_join(Q.potential_issues(F.col("normalized")), "; ").alias("issues"))


def _rule_rows(wanted: str, strict: bool = False) -> str:
    parts = []
    for rules, name, level, pattern, blocked, excuses, says in _RULES:
        if rules != wanted:
            continue
        cond = f"regexp_matches(norm, '(?i){pattern}')" + "".join(f" and not contains(lower(norm), '{w}')" for w in excuses if strict)
        flags = ", ".join(f"{b} as {c}" for b, c in zip(blocked, "pds", strict=True))
        parts.append(f"select event_id, '{rules}' as rule_set, '{name}' as rule_name, '{level}' as risk_level, '{says}' as description, {flags}, ops from a where {cond}")
    return " union all ".join(parts)


@query(
    "sql_rule_match",
    f"with {_A} select event_id, rule_set, rule_name, risk_level, description from ("
    + " union all ".join(_rule_rows(name) for name in ("builtin", "config", "deployed"))
    + ") z",
    fx="query_log",
)
def sql_rule_match(t: Inputs):
    return A.matched_rules(_analysed(t), Q.RULE_SETS).select("event_id", "rule_set", "rule_name", "risk_level", "description")


@query(
    "rule_query_join",
    f"with {_A} select rule_name, risk_level, count(*) as statements from ({_rule_rows('deployed', True)}) z group by 1, 2",
    fx="query_log",
)
def rule_query_join(t: Inputs):
    """Strict meaning: a WHERE excuses the statement."""
    hits = A.matched_rules(_analysed(t), Q.DEPLOYED_RULES, strict=True)
    return hits.groupBy("rule_name", "risk_level").agg(F.count(F.lit(1)).alias("statements"))


@query(
    "sql_env_permission",
    f"with {_A} select event_id, level as safety_level, level = 'safe' as production, level in ('safe', 'moderate') as dev, level <> 'critical' as sandbox from a",
    fx="query_log",
)
def sql_env_permission(t: Inputs):
    return A.environment_permission(_analysed(t)).select("event_id", "safety_level", "production", "dev", "sandbox")


@query(
    "sql_blocked_ops",
    f"""with {_A}, r as ({_rule_rows('deployed')}),
    f as (select event_id, bool_or(p) as p, bool_or(d) as d, bool_or(s) as s from r group by 1)
    select a.event_id, case when coalesce(p, false) then array_to_string(list_sort(list_distinct(ops)), ',') else '' end as production,
      case when coalesce(d, false) then array_to_string(list_sort(list_distinct(ops)), ',') else '' end as dev,
      case when coalesce(s, false) then array_to_string(list_sort(list_distinct(ops)), ',') else '' end as sandbox
    from a left join f on a.event_id = f.event_id""",
    fx="query_log",
)
def sql_blocked_ops(t: Inputs):
    b = A.blocked_operations(_analysed(t), Q.DEPLOYED_RULES)
    return b.select(
        "event_id",
        _joined("blocked_production").alias("production"),
        _joined("blocked_dev").alias("dev"),
        _joined("blocked_sandbox").alias("sandbox"),
    )


_ENV = "case when database_type = 'local_sandbox' then 'local_sandbox' when contains(lower(database_name), 'prod') then 'production' else 'dev' end"


@query("db_environment", f"select event_id, {_ENV} as environment from fx_query_log", fx="query_log")
def db_environment(t: Inputs):
    return t.fx("query_log").select("event_id", Q.environment(F.col("database_name"), F.col("database_type")).alias("environment"))


_G = (
    _A
    + f""", g0 as (select *, {_ENV} as env from a),
g1 as (select *, list_filter(ops, lambda o: not list_contains(case env when 'local_sandbox' then ['select', 'insert', 'update', 'create', 'alter'] else ['select'] end, o))[1] as bad from g0),
g as (select *, bad is null and level <> 'dangerous' as allowed,
  case when bad is not null then upper(bad) || ' operation not allowed in ' || env when level = 'dangerous' then 'Query marked as dangerous by analyzer' else 'Operation approved' end as reason,
  case when bad is not null then 'HIGH' when level = 'dangerous' then 'CRITICAL' else 'LOW' end as risk from g1)"""
)


@query(
    "safety_matrix",
    f"with {_G} select event_id, env as environment, coalesce(bad, '') as blocked_operation, allowed, reason, risk as risk_level from g",
    fx="query_log",
)
def safety_matrix(t: Inputs):
    g = A.gate(_analysed(t))
    return g.select(
        "event_id", "environment", F.coalesce("blocked_operation", F.lit("")).alias("blocked_operation"), "allowed", "reason", "risk_level"
    )


@query(
    "audit_decision",
    f"""with {_G} select event_id, qtype as query_type, level as safety_level, case when allowed then 'ALLOWED' else 'BLOCKED' end as decision, reason,
    array_to_string(case when doc then {_MONGO_RISKS} else {_RISKS} end, '; ') as risks, substr(query, 1, 200) as shown_query, query from g""",
    fx="query_log",
)
def audit_decision(t: Inputs):
    d = A.decisions(t.fx("query_log"))
    return d.select("event_id", "query_type", "safety_level", "decision", "reason", _joined("risk_factors", "; ").alias("risks"), "shown_query", "query")


@query(
    "mongo_ops",
    f"""with {_A} select event_id, array_to_string({_MONGO_HITS}, ',') as operations, array_to_string({_MONGO_OPS}, ',') as mapped,
    coalesce({_MONGO_OPS}[1], 'unknown') as primary_type from a where doc""",
    fx="query_log",
)
def mongo_ops(t: Inputs):
    log = t.fx("query_log").where(A.is_document_store(F.col("database_type")))
    text = F.trim("query")
    return log.select(
        "event_id",
        F.array_join(Q.mongo_operations(text), ",").alias("operations"),
        F.array_join(Q.mongo_as_operations(text), ",").alias("mapped"),
        Q.mongo_type(text).alias("primary_type"),
    )


@query(
    "mongo_collections",
    f"with {_A} select event_id, array_to_string(list_sort(list_distinct(regexp_extract_all(norm, 'db\\.(\\w+)\\.', 1))), ',') as collections from a where doc",
    fx="query_log",
)
def mongo_collections(t: Inputs):
    log = t.fx("query_log").where(A.is_document_store(F.col("database_type")))
    return log.select("event_id", F.array_join(Q.mongo_collections(F.trim("query")), ",").alias("collections"))


@query("mongo_risks", f"with {_A} select event_id, array_to_string({_MONGO_RISKS}, '; ') as risks from a where doc", fx="query_log")
def mongo_risks(t: Inputs):
    log = t.fx("query_log").where(A.is_document_store(F.col("database_type")))
    return log.select("event_id", F.array_join(Q.mongo_risks(F.trim("query")), "; ").alias("risks"))


_WRITE = "case " + " ".join(f"when regexp_matches(trim(query), '{p}') then {i + 1}" for i, p in enumerate(_WRITES)) + " end"


@query(
    "write_detect",
    f"select event_id, coalesce({_WRITE}, 0) as write_pattern, ({_WRITE}) is not null as is_write from fx_query_log",
    fx="query_log",
)
def write_detect(t: Inputs):
    out = A.write_detection(t.fx("query_log"))
    return out.select("event_id", F.coalesce("write_pattern", F.lit(0)).alias("write_pattern"), "is_write")


@query(
    "suspicious_detect",
    f"""select event_id, keyword, 'REVIEW' as status, 'Contains dangerous keyword: ' || keyword as message
    from (select event_id, unnest(list_filter({_q(_REVIEW)}, lambda w: contains(lower(query), w))) as keyword
      from (select event_id, 'EXPLAIN ' || query as query from fx_query_log) where ({_WRITE}) is null)""",
    fx="query_log",
)
def suspicious_detect(t: Inputs):
    """Statements behind a harmless first word: no write by pattern, yet they carry its words."""
    log = t.fx("query_log").withColumn("query", F.concat(F.lit("EXPLAIN "), "query"))
    return A.suspicious(log).select("event_id", "keyword", "status", "message")


_INJECT = "case " + " ".join(f"when regexp_matches(upper(query), '{p}') then {i + 1}" for i, p in enumerate(_BODIES)) + " end"


@query(
    "injection_detect",
    f"select event_id, coalesce({_INJECT}, 0) as injection_pattern, ({_INJECT}) is not null as blocked from fx_query_log",
    fx="query_log",
)
def injection_detect(t: Inputs):
    out = A.injections(t.fx("query_log"))
    return out.select("event_id", F.coalesce("injection_pattern", F.lit(0)).alias("injection_pattern"), "blocked")


# Ports, and the words looked for in turn; the first port's follow a command byte.
_PORTS = [
    (3306, "chr(3) || ", "INSERT UPDATE DELETE REPLACE CREATE DROP ALTER TRUNCATE"),
    (1433, "", "INSERT UPDATE DELETE CREATE DROP ALTER"),
    (27017, "", "insert update delete findAndModify remove"),
]


def _packet_sql() -> str:
    cases = [f"when port = {port} then (case " + " ".join(f"when contains(payload, {byte}'{w}') then '{w}'" for w in words.split()) + " end)" for port, byte, words in _PORTS]
    return "case " + " ".join(cases) + " end"


@query(
    "packet_write_detect",
    f"""with p as (select event_id, case event_id % 3 when 0 then 3306 when 1 then 1433 else 27017 end as port,
      case when event_id % 3 = 0 then chr(3) || query else query end as payload from fx_query_log)
    select * from (select event_id, port, {_packet_sql()} as write_word from p) where write_word is not null""",
    fx="query_log",
)
def packet_write_detect(t: Inputs):
    n = F.col("event_id") % 3
    traffic = t.fx("query_log").select(
        "event_id",
        F.when(n == 0, 3306).when(n == 1, 1433).otherwise(27017).alias("port"),
        F.when(n == 0, F.concat(F.lit("\x03"), "query")).otherwise(F.col("query")).alias("payload"),
    )
    return A.packet_writes(traffic).select("event_id", "port", "write_word")
