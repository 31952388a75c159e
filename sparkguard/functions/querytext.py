"""What a logged statement is and does, read from its text with column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading words of a statement, and the words that count as operations inside it.
LEADING = ("select", "insert", "update", "delete", "create", "drop", "alter", "truncate", "execute", "exec", "call")
OPERATIONS = ("select", "insert", "update", "delete", "create", "drop", "alter", "truncate")

# Words and system objects that make a statement risky, matched as substrings.
DANGEROUS_KEYWORDS = (
    "drop", "truncate", "delete", "exec", "execute", "xp_cmdshell", "sp_configure", "openrowset", "opendatasource",
    "bulk", "backup", "restore", "shutdown", "waitfor",
)
SYSTEM_OBJECTS = (
    "sys", "information_schema", "master", "model", "msdb", "tempdb", "mysql", "performance_schema", "pg_catalog", "pg_toast",
)

# Document-store operations in order of precedence, and the statement type each counts as.
MONGO_OPERATIONS = (
    "find", "findOne", "aggregate", "count", "distinct", "insertOne", "insertMany", "updateOne", "updateMany",
    "deleteOne", "deleteMany", "replaceOne", "createIndex", "dropIndex", "drop", "createCollection",
)
MONGO_TYPES = {
    "find": "select", "findOne": "select", "aggregate": "select", "count": "select",
    "insertOne": "insert", "insertMany": "insert",
    "updateOne": "update", "updateMany": "update", "replaceOne": "update",
    "deleteOne": "delete", "deleteMany": "delete",
    "createIndex": "create", "createCollection": "create",
    "drop": "drop", "dropIndex": "drop",
}

# Statements a read-only gate refuses.
WRITE_PATTERNS = (
    r"(?i)^\s*(INSERT|UPDATE|DELETE|REPLACE|MERGE)\s+",
    r"(?i)^\s*(TRUNCATE|DROP|CREATE|ALTER)\s+",
    r"(?i)^\s*(GRANT|REVOKE|DENY)\s+",
    r"(?i)^\s*(BACKUP|RESTORE)\s+",
    r"(?i)^\s*(EXEC|EXECUTE|CALL)\s+.*_(INSERT|UPDATE|DELETE|CREATE|DROP)",
    r"(?i)(insert|update|delete|drop|create|remove)\s*\(",
    r"(?i)\$set|\$unset|\$push|\$pull|\$inc",
    r"(?i)^\s*(SHUTDOWN|KILL)\s+",
)
# Words that send a statement to review.
REVIEW_WORDS = ("into", "set", "values", "modify", "cascade", "constraint", "index", "trigger", "procedure")
# Request bodies a gateway refuses, on upper-cased text.
INJECTION_PATTERNS = (
    r"INSERT\s+INTO",
    r"(?s)UPDATE\s+.*\s+SET",
    r"DELETE\s+FROM",
    r"DROP\s+TABLE",
    r"CREATE\s+TABLE",
    r"ALTER\s+TABLE",
    r"EXEC\s*\(",
    r"UNION\s+SELECT",
)
# Write words by server port; the first port carries a command byte before the word.
PACKET_WORDS = {
    3306: tuple("\x03" + w for w in ("INSERT", "UPDATE", "DELETE", "REPLACE", "CREATE", "DROP", "ALTER", "TRUNCATE")),
    1433: ("INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER"),
    27017: ("insert", "update", "delete", "findAndModify", "remove"),
}

# What findings say.
SAYS = {
    "keyword": "Contains dangerous keyword: ",
    "system object": "Accesses system object: ",
    "delete": "DELETE without WHERE clause",
    "update": "UPDATE without WHERE clause",
    "select all": "SELECT * may return large dataset",
    "order by": "ORDER BY without LIMIT may be slow",
    "many tables": "Query accesses many tables - potential performance impact",
    "literals": "String literals present - check for SQL injection",
    "drop collection": "DROP operation can delete entire collection",
    "delete many": "deleteMany without specific filter",
    "find": "find() without limit may return large dataset",
}


def _strings(items) -> Column:
    return F.array(*[F.lit(x) for x in items])


def normalized(text: Column) -> Column:
    """Comments dropped, white space collapsed, trimmed."""
    bare = F.regexp_replace(F.regexp_replace(text, r"(?m)--.*$", ""), r"(?s)/\*.*?\*/", "")
    return F.regexp_replace(F.trim(F.regexp_replace(bare, r"\s+", " ")), r"^ | $", "")


def query_type(norm: Column) -> Column:
    word = F.regexp_extract(F.lower(norm), "^(" + "|".join(LEADING) + r")\b", 1)
    return F.when(word == "", "unknown").when(word == "exec", "execute").otherwise(word)


def operations(norm: Column) -> Column:
    """Operation words in text order, or the statement type where there is none."""
    found = F.regexp_extract_all(F.lower(norm), F.lit(r"\b(" + "|".join(OPERATIONS) + r")\b"), F.lit(1))
    return F.when(F.size(found) > 0, found).otherwise(F.array(query_type(norm)))


def tables(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(r"(?i)\b(?:from|join|into|update|table)\s+([\w.]+)"), F.lit(1)))


def called_functions(norm: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(norm, F.lit(r"(\w+)\("), F.lit(1)))


def safety_level(ops: Column, kind: Column) -> Column:
    return (
        F.when(F.arrays_overlap(ops, _strings(["drop", "truncate"])), "critical")
        .when(F.arrays_overlap(ops, _strings(["delete", "execute"])), "dangerous")
        .when(F.arrays_overlap(ops, _strings(["insert", "update", "create", "alter"])), "moderate")
        .when(kind == "select", "safe")
        .otherwise("moderate")
    )


def _when_true(pairs: list[tuple[Column, str]]) -> Column:
    """Sorted array of the texts whose condition holds."""
    return F.array_sort(F.array_compact(F.array(*[F.when(c, text) for c, text in pairs])))


def risk_factors(norm: Column, ops: Column) -> Column:
    low = F.lower(norm)
    no_where = ~low.contains("where")
    return _when_true(
        [(low.contains(w), SAYS["keyword"] + w) for w in DANGEROUS_KEYWORDS]
        + [(low.contains(w), SAYS["system object"] + w) for w in SYSTEM_OBJECTS]
        + [(F.array_contains(ops, "delete") & no_where, SAYS["delete"])]
        + [(F.array_contains(ops, "update") & no_where, SAYS["update"])]
        + [(low.rlike(r"select\s+\*\s+from"), SAYS["select all"])]
    )


def potential_issues(norm: Column) -> Column:
    low = F.lower(norm)
    return _when_true(
        [
            (low.contains("order by") & ~low.contains("limit"), SAYS["order by"]),
            (F.size(tables(norm)) > 5, SAYS["many tables"]),
            (norm.rlike("'.*'"), SAYS["literals"]),
        ]
    )


def mongo_operations(text: Column) -> Column:
    return F.array_compact(F.array(*[F.when(text.contains(f".{op}("), op) for op in MONGO_OPERATIONS]))


def mongo_as_operations(text: Column) -> Column:
    """Statement types of the document-store operations, in order of precedence."""
    return F.array_compact(F.array(*[F.when(text.contains(f".{op}("), MONGO_TYPES.get(op)) for op in MONGO_OPERATIONS]))


def mongo_type(text: Column) -> Column:
    return F.coalesce(F.get(mongo_as_operations(text), F.lit(0)), F.lit("unknown"))


def mongo_collections(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"db\.(\w+)\."), F.lit(1))))


def mongo_risks(text: Column) -> Column:
    return _when_true(
        [
            (text.contains(".drop("), SAYS["drop collection"]),
            (text.contains(".deleteMany(") & ~text.contains("$where"), SAYS["delete many"]),
            (text.contains(".find(") & ~text.contains("limit("), SAYS["find"]),
        ]
    )


def write_pattern(text: Column) -> Column:
    """Number of the first write pattern that matches, or null."""
    return F.coalesce(*[F.when(F.trim(text).rlike(p), i + 1) for i, p in enumerate(WRITE_PATTERNS)])


def review_words(text: Column) -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.contains(w), w) for w in REVIEW_WORDS]))


def injection_pattern(body: Column) -> Column:
    return F.coalesce(*[F.when(F.upper(body).rlike(p), i + 1) for i, p in enumerate(INJECTION_PATTERNS)])


def packet_word(port: Column, payload: Column) -> Column:
    """First write word of the port's protocol inside the payload, or null."""
    cases = None
    for p, words in PACKET_WORDS.items():
        first = F.coalesce(*[F.when(payload.contains(w), w.lstrip("\x03")) for w in words])
        cases = F.when(port == p, first) if cases is None else cases.when(port == p, first)
    return cases


@dataclass(frozen=True)
class SafetyRule:
    """A pattern with its level and the environments it blocks.

    ``unless`` holds words whose presence excuses the statement; it counts only in strict matching.
    """

    name: str
    pattern: str
    level: str
    description: str = ""
    production: bool = True
    dev: bool = True
    sandbox: bool = False
    enabled: bool = True
    unless: tuple[str, ...] = ()

    def matches(self, norm: Column, strict: bool = False) -> Column:
        hit = norm.rlike("(?i)" + self.pattern)
        if strict:
            for word in self.unless:
                hit = hit & ~F.lower(norm).contains(word)
        return hit


# The built-in rules.
BUILTIN_RULES = (
    SafetyRule("drop_or_truncate", r"\b(drop|truncate)\s+(table|database|schema)", "critical", "DROP/TRUNCATE operations are destructive", sandbox=True),
    SafetyRule("command_shell", r"\bxp_cmdshell\b", "critical", "Command execution via xp_cmdshell", sandbox=True),
    SafetyRule("bulk_access", r"\b(bulk\s+insert|openrowset|opendatasource)\b", "dangerous", "Bulk data operations can affect performance"),
    SafetyRule("unsafe_delete", r"\bdelete\s+from\s+\w+", "dangerous", "DELETE without WHERE clause", unless=("where",)),
    SafetyRule("unsafe_update", r"\bupdate\s+\w+\s+set\s+", "dangerous", "UPDATE without WHERE clause", unless=("where",)),
    SafetyRule("system_access", r"\b(sys\.|information_schema\.|master\.|msdb\.)", "moderate", "System table/schema access", dev=False),
)
# The rules a configuration starts from.
CONFIG_RULES = (
    SafetyRule("block_drop_operations", r"\b(drop|truncate)\s+(table|database|schema|collection)", "critical", "DROP/TRUNCATE operations are destructive", sandbox=True),
    SafetyRule("block_system_commands", r"\b(xp_cmdshell|sp_configure|openrowset|opendatasource)\b", "critical", "System command execution", sandbox=True),
    SafetyRule("unsafe_deletes", r"\bdelete\s+from\s+\w+", "dangerous", "DELETE without WHERE clause", unless=("where",)),
    SafetyRule("unsafe_updates", r"\bupdate\s+\w+\s+set\s+", "dangerous", "UPDATE without WHERE clause", unless=("where",)),
    SafetyRule("system_table_access", r"\b(sys\.|information_schema\.|master\.|msdb\.)", "moderate", "System table/schema access", dev=False),
    SafetyRule("bulk_operations", r"\b(bulk\s+insert|load\s+data)\b", "moderate", "Bulk data operations"),
)
# The deployed rules.
DEPLOYED_RULES = (
    SafetyRule("block_drop_operations", r"\b(drop|truncate)\s+(table|database|schema|collection)\b", "critical", "DROP/TRUNCATE operations are destructive and irreversible", sandbox=True),
    SafetyRule(
        "block_system_commands",
        r"\b(xp_cmdshell|sp_configure|openrowset|opendatasource|exec\s+xp_|execute\s+xp_)\b",
        "critical", "System command execution via stored procedures",
        sandbox=True,
    ),
    SafetyRule("block_bulk_operations", r"\b(bulk\s+insert|load\s+data|restore\s+database|backup\s+database)\b", "critical", "Bulk operations can affect system performance", sandbox=True),
    SafetyRule("unsafe_deletes", r"\bdelete\s+from\s+\w+", "dangerous", "DELETE statements without WHERE clause can remove all data", unless=("where",)),
    SafetyRule("unsafe_updates", r"\bupdate\s+\w+\s+set\s+", "dangerous", "UPDATE statements without WHERE clause affect all rows", unless=("where",)),
    SafetyRule("dynamic_sql_injection", r"\b(exec|execute)\s*\(\s*@|\bexec\s+sp_executesql\b", "dangerous", "Dynamic SQL execution can be vulnerable to injection"),
    SafetyRule("system_table_access", r"\b(sys\.|information_schema\.|master\.|model\.|msdb\.|tempdb\.)\b", "moderate", "Access to system tables and schemas", dev=False),
    SafetyRule("admin_functions", r"\b(db_owner|db_securityadmin|db_ddladmin|sysadmin)\b", "moderate", "Administrative database functions", dev=False),
    SafetyRule("large_table_scans", r"\bselect\s+\*\s+from\s+\w+", "moderate", "SELECT * without WHERE/LIMIT can cause performance issues", dev=False, unless=("where", "limit", "top")),
    SafetyRule("mongodb_unsafe_operations", r"\.(drop|dropDatabase|dropIndex)\s*\(", "dangerous", "MongoDB drop operations"),
    SafetyRule("mongodb_bulk_write", r"\.(bulkWrite|insertMany|deleteMany)\s*\(", "moderate", "MongoDB bulk operations can affect performance", dev=False),
)
RULE_SETS = {"builtin": BUILTIN_RULES, "config": CONFIG_RULES, "deployed": DEPLOYED_RULES}

# Operations each environment allows; anything else is refused.
ALLOWED = {
    "production": ("select",),
    "dev": ("select",),
    "local_sandbox": ("select", "insert", "update", "create", "alter"),
}


def environment(database_name: Column, database_type: Column) -> Column:
    return (
        F.when(database_type == "local_sandbox", "local_sandbox")
        .when(F.lower(database_name).contains("prod"), "production")
        .otherwise("dev")
    )


def refused_operations(env: Column, ops: Column) -> Column:
    cases = None
    for name, allowed in ALLOWED.items():
        left = F.array_except(ops, _strings(allowed))
        cases = F.when(env == name, left) if cases is None else cases.when(env == name, left)
    return cases.otherwise(ops)
