"""The statement shapes of the query log, and strict rule matching."""

from __future__ import annotations

import pytest
from conftest import SF
from pyspark.sql import functions as F

from sparkguard.functions import querytext as Q
from sparkguard.operators import audit as A
from sparkguard.plans.registry import Inputs

# statement: type, level, allowed in production / dev / sandbox
CASES = {
    "SELECT * FROM orders": ("select", "safe", (True, True, True)),
    "SELECT name FROM sys.objects -- comment": ("select", "safe", (True, True, True)),
    "INSERT INTO users (name) VALUES ('test')": ("insert", "moderate", (False, True, True)),
    "UPDATE users SET name = 1": ("update", "moderate", (False, True, True)),
    "DELETE FROM users WHERE id = 1": ("delete", "dangerous", (False, False, True)),
    "EXEC xp_cmdshell 'dir'": ("execute", "dangerous", (False, False, True)),
    "EXECUTE(@statement)": ("execute", "dangerous", (False, False, True)),
    "DROP TABLE users": ("drop", "critical", (False, False, False)),
    "call report(1)": ("call", "moderate", (False, True, True)),
    "selection(1)": ("unknown", "moderate", (False, True, True)),
    "db.users.findOne({})": ("select", "safe", (True, True, True)),
    "db.users.drop()": ("drop", "critical", (False, False, False)),
    "{'find': 'users'}": ("unknown", "moderate", (False, True, True)),
}


@pytest.fixture(scope="module")
def log(spark):
    return Inputs(spark, SF).fx("query_log")


def test_cases(log):
    rows = A.environment_permission(A.analyse(log)).where(F.col("query").isin(*CASES)).select("query", "query_type", "safety_level", "production", "dev", "sandbox").distinct().collect()
    assert {r["query"]: (r["query_type"], r["safety_level"], (r["production"], r["dev"], r["sandbox"])) for r in rows} == CASES


def test_matrix_is_stricter_than_the_levels(log):
    """Reads pass everywhere, inserts and updates only in a sandbox, deletes nowhere."""
    wanted = ["SELECT * FROM orders", "UPDATE users SET name = 1", "DELETE FROM users"]
    passed = A.gate(A.analyse(log)).where(F.col("allowed") & F.col("query").isin(*wanted)).select("query", "environment").distinct().collect()
    assert {tuple(r) for r in passed} == {(wanted[0], e) for e in ("production", "dev", "local_sandbox")} | {(wanted[1], "local_sandbox")}


def test_the_type_of_the_database_decides(spark):
    rows = [(q, "dev_main", t) for q in ("db.users.find({})", "SELECT 1", '{"find": "users"}') for t in ("mongodb", "MongoDB", "mssql")]
    out = A.decisions(spark.createDataFrame(rows, "query string, database_name string, database_type string")).collect()
    got = {(r["query"], r["database_type"]): (r["query_type"], r["decision"]) for r in out}
    assert got["db.users.find({})", "mongodb"] == got["db.users.find({})", "MongoDB"] == ("select", "ALLOWED")
    assert got["db.users.find({})", "mssql"] == ("unknown", "BLOCKED") and got["SELECT 1", "mssql"] == ("select", "ALLOWED")
    assert got['{"find": "users"}', "mongodb"] == got["SELECT 1", "mongodb"] == ("unknown", "ALLOWED")


def test_every_rule_pattern_and_word_matches_some_rows_and_misses_some(log):
    a = A.risks(A.analyse(log))
    n = a.count()
    hits = {(r["rule_set"], r["rule_name"]): r["count"] for r in A.matched_rules(a, Q.RULE_SETS).groupBy("rule_set", "rule_name").count().collect()}
    assert set(hits) == {(k, r.name) for k, rules in Q.RULE_SETS.items() for r in rules} and max(hits.values()) < n
    assert {r[0] for r in A.write_detection(log).select("write_pattern").distinct().collect()} == {None, *range(1, len(Q.WRITE_PATTERNS) + 1)}
    assert {r[0] for r in A.injections(log).select("injection_pattern").distinct().collect()} == {None, *range(1, len(Q.INJECTION_PATTERNS) + 1)}
    found = {r[0] for r in a.select(F.explode("risk_factors")).distinct().collect()} | {r[0] for r in a.select(F.explode(Q.potential_issues(F.col("normalized")))).distinct().collect()}
    plain = {v for k, v in Q.SAYS.items() if k not in ("keyword", "system object")}
    assert found == plain | {Q.SAYS["keyword"] + w for w in Q.DANGEROUS_KEYWORDS} | {Q.SAYS["system object"] + w for w in Q.SYSTEM_OBJECTS}
    calls = a.where(A.is_document_store(F.col("database_type"))).select(F.explode(Q.mongo_operations(F.col("normalized"))))
    assert {r[0] for r in calls.distinct().collect()} == set(Q.MONGO_OPERATIONS)
    behind = log.withColumn("query", F.concat(F.lit("EXPLAIN "), "query"))
    assert {r["keyword"] for r in A.suspicious(behind).select("keyword").distinct().collect()} == set(Q.REVIEW_WORDS)


def test_statements_stay_whole(log):
    row = A.decisions(log, shown=20).where(F.length("query") > 300).first()
    assert len(row["query"]) > 300 and row["shown_query"] == row["query"][:20]


def test_matches_say_why(log):
    assert A.matched_rules(A.analyse(log), Q.RULE_SETS).where("description = ''").isEmpty()


def statements(spark, *texts):
    return spark.createDataFrame([(t, "dev_main", "mssql") for t in texts], "query string, database_name string, database_type string")


def rules_of(spark, text, strict):
    return {r["rule_name"] for r in A.matched_rules(A.analyse(statements(spark, text)), Q.DEPLOYED_RULES, strict).collect()}


def test_strict_where(spark):
    assert "unsafe_deletes" in rules_of(spark, "DELETE FROM users WHERE id = 1", False)
    assert "unsafe_deletes" not in rules_of(spark, "DELETE FROM users WHERE id = 1", True)
    assert "unsafe_deletes" in rules_of(spark, "delete from users", True)
    assert "large_table_scans" not in rules_of(spark, "SELECT * FROM t LIMIT 3", True)


def test_normalize(spark):
    text = "  SELECT a -- one\n, b /* two\n lines */ FROM t\t WHERE x = 1  "
    df = statements(spark, text).select(Q.normalized(F.col("query")))
    assert df.head()[0] == "SELECT a , b FROM t WHERE x = 1"


def test_tables_functions_and_issues(spark):
    text = "select count(*), max(x) from a.b join c on 1 = 1 join a.b on 2 = 2 order by 1"
    row = statements(spark, text).select(
        Q.tables(F.col("query")), Q.called_functions(F.col("query")), Q.potential_issues(F.col("query"))
    ).head()
    assert row[0] == ["a.b", "c"] and row[1] == ["count", "max"] and row[2] == ["ORDER BY without LIMIT may be slow"]


def test_risk_words_are_substrings(spark):
    row = A.risks(A.analyse(statements(spark, "SELECT is_deleted FROM t"))).head()
    assert row["risk_factors"] == ["Contains dangerous keyword: delete"]


def test_empty_and_null_statements(spark):
    df = spark.createDataFrame([("", "prod", "mssql"), (None, "prod", "mssql")], "query string, database_name string, database_type string")
    rows = A.decisions(df).collect()
    assert len(rows) == 2 and rows[0]["query_type"] == "unknown" and rows[0]["decision"] == "BLOCKED"


def test_write_and_review(spark):
    texts = ["  insert into t values (1)", "EXEC sp_INSERT", "db.t.update({$set: 1})", "SHUTDOWN now", "select 1", "explain values"]
    writes = [r["is_write"] for r in A.write_detection(statements(spark, *texts)).collect()]
    assert writes == [True, True, True, True, False, False]
    assert [r["keyword"] for r in A.suspicious(statements(spark, *texts)).collect()] == ["values"]


def test_packets_are_case_sensitive(spark):
    rows = [(3306, "\x03INSERT x"), (3306, "INSERT x"), (1433, "INSERT x"), (1433, "insert x"), (27017, "findAndModify"), (5432, "INSERT")]
    found = A.packet_writes(spark.createDataFrame(rows, "port int, payload string")).collect()
    assert [(r["port"], r["write_word"]) for r in found] == [(3306, "INSERT"), (1433, "INSERT"), (27017, "findAndModify")]


def test_injection(spark):
    texts = ["update t\nset\n x", "a union  select b", "exec (x)", "select 1"]
    assert [r["injection_pattern"] for r in A.injections(statements(spark, *texts)).collect()] == [2, 8, 7, None]
