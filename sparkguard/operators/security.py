"""Policies, compliance, keys, incidents, and the security posture."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.operators.lifecycle import whole_days
from sparkguard.operators.metrics import at

# Default policies; only the first three rule kinds are evaluated, the others are recorded.
POLICIES: dict[str, dict[str, object]] = {
    "password_policy": {
        "min_length": 12,
        "require_uppercase": True,
        "require_lowercase": True,
        "require_numbers": True,
        "require_special": True,
        "max_age_days": 90,
    },
    "mfa_policy": {"require_mfa": True, "allowed_methods": ["totp", "sms", "hardware_key"], "grace_period_days": 7},
    "encryption_policy": {
        "encryption_at_rest": True,
        "encryption_in_transit": True,
        "min_key_size": 256,
        "allowed_algorithms": ["AES-256", "RSA-2048"],
    },
    "network_security_policy": {"deny_public_access": True, "require_vpc": True, "allowed_ports": [443, 22], "require_waf": True},
}
# Risky ports; weights and texts of the posture.
RISKY_PORTS = (21, 23, 135, 139, 445)
NETWORK_SCORE = 85.0
ADVICE_BELOW = 80


# What findings and advice say.
SAYS = {
    "mfa": "Multi-factor authentication is required",
    "rest": "Data must be encrypted at rest",
    "public": "Resources should not be publicly accessible",
    "transit": "Network traffic must be encrypted",
    "unencrypted": "Unencrypted database connections",
    "tls": "Enable SSL/TLS for all database connections",
    "stale keys": "Review and clean up deprecated encryption keys",
    "critical mfa": "Enable MFA for all critical resources",
    "grant expiry": "Set expiration dates for temporary access grants",
    "slow": "Improve incident resolution rate",
}


@dataclass(frozen=True)
class ComplianceRule:
    rule_id: str
    framework: str
    description: str
    severity: str


# Compliance rules per framework.
COMPLIANCE_RULES = (
    ComplianceRule("soc2-encryption", "soc2", "All data must be encrypted at rest and in transit", "critical"),
    ComplianceRule("hipaa-access-control", "hipaa", "Access must be role-based with audit logging", "critical"),
    ComplianceRule("gdpr-data-retention", "gdpr", "Personal data must have retention policies", "high"),
)


def evaluate_policies(subjects: DataFrame, policies: dict[str, dict[str, object]] = POLICIES) -> DataFrame:
    """One row per subject and policy with its violations; rule kinds without a test are ignored."""

    def broken(rules: dict[str, object]) -> Column:
        tests = []
        if "min_length" in rules:
            n = rules["min_length"]
            tests.append(F.when(F.coalesce("password_length", F.lit(0)) < n, f"Password must be at least {n} characters"))
        if rules.get("require_mfa"):
            tests.append(F.when(~F.coalesce("mfa_enabled", F.lit(False)), SAYS["mfa"]))
        if rules.get("encryption_at_rest"):
            tests.append(F.when(~F.coalesce("encrypted_at_rest", F.lit(False)), SAYS["rest"]))
        return F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")

    each = F.array(*[F.struct(F.lit(p).alias("policy"), broken(r).alias("violations")) for p, r in policies.items()])
    out = subjects.select("*", F.explode(each).alias("e")).select(*subjects.columns, "e.*")
    return out.withColumn("passed", F.size("violations") == 0)


def check_network(configs: DataFrame) -> DataFrame:
    """Issues of network configurations with ``allowed_ports`` as an array of numbers."""
    risky = F.filter("allowed_ports", lambda p: p.isin(*RISKY_PORTS))
    named = F.transform(risky, lambda p: F.concat(F.lit("Port "), p.cast("string"), F.lit(" is considered risky and should not be exposed")))
    general = F.array_compact(
        F.array(
            F.when(F.coalesce("public_access", F.lit(False)), SAYS["public"]),
            F.when(~F.coalesce("encryption_in_transit", F.lit(False)), SAYS["transit"]),
        )
    )
    return configs.withColumn("issues", F.concat(general, F.coalesce(named, F.array().cast("array<string>")))).withColumn(
        "valid", F.size("issues") == 0
    )


def compliance_violations(results: DataFrame, rules: tuple[ComplianceRule, ...] = COMPLIANCE_RULES) -> DataFrame:
    """Failed rules with their number of failures, description and severity; an undescribed rule is medium."""
    failed = results.where(~F.col("passed")).groupBy("framework", "rule_id").agg(F.count(F.lit(1)).alias("failures"))
    described = {r.rule_id: r for r in rules}

    def told(field: str, default: str) -> Column:
        return F.coalesce(*[F.when(F.col("rule_id") == i, getattr(r, field)) for i, r in described.items()], F.lit(default))

    return failed.withColumns({"description": told("description", ""), "severity": told("severity", "medium")})


def compliance_scores(results: DataFrame, frameworks: list[str]) -> DataFrame:
    """Score per framework from rule results (``framework``, ``rule_id``, ``passed``), and the overall mean.

    A rule fails if any of its results failed. A framework without rules scores 100. Results are reduced
    to one row per rule before anything is listed.
    """
    rules = results.groupBy("framework", "rule_id").agg(F.every("passed").alias("passed"))
    scored = rules.groupBy("framework").agg(
        F.count(F.lit(1)).alias("total_rules"),
        F.count_if("passed").alias("passed_rules"),
        F.array_join(F.array_sort(F.collect_list(F.when(~F.col("passed"), F.col("rule_id")))), ",").alias("violations"),
    )
    wanted = results.sparkSession.createDataFrame([(f,) for f in frameworks], "framework string")
    per = wanted.join(scored, "framework", "left").select(
        "framework",
        F.coalesce("total_rules", F.lit(0)).alias("total_rules"),
        F.coalesce("passed_rules", F.lit(0)).alias("passed_rules"),
        F.coalesce(F.col("passed_rules") / F.col("total_rules") * 100, F.lit(100.0)).alias("score"),
        F.coalesce("violations", F.lit("")).alias("violations"),
    )
    overall = per.agg(
        F.lit("overall").alias("framework"),
        F.sum("total_rules").alias("total_rules"),
        F.sum("passed_rules").alias("passed_rules"),
        F.avg("score").alias("score"),
        F.array_join(F.array_sort(F.collect_list(F.nullif("violations", F.lit("")))), ",").alias("violations"),
    )
    return per.unionByName(overall)


def vulnerabilities(resources: DataFrame, name: str) -> DataFrame:
    """Resources with "database" in their name."""
    return resources.where(F.lower(name).contains("database")).select(
        F.col(name).alias("resource"),
        F.lit(SAYS["unencrypted"]).alias("vulnerability"),
        F.lit("high").alias("severity"),
        F.lit(SAYS["tls"]).alias("remediation"),
    )


def keys_due(keys: DataFrame, as_of: dt.datetime) -> DataFrame:
    age = whole_days(F.col("created_at"), at(as_of))
    return keys.withColumn("age_days", age).where((F.col("status") == "active") & (F.col("age_days") > F.col("rotation_days")))


def _posture(category: str, row: DataFrame, cuts: list[tuple[Column, int, Column]]) -> DataFrame:
    score = F.lit(100)
    for bad, minus, _ in cuts:
        score = score - F.when(bad, minus).otherwise(0)
    advice = F.array_compact(F.array(*[F.when(bad, text) for bad, _, text in cuts]))
    return row.select(F.lit(category).alias("category"), F.greatest(F.lit(0), score).cast("double").alias("score"), advice.alias("recommendations"))


def key_posture(keys: DataFrame, as_of: dt.datetime) -> DataFrame:
    due = whole_days(F.col("created_at"), at(as_of)) > F.col("rotation_days")
    row = keys.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if((F.col("status") == "active") & due).alias("due"),
    )
    rotate = F.concat(F.lit("Rotate "), F.col("due").cast("string"), F.lit(" encryption keys"))
    stale = F.coalesce((F.col("total") > 0) & (F.col("active") / F.nullif("total", F.lit(0)) < 0.8), F.lit(False))
    return _posture("encryption", row, [(F.col("due") > 0, 15, rotate), (stale, 10, F.lit(SAYS["stale keys"]))])


def access_posture(grants: DataFrame) -> DataFrame:
    """Shares of grants with MFA and expiry per resource, as they were defined: the divisor is resources."""
    row = grants.agg(
        F.countDistinct("resource").alias("resources"),
        F.count_if(F.col("require_mfa") == "true").alias("mfa"),
        F.count("expires_at").alias("expiry"),
    )
    some = F.col("resources") > 0
    few_mfa = F.coalesce(some & (F.col("mfa") / F.nullif("resources", F.lit(0)) * 100 < 90), F.lit(False))
    few_expiry = F.coalesce(some & (F.col("expiry") / F.nullif("resources", F.lit(0)) * 100 < 50), F.lit(False))
    return _posture(
        "access_control",
        row,
        [
            (few_mfa, 20, F.lit(SAYS["critical mfa"])),
            (few_expiry, 10, F.lit(SAYS["grant expiry"])),
        ],
    )


def incident_posture(incidents: DataFrame) -> DataFrame:
    row = incidents.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("remediation_status") == "resolved").alias("resolved"),
        F.count_if(F.col("threat_level") == "critical").alias("critical"),
    )
    slow = F.coalesce((F.col("total") > 0) & (F.col("resolved") / F.nullif("total", F.lit(0)) * 100 < 95), F.lit(False))
    review = F.concat(F.lit("Review "), F.col("critical").cast("string"), F.lit(" critical incidents"))
    return _posture("incident_response", row, [(slow, 20, F.lit(SAYS["slow"])), (F.col("critical") > 0, 10, review)])


def compliance_posture(scores: DataFrame) -> DataFrame:
    """Mean score of the given frameworks, and a line about the violated rules."""
    row = scores.where(F.col("framework") == "overall").select("score", F.size(F.filter(F.split("violations", ","), lambda v: v != "")).alias("n"))
    advice = F.when(
        F.col("n") > 0, F.array(F.concat(F.lit("Address "), F.col("n").cast("string"), F.lit(" compliance violations")))
    ).otherwise(F.array().cast("array<string>"))
    return row.select(F.lit("compliance").alias("category"), "score", advice.alias("recommendations"))


def network_posture(like: DataFrame) -> DataFrame:
    return like.sparkSession.range(1).select(
        F.lit("network_security").alias("category"), F.lit(NETWORK_SCORE).alias("score"), F.array().cast("array<string>").alias("recommendations")
    )


def security_posture(categories: list[DataFrame]) -> DataFrame:
    """The categories and their mean; advice counts only where a category scores below 80."""
    every = reduce(DataFrame.unionByName, categories)
    shown = every.withColumn("recommendations", F.when(F.col("score") < ADVICE_BELOW, F.col("recommendations")).otherwise(F.array().cast("array<string>")))
    overall = shown.agg(
        F.lit("overall").alias("category"),
        F.avg("score").alias("score"),
        F.array_sort(F.flatten(F.collect_list("recommendations"))).alias("recommendations"),
    )
    return shown.unionByName(overall)
