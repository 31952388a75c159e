"""Audit of a query log: one pass of column expressions, on a table or on a stream.

The log needs ``query``, ``database_name`` and ``database_type``. Statements of a document store
(type ``mongodb``) are read as its calls, all others as SQL. Rules are literals of the plan, so nothing is joined.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.functions import querytext as Q


def is_document_store(database_type: Column) -> Column:
    return F.coalesce(F.lower(database_type) == "mongodb", F.lit(False))


def analyse(log: DataFrame) -> DataFrame:
    """Adds normalized text, type, operations and safety level."""
    doc = is_document_store(F.col("database_type"))
    out = log.withColumn("normalized", F.when(doc, F.trim("query")).otherwise(Q.normalized(F.col("query"))))
    norm = F.col("normalized")
    out = out.withColumn("query_type", F.when(doc, Q.mongo_type(norm)).otherwise(Q.query_type(norm)))
    out = out.withColumn("operations", F.when(doc, Q.mongo_as_operations(norm)).otherwise(Q.operations(norm)))
    return out.withColumn("safety_level", Q.safety_level(F.col("operations"), F.col("query_type")))


def risks(analysed: DataFrame) -> DataFrame:
    doc, norm = is_document_store(F.col("database_type")), F.col("normalized")
    return analysed.withColumn("risk_factors", F.when(doc, Q.mongo_risks(norm)).otherwise(Q.risk_factors(norm, F.col("operations"))))


def matched_rules(analysed: DataFrame, rules: Iterable[Q.SafetyRule] | dict[str, Iterable[Q.SafetyRule]], strict: bool = False) -> DataFrame:
    """One row per statement and matching rule, of one rule set or of several named ones."""
    sets = rules if isinstance(rules, dict) else {"": rules}
    hits = F.array_compact(
        F.array(
            *[
                F.when(
                    r.matches(F.col("normalized"), strict),
                    F.struct(
                        F.lit(name).alias("rule_set"),
                        F.lit(r.name).alias("rule_name"),
                        F.lit(r.level).alias("risk_level"),
                        F.lit(r.description).alias("description"),
                        F.lit(r.production).alias("block_in_production"),
                        F.lit(r.dev).alias("block_in_dev"),
                        F.lit(r.sandbox).alias("block_in_sandbox"),
                    ),
                )
                for name, listed in sets.items()
                for r in listed
                if r.enabled
            ]
        )
    )
    return analysed.select(*analysed.columns, F.explode(hits).alias("rule")).select(*analysed.columns, "rule.*")


def blocked_operations(analysed: DataFrame, rules: Iterable[Q.SafetyRule], strict: bool = False) -> DataFrame:
    """Operations each environment blocks because of a matching rule."""
    rules = [r for r in rules if r.enabled]

    def blocked(flag: str) -> Column:
        hits = [r.matches(F.col("normalized"), strict) for r in rules if getattr(r, flag)]
        any_hit = hits[0]
        for h in hits[1:]:
            any_hit = any_hit | h
        return F.when(any_hit, F.array_sort(F.array_distinct("operations"))).otherwise(F.array().cast("array<string>"))

    return analysed.select(
        *analysed.columns,
        blocked("production").alias("blocked_production"),
        blocked("dev").alias("blocked_dev"),
        blocked("sandbox").alias("blocked_sandbox"),
    )


def environment_permission(analysed: DataFrame) -> DataFrame:
    level = F.col("safety_level")
    return analysed.select(
        *analysed.columns,
        (level == "safe").alias("production"),
        level.isin("safe", "moderate").alias("dev"),
        (level != "critical").alias("sandbox"),
    )


def gate(analysed: DataFrame) -> DataFrame:
    """The environment's allow list, then the dangerous level."""
    env = Q.environment(F.col("database_name"), F.col("database_type"))
    refused = F.get(Q.refused_operations(env, F.col("operations")), F.lit(0))
    dangerous = F.col("safety_level") == "dangerous"
    out = analysed.withColumn("environment", env).withColumn("blocked_operation", refused)
    blocked = F.col("blocked_operation")
    return (
        out.withColumn("allowed", blocked.isNull() & ~dangerous)
        .withColumn(
            "reason",
            F.when(blocked.isNotNull(), F.concat(F.upper(blocked), F.lit(" operation not allowed in "), F.col("environment")))
            .when(dangerous, "Query marked as dangerous by analyzer")
            .otherwise("Operation approved"),
        )
        .withColumn("risk_level", F.when(blocked.isNotNull(), "HIGH").when(dangerous, "CRITICAL").otherwise("LOW"))
    )


# Fixed value: characters of a statement that a log line shows.
SHOWN_CHARACTERS = 200


def decisions(log: DataFrame, shown: int = SHOWN_CHARACTERS) -> DataFrame:
    """One decision per logged statement; ``shown_query`` is its beginning for display, ``query`` stays whole."""
    out = gate(risks(analyse(log)))
    return out.withColumn("decision", F.when(F.col("allowed"), "ALLOWED").otherwise("BLOCKED")).withColumn("shown_query", F.substring("query", 1, shown))


def write_detection(log: DataFrame) -> DataFrame:
    """Statements a read-only gate refuses, with the pattern that says so."""
    return log.withColumn("write_pattern", Q.write_pattern(F.col("query"))).withColumn("is_write", F.col("write_pattern").isNotNull())


def suspicious(log: DataFrame) -> DataFrame:
    """One review row per word for statements that are no writes."""
    kept = log.where(Q.write_pattern(F.col("query")).isNull())
    out = kept.select(*log.columns, F.explode(Q.review_words(F.col("query"))).alias("keyword"))
    return out.withColumn("status", F.lit("REVIEW")).withColumn("message", F.concat(F.lit("Contains dangerous keyword: "), F.col("keyword")))


def injections(log: DataFrame, body: str = "query") -> DataFrame:
    return log.withColumn("injection_pattern", Q.injection_pattern(F.col(body))).withColumn(
        "blocked", F.col("injection_pattern").isNotNull()
    )


def packet_writes(traffic: DataFrame) -> DataFrame:
    """Traffic rows (``port``, ``payload``) that carry a write word of their protocol."""
    return traffic.withColumn("write_word", Q.packet_word(F.col("port"), F.col("payload"))).where(F.col("write_word").isNotNull())
