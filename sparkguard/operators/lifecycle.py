"""Life cycle of sandboxes, sessions, objects and logs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.operators.metrics import at

# Failures that make a failed sandbox due, session extension, session limit, storage tiers, days of retention.
MAX_ERRORS = 3
MAX_EXTENSION_SECONDS = 7200
SESSIONS_PER_USER = 5
TIERS = ((365, "EXPIRE"), (90, "GLACIER"), (30, "STANDARD_IA"))
RETENTION_DAYS = {"audit": 90, "sync": 7, "metrics": 1}


def seconds_between(start: Column, end: Column) -> Column:
    return (F.unix_micros(end.cast("timestamp")) - F.unix_micros(start.cast("timestamp"))) / 1_000_000


def whole_days(start: Column, end: Column) -> Column:
    return F.floor(seconds_between(start, end) / 86_400)


def list_sandboxes(boxes: DataFrame, state: str | None = None, kind: str | None = None, tags: list[str] | None = None) -> DataFrame:
    """By state, type, and any of the tags."""
    out = boxes if state is None else boxes.where(F.col("state") == state)
    out = out if kind is None else out.where(F.col("sandbox_type") == kind)
    return out.where(F.arrays_overlap("tags", F.array(*[F.lit(x) for x in tags]))) if tags else out


def due_for_cleanup(boxes: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Too old with automatic clean-up, or failed too often."""
    old = F.col("auto_cleanup") & (whole_days(F.col("created_at"), at(as_of)) > F.col("max_age_days"))
    failed = (F.col("state") == "failed") & (F.col("error_count") > MAX_ERRORS)
    return boxes.where(old | failed).withColumn("too_old", old).withColumn("too_many_failures", failed)


def due_for_refresh(boxes: DataFrame, as_of: dt.datetime) -> DataFrame:
    since = seconds_between(F.coalesce("last_refreshed", "created_at"), at(as_of)) / 3600
    out = boxes.withColumn("hours_since_refresh", since)
    return out.where(F.col("auto_refresh") & (F.col("state") == "active") & (F.col("hours_since_refresh") >= F.col("refresh_hours")))


def expired_sessions(sessions: DataFrame, containers: DataFrame, as_of: dt.datetime) -> DataFrame:
    """Active sessions past their end, or whose container is gone or not running."""
    state = containers.select(F.col("container_id"), F.col("container_status"))
    joined = sessions.where(F.col("status") == "active").join(state, "container_id", "left")
    late = F.col("expires_at") < at(as_of)
    stopped = F.col("container_id").isNotNull() & (F.coalesce("container_status", F.lit("gone")) != "running")
    return joined.where(late | stopped).withColumn("reason", F.when(late, "expired").otherwise("container"))


def session_times(sessions: DataFrame, as_of: dt.datetime, extension: Column) -> DataFrame:
    """Seconds left, and the end after an extension counted from now."""
    left = F.greatest(F.lit(0.0), seconds_between(at(as_of), F.col("expires_at")))
    granted = F.least(extension, F.lit(MAX_EXTENSION_SECONDS))
    end = F.timestamp_micros(F.unix_micros(at(as_of).cast("timestamp")) + granted.cast("long") * 1_000_000).cast("timestamp_ntz")
    return sessions.withColumn("remaining_seconds", left).withColumn("extended_to", F.when(F.col("status") == "active", end))


def users_at_limit(sessions: DataFrame, limit: int = SESSIONS_PER_USER) -> DataFrame:
    active = sessions.where(F.col("status") == "active").groupBy("user_id").agg(F.count(F.lit(1)).alias("active_sessions"))
    return active.where(F.col("active_sessions") >= limit)


def container_usage(stats: DataFrame) -> DataFrame:
    """CPU and memory per cent from two consecutive readings; missing readings count as zero."""
    cpu = F.col("cpu.total") - F.col("precpu.total")
    system = F.col("cpu.system") - F.col("precpu.system")
    usage, limit = F.coalesce("memory.usage", F.lit(0)), F.coalesce("memory.limit", F.lit(1))
    return stats.withColumn("cpu_percent", F.coalesce(F.when(system > 0, F.round(cpu / system * 100, 2)), F.lit(0.0))).withColumn(
        "memory_percent", F.when(limit != 0, F.round(usage / limit * 100, 2)).otherwise(0.0)
    )


def storage_tier(objects: DataFrame, ts: str, as_of: dt.datetime) -> DataFrame:
    age = F.datediff(at(as_of), F.col(ts))
    tier = F.lit("STANDARD")
    for days, name in reversed(TIERS):
        tier = F.when(age >= days, name).otherwise(tier)
    return objects.withColumn("age_days", age).withColumn("tier", tier)


def retained(rows: DataFrame, ts: str, as_of: dt.datetime, days: int) -> DataFrame:
    """A plain comparison on the time column, so that it prunes partitions and row groups."""
    return rows.where(F.col(ts) > at(as_of - dt.timedelta(days=days)))


def audit_between(
    audit: DataFrame, start: dt.datetime | None = None, end: dt.datetime | None = None, types: list[str] | None = None
) -> DataFrame:
    """Both ends included; no list means every type."""
    out = audit if start is None else audit.where(F.col("ts") >= at(start))
    out = out if end is None else out.where(F.col("ts") <= at(end))
    return out.where(F.col("type").isin(types)) if types else out


def connection_sessions(audit: DataFrame) -> DataFrame:
    """One row per session: its connection, disconnection, duration, statements and blocked statements."""
    kind = F.col("type")
    out = audit.groupBy("session_id").agg(
        F.min(F.when(kind == "CONNECTION", F.col("ts"))).alias("started_at"),
        F.max(F.when(kind == "DISCONNECTION", F.col("ts"))).alias("ended_at"),
        F.count_if(kind == "QUERY").alias("queries"),
        F.count_if(kind == "BLOCKED").alias("blocked"),
    )
    ended = F.when(F.col("ended_at") >= F.col("started_at"), F.col("ended_at"))
    out = out.where(F.col("started_at").isNotNull()).withColumn("ended_at", ended)
    return out.withColumn("duration_seconds", seconds_between(F.col("started_at"), F.col("ended_at")))
