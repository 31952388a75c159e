"""Line-oriented inputs: audit logs as JSON lines, metric lines as CSV, sandbox metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fields of the two audit shapes (gate lines and session lines), and of metric lines.
AUDIT_SCHEMA = (
    "timestamp timestamp_ntz, session_id string, type string, source string, query string, status string, message string, "
    "event_type string, user_id string, agent_id string, extra map<string,string>, _corrupt string"
)
METRIC_SCHEMA = "ts timestamp_ntz, name string, value double"
SANDBOX_SCHEMA = (
    "config struct<name string, sandbox_type string, auto_refresh boolean, refresh_hours int, auto_cleanup boolean, max_age_days int, tags array<string>>, "
    "info struct<sandbox_id bigint, state string, created_at timestamp_ntz, last_refreshed timestamp_ntz, storage_mb double, error_count int>"
)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    """Both audit shapes under one schema; broken lines keep their text in ``_corrupt``."""
    raw = spark.read.schema(AUDIT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return raw.withColumn("event_type", F.coalesce("event_type", "type")).drop("type")


def read_metric_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(METRIC_SCHEMA).option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]").csv(path)


def write_sandboxes(sandboxes: DataFrame, path: str) -> None:
    """Nested configuration and state, with null times kept."""
    config = F.struct("name", "sandbox_type", "auto_refresh", "refresh_hours", "auto_cleanup", "max_age_days", "tags").alias("config")
    info = F.struct("sandbox_id", "state", "created_at", "last_refreshed", "storage_mb", "error_count").alias("info")
    zone_free = sandboxes.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("created_at", "last_refreshed")})
    zone_free.select(config, info).write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_sandboxes(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SANDBOX_SCHEMA).json(path).select("config.*", "info.*")
