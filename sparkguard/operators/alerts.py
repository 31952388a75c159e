"""Alert evaluation, episodes and notifications.

Alert definitions are configuration: a handful of literals of the plan. They are matched to points by
series key, and the points are reduced per alert and grid time before anything is put in order.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.functions.series import key_of
from sparkguard.operators import metrics, timeslices


@dataclass(frozen=True)
class Alert:
    alert_id: str
    name: str
    metric_name: str
    threshold: float
    severity: str
    period_minutes: int = 5
    datapoints: int = 1
    operator: str = "GreaterThanThreshold"
    actions: tuple[str, ...] = ()
    tags: dict[str, str] = field(default_factory=dict)
    enabled: bool = True


# The default alerts.
DEFAULT_ALERTS = (
    Alert("high_cpu", "High CPU Usage", "system.cpu.usage", 80, "high", 5, 3, actions=("email", "slack")),
    Alert("high_memory", "High Memory Usage", "system.memory.usage", 90, "high", 5, 3, actions=("email", "slack")),
    Alert("disk_space", "Low Disk Space", "system.disk.free_percent", 10, "critical", 10, 2, "LessThanThreshold", ("email", "pagerduty")),
    Alert("error_rate", "High Error Rate", "application.error_rate", 5, "high", 5, 2, actions=("email", "slack")),
    Alert("response_time", "Slow Response Time", "application.response_time", 1000, "medium", 5, 3, actions=("email",)),
    Alert("cost_anomaly", "Cost Anomaly Detected", "cloud.daily_cost", 500, "medium", 1440, 1, actions=("email",)),
)
# How often alerts are evaluated, and the operators that can breach.
EVALUATION_SECONDS = 30
OPERATORS = {
    "GreaterThanThreshold": lambda v, t: v > t,
    "LessThanThreshold": lambda v, t: v < t,
    "GreaterThanOrEqualToThreshold": lambda v, t: v >= t,
    "LessThanOrEqualToThreshold": lambda v, t: v <= t,
}


def alert_table(spark: SparkSession, alerts: tuple[Alert, ...]) -> DataFrame:
    rows = [
        (a.alert_id, a.name, key_of(a.metric_name, a.tags), float(a.threshold), a.severity, a.operator, a.datapoints, list(a.actions), a.enabled)
        for a in alerts
    ]
    schema = "alert_id string, name string, series_key string, threshold double, severity string, operator string, datapoints int, actions array<string>, enabled boolean"
    return spark.createDataFrame(rows, schema)


def _matches(alert: Alert, tag_match: str) -> Column:
    if tag_match == "exact":
        return F.col("series_key") == key_of(alert.metric_name, alert.tags)
    hit = F.col("name") == alert.metric_name
    for k, v in alert.tags.items():
        hit = hit & (F.col("tags")[k] == v)
    return hit


def _breach(alert: Alert) -> Column:
    test = OPERATORS.get(alert.operator)
    return test(F.col("value"), F.lit(float(alert.threshold))) if test else F.lit(False)


def alert_points(points: DataFrame, alerts: tuple[Alert, ...], tag_match: str = "exact") -> DataFrame:
    """Each point once per enabled alert that watches its series, with its breach flag."""
    watching = F.array_compact(
        F.array(
            *[
                F.when(
                    _matches(a, tag_match),
                    F.struct(
                        F.lit(a.alert_id).alias("alert_id"),
                        F.lit(a.name).alias("alert_name"),
                        F.lit(a.severity).alias("severity"),
                        F.lit(a.operator).alias("operator"),
                        F.lit(float(a.threshold)).alias("threshold"),
                        F.lit(a.datapoints).alias("datapoints"),
                        F.lit(a.period_minutes * 60).alias("period"),
                        F.array(*[F.lit(x) for x in a.actions]).cast("array<string>").alias("actions"),
                        F.coalesce(_breach(a), F.lit(False)).alias("breach"),
                    ),
                )
                for a in alerts
                if a.enabled
            ]
        )
    )
    return points.select("*", F.explode(watching).alias("a")).select(*points.columns, "a.*")


_ALERT = ["alert_id", "alert_name", "severity", "operator", "threshold", "datapoints"]


def _state(breaches: Column, datapoints: Column) -> Column:
    return F.when(breaches >= datapoints, "firing").otherwise("ok")


def number(value: Column) -> Column:
    """A number in a message, with at least one decimal."""
    text = F.regexp_replace(value.cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(text.endswith("."), F.concat(text, F.lit("0"))).otherwise(text)


def _message() -> Column:
    return F.concat(
        F.col("alert_name"), F.lit(": "), number(F.col("current_value")), F.lit(" "), F.col("operator"), F.lit(" "), number(F.col("threshold"))
    )


def evaluate(
    points: DataFrame, alerts: tuple[Alert, ...], as_of: dt.datetime, id_column: str = "point_id", tag_match: str = "exact"
) -> DataFrame:
    """State of each alert at ``as_of``; an alert without points in its period has no row."""
    watched = alert_points(points, alerts, tag_match)
    start = timeslices.micros(metrics.at(as_of)) - F.col("period").cast("long") * 1_000_000
    ts = timeslices.micros(F.col("ts"))
    inside = watched.where((ts >= start) & (ts <= timeslices.micros(metrics.at(as_of))))
    out = inside.groupBy(*_ALERT, "actions").agg(
        F.count(F.lit(1)).alias("points"),
        F.count_if("breach").alias("breaches"),
        F.max_by("value", F.struct("ts", id_column)).alias("current_value"),
    )
    return out.withColumn("state", _state(F.col("breaches"), F.col("datapoints"))).withColumn("message", _message())


def grid_spans(
    points: DataFrame,
    alerts: tuple[Alert, ...],
    step: int = EVALUATION_SECONDS,
    id_column: str = "point_id",
    tag_match: str = "exact",
) -> DataFrame:
    """State of each alert over spans of grid times that see the same points. Grid times without points in the period are in no span.

    A point enters an alert's look-back at one grid time and leaves it at another. Both changes are summed up per alert and grid time
    before anything is put in order, so a point is two changes however long the period is. Running sums over the changes give the
    state, which lasts until the next change; the latest point so far is the latest in the period, if any is.
    """
    watched = alert_points(points, alerts, tag_match)
    first, last = timeslices.first_and_last_slot(step, F.col("period"), F.col("ts"))
    breach = F.col("breach").cast("long")
    latest = F.struct("ts", F.col(id_column).alias("id"), "value")
    enters = F.struct(first.alias("slot"), F.lit(1).alias("n"), breach.alias("b"), latest.alias("latest"))
    leaves = F.struct((last + 1).alias("slot"), F.lit(-1).alias("n"), (-breach).alias("b"), F.nullif(latest, latest).alias("latest"))
    changes = watched.where(first <= last).select(*_ALERT, F.explode(F.array(enters, leaves)).alias("c")).select(*_ALERT, "c.*")
    per_slot = changes.groupBy(*_ALERT, "slot").agg(F.sum("n").alias("n"), F.sum("b").alias("b"), F.max("latest").alias("latest"))
    by_alert = W.partitionBy("alert_id").orderBy("slot")  # a row per grid time at most
    so_far = by_alert.rowsBetween(W.unboundedPreceding, 0)
    running = per_slot.select(
        *_ALERT, "slot", F.sum("n").over(so_far).alias("points"), F.sum("b").over(so_far).alias("breaches"),
        F.max("latest").over(so_far).alias("latest"), F.lead("slot").over(by_alert).alias("until"),
    )
    spans = running.where(F.col("points") > 0)
    return spans.select(
        *_ALERT, "slot", "breaches", F.col("latest.value").alias("current_value"), _state(F.col("breaches"), F.col("datapoints")).alias("state"),
        _grid_time(F.col("slot"), step).alias("evaluated_at"), _grid_time(F.col("until") - 1, step).alias("last_at"), (F.col("until") - F.col("slot")).alias("evaluations"),
    )


def _grid_time(slot: Column, step: int) -> Column:
    return F.timestamp_seconds(slot * step).cast("timestamp_ntz")


def grid_states(
    points: DataFrame, alerts: tuple[Alert, ...], step: int = EVALUATION_SECONDS, id_column: str = "point_id", tag_match: str = "exact"
) -> DataFrame:
    """State of each alert at every grid time with points in its period: a row per evaluation."""
    spans = grid_spans(points, alerts, step, id_column, tag_match)
    every = spans.withColumn("slot", F.explode(F.sequence("slot", F.col("slot") + F.col("evaluations") - 1)))
    return every.drop("last_at", "evaluations").withColumns({"evaluated_at": _grid_time(F.col("slot"), step), "slot": F.col("slot") * step})


def episodes(spans: DataFrame) -> DataFrame:
    """Runs of firing evaluations, from spans of them: the first one fires, the next evaluation that does not resolves."""
    runs = timeslices.with_run(spans, ["alert_id"], ["evaluated_at"], "state")
    keys = [*_ALERT, "run", "state"]
    spans = runs.groupBy(*keys).agg(
        F.min("evaluated_at").alias("triggered_at"),
        F.max("last_at").alias("last_seen"),
        F.sum("evaluations").alias("evaluations"),
        F.max_by("current_value", "evaluated_at").alias("current_value"),
        F.min_by("current_value", "evaluated_at").alias("first_value"),
    )
    firing = spans.where(F.col("state") == "firing")
    ends = spans.where(F.col("state") == "ok").select("alert_id", (F.col("run") - 1).alias("run"), F.col("triggered_at").alias("resolved_at"))
    out = firing.drop("state").join(ends, ["alert_id", "run"], "left")
    return out.withColumn("state", F.when(F.col("resolved_at").isNull(), "firing").otherwise("resolved"))


def firing(spans: DataFrame, as_of: dt.datetime) -> DataFrame:
    """The episodes that have begun by ``as_of`` and are not resolved by then, from spans of evaluations; later evaluations are not looked at."""
    return episodes(spans.where(F.col("evaluated_at") <= metrics.at(as_of))).where(F.col("state") == "firing")


def notifications(instances: DataFrame, alerts: tuple[Alert, ...]) -> DataFrame:
    """One row per action when an instance fires, and one with ``_resolution`` when it resolves."""
    actions = None
    for a in alerts:
        here = F.array(*[F.lit(x) for x in a.actions]).cast("array<string>")
        actions = F.when(F.col("alert_id") == a.alert_id, here) if actions is None else actions.when(F.col("alert_id") == a.alert_id, here)
    fired = F.struct(F.lit("").alias("suffix"), F.col("triggered_at").alias("at"))
    resolved = F.struct(F.lit("_resolution").alias("suffix"), F.col("resolved_at").alias("at"))
    events = F.when(F.col("resolved_at").isNotNull(), F.array(fired, resolved)).otherwise(F.array(fired))
    out = instances.withColumn("action", F.explode(actions)).withColumn("e", F.explode(events))
    return out.select("alert_id", "triggered_at", F.concat("action", F.col("e.suffix")).alias("handler"), F.col("e.at").alias("sent_at"))


def failure_runs(checks: DataFrame, keys: list[str], id_column: str, at_least: int) -> DataFrame:
    """Runs of at least ``at_least`` failures (``value`` 0) in a row."""
    runs = timeslices.with_run(checks, keys, ["ts", id_column], "value")
    out = runs.where(F.col("value") == 0).groupBy(*keys, "run").agg(
        F.count(F.lit(1)).alias("failures"), F.min("ts").alias("first_failure"), F.max("ts").alias("last_failure")
    )
    return out.where(F.col("failures") >= at_least).drop("run")
