"""Cost points, reports, budgets, rankings, and savings."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.operators.metrics import at

# Metric names of a cost point, months and shares of the savings rules, budget alert share.
COST_METRICS = ("cloud.cost", "cloud.daily_cost")
HOURS_PER_MONTH = 24 * 30
IDLE_CPU_PERCENT, IDLE_CPU_SAVING = 10, 0.5
COLD_DAYS, COLD_SAVING = 90, 0.7
MONTHLY_BUDGET, BUDGET_ALERT = 10_000.0, 0.80


def track(costs: DataFrame) -> DataFrame:
    """Each cost as two metric points tagged with provider, service and currency."""
    tags = F.create_map(*[x for c in ("provider", "service", "currency") for x in (F.lit(c), F.col(c))])
    return costs.select("*", F.explode(F.array(*[F.lit(n) for n in COST_METRICS])).alias("name")).select(
        *costs.columns, "name", F.col("cost").alias("value"), tags.alias("tags"), F.col("currency").alias("unit")
    )


def report(costs: DataFrame, start: dt.datetime, end: dt.datetime, by: list[str] | None = None) -> DataFrame:
    """Costs within both ends; by the given columns and day, or the detail rows."""
    inside = costs.where(F.col("ts").between(at(start), at(end)))
    if not by:
        return inside
    return inside.groupBy(*by, F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(F.sum("cost").alias("cost"))


def daily(costs: DataFrame, start: dt.datetime, end: dt.datetime) -> DataFrame:
    """Total per day; days without costs are zero."""
    totals = costs.where(F.col("ts").between(at(start), at(end))).groupBy(F.to_date("ts").alias("d")).agg(F.sum("cost").alias("cost"))
    span = (end.date() - start.date()).days + 1
    days = costs.sparkSession.range(span).select(F.date_add(F.lit(start.date()), F.col("id").cast("int")).alias("d"))
    return days.join(totals, "d", "left").select(F.col("d").cast("timestamp_ntz").alias("day"), F.coalesce("cost", F.lit(0.0)).alias("cost"))


def by_service(costs: DataFrame) -> DataFrame:
    """Sum per service and the grand total (``service`` null), largest first."""
    out = costs.rollup("service").agg(F.sum("cost").alias("cost"), F.grouping("service").cast("int").alias("is_total"))
    return out.orderBy("is_total", F.desc("cost"), "service")


def rank_services(costs: DataFrame) -> DataFrame:
    return costs.groupBy("service").agg(F.sum("cost").alias("cost")).orderBy(F.desc("cost"), "service")


def explode_response(responses: DataFrame) -> DataFrame:
    """Nested cost responses (``results`` of days with groups) to flat rows."""
    days = responses.select("*", F.explode("results").alias("day")).select("*", F.explode("day.groups").alias("g"))
    return days.select(
        *[c for c in responses.columns if c != "results"],
        F.col("day.start").alias("date"),
        F.get("g.keys", F.lit(0)).alias("service"),
        F.coalesce(F.get("g.keys", F.lit(1)), F.lit("untagged")).alias("project"),
        F.col("g.cost").cast("double").alias("cost"),
        F.coalesce(F.col("g.usage").cast("double"), F.lit(0.0)).alias("usage"),
    )


def budget(costs: DataFrame, amount: float = MONTHLY_BUDGET, share: float = BUDGET_ALERT) -> DataFrame:
    """Month-to-date spend per day against the budget. Costs are summed per day first: a month is at most 31 rows."""
    days = costs.groupBy(F.to_date("ts").alias("d")).agg(F.sum("cost").alias("cost"))
    month = W.partitionBy(F.trunc("d", "month")).orderBy("d").rowsBetween(W.unboundedPreceding, 0)
    out = days.withColumn("spent", F.sum("cost").over(month))
    return out.select(
        F.col("d").cast("timestamp_ntz").alias("day"),
        "cost",
        "spent",
        (F.col("spent") / amount * 100).alias("used_percent"),
        (F.col("spent") >= amount * share).alias("alert"),
    )


def savings(resources: DataFrame) -> DataFrame:
    """Monthly cost and possible saving per resource with an hourly price."""
    monthly = F.col("cost_per_hour") * HOURS_PER_MONTH
    idle = (F.col("resource_type") == "compute") & (F.coalesce("cpu_utilization", F.lit(100)) < IDLE_CPU_PERCENT)
    cold = (F.col("resource_type") == "storage") & (F.coalesce("last_access_days", F.lit(0)) > COLD_DAYS)
    priced = resources.where(F.col("cost_per_hour").isNotNull() & (F.col("cost_per_hour") != 0))
    return priced.select(
        "identifier",
        monthly.alias("monthly_cost"),
        F.when(idle, "downsize or terminate").when(cold, "move to cold storage").alias("action"),
        F.when(idle, "low CPU utilization").when(cold, "infrequent access").alias("reason"),
        F.when(idle, monthly * IDLE_CPU_SAVING).when(cold, monthly * COLD_SAVING).otherwise(0.0).alias("monthly_savings"),
    )


def savings_total(resources: DataFrame) -> DataFrame:
    return savings(resources).agg(
        F.sum("monthly_cost").alias("total_monthly_cost"),
        F.sum("monthly_savings").alias("potential_savings"),
        F.count("action").alias("recommendations"),
    )
