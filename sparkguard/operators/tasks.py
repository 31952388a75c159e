"""Tasks with dependencies: readiness, results, clean-up, usage."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.operators.metrics import at


@dataclass(frozen=True)
class Limits:
    cpu_cores: float
    memory_gb: float
    disk_gb: float


# Resource limits per agent type; a type without a disk figure has the general one.
LIMITS = {
    "data_analyst": Limits(2.0, 4.0, 20.0),
    "code_generator": Limits(1.5, 3.0, 15.0),
    "security_auditor": Limits(1.0, 2.0, 10.0),
    "document_processor": Limits(1.0, 2.0, 10.0),
    "api_integrator": Limits(1.0, 2.0, 10.0),
    "test_runner": Limits(2.0, 4.0, 20.0),
}
FINISHED = ("completed", "failed", "timeout")
# Fixed value: agents that may run at once.
MOST_AGENTS = 10


def ready(tasks: DataFrame) -> DataFrame:
    """Pending tasks whose dependencies all exist and are completed."""
    pending = tasks.where(F.col("status") == "pending")
    needs = pending.select(F.col("task_id").alias("waiting"), F.explode("dependencies").alias("task_id"))
    done = tasks.where(F.col("status") == "completed").select("task_id")
    unmet = needs.join(done, "task_id", "left_anti").select("waiting").distinct()
    return pending.join(unmet, pending["task_id"] == unmet["waiting"], "left_anti")


def dependency_results(tasks: DataFrame) -> DataFrame:
    """Per task its dependencies' results as a map; the map is no longer than the task's own list."""
    needs = tasks.select("task_id", F.explode("dependencies").alias("dependency"))
    results = tasks.where(F.col("result").isNotNull()).select(F.col("task_id").alias("dependency"), F.col("result").alias("dependency_result"))
    found = needs.join(results, "dependency")
    pairs = F.array_sort(F.collect_list(F.struct("dependency", "dependency_result")))
    return found.groupBy("task_id").agg(F.map_from_entries(pairs).alias("results"))


def workflow_results(tasks: DataFrame) -> DataFrame:
    seconds = F.unix_seconds(F.col("completed_at").cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp"))
    return tasks.select("task_id", "status", "result", "error", seconds.cast("double").alias("duration"))


def due_for_cleanup(tasks: DataFrame, as_of: dt.datetime, hours: int = 24) -> DataFrame:
    return tasks.where(F.col("status").isin(*FINISHED) & (F.col("completed_at") < at(as_of - dt.timedelta(hours=hours))))


def agent_report(tasks: DataFrame, most: int = MOST_AGENTS) -> DataFrame:
    """One row: agents at work, how many may be, tasks that wait and tasks that are done."""
    status = F.col("status")
    return tasks.agg(
        F.count_if(status == "running").alias("active_agents"),
        F.lit(most).cast("long").alias("max_agents"),
        F.count_if(status == "pending").alias("queued_tasks"),
        F.count_if(status == "completed").alias("completed_tasks"),
    )


def type_usage(tasks: DataFrame, active: str = "running") -> DataFrame:
    """Active tasks per agent type with the limits of one and of all of them."""
    counts = tasks.where(F.col("status") == active).groupBy("agent_type").agg(F.count(F.lit(1)).alias("active"))

    def limit(name: str):
        cases = None
        for kind, lim in LIMITS.items():
            cases = F.when(F.col("agent_type") == kind, getattr(lim, name)) if cases is None else cases.when(F.col("agent_type") == kind, getattr(lim, name))
        return cases

    out = counts.withColumns({n: limit(n) for n in ("cpu_cores", "memory_gb", "disk_gb")})
    return out.withColumn("total_cpu_cores", F.col("active") * F.col("cpu_cores")).withColumn(
        "total_memory_gb", F.col("active") * F.col("memory_gb")
    )
