"""Counts by several columns in one pass, and small one-row summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def breakdown(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count per value of each column, and the total: grouping sets, so the rows are read once."""
    sets = [[F.col(c)] for c in columns] + [[]]
    out = df.groupingSets(sets, *[F.col(c) for c in columns]).agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"))
    # the bits of the id tell which columns a row was not grouped by
    n = len(columns)
    names = F.create_map(*[F.lit(x) for i, c in enumerate(columns) for x in (2**n - 1 - 2 ** (n - 1 - i), c)])
    dimension = F.coalesce(names[F.col("g").cast("int")], F.lit("total"))
    return out.select(dimension.alias("dimension"), F.coalesce(*columns, F.lit("all")).alias("item"), "n")


def latest(rows: DataFrame, n: int, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The ``n`` newest rows, newest first, ties by the larger ``tie``."""
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(n)


def recent_success(log: DataFrame, last: int) -> DataFrame:
    """Success among the latest entries."""
    return latest(log, last).agg(
        F.count(F.lit(1)).alias("total_queries"), F.count_if("success").alias("successful_queries"), F.count_if(~F.col("success")).alias("failed_queries")
    )


def operation_counts(analysed: DataFrame) -> DataFrame:
    return analysed.select(F.explode("operations").alias("operation")).groupBy("operation").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "operation")


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Several one-row aggregates side by side: stacked, then folded, so nothing is joined."""
    columns = [c for p in parts for c in p.columns]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in columns])
