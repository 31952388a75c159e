"""Rates, ratios, changes and histogram quantiles over counters and gauges.

Rates do not extrapolate to the window's edges: the increase between samples is divided by the length
of the window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.operators.timeslices import rolling, with_previous


def increases(samples: DataFrame, keys: list[str], value: str, id_column: str) -> DataFrame:
    """Increase since the sample before; a drop is a reset and counts from zero."""
    out = with_previous(samples, keys, ["ts", id_column], [value])
    v, p = F.col(value), F.col(f"prev_{value}")
    return out.withColumn("increase", F.when(p.isNull(), 0.0).when(v < p, v.cast("double")).otherwise((v - p).cast("double"))).drop(
        f"prev_{value}"
    )


def rate(samples: DataFrame, keys: list[str], value: str, id_column: str, seconds: int = 300) -> DataFrame:
    """Per-second increase over the look-back, at every sample."""
    up = increases(samples, keys, value, id_column)
    out = rolling(up, keys, "ts", "increase", seconds, ("sum",), counted=samples)
    return out.withColumn("rate", F.col("sum") / F.lit(float(seconds))).drop("sum", "increase")


def ratio(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """``value`` of ``a`` per ``value`` of ``b`` in per cent where the labels match; null for a zero divisor."""
    left = a.withColumnRenamed("value", "a")
    right = b.withColumnRenamed("value", "b")
    joined = left.join(right, keys, "inner")
    return joined.select(*keys, (F.col("a") / F.nullif(F.col("b"), F.lit(0.0)) * 100).alias("percent"))


def changes(samples: DataFrame, keys: list[str], value: str, id_column: str, seconds: int = 3600) -> DataFrame:
    """Number of value changes within the look-back, at every sample."""
    out = with_previous(samples, keys, ["ts", id_column], [value])
    p = F.col(f"prev_{value}")
    flagged = out.withColumn("_changed", F.when(p.isNotNull() & (F.col(value) != p), 1).otherwise(0)).drop(f"prev_{value}")
    return rolling(flagged, keys, "ts", "_changed", seconds, ("sum",), counted=samples).withColumnRenamed("sum", "changes").drop("_changed")


def histogram_quantile(buckets: DataFrame, keys: list[str], quantiles: list[float]) -> DataFrame:
    """Quantiles from cumulative buckets (``le``, ``cum_count``); the last bucket is infinite.

    A group is the bucket list of one series, a fixed handful of rows.
    """
    w = W.partitionBy(*keys).orderBy("le")
    total = F.max("cum_count").over(W.partitionBy(*keys))
    ranked = buckets.select(
        *keys,
        F.col("le").cast("double").alias("le"),
        "cum_count",
        F.coalesce(F.lag("le").over(w), F.lit(0)).cast("double").alias("lower"),
        F.coalesce(F.lag("cum_count").over(w), F.lit(0)).alias("below"),
        total.alias("total"),
    )
    ranked = ranked.withColumn("q", F.explode(F.array(*[F.lit(q) for q in quantiles]))).withColumn("rank", F.col("total") * F.col("q"))
    hit = F.min_by(F.struct("le", "cum_count", "lower", "below", "rank"), "le")
    found = ranked.where(F.col("cum_count") >= F.col("rank")).groupBy(*keys, "q").agg(hit.alias("h"))
    infinite = F.col("h.le") == float("inf")
    inner = F.col("h.lower") + (F.col("h.le") - F.col("h.lower")) * (F.col("h.rank") - F.col("h.below")) / (
        F.nullif(F.col("h.cum_count") - F.col("h.below"), F.lit(0))
    )
    return found.select(*keys, "q", F.when(infinite, F.col("h.lower")).otherwise(inner).alias("quantile"))
