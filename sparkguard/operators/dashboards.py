"""All widgets of a dashboard in one job."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.operators import metrics, ranking
from sparkguard.operators.joining import null_safe_join

# The time ranges a dashboard can ask for; anything else is an hour.
TIME_RANGES = {
    "1h": dt.timedelta(hours=1),
    "6h": dt.timedelta(hours=6),
    "24h": dt.timedelta(hours=24),
    "7d": dt.timedelta(days=7),
    "30d": dt.timedelta(days=30),
}


@dataclass(frozen=True)
class Widget:
    title: str
    kind: str
    series_key: str
    label: str = ""
    stat: str = "avg"
    low: float = 0.0
    high: float = 100.0


def dashboard_data(
    points: DataFrame, widgets: list[Widget], time_range: str, as_of: dt.datetime, lookback: int = metrics.LOOKBACK_SECONDS
) -> DataFrame:
    """Rows ``title, kind, label, ts, value, low, high``.

    Line and area widgets give the points of the time range; gauges give the average with the widget's
    bounds, stat widgets the chosen statistic, both over the look-back. No data counts as zero.
    """
    span = TIME_RANGES.get(time_range, TIME_RANGES["1h"])
    spark = points.sparkSession
    lines = [w for w in widgets if w.kind in ("line_chart", "area_chart")]
    singles = [w for w in widgets if w.kind in ("gauge", "stat")]
    out = None
    if lines:
        held = F.array_compact(
            F.array(
                *[
                    F.when(
                        F.col("series_key") == w.series_key,
                        F.struct(
                            F.lit(w.title).alias("title"), F.lit(w.kind).alias("kind"), F.lit(w.label or w.series_key).alias("label")
                        ),
                    )
                    for w in lines
                ]
            )
        )
        shown = points.where(F.col("series_key").isin([w.series_key for w in lines])).where(
            F.col("ts").between(metrics.at(as_of - span), metrics.at(as_of))
        )
        out = shown.select(F.explode(held).alias("w"), "ts", "value").select(
            "w.*", "ts", "value", F.lit(None).cast("double").alias("low"), F.lit(None).cast("double").alias("high")
        )
    if singles:
        watched = metrics.recent(points.where(F.col("series_key").isin([w.series_key for w in singles])), as_of, lookback)
        stats = watched.groupBy("series_key").agg(*metrics.basic_stats(F.col("value")))
        cuts = {w.stat: metrics.PERCENTILES[w.stat] for w in singles if w.kind == "stat" and w.stat in metrics.PERCENTILES}
        if cuts:
            stats = null_safe_join(stats, ranking.percentiles(watched.select("series_key", "value"), ["series_key"], "value", cuts), ["series_key"])
        rows = [(w.title, w.kind, w.label or w.series_key, w.series_key, float(w.low), float(w.high)) for w in singles]
        table = spark.createDataFrame(rows, "title string, kind string, label string, series_key string, low double, high double")
        value = None
        for w in singles:
            here = (F.col("title") == w.title) & (F.col("label") == (w.label or w.series_key))
            chosen = F.col("avg" if w.kind == "gauge" else w.stat).cast("double")
            value = F.when(here, chosen) if value is None else value.when(here, chosen)
        gauge = F.col("kind") == "gauge"
        joined = null_safe_join(table, stats, ["series_key"]).select(
            "title",
            "kind",
            "label",
            F.lit(None).cast("timestamp_ntz").alias("ts"),
            F.coalesce(value, F.lit(0.0)).alias("value"),
            F.when(gauge, F.col("low")).alias("low"),
            F.when(gauge, F.col("high")).alias("high"),
        )
        out = joined if out is None else out.unionByName(joined)
    return out
