"""Request limits and error rates per tumbling window; the same calls serve a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values: (requests, seconds) of the gateway, the configuration and the packet filter; alert thresholds.
GATEWAY_LIMIT = (100, 60)
CONFIG_LIMIT = (1000, 60)
PACKET_LIMITS = ((5, 1), (10, 1))
ERROR_RATE = 0.05
RESPONSE_SECONDS = 5.0


def request_counts(requests: DataFrame, keys: list[str], length: str) -> DataFrame:
    timed = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed_counts(timed, keys, length)


def timed_counts(timed: DataFrame, keys: list[str], length: str) -> DataFrame:
    out = timed.groupBy(F.window("ts", length).alias("w"), *keys).agg(F.count(F.lit(1)).alias("requests"))
    return out.select(F.col("w.start").alias("window_start"), *keys, "requests")


def violations(requests: DataFrame, keys: list[str], length: str = "60 seconds", limit: int = GATEWAY_LIMIT[0]) -> DataFrame:
    counts = request_counts(requests, keys, length)
    return counts.where(F.col("requests") > limit).withColumn("over_limit", F.col("requests") - limit)


def peaks(requests: DataFrame, keys: list[str], limits: tuple[tuple[int, int], ...] = (GATEWAY_LIMIT, CONFIG_LIMIT, *PACKET_LIMITS)) -> DataFrame:
    """Busiest window and number of violations per client under each of several limits, in one pass."""
    each = F.array(*[F.struct(F.lit(n).alias("max_requests"), F.lit(s).alias("seconds")) for n, s in limits])
    spread = requests.select("ts", *keys, F.explode(each).alias("l")).select("ts", *keys, "l.*")
    slot = F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / F.col("seconds"))
    counts = spread.groupBy("max_requests", "seconds", *keys, slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy("max_requests", "seconds", *keys).agg(
        F.max("n").alias("peak"), F.count_if(F.col("n") > F.col("max_requests")).alias("violations")
    )


def error_rates(log: DataFrame, length: str) -> DataFrame:
    """Share of failed statements and mean time per window against the alert thresholds."""
    timed = log.withColumn("ts", F.col("ts").cast("timestamp"))
    out = timed.groupBy(F.window("ts", length).alias("w")).agg(
        F.count(F.lit(1)).alias("requests"), F.count_if(~F.col("success")).alias("errors"), F.avg("execution_time").alias("average")
    )
    rate = F.col("errors") / F.col("requests")
    return out.select(
        F.col("w.start").alias("window_start"),
        "requests",
        "errors",
        rate.alias("error_rate"),
        "average",
        ((rate > ERROR_RATE) | (F.col("average") > RESPONSE_SECONDS)).alias("alert"),
    )
