"""Exact positions and percentiles without putting a group into one task.

Percentiles narrow the values down: borders from a sketch, exact counts between them, then the few values around the wanted ranks.

For positions, rows are range-partitioned by key and order, so a hot key spreads over as many tasks as it needs.
Positions inside a partition plus the sizes of the partitions before it give the exact position.
The partitioned rows are checkpointed once: both steps must see the same partition borders, also after
an executor is lost.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.operators.joining import null_safe_join
from sparkguard.operators.timeslices import time_slice
from sparkguard.session import shared_dir

# Of the sketches whose borders narrow percentiles down: their relative error is one over it.
ACCURACY = 10_000


def positions(df: DataFrame, keys: list[str], order: list[str], weight: Column | None = None) -> DataFrame:
    """Adds ``before`` (weight of the rows of the same key that sort earlier) and ``total``.

    ``order`` must be unique within a key.
    """
    shared_dir(df.sparkSession)
    weighted = df.withColumn("_w", F.lit(1).cast("long") if weight is None else weight)
    placed = weighted.repartitionByRange(*keys, *order).withColumn("_g", F.struct(*keys, F.spark_partition_id().alias("_part"))).checkpoint()
    sizes = placed.groupBy("_g").agg(F.sum("_w").alias("_n"))
    whole = W.partitionBy(*[F.col(f"_g.{k}") for k in keys])
    earlier = whole.orderBy(F.col("_g._part")).rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(F.col("_g").alias("_h"), F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"), F.sum("_n").over(whole).alias("total"))
    inside = W.partitionBy("_g").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    local = placed.withColumn("_local", F.coalesce(F.sum("_w").over(inside), F.lit(0)))
    out = local.join(offsets, F.col("_g") == F.col("_h"))
    return out.select(*df.columns, (F.col("_offset") + F.col("_local")).alias("before"), "total")


def percentiles(
    df: DataFrame, keys: list[str], value: str, wanted: dict[str, float], accuracy: int = ACCURACY, discrete: bool = False
) -> DataFrame:
    """Exact percentiles, one row per key, by narrowing; nothing is sorted as a whole and no job runs before the query does.

    They interpolate linearly; if discrete, they are the value whose rank, from 1, is the share of the rows rounded up.

    A mergeable sketch per key gives borders close to the wanted ranks on either side. One scan counts what lies up to each border, so it is
    known exactly between which borders a rank falls, whatever the sketch's error. Another scan counts the distinct values between these
    borders alone, about ``len(wanted) * 6 / accuracy`` of the rows, and picks the ranks among them. Of a hot key, a task sees its share of the scan
    and, in the last step, those few values.
    """
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    around = sorted({min(1.0, max(0.0, q + d * 3 / accuracy)) for q in wanted.values() for d in (-1, 1)})
    borders = rows.groupBy(*keys).agg(F.array_sort(F.percentile_approx("_v", around, accuracy)).alias("_b"))
    n = len(around)
    upto = [F.count_if(F.col("_v") <= F.col("_b")[i]) for i in range(n)]
    counts = null_safe_join(rows, borders, keys).groupBy(*keys).agg(F.any_value("_b").alias("_b"), F.count(F.lit(1)).alias("_total"), F.array(*upto).alias("_upto"))

    def placed_rank(rank: Column, weight: Column, name: str) -> Column:
        """A rank with the bin that holds it: above border ``bin - 1`` and up to border ``bin``, where these exist. Ranks count from the bin's start."""
        at = F.size(F.filter("_upto", lambda c: c <= rank))
        return F.struct(F.lit(name).alias("name"), weight.alias("weight"), (rank - F.when(at > 0, F.get("_upto", at - 1)).otherwise(0)).alias("rank"), at.alias("bin"))

    ranks = []
    for name, q in wanted.items():
        if discrete:
            upper = F.ceil(F.col("_total") * F.lit(Decimal(str(q)))).cast("long")  # as a double, 0.07 of 100 rows would be more than 7
            ranks.append(placed_rank(F.greatest(upper - 1, F.lit(0)), F.lit(1.0), name))
            continue
        at = (F.col("_total") - 1) * F.lit(q)
        low = F.floor(at)
        share = at - low
        ranks.append(placed_rank(low, 1 - share, name))
        ranks.append(F.when(share > 0, placed_rank(low + 1, share, name)))
    asked = counts.withColumn("_ranks", F.array_compact(F.array(*ranks)))
    bins = asked.select("*", F.explode(F.array_distinct(F.transform("_ranks", lambda r: r["bin"]))).alias("_bin")).select(
        *keys, "_bin", F.filter("_ranks", lambda r: r["bin"] == F.col("_bin")).alias("_asked"),
        F.when(F.col("_bin") > 0, F.get("_b", F.col("_bin") - 1)).alias("_low"), F.when(F.col("_bin") < n, F.get("_b", F.col("_bin"))).alias("_high"),
    )
    within = (F.col("_low").isNull() | (F.col("_v") > F.col("_low"))) & (F.col("_high").isNull() | (F.col("_v") <= F.col("_high")))
    near = null_safe_join(rows, bins, keys).where(within)
    found = near.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_n"), F.any_value("_asked").alias("_asked"))
    earlier = W.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(W.unboundedPreceding, -1)
    placed = found.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))

    def part(name: str) -> Column:
        here = F.filter("_asked", lambda r: (r["name"] == name) & (r["rank"] >= F.col("_before")) & (r["rank"] < F.col("_before") + F.col("_n")))
        return F.sum(F.when(F.size(here) > 0, F.col("_v") * F.aggregate(here, F.lit(0.0), lambda a, r: a + r["weight"]))).alias(name)

    return placed.groupBy(*keys).agg(*[part(name) for name in wanted])


def newest(df: DataFrame, keys: list[str], ts: str, tie: str, n: int, slice_seconds: int = 60) -> DataFrame:
    """The ``n`` newest rows per key, ties by the larger ``tie``.

    Rows are counted per key and slice of time first, which gives the slice per key from which on there
    are ``n`` rows. Older rows are dropped before anything is ranked, so a hot key brings about ``n`` rows
    to the ranking and not its whole history.
    """
    sliced = df.withColumn("_slice", time_slice(ts, slice_seconds))
    sizes = sliced.groupBy(*keys, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    newer = W.partitionBy(*keys).orderBy(F.desc("_slice")).rowsBetween(W.unboundedPreceding, -1)
    needed = sizes.withColumn("_newer", F.coalesce(F.sum("_n").over(newer), F.lit(0))).where(F.col("_newer") < n)
    oldest = needed.groupBy(*keys).agg(F.min("_slice").alias("_oldest"))
    rough = sliced.join(oldest, keys).where(F.col("_slice") >= F.col("_oldest"))
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(F.desc(ts), F.desc(tie)))
    return rough.withColumn("_rn", rank).where(F.col("_rn") <= n).select(*df.columns)
