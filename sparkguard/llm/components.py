"""Connected components of a table of links, by alternating stars.

A large star links all larger neighbours of a node to its least neighbour, a small star the others; after a few rounds
every node hangs on the least node of its component. Each round is written to the shared folder. A node with very many
neighbours is reduced by partial minima before the shuffle, and its join is a plain one that AQE splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkguard.llm.common import saved


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """(a, root) for every node that is not the least of its component, from links (a, b) in any direction."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where(F.col("a") != F.col("b")).distinct(), "links")
    state = _state(now)
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
        large = both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where(F.col("a") != F.col("b")).distinct(), "large-star")
        low = large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        small = large.join(low, F.col("a") == F.col("u")).where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        now = saved(small.unionByName(low.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct(), "small-star")
        before, state = state, _state(now)
        if state == before:
            return now.select("a", F.col("b").alias("root"))
