"""Mixing sources to target weights along a curriculum.

Every source has a weight and a schedule, the rate at which it is read over the course of training. The integral of its schedule times its
target is its cumulative demand; a document's place in its source's order, mapped back through that demand, is its position in
training, and rows are range-sorted by it. A source whose target exceeds its size is read again from the start, so a document is
read twice at most; the document on the border of the target is cut there.

A source's order is a hash of the ids, so running sums need no sampled borders: rows are summed by source and hash range first,
and only the short list of ranges is accumulated. A source with a third of all rows is as many ranges as it needs.

Defined results: a null text has size zero, and such rows are never taken; a null source is a source of its own, the last; rows without an id
are placed by their size; repeated rows are read one by one; an empty table gives an empty result. Other columns are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.llm.common import SPACE, power_of_two, saved

# Weights of the sources in code point order, repeating, and how their rates change from start to end of training.
WEIGHTS = (3, 1, 2)
SLOPES = (-0.5, 0.5, 0.0)
# Words of the mix as a share of all words, and the times that a document may be read.
SHARE, MOST = 1.5, 2
# Rows that a hash range of all rows is meant to hold.
RANGE_ROWS = 20_000


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds ``rank``, from zero in code point order, null last. Sorted by ranges; only their sizes meet in one task."""
    ordered = sources.repartitionByRange(F.col("source").isNull(), F.col("source")).withColumn("part", F.spark_partition_id())
    ordered = saved(ordered, "mix-sources")
    sizes = ordered.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("part").orderBy(F.col("source").isNull(), "source")) - 1
    return ordered.withColumn("inside", inside).join(before, "part").select("source", "source_size", (F.col("before") + F.col("inside")).alias("rank"))


def _cycled(values: tuple, rank: str = "rank") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(rank) % len(values) + 1).cast("int"))


def targets(sources: DataFrame) -> DataFrame:
    """(source, source_size) with ``target`` words and ``slope``: weights share the mix, up to MOST times a source's size."""
    ranked = saved(_ranked(sources).withColumn("w", _cycled(WEIGHTS)), "mix-ranked")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:  # each step fills at least one more source, and all that the present level overflows
        over = F.col("source_size") * MOST < F.lit(level) * F.col("w")
        row = ranked.agg(
            F.count_if(over).alias("full"),
            F.coalesce(F.sum(F.when(over, F.col("source_size") * MOST)), F.lit(0)).alias("given"),
            F.coalesce(F.sum(F.when(~over, F.col("w"))), F.lit(0)).alias("open"),
        ).first()
        if row["full"] == full or not row["open"]:
            break
        full, level = row["full"], (SHARE * total - row["given"]) / row["open"]
    target = F.least((F.col("source_size") * MOST).cast("double"), F.lit(level) * F.col("w"))
    return ranked.select("source", "source_size", target.alias("target"), _cycled(SLOPES).alias("slope"))


def _position(start: Column) -> Column:
    """Where in training the demand of a source reaches ``start`` words: the inverse of target * (slope t^2 + (1 - slope) t)."""
    u, s = start / F.col("target"), F.col("slope")
    return F.when(s == 0, u).otherwise((F.sqrt((1 - s) * (1 - s) + 4 * s * u) - (1 - s)) / (2 * s))


def mixed(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", size: Column | None = None) -> DataFrame:
    """Per row: ``row`` (a struct of all its columns), size, source_size, target, taken, and the positions of its two readings."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(own, F.col(f"`{source_col}`").alias("source"), (word_count(text_col) if size is None else size).alias("size"))
    rows = rows.withColumn("place", F.md5(F.coalesce(F.col(f"row.`{id_col}`").cast("string"), F.concat(F.lit("size "), F.col("size").cast("string")))))
    bits = min(24, max(6, power_of_two(docs.count() // RANGE_ROWS)))
    rows = rows.withColumn("range", F.shiftright(F.conv(F.substring("place", 1, 6), 16, 10).cast("int"), 24 - bits))
    ranges = saved(rows.groupBy("source", "range").agg(F.sum("size").alias("words")), "mix-ranges")
    goals = saved(targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")
    earlier = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    begun = ranges.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("begun"))
    goals = goals.withColumnRenamed("source", "g")
    begun = saved(begun.join(goals, F.col("s").eqNullSafe(F.col("g"))).drop("g"), "mix-begun")
    inside = W.partitionBy("source", "range").orderBy("place", "size", F.xxhash64("row")).rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.join(begun, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    goal, before = F.floor(F.col("target") + 0.5), F.col("begun") + F.col("inside")
    once, again = (F.greatest(F.lit(0), F.least(F.col("size"), goal - x)) for x in (before, before + F.col("source_size")))
    out = rows.withColumns({"before": before, "first_words": once, "again_words": again})
    first, second = (F.when(F.col(k) > 0, _position(x)) for k, x in (("first_words", F.col("before")), ("again_words", F.col("before") + F.col("source_size"))))
    return out.select(
        "row", "size", "source_size", "target", (F.col("first_words") + F.col("again_words")).alias("taken"),
        first.alias("position"), second.alias("again_position"), "first_words", "again_words",
    )


def mixture(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken and the positions of its readings, sorted by the first."""
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), word_count(text_col).alias("size"))
    out = mixed(saved(slim, "mix-sizes"), "doc_id", "source", size=F.col("size"))
    return out.select("row.doc_id", "size", "source_size", "target", "taken", "position", "again_position").orderBy(F.asc_nulls_last("position"), "doc_id")


def curriculum(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows to train on in the order of their positions, with the columns of ``docs``; a border document's text is cut."""
    whole = mixed(docs, id_col, source_col, text_col)
    read = F.array(*[F.struct(F.col(p).alias("at"), F.col(w).alias("words")) for p, w in (("position", "first_words"), ("again_position", "again_words"))])
    rows = whole.select("row", "size", F.explode(F.filter(read, lambda x: x["words"] > 0)).alias("read"))
    rows = rows.repartitionByRange(F.col("read.at")).sortWithinPartitions("read.at")
    text = F.col(f"row.`{text_col}`")
    words = F.split(F.trim(F.regexp_replace(text, SPACE, " ")), " ")
    cut = F.when(F.col("read.words") == F.col("size"), text).otherwise(F.array_join(F.slice(words, F.lit(1), F.col("read.words").cast("int")), " "))
    return rows.select(*[(cut if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
