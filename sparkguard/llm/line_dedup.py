"""Repeated runs of lines by winnowing over line hashes, with DataFrame functions alone.

Lines are hashed where texts are read. A window is the fewest consecutive lines that hold MIN_WORDS words: one starts at every line (``on``), one ends at
every line (``upto``). Of each window the line with the least hash is picked, the first of equal ones. Equal windows have equal picks, so any run of
MIN_WORDS words that two places share holds a pick that both of them have: picks are guaranteed fingerprints, and there are far fewer of them than lines.

Positions are joined on the picks: what is picked at one position only can be no repeat, and its windows go no further. Around a pick that
is found elsewhere the match is extended both ways, window by window: the windows that hold the pick are compared by the hashes of all their lines, and
each place of a window but the first one in the corpus loses its lines. The shortest windows from a line on and up to a line cover every longer run, so with
them a line goes if, and only if, a run of MIN_WORDS words around it has any earlier place, whichever that is. No pairs are made: a window's places
meet as one row, counted before the shuffle, and a window that a third of all documents share is a plain join that AQE splits.

Documents come in the order of their ids, then of their texts' digests; a line without words counts as one word. Defined results: a null text is an empty one, which is a single line; null ids come last; repeated rows lose what the
first of them has; a run never reaches over the end of a text; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.llm.common import saved, text_of

# Words that a repeated run must have.
MIN_WORDS = 50


def line_rows(docs: DataFrame) -> DataFrame:
    """One row per line: row_id, doc (its order), no (its number), h, words, s (words before it)."""
    lines = F.split("text", "\n")
    words = F.greatest(F.lit(1), F.regexp_count(F.col("line"), F.lit("[^\\x20\\x09-\\x0D]+")))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("digest"), "row_id").alias("doc")
    rows = docs.select("row_id", order, F.posexplode(lines).alias("no", "line")).select("row_id", "doc", "no", F.xxhash64("line").alias("h"), words.alias("words"))
    before = F.sum("words").over(W.partitionBy("row_id").orderBy("no").rowsBetween(W.unboundedPreceding, -1))
    return saved(rows, "line-hashes").withColumn("s", F.coalesce(before, F.lit(0)))


def windows(lines: DataFrame) -> DataFrame:
    """The windows that start at a line and those that end at one and are none of the first kind: doc, no, size, key, and their pick: least and pick_no."""
    text = W.partitionBy("row_id")
    ahead, behind = text.orderBy("s").rangeBetween(0, MIN_WORDS - 1), text.orderBy(F.col("s") + F.col("words")).rangeBetween(1 - MIN_WORDS, 0)
    wide = lines.withColumns({
        "on": F.collect_list("h").over(ahead), "held": F.sum("words").over(ahead),
        "upto": F.collect_list("h").over(behind), "reached": F.sum("words").over(behind) - F.col("words"),
    })
    from_here = F.when(F.col("held") >= MIN_WORDS, F.struct("no", F.col("on").alias("run")))
    to_here = F.when(F.col("reached") >= MIN_WORDS, F.struct((F.col("no") - F.size("upto") + 1).alias("no"), F.col("upto").alias("run")))
    each = wide.select("row_id", "doc", F.explode(F.array_compact(F.array(from_here, to_here))).alias("w"))
    least = F.array_min("w.run")
    picked = F.col("w.no") + F.array_position("w.run", least).cast("int") - 1
    return each.select("row_id", "doc", "w.no", F.size("w.run").alias("size"), least.alias("least"), picked.alias("pick_no"), F.xxhash64("w.run").alias("key"))


def repeated_picks(marked: DataFrame) -> DataFrame:
    """The line hashes that are picked at two positions or more: ``least``."""
    place = F.struct("row_id", "pick_no")
    found = marked.groupBy("least").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    return found.where(F.col("a") != F.col("z")).select("least")


def repeated_runs(docs: DataFrame) -> DataFrame:
    """(row_id, a, b): numbers of the first and the last line of the windows that have an earlier place."""
    marked = saved(windows(line_rows(docs)), "line-windows")
    near = saved(marked.join(repeated_picks(marked), "least"), "line-matches")
    window = ["least", "key", "size"]
    first = near.groupBy(*window).agg(F.min(F.struct("doc", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    later = near.join(first.where(F.col("n") > 1), window).where((F.col("row_id") != F.col("first.doc.row_id")) | (F.col("no") != F.col("first.no")))
    return later.select("row_id", F.col("no").alias("a"), (F.col("no") + F.col("size") - 1).alias("b"))


def dropped_ranges(docs: DataFrame) -> DataFrame:
    """(row_id, ranges): disjoint ranges of line numbers, as many as a text has lines at most."""
    text = W.partitionBy("row_id").orderBy("a", "b")
    reach = F.max("b").over(text.rowsBetween(W.unboundedPreceding, -1))
    runs = repeated_runs(docs).distinct().withColumn("new", F.when(F.col("a") <= reach + 1, 0).otherwise(1)).withColumn("island", F.sum("new").over(text))
    whole = runs.groupBy("row_id", "island").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.groupBy("row_id").agg(F.collect_list(F.struct("a", "b")).alias("ranges"))


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text without the repeated runs, n_lines and dropped_lines; one row per document."""
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    texts = saved(read.withColumn("row_id", F.monotonically_increasing_id()), "line-texts")
    rows = texts.join(dropped_ranges(texts), "row_id", "left").withColumn("lines", F.split("text", "\n"))
    gone = F.flatten(F.transform("ranges", lambda r: F.sequence(r["a"], r["b"])))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), gone)
    rows = rows.withColumn("kept", F.when(F.col("ranges").isNotNull(), kept))
    text = F.coalesce(F.array_join(F.transform("kept", lambda i: F.col("lines")[i]), "\n"), F.col("text"))
    n = F.size("lines").cast("long")
    dropped = F.when(F.col("kept").isNull(), F.lit(0)).otherwise(n - F.size("kept")).cast("long")
    return rows.select("doc_id", text.alias("text"), n.alias("n_lines"), dropped.alias("dropped_lines"))
