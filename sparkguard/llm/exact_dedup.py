"""Exact duplicates by counting quotient filters and byte verification.

Each partition packs the 64-bit fingerprints of its texts into counting quotient filters, one per range of leading
bits. The filters of a range merge by their sorted remainders, so only compact filters are shuffled. Only texts whose
fingerprint has a merged count above one are compared, by grouping on the bytes themselves: equal texts collapse on
the map side, so a group that holds a third of all rows costs one row per task.

Defined results: a null text is an empty one; a null id counts as larger than any other; every repeated row counts in
``group_size``; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.llm import quotient_filter as qf
from sparkguard.llm.common import SPACE, keep_rows, power_of_two, saved, shuffle_parts, text_of

# Distinct fingerprints that one merged filter is meant to hold.
SEGMENT_ROWS = 200_000


def normalized(text: str = "text") -> Column:
    """Every run of white space becomes one space."""
    return F.regexp_replace(text_of(text), SPACE, " ")


def partition_filters(fingerprints: DataFrame, bits: int) -> DataFrame:
    """One filter per partition and segment (the first ``bits`` bits) of the column ``fp``."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [b.column(0).to_numpy(zero_copy_only=False).view(np.uint64) for b in batches]
        if not parts:
            return
        fps, counts = qf.counted(np.concatenate(parts))
        segments = (fps >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(fps), np.int64)
        at = np.flatnonzero(np.r_[True, segments[1:] != segments[:-1]]) if len(fps) else []
        ends = np.r_[at[1:], len(fps)] if len(fps) else []
        rows = [(int(segments[a]), qf.build(fps[a:b], counts[a:b], bits)) for a, b in zip(at, ends, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["segment", "filter"])

    return fingerprints.select("fp").mapInArrow(build, "segment int, filter binary")


def repeated_fingerprints(fingerprints: DataFrame) -> DataFrame:
    """(fp, n) of the fingerprints that occur more than once; a group merges one bounded range of fingerprints."""
    rows = fingerprints.count()
    bits = min(24, power_of_two(max(rows // SEGMENT_ROWS, 2 * shuffle_parts(fingerprints.sparkSession))))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        fps, counts = qf.entries(qf.merge(list(pdf["filter"]), bits))
        many = counts > 1
        return pd.DataFrame({"fp": fps[many].view(np.int64), "n": counts[many]})

    return partition_filters(fingerprints, bits).groupBy("segment").applyInPandas(merge, "fp long, n long")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = docs.select(F.col(f"`{id_col}`").alias("doc_id"), normalized(f"`{text_col}`").alias("norm"))
    marked = saved(plain.select("doc_id", F.xxhash64("norm").alias("fp"), F.sha2("norm", 256).alias("text_sha256")), "exact-marks")
    repeated = saved(repeated_fingerprints(marked).select("fp"), "exact-repeated")
    suspects = plain.withColumn("fp", F.xxhash64("norm")).join(repeated, "fp", "left_semi")
    same = suspects.groupBy("norm").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = same.where(F.col("group_size") > 1).select(F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    out = marked.join(groups, "text_sha256", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return out.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without exact copies, with all their columns; of repeated rows one stays."""
    groups = saved(exact_groups(docs, id_col, text_col), "exact-groups")
    keys = [F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_digest")]
    lost = groups.where(~F.col("kept")).select(*keys)
    again = groups.where(F.col("kept") & (F.col("group_size") > 1)).groupBy(*keys).count().where(F.col("count") > 1)
    return keep_rows(docs, id_col, F.sha2(normalized(f"`{text_col}`"), 256), lost, saved(again.drop("count"), "exact-twice"))
