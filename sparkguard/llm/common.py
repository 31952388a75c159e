"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkguard.session import shared_dir

# Fixed value: the white space that separates words.
SPACE = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def saved(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(name: str = "text") -> Column:
    """A null text counts as an empty one."""
    return F.coalesce(F.col(name), F.lit(""))


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id's decimal text, modulo ``parts``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def power_of_two(n: int) -> int:
    """Bits of the smallest power of two that is not below ``n``."""
    return max(0, (max(1, int(n)) - 1).bit_length())


def fresh(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` is called that."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def one_of_each(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least in all its columns; equal rows are merged before they are shuffled."""
    columns = [f"`{c}`" for c in df.columns]
    row = F.struct(*[F.col(c) for c in columns]).alias("least")
    found = df.groupBy(*[F.col(f"`{k}`") for k in keys]).agg(F.min(row).alias(fresh(df, "least_row")))
    return found.select(F.col(found.columns[-1] + ".*")).select(*[F.col(c) for c in columns])


def keep_rows(docs: DataFrame, id_col: str, digest: Column, lost: DataFrame, twice: DataFrame) -> DataFrame:
    """``docs`` without the rows whose (id, digest) is in ``lost``; of those in ``twice`` one row stays each.

    Both lists have two columns, the id and the digest, and are small against the texts.
    """
    own, key, value = (fresh(docs, x) for x in ("digest_own", "key_id", "key_digest"))
    keyed = docs.withColumn(own, digest)
    lost, twice = lost.toDF(key, value).distinct(), twice.toDF(key, value)

    def match(df: DataFrame) -> Column:
        return df[f"`{id_col}`"].eqNullSafe(F.col(key)) & (F.col(own) == F.col(value))

    kept = keyed.join(lost, match(keyed), "left_anti")
    if twice.isEmpty():
        return kept.drop(own)
    single = kept.join(twice, match(kept), "left_anti")
    return single.unionByName(one_of_each(kept.join(twice, match(kept), "left_semi"), [id_col, own])).drop(own)


_GAP = re.compile(rb"[\x20\x09-\x0D]")
# Bytes of a text that are split into words at once, so that a very long text needs little memory.
PIECE = 1 << 20


def words_of(data: bytes) -> Iterator[list[bytes]]:
    """The words of a text, in lists of bounded length."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE) if len(data) - at > PIECE else None
        end = gap.start() if gap else len(data)
        yield data[at:end].split()  # bytes split at the six ASCII blanks only
        at = end


# Bytes of texts that are Python strings at once.
SLICE = 2 << 20


def text_slices(batch: pa.RecordBatch, column: int, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in slices whose texts hold about ``limit`` bytes, however long the texts are; a longer text is a slice of its own."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at, before = 0, 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, end - at)
        at, before = end, int(ends[end - 1])


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives freed memory back: workers serve one stage after the other."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim:
            trim(0)

    return whole
