"""Near duplicates by SimHash fingerprints and a hierarchical index in Gray order.

Texts are reduced to 64-bit fingerprints where they are read; equal fingerprints are one code from then on. Two codes
that differ in at most two bits agree on at least one of three blocks of bits. For each block the codes are rotated so that it
leads, sorted by Gray rank and cut into ranges of about equal size. A range is one task: it builds the index of its codes and links
them. Codes that share the leading block with later ranges (a hot block) also visit those, unless the bits that all codes of
the range share already differ too much. A task returns a spanning forest of its links, never its pairs; the forests meet in
connected components.

Defined results: a null text is an empty one; texts without words have fingerprint zero and link like any other; a null id never
is a component's id unless all its ids are null; repeated rows share their component; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.llm import gray_index
from sparkguard.llm.common import keep_rows, saved, shuffle_parts, text_of, text_slices, tidy, words_of
from sparkguard.llm.components import components

SHINGLE = 3
RADIUS = 2
# Fixed value: the seed of the shingle hash.
SEED = 42
# Bits of the blocks, one more than may differ.
BLOCKS = (22, 21, 21)
# Codes that a range is meant to hold.
RANGE_CODES = 32_768
# Codes per range that set the borders; the only codes that reach the driver.
PICKS = 8


def simhash(data: bytes) -> int:
    """Majority bits of the hashes of a text's shingles."""
    sums, n, carry, any_words = np.zeros(64, np.int64), 0, [], []
    digest = xxhash.xxh64_intdigest
    for words in words_of(data.lower()):
        words = carry + words
        if len(words) < SHINGLE:
            carry = any_words = words
            continue
        joined = b" ".join(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
        ends = np.cumsum(sizes) - 1
        starts = (ends - sizes + 1)[: len(words) - SHINGLE + 1].tolist()
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)), np.uint64, len(starts))
        for at in range(0, len(hashes), 65_536):
            bits = np.unpackbits(hashes[at : at + 65_536].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            sums += bits.sum(axis=0, dtype=np.int32)
        n += len(hashes)
        carry = words[len(words) - SHINGLE + 1 :]
    if not n and any_words:
        return digest(b" ".join(any_words), SEED)
    return int(np.packbits(sums * 2 > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, row_key, fp): row_key is a digest of the text, fp the fingerprint as a signed number."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), row_key(text_col).alias("row_key"), text_of(f"`{text_col}`").cast("binary").alias("text"))

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x for whole in batches for x in text_slices(whole, 2)):
            fps = np.fromiter((simhash(x) for x in b.column(2).to_pylist()), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fps.view(np.int64))], ["doc_id", "row_key", "fp"])

    return read.mapInArrow(tidy(mark), f"doc_id {kind}, row_key long, fp long")


def row_key(text_col: str = "text") -> Column:
    return F.xxhash64(text_of(f"`{text_col}`"))


def _shifts() -> list[int]:
    return [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]


def _borders(codes: DataFrame) -> list[np.ndarray]:
    """First ranks of the ranges after the first, per rotation, from PICKS codes per range, which a hash draws."""
    n = codes.count()
    ranges = max(-(-n // RANGE_CODES), shuffle_parts(codes.sparkSession))
    picks = codes.where(F.pmod(F.xxhash64("fp"), F.lit(max(1, n))) < PICKS * ranges).select("fp").toArrow()
    found = picks.column(0).to_numpy().view(np.uint64)
    out = []
    for shift in _shifts():
        ranks = np.sort(gray_index.gray_rank(gray_index.rotate(found, shift)))
        out.append(np.unique(ranks[np.arange(1, ranges) * len(ranks) // ranges]) if len(ranks) else ranks)
    return out


def _place(codes: np.ndarray, which: int, borders: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, bool]]:
    """(range, rotated code, home) for the ranges that the codes belong to or must visit."""
    code = gray_index.rotate(codes, _shifts()[which])
    rank, rest = gray_index.gray_rank(code), np.uint64(64 - BLOCKS[which])
    home = np.searchsorted(borders, rank, "right")
    yield home, code, True
    last = np.searchsorted(borders, rank | ((np.uint64(1) << rest) - np.uint64(1)), "right")
    first = gray_index.gray_code(np.r_[np.uint64(0), borders])
    # bits that all codes of a range share: the common prefix of its first and last rank
    ends = np.r_[borders - np.uint64(1), ~np.uint64(0)] if len(borders) else np.array([~np.uint64(0)])
    differ = np.r_[np.uint64(0), borders] ^ ends
    for k in (1, 2, 4, 8, 16, 32):
        differ |= differ >> np.uint64(k)
    mask = ~differ
    for step in range(1, int((last - home).max(initial=0)) + 1):
        far = np.flatnonzero(home + step <= last)
        to = home[far] + step
        near = np.bitwise_count((code[far] ^ first[to]) & mask[to]) <= RADIUS
        yield to[near], code[far][near], False


def links(codes: DataFrame) -> DataFrame:
    """A spanning forest (a, b) of the links between distinct codes in the column ``fp``."""
    borders = _borders(codes)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for which in range(len(BLOCKS)):
                for to, code, home in _place(fps, which, borders[which]):
                    n = len(to)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, which, np.int32)), pa.array(to.astype(np.int32)), pa.array(code.view(np.int64)), pa.array(np.full(n, home))], ["block", "range", "code", "home"]
                    )

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        which = int(key[0])
        lead = ((1 << BLOCKS[which]) - 1) << (64 - BLOCKS[which])
        found = gray_index.forest(pdf["code"].to_numpy().view(np.uint64), pdf["home"].to_numpy(bool), RADIUS, lead)
        a, b = (gray_index.rotate(x, 64 - _shifts()[which]).view(np.int64) for x in found)
        return pd.DataFrame({"a": a, "b": b})

    placed = codes.select("fp").mapInArrow(place, "block int, range int, code long, home boolean")
    return placed.groupBy("block", "range").applyInPandas(link, "a long, b long")


def near_groups(marked: DataFrame) -> DataFrame:
    """(fp, component_id, first_id, first_key) per code: the least id of its component, and the row of it that stays."""
    row = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row_key")
    codes = saved(marked.groupBy("fp").agg(F.min(row).alias("first")), "simhash-codes")
    roots = components(links(codes))
    placed = saved(codes.join(roots, codes.fp == roots.a, "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")
    least = placed.groupBy("root").agg(F.min("first").alias("first"))
    return placed.select("fp", "root").join(least, "root").select("fp", F.col("first.doc_id").alias("component_id"), F.col("first.row_key").alias("first_key"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (hex), component_id."""
    marked = saved(fingerprints(docs, id_col, text_col), "simhash")
    groups = near_groups(marked)
    return marked.join(groups, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component stays, the one with the least id, with all columns; of repeated rows one stays."""
    marked = saved(fingerprints(docs, id_col, text_col), "simhash")
    rows = marked.join(near_groups(marked), "fp")
    stays = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("row_key") == F.col("first_key"))
    keys = [F.col("doc_id").alias("_id"), F.col("row_key").alias("_digest")]
    told = saved(rows.select(*keys, stays.alias("stays")), "simhash-told")
    again = told.where("stays").groupBy("_id", "_digest").count().where(F.col("count") > 1).drop("count")
    return keep_rows(docs, id_col, row_key(text_col), told.where(~F.col("stays")).drop("stays"), saved(again, "simhash-twice"))
