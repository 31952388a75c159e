"""Document fingerprints by Order MinHash, sensitive to edits and to the order of what a text says.

Every k-mer of a text is numbered by its occurrence, so repeats stay apart. For each of TUPLES orders, the LENGTH least
k-mers are taken in the order they have in the text and hashed together; the share of equal hashes of two texts estimates
their likeness and falls with their edit distance. Texts are compared with their neighbours by id: rows are range-partitioned and
sorted by id, each task walks through its rows with the next one in sight, and only the first and the last row of each task meet in a
second, small step.

Defined results: a null text is an empty one; an empty text has the fingerprint zero and is like any other empty one; a text shorter
than a k-mer is one k-mer; null ids come first; repeated ids follow in the order of their texts' digests; a single row is its own
neighbour; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.llm.common import saved, text_of

KMER, TUPLES, LENGTH = 8, 32, 2
# k-mers times orders that are held at once.
BLOCK = 1 << 18

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F))
_ORDERS = (np.random.default_rng(20_240).integers(1 << 20, 1 << 31, TUPLES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _B
    return x ^ (x >> np.uint64(29))


def numbered_kmers(text: str) -> np.ndarray:
    """Hashes of a text's k-mers, each with the number of its occurrence."""
    c = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    k = min(KMER, len(c))
    m = len(c) - k + 1 if k else 0
    h = np.zeros(m, np.uint64)
    for j in range(k):
        h *= _A
        h += c[j : j + m]
    h = _mixed(h)
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if len(same):
        first = np.ones(m, bool)
        first[same] = False
        at = np.arange(m)
        nth = at - np.maximum.accumulate(np.where(first, at, 0))
        h[order] += nth.astype(np.uint64) * _C
        h = _mixed(h)
    else:
        h = _mixed(h)
    return h


def signature(text: str) -> np.ndarray:
    """TUPLES hashes of the least k-mers in text order."""
    h = numbered_kmers(text)
    m = len(h)
    if not m:
        return np.zeros(TUPLES, np.uint32)
    small = (h >> np.uint64(32)).astype(np.uint32)
    picks = np.empty((TUPLES, min(LENGTH, m)), np.int64)
    step = max(1, BLOCK // m)
    for at in range(0, TUPLES, step):
        keys = small * _ORDERS[at : at + step]
        rows = np.arange(len(keys))
        for j in range(picks.shape[1]):
            least = keys.argmin(axis=1)
            picks[at : at + step, j] = least
            keys[rows, least] = np.uint32(0xFFFFFFFF)
    picks.sort(axis=1)
    out = np.arange(1, TUPLES + 1, dtype=np.uint64)
    for j in range(picks.shape[1]):
        out = _mixed(out * _C + h[picks[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def edited(text: str, other: str) -> str:
    """The last quarter replaced by as many characters from the start of another text."""
    n = len(text) // 4
    return text[: len(text) - n] + other[:n]


def _row(text: str, own: np.ndarray, other: str, next_sig: np.ndarray) -> tuple:
    changed = edited(text, other)
    sig = signature(changed)
    return (
        len(text), hashlib.sha256(changed.encode()).digest(), own.astype(">u4").tobytes(), sig.astype(">u4").tobytes(),
        float((own == sig).mean()), float((own == next_sig).mean()),
    )


_TYPES = [pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.float64(), pa.float64()]
_NAMES = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_SCHEMA = "n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _batch(ids: pa.Array, rows: list[tuple], more: dict[str, pa.Array]) -> pa.RecordBatch:
    columns = [pa.array([r[i] if r else None for r in rows], t) for i, t in enumerate(_TYPES)]
    return pa.RecordBatch.from_arrays([ids, *columns, *more.values()], ["doc_id", *_NAMES, *more])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per document."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text")).withColumn("digest", F.xxhash64("text"))
    ordered = read.repartitionByRange("doc_id", "digest").sortWithinPartitions("doc_id", "digest")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        held, text, own = None, "", np.zeros(0, np.uint32)

        def border(row_id: pa.Array, head: str | None, tail: str | None) -> pa.RecordBatch:
            more = {"part": pa.array([part], pa.int32()), "head": pa.array([head], pa.string()), "tail": pa.array([tail], pa.string())}
            return _batch(row_id, [()], more)

        for whole in batches:
            for at in range(0, whole.num_rows, 200):  # results leave before many have gathered
                b = whole.slice(at, 200)
                ids, rows = [], []
                for i, other in enumerate(b.column(1).to_pylist()):
                    sig = signature(other)
                    if held is None:
                        yield border(b.column(0).slice(i, 1), other, None)
                    else:
                        ids.append(held)
                        rows.append(_row(text, own, other, sig))
                    held, text, own = b.column(0).slice(i, 1), other, sig
                if rows:
                    none = {"part": pa.nulls(len(rows), pa.int32()), "head": pa.nulls(len(rows), pa.string()), "tail": pa.nulls(len(rows), pa.string())}
                    yield _batch(pa.concat_arrays(ids), rows, none)
        if held is not None:
            yield border(held, None, text)

    out = saved(ordered.select("doc_id", "text").mapInArrow(walk, f"doc_id {kind}, {_SCHEMA}, part int, head string, tail string"), "minhash")
    heads = out.where(F.col("head").isNotNull()).select("part", "head")
    places = heads.select("part", (F.row_number().over(W.orderBy("part")) - 1).alias("place"))  # one row per task
    count = places.agg(F.count(F.lit(1))).scalar()
    tails = out.where(F.col("tail").isNotNull()).select("doc_id", "part", "tail").join(places, "part").withColumn("at", (F.col("place") + 1) % count)
    last = tails.join(heads.join(places, "part").select(F.col("place").alias("at"), "head"), "at").select("doc_id", "tail", "head")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pairs = zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)
            yield _batch(b.column(0), [_row(t, signature(t), h, signature(h)) for t, h in pairs], {})

    inner = out.where(F.col("part").isNull()).drop("part", "head", "tail")
    whole = inner.unionByName(last.mapInArrow(finish, f"doc_id {kind}, {_SCHEMA}"))
    return whole.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
