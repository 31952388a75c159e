"""Packing documents into sequences by linear grouping.

Texts become token pieces where they are read; only numbers go on. The large lengths are cut, in descending order, into groups of
equally many pieces, and every length counts as the largest of its group. For these few sizes the sequences are filled by
configurations: the fullest choice of sizes for the largest one left, repeated as long as it lasts. That needs the histogram
of lengths alone, which has at most one row per length. The actual pieces then take the places of their groups by rank, and the
small ones go best-fit into the room that is left, in shards of bounded size.

Defined results: a null text is an empty one, which is the end token alone; repeated rows and null ids are packed like any other; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkguard.llm.common import saved, text_of, text_slices, tidy

CAPACITY = 1024
END = 2
# Groups of equally many large pieces, and the length up to which a piece is small.
GROUPS = 512
SMALL = 340
# Sequences and small pieces that a shard of the best fit is meant to hold.
SHARD_ROWS = 2000
# Bytes of parts of texts, with their tokens, that a worker remembers, and what a part takes besides.
MOST_BYTES, PART_BYTES = 96 << 20, 200
# Letters of a text that are split into parts at once.
CHUNK = 1 << 20

# Fixed value: how a space is written in the names of byte-level tokens.
_SPACE = "\u0120"
_LATIN_END = "\u0250"
_BETWEEN = re.compile(r"\S (?=\S)")


class TokenIds:
    """Token ids of whole texts, as little-endian 32-bit numbers.

    A space before another character always starts a new token, so a text's ids are those of its parts at the spaces, and the ids
    of a part are looked up once. Texts where a space meets other white space are encoded as they are. ``ranks`` may name the same
    vocabulary as a rank file; new parts in Latin letters are then encoded by the faster library that reads it.
    """

    def __init__(self, vocabulary: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.known: dict[str, bytes | None] = {}
        self.held = 0
        tokens = self.tokenizer.get_vocab()
        self.after_space = np.zeros(max(tokens.values()) + 1, bool)
        self.after_space[[i for t, i in tokens.items() if t.startswith(_SPACE)]] = True
        self.special = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.fast = None
        if ranks:
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary

    def encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _whole(self, text: str) -> bytes:
        return np.array(self.encode(text), "<u4").tobytes()

    def _learn(self, parts: set[str]) -> None:
        """Many parts in one call: they hold no spaces themselves, so every token that starts with one starts a part."""
        known, quick, slow = self.known, [], []
        self.held += sum(map(len, parts)) * 3 + len(parts) * PART_BYTES
        for p in parts:
            if not p or p[0].isspace() or p[-1].isspace():
                known[p] = None  # its ids hang on its neighbours
            elif self.fast and max(p) < _LATIN_END and not any(x in p for x in self.special):
                quick.append(p)
            else:
                slow.append(p)
        for encode, of in ((self.fast, quick), (self.encode, slow)):
            for at in range(0, len(of), 5000):
                some = of[at : at + 5000]
                ids = np.array(encode(" " + " ".join(some)), "<u4")
                starts = np.flatnonzero(self.after_space[ids]) * 4
                data = ids.tobytes()
                for part, a, b in zip(some, starts.tolist(), [*starts[1:].tolist(), len(data)], strict=True):
                    known[part] = data[a:b]

    def _bounded(self) -> None:
        if self.held > MOST_BYTES:
            self.known.clear()
            self.held = 0

    def of(self, text: str) -> bytes:
        """The ids of a text, chunk by chunk."""
        if len(text) <= CHUNK:
            return self._of_chunk(text)
        found = []
        for chunk in chunks(text):
            self._bounded()
            found.append(self._of_chunk(chunk))
        return b"".join(found)

    def of_many(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of texts; the parts of the short ones are learned together."""
        self._bounded()
        self._learn(set().union(*(t.split(" ") for t in texts if len(t) <= CHUNK)).difference(self.known))
        yield from map(self.of, texts)

    def _of_chunk(self, text: str) -> bytes:
        known, parts = self.known, text.split(" ")
        first, last = parts[0], parts[-1]
        if len(parts) == 1 or first[-1:].isspace() or not last or last[0].isspace():
            return self._whole(text)
        try:
            inner = list(map(known.__getitem__, parts[1:]))
        except KeyError:
            self._learn(set(parts).difference(known))
            inner = list(map(known.__getitem__, parts[1:]))
        tail = inner.pop()
        if None in inner:
            return self._whole(text)
        return self._whole(first) + b"".join(inner) + (tail or self._whole(" " + last))


def chunks(text: str) -> Iterator[str]:
    """A text in chunks of about CHUNK letters, cut before a single space between other letters, where a token always starts."""
    at = 0
    while len(text) - at > CHUNK:
        cut = _BETWEEN.search(text, at + CHUNK)
        if not cut:
            break
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


_TOKENIZERS: dict[tuple[str, str | None], TokenIds] = {}


def tokenizer(vocabulary: str, ranks: str | None) -> TokenIds:
    """One per worker."""
    key = (vocabulary, ranks)
    if key not in _TOKENIZERS:
        _TOKENIZERS[key] = TokenIds(vocabulary, ranks)
    return _TOKENIZERS[key]


def pieces(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32; ``part`` and ``nth`` number the pieces of a length where they were made."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    end = np.array([END], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, made, part = tokenizer(vocabulary, ranks), np.zeros(CAPACITY + 1, np.int64), TaskContext.get().partitionId()
        for whole in batches:
            for b in text_slices(whole, 1):
                rows: list[tuple] = []
                for i, found in enumerate(ids.of_many(b.column(1).to_pylist())):
                    data = found + end
                    n, start = len(data) // 4, 0
                    length = n % CAPACITY or CAPACITY
                    while start < n:
                        rows.append((i, (start + CAPACITY - 1) // CAPACITY, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), made[length]))
                        made[length] += 1
                        start, length = start + length, CAPACITY
                source, piece, begin, length, crc, nth = zip(*rows, strict=True)
                columns = [b.column(0).take(pa.array(source)), pa.array(piece, pa.int32()), pa.array(begin, pa.int64()), pa.array(length, pa.int32())]
                columns += [pa.array(crc, pa.int64()), pa.array(np.full(len(rows), part, np.int32)), pa.array(nth, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return read.mapInArrow(tidy(cut), f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, part int, nth long")


def fullest(sizes: list[int], counts: list[int], room: int) -> dict[int, int]:
    """How many of each size fill the room best, larger ones first."""
    reach: list[tuple[int, int] | None] = [None] * (room + 1)  # (place of the size added last, sum before it)
    sums = [0]
    done = bytearray(room + 1)
    done[0] = 1
    for k, (size, count) in enumerate(zip(sizes, counts, strict=True)):
        fresh = sums
        for _ in range(min(count, room // size)):
            fresh = [s + size for s in fresh if s + size <= room and not done[s + size]]
            if not fresh:
                break
            for s in fresh:
                done[s], reach[s] = 1, (k, s - size)
            sums = sums + fresh
        if done[room]:
            break
    best, out = max(sums), {}
    while best:
        k, best = reach[best]
        out[k] = out.get(k, 0) + 1
    return out


class Plan:
    """Groups by rank (of pieces by falling length) and the places that the configurations give them."""

    def __init__(self, histogram: dict[int, int]):
        lengths = sorted((x for x in histogram if x > SMALL), reverse=True)
        number = np.array([histogram[x] for x in lengths], np.int64)
        self.before = np.zeros(CAPACITY + 1, np.int64)  # larger pieces, by length
        self.before[lengths] = np.cumsum(number) - number
        total = int(number.sum())
        self.firsts = np.unique(np.arange(min(GROUPS, total), dtype=np.int64) * total // max(1, min(GROUPS, total)))
        ends = np.cumsum(number)
        sizes = [lengths[int(np.searchsorted(ends, f, "right"))] for f in self.firsts]
        left = np.diff(np.r_[self.firsts, total]).tolist()
        self.sequences = 0
        places: list[list[tuple[int, int, int]]] = [[] for _ in sizes]  # (first place, first sequence, places per sequence)
        given = [0] * len(sizes)
        for top in range(len(sizes)):
            while left[top]:
                others = [k for k in range(top, len(sizes)) if left[k] - (k == top)]
                use = {others[k]: c for k, c in fullest([sizes[k] for k in others], [left[k] - (k == top) for k in others], CAPACITY - sizes[top]).items()}
                use[top] = use.get(top, 0) + 1
                times = min(left[k] // c for k, c in use.items())
                for k, c in use.items():
                    places[k].append((given[k], self.sequences, c))
                    given[k] += c * times
                    left[k] -= c * times
                self.sequences += times
        self.group_of = np.array([k for k, p in enumerate(places) for _ in p], np.int64)
        self.place = np.array([x for p in places for x in p], np.int64).reshape(-1, 3)
        self.start = self.firsts[self.group_of] + self.place[:, 0] if len(self.place) else np.zeros(0, np.int64)

    def sequence(self, length: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The sequences of large pieces: their ranks fall into runs of places."""
        rank = self.before[length] + nth
        run = np.searchsorted(self.start, rank, "right") - 1
        return self.place[run, 1] + (rank - self.start[run]) // self.place[run, 2]


def best_fit(room: dict[int, int], lengths: list[int]) -> tuple[list[int], int]:
    """Where each length goes: a key of ``room`` or, below zero, a new sequence (-1, -2, ...); and how many are new."""
    free: dict[int, list[int]] = {}
    for key, r in sorted(room.items()):
        if r:
            free.setdefault(r, []).append(key)
    rooms, out, new = sorted(free), [0] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[i]
        at = bisect_left(rooms, n)
        if at == len(rooms):
            new += 1
            key, r = -new, CAPACITY
        else:
            r = rooms[at]
            key = free[r].pop()
            if not free[r]:
                del free[r], rooms[at]
        out[i] = key
        if r > n:
            if r - n not in free:
                insort(rooms, r - n)
            free.setdefault(r - n, []).append(key)
    return out, new


def numbered(cut: DataFrame) -> DataFrame:
    """``nth`` counted through all parts, per length: a part's pieces follow those of the parts before it."""
    sizes = cut.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    earlier = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    begun = sizes.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begun"))
    return cut.join(begun, ["length", "part"]).withColumn("nth", F.col("nth") + F.col("begun")).drop("part", "begun")


def packed(docs: DataFrame, vocabulary: str, ranks: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    cut = saved(pieces(docs, vocabulary, ranks, id_col, text_col), "pack-pieces")
    plan = Plan({r["length"]: r["count"] for r in cut.groupBy("length").count().collect()})
    rows = numbered(cut)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            length, nth = (b.column(names.index(x)).to_numpy() for x in ("length", "nth"))
            yield pa.RecordBatch.from_arrays([*[b.column(names.index(c)) for c in columns], pa.array(plan.sequence(length, nth))], [*columns, "sequence_id"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length int, ids_crc32 long, sequence_id long"
    large = saved(rows.where(F.col("length") > SMALL).mapInArrow(place, schema), "pack-large")
    small = rows.where(F.col("length") <= SMALL)
    shards = max(1, (plan.sequences + cut.where(F.col("length") <= SMALL).count()) // SHARD_ROWS)
    room = large.groupBy("sequence_id").agg((CAPACITY - F.sum("length")).cast("int").alias("room")).where(F.col("room") > 0)
    room = room.withColumn("shard", (F.col("sequence_id") % shards).cast("int"))
    small = small.withColumn("shard", F.pmod(F.col("nth") + F.col("length"), F.lit(shards)).cast("int"))
    first_new = plan.sequences

    def fit(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        where, _ = best_fit(dict(zip(left["sequence_id"].tolist(), left["room"].tolist(), strict=True)), right["length"].tolist())
        out = right[columns].copy()
        out["sequence_id"] = np.array([k if k >= 0 else first_new + key[0] - (k + 1) * shards for k in where], np.int64)
        return out

    fitted = room.groupBy("shard").cogroup(small.groupBy("shard")).applyInPandas(fit, schema)
    order = W.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "piece", "ids_crc32").rowsBetween(W.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(order), F.lit(0))
    out = large.unionByName(fitted).withColumn("offset", offset)
    return out.select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id", "offset")
