"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

The n-grams are words, the first letters of words (so that inflected forms share a weight) and pairs of neighbours.

The classifier is fitted on a sample of about SAMPLE_ROWS labelled texts, drawn by a hash of their ids; their features are
computed where the texts are read and go, compressed, to one task, which learns in a fixed order and holds SAMPLE_BYTES of them at most. Each coordinate has its own rate, and L1
leaves few weights that differ from zero, at most 2**BITS. They are what every task gets.

Defined results: a null text is an empty one; an empty text scores the bias alone; null labels and labels without a document
teach nothing; labels may be numbers or booleans; a document labelled twice has the larger label; without any label every score is 0.5; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.llm.common import text_of, text_slices, tidy

# Labelled texts to learn from, and the bytes of their features, compressed, that the learner holds: beyond them no further texts are taken.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 160 << 20
BITS = 20
EPOCHS = 4
ALPHA, BETA, L1, L2 = 1.0, 1.0, 4.0, 0.1
THRESHOLD = 0.7

_WORD = re.compile(rb"[a-z\x80-\xff]+")
_MIX, _PAIR, _SKIP = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))
# Letters of a word's beginnings: inflected forms share them.
STEMS = (3, 4, 5, 6)
# Words whose hashes a task remembers.
MOST_WORDS = 120_000
# Bytes of a text that are turned into features at once.
PIECE = 1 << 20


class Words(dict):
    """Places of words in a table of the hashes of a word and of its beginnings; emptied before it grows large."""

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.zeros((1 << 16, 1 + len(STEMS)), np.uint64)

    def __missing__(self, word: bytes) -> int:
        place = len(self)
        if place == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
        chars = word.decode("utf-8", "replace")
        self.hashes[place] = [xxhash.xxh64_intdigest(word), *[xxhash.xxh64_intdigest(chars[:k], k) for k in STEMS]]
        self[word] = place
        return place

    def bounded(self) -> Words:
        """To be called between texts."""
        if len(self) > MOST_WORDS:
            self.clear()
        return self


def features(text: str, words: Words) -> Iterator[np.ndarray]:
    """Indices of a text's words, their beginnings, neighbouring pairs and pairs that skip a word, in pieces of bounded size."""
    data, at, carry = text.lower().encode(), 0, np.zeros(0, np.uint64)
    shift = np.uint64(64 - BITS)
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and (97 <= data[end] <= 122 or data[end] >= 128):
            end += 1
        found = _WORD.findall(data, at, end)
        places = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        single = words.hashes[np.unique(places)].ravel()
        h = np.concatenate([carry, words.hashes[places, 0]])
        new = len(carry)  # pairs that end before here are known already
        near = h[max(new - 1, 0) : -1] * _PAIR + h[max(new, 1) :]
        skip = h[max(new - 2, 0) : -2] * _SKIP + h[max(new, 2) :]
        yield (np.concatenate([single, near, skip]) * _MIX >> shift).astype(np.int64)
        carry, at = h[-2:], end


def packed(at: np.ndarray) -> bytes:
    """Sorted places as compressed differences."""
    return zstandard.compress(np.diff(at, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 3)


def unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.cumsum(np.ascontiguousarray(raw.T).view("<u4").ravel(), dtype=np.int64)


class Ftrl:
    """Weights and per-coordinate rates; the last place is the bias."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z, l1 = self.z[at], np.where(at == 1 << BITS, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2))

    def learn(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - label
        root = np.sqrt(self.n[at])
        self.n[at] += g * g
        self.z[at] += g - (np.sqrt(self.n[at]) - root) / ALPHA * w


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> dict[int, float]:
    """Weights that are not zero, by feature; the bias is at 2**BITS. ``labels`` holds the rows to learn from."""
    told = labels.where(F.col(f"`{label_col}`").cast("int").isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(F.col(f"`{label_col}`").cast("int")).alias("label"))
    drawn = F.pmod(F.xxhash64("_id", F.lit("toxicity")), F.lit(1 << 30))
    share = min(1.0, SAMPLE_ROWS / max(1, told.count()))
    sample = F.broadcast(told.where(drawn < int(share * (1 << 30))).select("_id", "label", drawn.alias("place")))
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), text_of(f"`{text_col}`").alias("text")).join(sample, "_id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Words()
        for whole in batches:
            for b in text_slices(whole, 2):
                rows = [packed(np.unique(np.concatenate([np.zeros(0, np.int64), *features(x, known.bounded())]))) for x in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(rows, pa.binary())], ["place", "label", "at"])

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, rows, held = Ftrl(), [], 0
        for b in batches:
            for label, at in zip(b.column(1).to_pylist(), b.column(2), strict=True):
                held += len(data := at.as_py())
                if held <= SAMPLE_BYTES or not rows:
                    rows.append((label, data))
        for _ in range(EPOCHS):
            for label, data in rows:
                model.learn(np.r_[unpacked(data), 1 << BITS], int(label > 0))
        w = model.weights(np.arange((1 << BITS) + 1))
        at = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(w[at])], ["at", "w"])

    rows = texts.select("place", "label", "text").mapInArrow(tidy(extract), "place long, label int, at binary")
    model = rows.repartition(1).sortWithinPartitions("place", "label", "at").mapInArrow(tidy(learn), "at long, w double")
    return {r["at"]: r["w"] for r in model.collect()}


def _scorer(weights: dict[int, float]):
    at, value = np.array(list(weights), np.int64), np.array(list(weights.values()))

    def score(texts: list[str | None], dense: np.ndarray, known: Words) -> np.ndarray:
        dense[at] = value
        sums = np.full(len(texts), dense[1 << BITS])
        for i, text in enumerate(texts):
            hit = [f[dense[f] != 0] for f in features(text or "", known.bounded())]
            if hit:
                sums[i] += dense[np.unique(np.concatenate(hit))].sum()
        return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))

    return score


def scores(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score, predicted) per document; nothing is shuffled."""
    score = _scorer(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, known = np.zeros((1 << BITS) + 1), Words()
        for b in (x for whole in batches for x in text_slices(whole, 1)):
            s = score(b.column(1).to_pylist(), dense, known)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    return read.mapInArrow(tidy(run), f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")


def without_toxic(docs: DataFrame, weights: dict[int, float], text_col: str = "text") -> DataFrame:
    """The documents that score below the threshold, whole rows; nothing is shuffled."""
    score, place = _scorer(weights), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, known = np.zeros((1 << BITS) + 1), Words()
        for b in (x for whole in batches for x in text_slices(whole, place)):
            yield b.filter(pa.array(score(b.column(place).to_pylist(), dense, known) < THRESHOLD))

    return docs.mapInArrow(tidy(run), docs.schema)


def learnable(labels: DataFrame, outside: Column) -> DataFrame:
    """Labels of the documents for which ``outside`` (held out) is false."""
    return labels.where(~outside)
