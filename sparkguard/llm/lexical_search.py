"""Ranked lexical search over per-term posting lists that are blocked by the likeness of their documents.

Texts are counted where they are read; what goes on are the counts of the terms that the items of a search name. Documents stand in shards of
bounded size. Within a shard each term's posting list is clustered: some of its documents are centres, and every document joins the centre that it is
most alike to (cosine of a random projection of its term impacts). A block stores, for each term that shares an item with the list's term, the
largest impact that any of its documents has, rounded up; where more than COLUMNS terms share an item with it, those beyond have one entry together, the
largest sum that a document has of them. So the sum of a block's entries over an item's terms is never below a score in it, and a block
is passed over only when that sum, exact in whole numbers, is below the score that the 50th best document is known to have.

Lists are walked for a part of an item's terms: those left out are the ones whose largest impacts together stay below that score. A first search over
a bounded number of shards gives each item a score that at least 50 documents reach; it only makes the rest skip more. Each shard returns what may be
among an item's best, and a window ranks them. A term with a third of all rows is cut by shards, like any other.

Items are taken in blocks of about BLOCK_BYTES of text, so what a task holds of them is bounded however many there are.

Defined results: null texts have no terms, as have items without any; an item without a scoring document has no rows; repeated items are ranked
each for itself; null item ids are kept; of documents with equal scores and ids (repeated rows, null ids come last) any order is right, each is one rank;
empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from sparkguard.llm.common import saved, text_of, text_slices, tidy

BEST = 50
# Documents and counted terms of a shard at most (a document with more is a shard of its own), and shards that a task makes.
SHARD, SHARD_TERMS, TASK_SHARDS = 2048, 400_000, 4
# Documents that a block is meant to have, and blocks of a list at most (a list is no longer than a shard).
BLOCK, MOST_BLOCKS = 32, 32
# Terms that have an entry of their own in the summaries of a list.
COLUMNS = 512
# Numbers that stand for a document when lists are clustered.
SKETCH = 32
# Shards of the first search, blocks that are scored between two looks at the bounds.
FIRST_SHARDS, STEP = 8, 16
# Text of the items that are searched for at once.
BLOCK_BYTES = 4 << 20
# Bytes of a text that are split into terms at once.
PIECE = 1 << 20

# Terms are runs of [0-9A-Za-z] and of all characters beyond ASCII, with A-Z lower-cased; every other byte separates.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")


def terms_of(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, in lists of bounded length."""
    data, at = text.encode(), 0
    while at < len(data):
        gap = _GAP.search(data, at + PIECE) if len(data) - at > PIECE else None
        end = gap.start() if gap else len(data)
        yield data[at:end].translate(_FOLD).split()
        at = end


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _commonest(lists: list[np.ndarray]) -> np.ndarray:
    """The COLUMNS numbers that most lists have, sorted."""
    found, times = np.unique(np.concatenate(lists), return_counts=True)
    return np.sort(found[np.argsort(-times, kind="stable")[:COLUMNS]]).astype(np.int32)


@dataclass
class Items:
    """A block of items: their ids, the indices of their terms, and for each term those of the terms sharing an item with it that summaries have (sorted)."""

    ids: list
    terms: dict[bytes, int]
    of: list[np.ndarray]
    beside: list[np.ndarray]

    @classmethod
    def read(cls, rows: list) -> Items:
        terms: dict[bytes, int] = {}
        of = [np.array(sorted({terms.setdefault(t, len(terms)) for some in terms_of(r["text"]) for t in some}), np.int64) for r in rows]
        near: list[list[np.ndarray]] = [[] for _ in terms]
        for found in of:
            for t in found:
                near[t].append(found[:COLUMNS])
        return cls([r["item_id"] for r in rows], terms, of, [_commonest(x) for x in near])


def counted(docs: DataFrame, items: Items, id_col: str, text_col: str) -> DataFrame:
    """A row per document that has a term of the items: doc_id, n (all its terms), terms, counts. Each task adds a row, the only one
    with ``docs``: the terms and documents that it has read, and the document frequencies of the items' terms in them."""
    kind = docs.schema[id_col].dataType
    known, arrow = items.terms, to_arrow_type(kind)
    names = ["doc_id", "n", "docs", "terms", "counts"]

    def rows(ids: pa.Array, *columns: list) -> pa.RecordBatch:
        types = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(columns, types, strict=True)]], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, all_terms, all_docs = np.zeros(len(known), np.int64), 0, 0
        for whole in batches:
            for b in text_slices(whole, 1):
                kept, ns, terms, counts = [], [], [], []
                for i, text in enumerate(b.column(1)):
                    n, found = 0, Counter()
                    for some in terms_of(text.as_py()):
                        n += len(some)
                        found.update(filter(known.__contains__, some))
                    all_terms, all_docs = all_terms + n, all_docs + (n > 0)
                    if found:
                        t = np.fromiter(map(known.__getitem__, found), np.int32, len(found))
                        df[t] += 1
                        kept.append(i)
                        ns.append(n)
                        terms.append(t)
                        counts.append(np.fromiter(found.values(), np.int64, len(found)))
                if kept:
                    yield rows(b.column(0).take(pa.array(kept)), ns, [None] * len(kept), terms, counts)
        seen = np.flatnonzero(df)
        yield rows(pa.nulls(1, arrow), [all_terms], [all_docs], [seen.astype(np.int32)], [df[seen]])

    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_of(f"`{text_col}`").alias("text"))
    out = read.mapInArrow(tidy(count), f"doc_id {kind.simpleString()}, n long, docs long, terms array<int>, counts array<long>")
    return saved(out, "search-counts")


@dataclass
class Corpus:
    """Documents that have terms, terms with repeats, and a weight per term."""

    docs: int
    terms: int
    weights: np.ndarray

    @classmethod
    def read(cls, counts: DataFrame, n_terms: int) -> Corpus:
        tasks = counts.where(F.col("docs").isNotNull())
        total = tasks.agg(F.sum("docs").alias("docs"), F.sum("n").alias("n")).first()
        df = tasks.select(F.explode(F.arrays_zip("terms", "counts")).alias("x")).groupBy("x.terms").agg(F.sum("x.counts").alias("df"))
        n_docs, weights = total["docs"] or 0, np.zeros(n_terms, np.int64)
        for r in df.collect():
            weights[r["terms"]] = weight(n_docs, r["df"])
        return cls(n_docs, total["n"] or 0, weights)

    def impacts(self, n: np.ndarray, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """What an occurrence of a term adds to a document's score."""
        m = 50 + (50 * n * self.docs) // self.terms
        return self.weights[terms] * ((1_000_000_000 * counts) // (1000 * counts + 20 * m))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Shard:
    """Documents with their terms' impacts, and the blocked list of each term with the blocks' summaries.

    ``first`` and ``size``: a document's entries in ``term`` and ``impact``. ``list_first``: a list's first block. ``block_first``: a block's first place in
    ``members``. ``summary``: per list a matrix in units of ``unit``, a row per block, a column per term beside the list's and one for the rest.
    """

    KINDS = {  # noqa: RUF012  what is stored, in this order
        "first": np.int64, "size": np.int64, "term": np.int32, "impact": np.int64, "lists": np.int32, "list_first": np.int32, "block_first": np.int32,
        "members": np.int16, "summary": np.uint8, "summary_first": np.int64, "unit": np.int64, "most": np.int64,
    }

    def __init__(self, parts: dict[str, np.ndarray]):
        self.__dict__ |= parts
        self.place = {t: k for k, t in enumerate(self.lists.tolist())}

    @classmethod
    def build(cls, size: np.ndarray, term: np.ndarray, impact: np.ndarray, beside: list[np.ndarray]) -> Shard:
        first = np.cumsum(size) - size
        doc = np.repeat(np.arange(len(size)), size)
        signs = np.random.default_rng(1).integers(0, 2, (len(beside), SKETCH)).astype(np.float32) * 2 - 1
        sketch = np.zeros((len(size), SKETCH), np.float32)
        total = np.zeros(len(size), np.int64)
        if (some := size > 0).any():
            sketch[some] = np.add.reduceat(signs[term] * impact[:, None].astype(np.float32), first[some])
            total[some] = np.add.reduceat(impact, first[some])
        sketch /= np.maximum(np.linalg.norm(sketch, axis=1, keepdims=True), 1e-9)
        order = np.argsort(term, kind="stable")
        ends = np.flatnonzero(np.r_[np.diff(term[order]) != 0, [True]] if len(order) else []) + 1
        lists, list_first, block_first, members, summaries, summary_first, units, most = [], [0], [0], [], [], [0], [], []
        column = np.full(len(beside), -1, np.int64)
        for a, b in zip(np.r_[0, ends[:-1]].astype(int), ends, strict=True):
            t, docs = int(term[order[a]]), doc[order[a:b]]
            top = int(impact[order[a:b]].max())
            if not top:
                continue  # it adds nothing to any score
            n = min(MOST_BLOCKS, -(-len(docs) // BLOCK))
            centres = sketch[docs[np.arange(n) * len(docs) // n]]
            block = (sketch[docs] @ centres.T).argmax(1) if n > 1 else np.zeros(len(docs), np.int64)
            turn = np.argsort(block, kind="stable")
            sizes = np.bincount(block, minlength=n)
            block = np.repeat(np.arange((sizes > 0).sum()), sizes[sizes > 0])
            docs, sizes = docs[turn], sizes[sizes > 0]
            near = beside[t]
            width = len(near) + 1
            column[near] = np.arange(len(near))
            at, of = _ranges(first[docs], size[docs]), np.repeat(np.arange(len(docs)), size[docs])
            where = column[term[at]]
            used = where >= 0
            at, of, where = at[used], of[used], where[used]
            largest = np.zeros(len(sizes) * width, np.int64)
            np.maximum.at(largest, block[of] * width + where, impact[at])
            rest = total[docs] - np.bincount(of, impact[at].astype(float), len(docs)).astype(np.int64)
            np.maximum.at(largest, block * width + len(near), rest)
            column[near] = -1
            unit = -(-int(largest.max()) // 255)
            lists.append(t)
            units.append(unit)
            most.append(top)
            members.append(docs)
            block_first += (block_first[-1] + np.cumsum(sizes)).tolist()
            list_first.append(list_first[-1] + len(sizes))
            summaries.append((-(-largest // unit)).astype(np.uint8))
            summary_first.append(summary_first[-1] + len(largest))
        join = lambda x: np.concatenate(x) if x else np.zeros(0)
        parts = [first, size, term, impact, lists, list_first, block_first, join(members), join(summaries), summary_first, units, most]
        return cls({k: np.asarray(v, kind) for (k, kind), v in zip(cls.KINDS.items(), parts, strict=True)})

    def stored(self) -> list[bytes]:
        return [getattr(self, k).tobytes() for k in self.KINDS]

    @classmethod
    def read(cls, blobs: list[bytes]) -> Shard:
        return cls({k: np.frombuffer(b, kind) for (k, kind), b in zip(cls.KINDS.items(), blobs, strict=True)})

    def scores(self, docs: np.ndarray, asked: np.ndarray) -> np.ndarray:
        at = _ranges(self.first[docs], self.size[docs])
        value = np.where(asked[self.term[at]], self.impact[at], 0)
        return np.add.reduceat(value, np.cumsum(self.size[docs]) - self.size[docs])

    def search(self, terms: np.ndarray, asked: np.ndarray, beside: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """The shard's documents that may be among the best and score ``least`` at least, with their scores. ``asked`` marks ``terms``."""
        here = sorted((int(self.most[k]), k) for t in terms.tolist() if (k := self.place.get(t)) is not None)
        sums = np.cumsum([m for m, _ in here]) if here else np.zeros(0, np.int64)
        walked = [k for _, k in here[int(np.searchsorted(sums, least, "left")) :]]
        if not walked:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        bounds, blocks = [], []
        for k in walked:
            near = beside[self.lists[k]]
            rows = self.summary[self.summary_first[k] : self.summary_first[k + 1]].reshape(-1, len(near) + 1)
            at = np.searchsorted(near, terms)
            own = at[near[np.minimum(at, len(near) - 1)] == terms]
            bounds.append((rows[:, own].sum(1, dtype=np.int64) + (rows[:, -1] if len(own) < len(terms) else 0)) * self.unit[k])
            blocks.append(np.arange(self.list_first[k], self.list_first[k + 1]))
        bound, block = np.concatenate(bounds), np.concatenate(blocks)
        turn = np.argsort(-bound, kind="stable")
        bound, block = bound[turn], block[turn]
        seen = np.zeros(len(self.size), bool)
        found, values, at = [], [], 0
        best = np.zeros(0, np.int64)
        while at < len(block) and bound[at] >= least:
            some = block[at : at + STEP][bound[at : at + STEP] >= least]
            at += STEP
            docs = np.unique(self.members[_ranges(self.block_first[some].astype(np.int64), (self.block_first[some + 1] - self.block_first[some]).astype(np.int64))]).astype(np.int64)
            docs = docs[~seen[docs]]
            if not len(docs):
                continue
            seen[docs] = True
            value = self.scores(docs, asked)
            found.append(docs)
            values.append(value)
            best = np.sort(np.r_[best, value])[-BEST:]
            if len(best) == BEST:
                least = max(least, int(best[0]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        docs, value = np.concatenate(found), np.concatenate(values)
        keep = value >= least
        return docs[keep], value[keep]


def index(counts: DataFrame, corpus: Corpus, items: Items) -> DataFrame:
    """A row per shard: its documents' ids, and what ``Shard`` stores. Counts are dealt out to tasks of a few shards each."""
    kind = counts.schema["doc_id"].dataType
    beside = items.beside

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in shards(batches):
            terms, n = b.column(2), b.column(1).to_numpy()
            size = terms.value_lengths().to_numpy().astype(np.int64)
            term, count = terms.flatten().to_numpy(), b.column(3).flatten().to_numpy()
            shard = Shard.build(size, term, corpus.impacts(np.repeat(n, size), term, count), beside)
            ids = pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0))
            yield pa.RecordBatch.from_arrays([ids, *[pa.array([x], pa.binary()) for x in shard.stored()]], ["doc_ids", *Shard.KINDS])

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        docs = terms = 0
        for b in batches:
            ends = np.cumsum(b.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))
            at = before = 0
            while at < b.num_rows:
                end = min(at + SHARD - docs, int(np.searchsorted(ends, before + SHARD_TERMS - terms, "right")))
                if end <= at and docs:  # full
                    yield pa.concat_batches(held)
                    held, docs, terms = [], 0, 0
                    continue
                end = max(end, at + 1)
                held.append(b.slice(at, end - at))
                docs, terms = docs + end - at, terms + int(ends[end - 1]) - before
                at, before = end, int(ends[end - 1])
        if held:
            yield pa.concat_batches(held)

    read = counts.where(F.col("docs").isNull()).select("doc_id", "n", "terms", "counts")
    schema = f"doc_ids array<{kind.simpleString()}>, " + ", ".join(f"{k} binary" for k in Shard.KINDS)
    spread = read.repartition(1 + corpus.docs // (SHARD * TASK_SHARDS))  # the counts are small, the work on them is not
    return saved(spread.mapInArrow(tidy(build), schema), "search-index")


def _candidates(shards: DataFrame, items: Items, item_type, least: np.ndarray, best: int) -> DataFrame:
    """item (its number), item_id, doc_id, score: each shard's documents that may be among an item's best."""
    doc_type = shards.schema["doc_ids"].dataType.elementType
    arrow, ids = to_arrow_type(item_type), items.ids
    of, beside, n_terms = items.of, items.beside, len(items.terms)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = np.zeros(n_terms, bool)
        for b in batches:
            for row in range(b.num_rows):
                doc_ids = b.column(0)[row].values
                shard = Shard.read([b.column(k + 1)[row].as_py() for k in range(len(Shard.KINDS))])
                item, docs, scores = [], [], []
                for k, terms in enumerate(of):
                    asked[terms] = True
                    found, value = shard.search(terms, asked, beside, int(least[k]))
                    asked[terms] = False
                    item.append(np.full(len(found), k, np.int32))
                    docs.append(found)
                    scores.append(value)
                number, found = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (item, docs))
                names = pa.array(ids, arrow).take(pa.array(number, pa.int32()))
                columns = [pa.array(number, pa.int32()), names, doc_ids.take(pa.array(found, pa.int64())), pa.array(np.concatenate(scores) if scores else [], pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["item", "item_id", "doc_id", "score"])

    schema = f"item int, item_id {item_type.simpleString()}, doc_id {doc_type.simpleString()}, score long"
    found = shards.mapInArrow(tidy(search), schema)
    rank = F.row_number().over(W.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", rank).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, doc_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the ``best`` documents of each item."""
    if best > BEST:
        raise ValueError(f"at most {BEST} documents an item")
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), text_of(f"`{text_col}`").alias("text"))
    item_type, doc_type = asked.schema["item_id"].dataType, docs.schema[doc_col].dataType
    size = asked.agg(F.sum(F.octet_length("text")).alias("size")).first()["size"] or 0
    parts = -(-size // BLOCK_BYTES)
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(1, parts)))
    out = []
    for k in range(parts):
        some = Items.read(asked.where(block == k).collect())
        if some.terms:
            out.append(_searched(docs, some, item_type, best, doc_col, text_col))
    schema = f"item_id {item_type.simpleString()}, rank int, doc_id {doc_type.simpleString()}, score long"
    return reduce(DataFrame.unionByName, out) if out else docs.sparkSession.createDataFrame([], schema)


def _searched(docs: DataFrame, items: Items, item_type, best: int, doc_col: str, text_col: str) -> DataFrame:
    counts = counted(docs, items, doc_col, text_col)
    corpus = Corpus.read(counts, len(items.terms))
    shards = index(counts, corpus, items)
    n = shards.count()
    # Any documents serve: what an item's 50th best of them scores, 50 documents of the whole score too. Scores of zero are no results.
    some = shards.where(F.pmod(F.xxhash64(F.element_at("doc_ids", 1), F.size("doc_ids")), F.lit(1 << 20)) < F.lit((FIRST_SHARDS << 20) // max(1, n)))
    least = np.ones(len(items.of), np.int64)
    for r in _candidates(some, items, item_type, least, best).where(F.col("rank") == best).select("item", "score").collect():
        least[r["item"]] = max(1, r["score"])
    found = _candidates(shards, items, item_type, least, best)
    return found.select("item_id", "rank", "doc_id", "score")
