"""Languages of texts as mixtures, by expectation-maximisation over n-gram likelihoods.

Training counts hashed letter n-grams per language, where the texts are read; the counts are summed and become one table of log-likelihoods, of
fixed size per language. A document is a bag of words, each with its likelihood in every language. Expectation-maximisation finds
the shares of the languages; from the best single language on, a language joins the set only if the likelihood gains more than the penalty for one more
share. The prediction is the language with the largest share.

Defined results: null texts and texts without a letter are ``und`` with score 0, as is everything if nothing could be learned; rows without a
language teach nothing; ties go to the language that sorts first; repeated rows count again; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkguard.llm.common import saved

# Places of the n-gram table, the n-grams' lengths, and what is added to every count.
BITS, ORDERS, ADDED = 16, (1, 2, 3, 4), 0.5
# A word's likelihood ratio between languages is at most this (natural log).
MOST_RATIO = 8.0
EM_STEPS, PENALTY = 8, 2.0
UNKNOWN = "und"
# Words whose numbers a task remembers, and letters of text that are read at once.
MOST_WORDS, PIECE = 300_000, 1 << 20

_WORD = re.compile(r"[^\W\d_]+")
_B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def grams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the n-grams of words, with their ends marked, and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer((" " + "  ".join(words) + " ").encode("utf-32-le"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(words)), sizes)
    places, owners, h = [], [], np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        h = h[: len(codes) - n + 1] * _B + codes[n - 1 :] + np.uint64(1)
        if n in ORDERS:
            whole = owner[: len(h)] == owner[n - 1 :]
            x = (h[whole] ^ (h[whole] >> np.uint64(29))) * _C
            places.append((x >> np.uint64(64 - BITS)).astype(np.int64))
            owners.append(owner[: len(h)][whole])
    return np.concatenate(places), np.concatenate(owners)


def words_in(text: str) -> Iterator[list[str]]:
    """Lower-case words, in lists of bounded length."""
    at = 0
    while at < len(text):
        end = min(len(text), at + PIECE)
        while end < len(text) and text[end].isalpha():
            end += 1
        yield _WORD.findall(text[at:end].lower())
        at = end


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        number = self[word] = len(self)
        return number


def train(docs: DataFrame, usable: Column, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages and their log-likelihoods of the n-grams (languages x places), from the rows where ``usable`` holds."""
    rows = docs.where(usable & F.col(f"`{lang_col}`").isNotNull() & F.col(f"`{text_col}`").isNotNull())
    read = rows.select(F.col(f"`{lang_col}`").cast("string").alias("lang"), F.col(f"`{text_col}`").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        numbers: dict[str, _Numbers] = {}
        seen: dict[str, list[np.ndarray]] = {}

        def settle(lang: str) -> None:
            n = len(numbers[lang])
            often = np.bincount(np.concatenate(seen[lang]), minlength=n)
            places, owner = grams(list(numbers[lang]))
            total[lang] = total.get(lang, 0) + np.bincount(places, often[owner], 1 << BITS)
            numbers[lang], seen[lang] = _Numbers(), []

        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                own = numbers.setdefault(lang, _Numbers())
                for words in words_in(text):
                    if words:
                        seen.setdefault(lang, []).append(np.fromiter(map(own.__getitem__, words), np.int64, len(words)))
                if len(own) > MOST_WORDS or len(seen.get(lang, ())) > 5000:
                    settle(lang)
                    own = numbers[lang]
        for lang in list(seen):
            if seen[lang]:
                settle(lang)
        for lang, counts in total.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at.astype(np.int32)), pa.array(counts[at].astype(np.int64))], ["lang", "place", "n"])

    counted = saved(read.mapInArrow(count, "lang string, place int, n long").groupBy("lang", "place").agg(F.sum("n").alias("n")), "language-counts")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().collect())
    table = np.full((len(langs), 1 << BITS), ADDED)
    for i, lang in enumerate(langs):
        found = counted.where(F.col("lang") == lang).select("place", "n").toPandas()
        table[i, found["place"]] += found["n"]
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def _shares(value: np.ndarray, starts: np.ndarray, sizes: np.ndarray, active: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Shares of the active languages per document and the log-likelihood. ``value``: likelihoods of words, scaled by their largest."""
    shares = active / active.sum(axis=1, keepdims=True)
    for _ in range(EM_STEPS):
        joint = value * np.repeat(shares, sizes, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        shares = (np.add.reduceat(joint, starts, axis=0) / sizes[:, None]).astype(np.float32)
    whole = np.log((value * np.repeat(shares, sizes, axis=0)).sum(axis=1, dtype=np.float64))
    return shares, np.add.reduceat(whole, starts)


def mixtures(likelihood: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Shares per document of the languages in its set; words x languages log-likelihoods, documents are runs of ``sizes`` words."""
    best = likelihood.max(axis=1, keepdims=True)
    value = np.exp(np.maximum(likelihood - best, -MOST_RATIO)).astype(np.float32)
    docs, langs = len(sizes), likelihood.shape[1]
    starts = np.cumsum(sizes) - sizes
    alone = np.add.reduceat(np.log(value), starts, axis=0)
    first = alone.argmax(axis=1)
    shares = np.zeros((docs, langs), np.float32)
    shares[np.arange(docs), first] = 1
    reached = alone[np.arange(docs), first].astype(np.float64)
    penalty = PENALTY * np.log(sizes + 1.0)
    left = np.flatnonzero(-reached > penalty) if langs > 1 else np.zeros(0, np.int64)  # the rest cannot gain enough
    while len(left):
        at = np.concatenate([np.arange(s, s + n) for s, n in zip(starts[left].tolist(), sizes[left].tolist(), strict=True)])
        own, n = value[at], sizes[left]
        begin = np.cumsum(n) - n
        full, _ = _shares(own, begin, n, np.ones((len(left), langs), np.float32))
        full[shares[left] > 0] = -1
        active = shares[left] > 0
        active[np.arange(len(left)), full.argmax(axis=1)] = True
        tried, gained = _shares(own, begin, n, active.astype(np.float32))
        good = gained - reached[left] > penalty[left]
        shares[left[good]], reached[left[good]] = tried[good], gained[good]
        left = left[good & (active.sum(axis=1) < langs)]
    return shares


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (the share of that language) and languages (how many are in the set); nothing is shuffled."""
    kind = docs.schema[id_col].dataType.simpleString()
    read = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    spread = docs.sparkSession.sparkContext.broadcast(table.astype(np.float32)) if langs else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, known = _Numbers(), np.zeros((0, len(langs)), np.float32)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                if len(numbers) > MOST_WORDS:
                    numbers, known = _Numbers(), known[:0]
                tokens, sizes, used = [], [], []
                for i, text in enumerate(b.column(1).to_pylist() if langs else []):
                    parts = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in words_in(text or "")]
                    n = sum(map(len, parts))
                    if n and any(c.isalpha() for c in text):  # words may be numbers of other scripts
                        tokens, sizes, used = tokens + parts, [*sizes, n], [*used, i]
                names, score, size = [UNKNOWN] * b.num_rows, np.zeros(b.num_rows), np.zeros(b.num_rows, np.int32)
                if used:
                    new = list(numbers)[len(known) :]
                    if new:
                        places, owner = grams(new)
                        fresh = np.stack([np.bincount(owner, spread.value[k][places], len(new)) for k in range(len(langs))], axis=1)
                        known = np.concatenate([known, fresh.astype(np.float32)])
                    shares = mixtures(known[np.concatenate(tokens)], np.array(sizes))
                    top = shares.argmax(axis=1)
                    score[used] = np.clip(shares[np.arange(len(used)), top], 0, 1)
                    size[used] = (shares > 0).sum(axis=1)
                    for i, k in zip(used, top.tolist(), strict=True):
                        names[i] = langs[k]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names), pa.array(score), pa.array(size)], ["doc_id", "lang_pred", "score", "languages"])

    return read.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, languages int")
