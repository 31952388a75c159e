from __future__ import annotations

import collections
import math
import zlib

import numpy as np
import pytest
from llm.samples import TEXTS, documents, empty
from pyspark.sql import functions as F

from sparkguard.llm import brown
from sparkguard.llm.queries import QUERIES


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def expected(rows, train):
    counts = collections.Counter(w for (i, t, _) in rows if train(i) for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, t, _ in rows:
        own = tokens(t)
        out.append((i, len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("size", [50, 1_000_000])
def test_counts_and_base_score(spark, monkeypatch, size):
    monkeypatch.setattr(brown, "PACK_TOKENS", size)
    got = brown.scores(documents(spark), F.col("doc_id") % 3 != 0).collect()
    want = expected(TEXTS, lambda i: i is not None and i % 3 != 0)
    rows = sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=lambda r: repr(r[:4]))
    assert [r[:4] for r in rows] == [w[:4] for w in sorted(want, key=lambda r: repr(r[:4]))]
    assert np.allclose(sorted(r[4] for r in rows), sorted(w[4] for w in want))
    assert all(r.score < 0 for r in got)


def plain_scores(texts, train, rounds):
    """A class model kept in dictionaries: all words look for a better class in each round, then steps and words are scored."""
    k, texts = brown.CLASSES, [tokens(t) for t in texts]
    classes = {w: brown.first_class(w) for t in texts for w in t}
    learned = [t for t, yes in zip(texts, train, strict=True) if yes]
    counts = collections.Counter(w for t in learned for w in t)

    def steps():
        out = np.zeros((k, k))
        for t in learned:
            for a, b in zip([b"\n", *t], t, strict=False):
                out[classes[a], classes[b]] += 1
        return out

    for _ in range(rounds):
        at = steps()
        logs, shares = np.log(at + 0.5), np.log(at.sum(axis=0) + 0.5)
        value = {w: -n * shares for w, n in counts.items()}  # the words' own steps are not taken out first
        for t in learned:
            for a, b in zip([b"\n", *t], t, strict=False):
                value[b] = value[b] + logs[classes[a]]
            for a, b in zip(t, t[1:], strict=False):
                value[a] = value[a] + logs[:, classes[b]] - shares
        moved = {}
        for w, v in value.items():
            v -= brown.TIE * np.arange(k)
            v[classes[w]] += brown.STAY
            moved[w] = classes[w] if w == b"\n" else 1 + int(v[1:].argmax())
        classes |= moved
    at = steps()
    sizes, distinct = np.zeros(k), np.zeros(k)
    for w, n in counts.items():
        sizes[classes[w]] += n
        distinct[classes[w]] += 1
    room = sizes + brown.ADDED * (distinct + 1)
    step = np.log10((at + brown.PRIOR * room / room.sum()) / (at.sum(axis=1, keepdims=True) + brown.PRIOR))
    word = lambda w: math.log10(counts[w] + brown.ADDED) - math.log10(room[classes[w]])
    return [sum(step[classes[a], classes[b]] + word(b) for a, b in zip([b"\n", *t], t, strict=False)) for t in texts]


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_against_a_plain_class_model(spark, monkeypatch, rounds):
    """Words that occur once are exchanged like any other."""
    monkeypatch.setattr(brown, "PACK_TOKENS", 400)
    monkeypatch.setattr(brown, "ROUNDS", rounds)
    monkeypatch.setattr(brown, "STAY", 0.37)
    rng = np.random.default_rng(rounds)
    pool = [f"{rng.integers(10**6)}{e}" for e in ("an", "en", "on", "st", "ly", "ed") for _ in range(30)]
    texts = [" ".join(pool[int(x) % 180] for x in np.cumsum(rng.choice([31, 29, 60, 7], rng.integers(0, 40)))) + f" once{i}" for i in range(120)]
    rows = [(i, t, "a") for i, t in enumerate(texts)]
    got = {r.doc_id: r.score for r in brown.scores(documents(spark, rows).repartition(3), F.col("doc_id") % 5 != 0).collect()}
    want = plain_scores(texts, [i % 5 != 0 for i in range(120)], rounds)
    off = [i for i in range(120) if abs(got[i] - want[i]) > 1e-5 * abs(want[i])]
    assert not off, [(i, got[i], want[i]) for i in off[:5]] + [len(off)]


def test_packs_do_not_change_the_scores(spark, monkeypatch):
    docs = documents(spark)
    a = sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in brown.scores(docs, F.lit(True)).collect())
    monkeypatch.setattr(brown, "PACK_TOKENS", 100)
    assert sorted((str(r.doc_id), r.n_tokens, round(r.score, 6)) for r in brown.scores(docs.repartition(5), F.lit(True)).collect()) == a


def test_probabilities_of_the_next_word_sum_to_one(spark):
    """After the same start, all known words and one unknown word per class take up the whole."""
    vocabulary = [f"w{i}{e}" for i in range(6) for e in ("ab", "cd")]
    rows = [(i, " ".join(vocabulary[(i * k) % 12] for k in range(1, 9)), "a") for i in range(1, 30)]
    probes = [(1000 + k, w, "a") for k, w in enumerate(vocabulary)]
    got = {r.doc_id: r for r in brown.scores(documents(spark, rows + probes), F.col("doc_id") < 1000).collect()}
    total = sum(10 ** got[1000 + k].score for k in range(len(vocabulary)))
    assert 0 < total <= 1.0


def test_better_than_single_words(spark):
    rows = QUERIES["op9_brown_lm"](spark, "/root/testdata/sf0.1").where("held_out").agg(F.sum("score").alias("a"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert 10 ** (-rows.a / rows.n) < 0.6 * 10 ** (-rows.b / rows.n)


def test_held_out_rows(spark):
    rows = QUERIES["op9_brown_lm"](spark, "/root/testdata/sf0.001").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 10 == 0) for r in rows)


def test_nothing_to_learn(spark):
    assert brown.scores(empty(spark), F.lit(True)).count() == 0
    got = brown.scores(documents(spark), F.lit(False)).collect()
    assert len(got) == len(TEXTS) and {(r.n_known, r.train_tokens, r.base_score) for r in got} == {(0, 0, 0.0)}
