"""Ranked search against scoring every document, and the index's bounds."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.samples import documents, empty, words

from sparkguard.llm import lexical_search

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, best=50):
    counts = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts]
    n_docs, total = sum(n > 0 for _, _, n in counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    out = []
    for item, text in items:
        terms = set(TERM.findall((text or "").translate(LOWER)))
        scored = []
        for i, c, n in counts:
            s = 0
            for t in terms & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                s += w * ((10**9 * c[t]) // (1000 * c[t] + 20 * (100 - 50 + (50 * n * n_docs) // total)))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


def asked(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 2.0) for i, t in rows], "item_id long, text string, doc_id int, rank string, score double")


def result(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def corpus(seed, n):
    rng = random.Random(seed)
    pool = words(400, seed).split()
    shares = [1 / (k + 1) for k in range(len(pool))]
    copy = " ".join(rng.choices(pool, shares, k=30))
    return [(i, copy if i % 3 == 0 else " ".join(rng.choices(pool, shares, k=rng.randint(0, 120)))) for i in range(n)], pool, shares, rng


@pytest.mark.parametrize(("shard", "terms"), [(64, 400_000), (64, 30), (4096, 400_000)])
def test_against_brute_force(spark, monkeypatch, shard, terms):
    monkeypatch.setattr(lexical_search, "SHARD", shard)
    monkeypatch.setattr(lexical_search, "SHARD_TERMS", terms)
    docs, pool, shares, rng = corpus(shard, 700)
    items = [(k, " ".join(rng.choices(pool, shares, k=rng.randint(1, 60)))) for k in range(25)]
    got = result(lexical_search.search(documents(spark, [(i, t, "a") for i, t in docs]).repartition(3), asked(spark, items)))
    assert got == brute(docs, items)


def test_many_terms_beside_and_items_in_blocks(spark, monkeypatch):
    """More terms share an item than summaries have columns, and the items do not fit into one block."""
    monkeypatch.setattr(lexical_search, "COLUMNS", 7)
    monkeypatch.setattr(lexical_search, "BLOCK_BYTES", 600)
    docs, pool, shares, rng = corpus(9, 300)
    items = [(k, " ".join(rng.choices(pool, shares, k=rng.randint(1, 80)))) for k in range(12)]
    assert result(lexical_search.search(documents(spark, [(i, t, "a") for i, t in docs]), asked(spark, items))) == brute(docs, items)


def test_awkward_rows(spark):
    docs = [(1, None), (2, ""), (3, "..!"), (4, "Ünïcode ünïcode WORD"), (5, "word-word_word"), (6, words(30_000, 3) + " word"), (7, "word"), (8, "word"), (9, "KK word x")]
    items = [(1, "Word"), (2, None), (3, ""), (4, "nowhere"), (None, "ünïcode word"), (5, "ÜNÏCODE"), (6, words(3000, 3)), (7, "WORD X kK")]
    assert result(lexical_search.search(documents(spark, [(i, t, "a") for i, t in docs]), asked(spark, items))) == brute(docs, items)


def test_repeated_rows_and_items(spark):
    docs = [(1, "a b"), (1, "a b"), (None, "a b"), (2, "a c"), (3, "z"), (4, "y"), (5, "x")]
    got = result(lexical_search.search(documents(spark, [(i, t, "a") for i, t in docs]), asked(spark, [(1, "a b")])))
    assert got == brute(docs, [(1, "a b")])
    twice = result(lexical_search.search(documents(spark, [(i, t, "a") for i, t in docs]), asked(spark, [(1, "a b"), (1, "a b")])))
    assert twice == sorted(got + got, key=repr)


def test_empty_tables(spark):
    assert lexical_search.search(empty(spark), asked(spark, [(1, "a")])).count() == 0
    assert lexical_search.search(documents(spark), asked(spark, [])).count() == 0
    assert lexical_search.search(documents(spark), asked(spark, [(1, None)])).count() == 0


def test_blocks_are_skipped_and_bounds_hold():
    """No document of a block scores beyond the block's bound, and a high known score leaves most documents unscored."""
    rng = np.random.default_rng(1)
    size = rng.integers(5, 40, 1500)
    term = np.concatenate([np.sort(rng.choice(300, s, False, 1 / np.arange(2, 302) / (1 / np.arange(2, 302)).sum())) for s in size]).astype(np.int32)
    impact = rng.integers(1, 1 << 34, len(term))
    items = [np.sort(rng.choice(300, 20, False)) for _ in range(30)]
    near = [[x for x in items if t in x] for t in range(300)]
    beside = [lexical_search._commonest(x) if x else np.array([t], np.int32) for t, x in enumerate(near)]
    shard = lexical_search.Shard.read(lexical_search.Shard.build(size, term, impact, beside).stored())
    scored = []
    shard.scores = lambda docs, asked, own=shard.scores: (scored.append(len(docs)), own(docs, asked))[1]
    for terms in items:
        asked_terms = np.zeros(300, bool)
        asked_terms[terms] = True
        doc = np.repeat(np.arange(1500), size)
        want = np.bincount(doc, np.where(asked_terms[term], impact, 0).astype(float), 1500).astype(np.int64)
        least = int(np.sort(want)[-50])
        docs, values = shard.search(terms, asked_terms, beside, 1)
        assert sorted(values.tolist())[-50:] == sorted(want.tolist())[-50:] and (want[docs] == values).all()
        scored.clear()
        docs, values = shard.search(terms, asked_terms, beside, least)
        assert sorted(docs.tolist()) == np.flatnonzero(want >= least).tolist()
        assert sum(scored) < 1500
