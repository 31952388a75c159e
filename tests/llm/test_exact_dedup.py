from __future__ import annotations

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.samples import TEXTS, as_rows, documents, empty

from sparkguard.llm import exact_dedup
from sparkguard.llm import quotient_filter as qf

FPS = st.lists(st.one_of(st.integers(0, 2**64 - 1), st.integers(0, 40), st.integers(2**63, 2**63 + 9)), max_size=200)


def make(values):
    return qf.build(*qf.counted(np.array(values, np.uint64)))


@settings(max_examples=60, deadline=None)
@given(FPS, FPS)
def test_filters_keep_every_fingerprint_and_merge_without_loss(a, b):
    merged = qf.merge([make(a), make(b), make([])])
    want = {}
    for x in a + b:
        want[x] = want.get(x, 0) + 1
    fps, counts = qf.entries(merged)
    assert fps.tolist() == sorted(want) and counts.tolist() == [want[x] for x in sorted(want)]
    for x in [*want][:20]:
        assert qf.count(merged, x) == want[x]
    assert all(qf.count(merged, x) == want.get(x, 0) for x in (0, 1, 2**64 - 1, 12345))


def test_large_counts_and_segments():
    fps, counts = np.array([5 << 60, (5 << 60) + 1, (5 << 60) + (1 << 58)], np.uint64), np.array([1, 10**9, 2], np.int64)
    data = qf.build(fps, counts, 4)
    back = qf.entries(qf.merge([data, data], 4))
    assert back[0].tolist() == fps.tolist() and back[1].tolist() == [2, 2 * 10**9, 4]
    assert qf.count(data, 6 << 60) == 0


def plain(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in rows]
    out = []
    for (i, _, _), n in zip(rows, norm, strict=True):
        ids = [j for (j, _, _), m in zip(rows, norm, strict=True) if m == n]
        keep = min((j for j in ids if j is not None), default=None)
        out.append((i, keep, len(ids), i == keep, hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_groups_against_brute_force(spark):
    assert as_rows(exact_dedup.exact_groups(documents(spark))) == plain(TEXTS)
    assert exact_dedup.exact_groups(empty(spark)).count() == 0


def test_equal_fingerprints_of_different_texts_stay_apart(spark, monkeypatch):
    real = exact_dedup.F.xxhash64
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: real(*c) * 0)
    assert as_rows(exact_dedup.exact_groups(documents(spark))) == plain(TEXTS)


def test_one_row_of_each_group_stays(spark):
    docs = documents(spark)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in kept.collect()]
    assert sorted(norm) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t, _ in TEXTS})
    assert exact_dedup.drop_copies(empty(spark)).count() == 0


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(i, "same text" if i % 3 == 0 else f"text {i}", "a") for i in range(900)]
    out = exact_dedup.exact_groups(documents(spark, rows)).collect()
    assert {r.keep_id for r in out if r.doc_id % 3 == 0} == {0} and sum(r.kept for r in out) == 601
