from __future__ import annotations

import hashlib

import numpy as np
import pytest
from llm.samples import TEXTS, documents, empty, words

from sparkguard.llm import order_minhash as omh


def plain_signature(text):
    """The least numbered k-mers of every order, one by one."""
    h = omh.numbered_kmers(text)
    if not len(h):
        return [0] * omh.TUPLES
    out = []
    for j, order in enumerate(omh._ORDERS[:, 0].tolist()):
        keys = [((int(x) >> 32) * order) & 0xFFFFFFFF for x in h]
        least = sorted(sorted(range(len(h)), key=lambda i: (keys[i], i))[: omh.LENGTH])
        value = np.array([j + 1], np.uint64)
        for i in least:
            value = omh._mixed(value * omh._C + h[i])
        out.append(int(value[0]) >> 32)
    return out


def test_signature_against_a_plain_one():
    for text in ("", "a", "abcdefgh", "abababababababab", words(200, 1)):
        assert omh.signature(text).tolist() == plain_signature(text)


def test_repeated_kmers_are_numbered():
    assert len(set(omh.numbered_kmers("a" * 50).tolist())) == 43
    assert omh.numbered_kmers("abcdefghX")[0] == omh.numbered_kmers("abcdefghY")[0]


def test_order_and_edits_count():
    a, b = words(300, 1), words(300, 2)
    like = lambda x, y: float((omh.signature(x) == omh.signature(y)).mean())
    assert like(a, a) == 1 and like(a, b) < 0.1
    assert like(a + " " + b, b + " " + a) < 0.75  # the same k-mers in another order
    assert like(a, a[:-20]) > 0.7 > like(a, a[: len(a) // 2])


def test_blocks_do_not_matter(monkeypatch):
    text = words(500, 4)
    want = omh.signature(text).tolist()
    monkeypatch.setattr(omh, "BLOCK", 1)
    assert omh.signature(text).tolist() == want


@pytest.mark.parametrize("parts", ["1", "5", "40"])
def test_documents_and_their_neighbours(spark, parts):
    unique = {i: (i, t, s) for i, t, s in TEXTS if i is not None}
    rows = list(unique.values())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = {r.doc_id: r for r in omh.fingerprints(documents(spark, rows)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    texts = [t or "" for _, t, _ in sorted(rows, key=lambda r: r[0])]
    for k, i in enumerate(sorted(unique)):
        t, u = texts[k], texts[(k + 1) % len(texts)]
        e = t[: len(t) - len(t) // 4] + u[: len(t) // 4]
        own, other, new = (omh.signature(x) for x in (t, u, e))
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        assert r.fingerprint == "".join(f"{x:08x}" for x in own) and r.edited_fingerprint == "".join(f"{x:08x}" for x in new)
        assert (r.near_edited, r.near_next) == ((own == new).mean(), (own == other).mean())


def test_awkward_rows(spark):
    out = omh.fingerprints(documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _, _ in TEXTS)
    assert omh.fingerprints(empty(spark)).count() == 0
    (one,) = omh.fingerprints(documents(spark, [(1, "a lonely text", "a")])).collect()
    assert one.near_next == 1 and one.edited_sha256 == hashlib.sha256(b"a lonely ta l").hexdigest()
