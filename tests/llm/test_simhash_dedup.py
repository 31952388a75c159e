from __future__ import annotations

import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.samples import TEXTS, as_rows, documents, empty

from sparkguard.llm import gray_index, simhash_dedup
from sparkguard.llm.components import components

UPPER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def simhash(text):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if x]
    shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def linked(codes):
    """Least member of each code's component, by brute force."""
    root = {c: c for c in codes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in codes:
        for b in codes:
            if (a ^ b).bit_count() <= 2:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {c: find(c) for c in codes}


def near_codes(seed, n=40, spread=12):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n, dtype=np.uint64)
    out = [base]
    for _ in range(spread):
        x = base.copy()
        for _ in range(int(rng.integers(1, 4))):
            x ^= np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)
        out.append(x)
    return np.unique(np.concatenate(out))


@settings(max_examples=25, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([1, 7, 8, 9, 64, 65, 200]))
def test_index_finds_exactly_the_pairs_within_the_radius(seed, n):
    codes = near_codes(seed)[:n]
    got = {p for q, c in gray_index.GrayIndex(codes).within(codes, 2) for p in zip(q.tolist(), c.tolist(), strict=True)}
    assert got == set(zip(*(x.tolist() for x in np.nonzero(np.bitwise_count(codes[:, None] ^ codes[None]) <= 2)), strict=True))


def test_gray_order():
    codes = np.arange(64, dtype=np.uint64)
    in_order = codes[np.argsort(gray_index.gray_rank(codes))]
    assert (np.bitwise_count(in_order[1:] ^ in_order[:-1]) == 1).all()
    assert (gray_index.gray_code(gray_index.gray_rank(codes)) == codes).all()


def test_links_with_small_ranges_and_a_hot_block(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "RANGE_CODES", 50)
    rng = np.random.default_rng(3)
    hot = np.uint64(0x123456789ABCDEF0) ^ rng.integers(0, 1 << 9, 400, dtype=np.uint64)  # one leading block for all
    codes = np.unique(np.concatenate([near_codes(1), hot]))
    df = spark.createDataFrame([(int(x),) for x in codes.view(np.int64)], "fp long")
    forest = simhash_dedup.links(df)
    roots = {r.a: r.root for r in components(forest).collect()}
    groups = {}
    for c in codes.view(np.int64).tolist():
        groups.setdefault(roots.get(c, c), set()).add(c & (2**64 - 1))
    want = {}
    for c, r in linked(codes.tolist()).items():
        want.setdefault(r, set()).add(c)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))
    assert forest.count() < 4 * len(codes)  # a forest, never all pairs


def test_components_of_a_long_chain_and_a_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = {r.a: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(1, 200)}}


def test_documents_against_brute_force(spark):
    fps = [simhash(t) for _, t, _ in TEXTS]
    roots = linked(sorted(set(fps)))
    want = []
    for (i, _, _), f in zip(TEXTS, fps, strict=True):
        ids = [j for (j, _, _), g in zip(TEXTS, fps, strict=True) if roots[g] == roots[f] and j is not None]
        want.append((i, f"{f:016x}", min(ids, default=None)))
    assert as_rows(simhash_dedup.near_duplicates(documents(spark))) == sorted(want, key=repr)
    assert simhash_dedup.near_duplicates(empty(spark)).count() == 0


def test_pieces_of_a_long_text_make_the_same_fingerprint(monkeypatch):
    from sparkguard.llm import common

    text = " ".join(f"w{i}" for i in range(500))
    whole = simhash_dedup.simhash(text.encode())
    for size in (3, 10, 64):
        monkeypatch.setattr(common, "PIECE", size)
        assert simhash_dedup.simhash(text.encode()) == whole == simhash(text)


def test_one_of_each_component_stays(spark):
    docs = documents(spark)
    kept = simhash_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    roots = linked(sorted({simhash(t) for _, t, _ in TEXTS}))
    got = [roots[simhash(r.text)] for r in kept.collect()]
    assert sorted(got) == sorted(set(roots.values()))
