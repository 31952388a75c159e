from __future__ import annotations

import collections
import math
import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from llm.samples import TEXTS, documents, empty
from tokenizers import Tokenizer

from sparkguard.llm import packing

ROOT = Path(__file__).resolve().parents[2]
PATHS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
PLAIN = Tokenizer.from_file(PATHS[0])
FAST, SLOW = packing.TokenIds(*PATHS), packing.TokenIds(PATHS[0])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("  \n\t ab'sé1.|Ġ  末"), st.characters(codec="utf-8")), max_size=40), min_size=1, max_size=4))
@example(["a  b", "a \n b", " a", "a ", "", " ", "a\n", "x\n \ny", "it's <|endoftext|> x<|endoftext|>y", "a  b", "a \x85b"])
def test_ids_are_those_of_the_whole_text(texts):
    want = [np.array(PLAIN.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert list(FAST.of_many(texts)) == want and list(SLOW.of_many(texts)) == want


def test_chunks_of_a_long_text(monkeypatch):
    """A long text is encoded piece by piece, and the ids are those of the whole."""
    rng = random.Random(1)
    monkeypatch.setattr(packing, "CHUNK", 50)
    for _ in range(60):
        text = "".join(rng.choices(["ab", "é", " ", " ", "  ", "\n", "x.", "12", "\u672b", "it's"], k=300))
        assert len(list(packing.chunks(text))) > 3 and "".join(packing.chunks(text)) == text
        assert FAST.of(text) == np.array(PLAIN.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_memory_of_many_long_texts():
    """500 texts of 20,000 words at once take no more than a few texts do."""
    code = f"""
import random, resource
import pyarrow as pa
from sparkguard.llm import packing
from sparkguard.llm.common import text_slices
ids = packing.TokenIds({PATHS[0]!r}, {PATHS[1]!r})
rng = random.Random(1)
words = [''.join(rng.choices('abcdefghij', k=rng.randint(2, 9))) for _ in range(300_000)]
batch = pa.RecordBatch.from_arrays([pa.array([' '.join(rng.choices(words, k=20_000)) for _ in range(500)])], ['text'])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = sum(len(x) for b in text_slices(batch, 0) for x in ids.of_many(b.column(0).to_pylist()))
print(n, resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before)
"""
    n, more = map(int, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=ROOT).stdout.split())
    assert n > 10_000_000 and more < 200_000


def check(rows, texts):
    want = []
    for i, t, _ in texts:
        ids = [*PLAIN.encode(t or "", add_special_tokens=False).ids, 2]
        start, length, piece = 0, len(ids) % 1024 or 1024, 0
        while start < len(ids):
            want.append((i, piece, start, length, zlib.crc32(np.array(ids[start : start + length], "<u4").tobytes())))
            start, length, piece = start + length, 1024, piece + 1
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr) == sorted(want, key=repr)
    held = collections.defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for places in held.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= 1024
    return len(held), math.ceil(sum(r.length for r in rows) / 1024)


@pytest.mark.parametrize("shard_rows", [3, 2000])
def test_documents(spark, monkeypatch, shard_rows):
    monkeypatch.setattr(packing, "SHARD_ROWS", shard_rows)
    check(packing.packed(documents(spark), *PATHS).collect(), TEXTS)


def test_empty(spark):
    assert packing.packed(empty(spark), *PATHS).count() == 0
    check(packing.packed(documents(spark, [(i, None, "a") for i in range(1500)]), *PATHS).collect(), [(i, None, "a") for i in range(1500)])


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 3000))
def test_plan_places_every_large_piece(seed, n):
    rng = random.Random(seed)
    lengths = np.array([rng.choice([1024, rng.randint(341, 1024), rng.randint(341, 500)]) for _ in range(n)])
    plan = packing.Plan(dict(collections.Counter(lengths.tolist())))
    seen, nth = collections.Counter(), np.zeros(n, np.int64)
    for i, x in enumerate(lengths.tolist()):
        nth[i], seen[x] = seen[x], seen[x] + 1
    at = plan.sequence(lengths, nth)
    assert at.min() >= 0 and at.max() < plan.sequences and np.bincount(at, lengths).max() <= 1024


def test_few_more_sequences_than_the_bound():
    rng = random.Random(1)
    lengths = [rng.randint(1, 1024) for _ in range(20_000)]
    large = np.array([x for x in lengths if x > packing.SMALL])
    plan = packing.Plan(dict(collections.Counter(large.tolist())))
    seen, nth = collections.Counter(), np.zeros(len(large), np.int64)
    for i, x in enumerate(large.tolist()):
        nth[i], seen[x] = seen[x], seen[x] + 1
    room = 1024 - np.bincount(plan.sequence(large, nth), large, plan.sequences)
    _, new = packing.best_fit({i: int(r) for i, r in enumerate(room)}, [x for x in lengths if x <= packing.SMALL])
    assert plan.sequences + new <= 1.01 * math.ceil(sum(lengths) / 1024)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 30), st.integers(1, 4)), min_size=1, max_size=6, unique_by=lambda x: x[0]), st.integers(1, 60))
def test_fullest_choice_against_all_choices(items, room):
    sizes, counts = [s for s, _ in items], [c for _, c in items]
    sums = {0}
    for s, c in items:
        sums = {x + k * s for x in sums for k in range(c + 1) if x + k * s <= room}
    use = packing.fullest(sizes, counts, room)
    assert all(0 < n <= counts[k] for k, n in use.items()) and sum(sizes[k] * n for k, n in use.items()) == max(sums)
