from __future__ import annotations

import collections
import re

from llm.samples import TEXTS, as_rows, documents, empty

from sparkguard.llm import mixing


def sizes(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def test_every_source_comes_to_its_target(spark):
    rows = mixing.mixture(documents(spark)).collect()
    assert sorted(map(str, (r.doc_id for r in rows))) == sorted(str(i) for i, _, _ in TEXTS)
    source = collections.Counter()
    for _, t, s in TEXTS:
        source[s] += sizes(t)
    by_size = {}
    for r in rows:
        by_size.setdefault(r.source_size, []).append(r)
        assert 0 <= r.taken <= 2 * r.size
    assert set(by_size) == set(source.values())
    for size, own in by_size.items():
        assert abs(sum(r.taken for r in own) - own[0].target) <= 0.5 and own[0].target <= 2 * size
    assert abs(sum(own[0].target for own in by_size.values()) - 1.5 * sum(source.values())) < 1e-6


def test_reruns_agree_and_positions_rise(spark):
    docs = documents(spark)
    a, b = mixing.mixture(docs).collect(), mixing.mixture(docs.repartition(7)).collect()
    assert sorted(map(repr, a)) == sorted(map(repr, b))
    places = [r.position for r in a if r.position is not None]
    assert places == sorted(places) and all(0 <= p < 1 for p in places)
    assert all(r.again_position > r.position for r in a if r.again_position is not None)


def test_training_rows_are_the_mix(spark):
    docs = documents(spark)
    rows = mixing.curriculum(docs)
    assert rows.columns == docs.columns
    taken = collections.Counter()
    for r in mixing.mixture(docs).collect():
        taken[r.doc_id] += r.taken
    read = collections.Counter()
    for r in rows.collect():
        read[r.doc_id] += sizes(r.text)
    assert {k: v for k, v in taken.items() if v} == dict(read)


def test_a_weight_of_a_source_is_its_rate(spark):
    """The schedule falls, rises or is flat, and its integral is one."""
    docs = documents(spark, [(i, "a b c d", s) for i in range(600) for s in ("a", "b", "c")])
    rows = mixing.mixed(docs).selectExpr("row.source", "position", "again_position").collect()
    early = {s: [0, 0] for s in "abc"}
    for r in rows:
        for p in (r.position, r.again_position):
            if p is not None:
                early[r.source][p >= 0.5] += 1
    assert early["a"][0] > 1.5 * early["a"][1] and early["b"][1] > 1.5 * early["b"][0] and abs(early["c"][0] - early["c"][1]) < 10


def test_empty(spark):
    assert as_rows(mixing.mixture(empty(spark))) == [] and mixing.curriculum(empty(spark)).count() == 0
    blank = documents(spark, [(1, None, "a"), (2, "  ", None)])
    assert [r.taken for r in mixing.mixture(blank).collect()] == [0, 0]
