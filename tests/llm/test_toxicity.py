from __future__ import annotations

import numpy as np
import pytest
from llm.samples import TEXTS, documents, empty
from pyspark.sql import functions as F

from sparkguard.llm import toxicity
from sparkguard.llm.common import table
from sparkguard.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_rows(spark):
    got = QUERIES["op6_toxicity"](spark, SF).join(table(spark, SF, "labels").select("doc_id", "toxic"), "doc_id").where("held_out")
    right = {(r.toxic, r.predicted): r.n for r in got.groupBy("toxic", "predicted").agg(F.count("*").alias("n")).collect()}
    assert right[1, 1] / (right[1, 1] + right[1, 0]) > 0.75 and right.get((0, 1), 0) < 0.01 * right[0, 0]


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_awkward_rows(spark):
    told = labels(spark, [(4, 1, 1), (4, 1, 0), (None, 0, 1), (5, 0, None), (77, 0, 1), (1, 0, 0), (8, 1, 0)])
    weights = toxicity.fit(documents(spark), told)
    got = toxicity.scores(documents(spark), weights).collect()
    assert len(got) == len(TEXTS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    blank = {r.score for r in got if r.doc_id in (1, 2, 3)}
    assert len(blank) == 1 and toxicity.scores(empty(spark), weights).count() == 0
    kept = toxicity.without_toxic(documents(spark), weights)
    assert kept.columns == documents(spark).columns and kept.count() == sum(1 - r.predicted for r in got)


def test_nothing_to_learn(spark):
    weights = toxicity.fit(documents(spark), labels(spark, []))
    assert {r.score for r in toxicity.scores(documents(spark), weights).collect()} == {0.5}
    assert toxicity.fit(empty(spark), labels(spark, [(1, 1, 1)])) == {}


def test_pieces_of_a_long_text(monkeypatch):
    text = "Some Wörds and more words, " * 40
    words = toxicity.Words()
    whole = set(np.concatenate(list(toxicity.features(text, words))).tolist())
    for size in (1, 9, 100):
        monkeypatch.setattr(toxicity, "PIECE", size)
        assert set(np.concatenate(list(toxicity.features(text, words))).tolist()) == whole


def test_learner_against_a_plain_one():
    rng = np.random.default_rng(2)
    rows = [(np.unique(np.r_[rng.integers(0, 50, 8), 1 << toxicity.BITS]), int(rng.random() < 0.4)) for _ in range(200)]
    model = toxicity.Ftrl()
    z, n = {}, {}

    def weight(i):
        l1 = 0 if i == 1 << toxicity.BITS else toxicity.L1
        if abs(z.get(i, 0)) <= l1:
            return 0.0
        return -(z[i] - np.sign(z[i]) * l1) / ((toxicity.BETA + np.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for at, label in rows:
        model.learn(at, label)
        w = {i: weight(i) for i in at.tolist()}
        g = 1 / (1 + np.exp(-sum(w.values()))) - label
        for i in w:
            sigma = (np.sqrt(n.get(i, 0) + g * g) - np.sqrt(n.get(i, 0))) / toxicity.ALPHA
            z[i] = z.get(i, 0) + g - sigma * w[i]
            n[i] = n.get(i, 0) + g * g
    at = np.array(sorted(z))
    assert np.allclose(model.weights(at), [weight(i) for i in at.tolist()])


@pytest.mark.parametrize("kind", ["tinyint", "bigint", "boolean", "double"])
def test_types_of_labels(spark, kind):
    """Labels of any number type, nulls among them, teach the same."""
    rows = [(4, 1), (5, 0), (6, 0), (8, None), (12, 1), (13, 1)]
    want = toxicity.fit(documents(spark), labels(spark, [(i, 1, v) for i, v in rows]))
    told = labels(spark, [(i, 1, v) for i, v in rows]).withColumn("toxic", F.col("toxic").cast(kind))
    assert toxicity.fit(documents(spark), told) == want


def test_the_learner_holds_bounded_features(spark, monkeypatch):
    at = np.unique(np.random.default_rng(1).integers(0, 1 << toxicity.BITS, 3000))
    assert (toxicity.unpacked(toxicity.packed(at)) == at).all() and len(toxicity.packed(at)) < 2.5 * len(at)
    assert len(toxicity.unpacked(toxicity.packed(at[:0]))) == 0
    told = labels(spark, [(i, 1, i % 2) for i in (4, 5, 6, 8, 12, 13)])
    monkeypatch.setattr(toxicity, "SAMPLE_BYTES", 1)
    assert len(toxicity.fit(documents(spark), told)) > 0
