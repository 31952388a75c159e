from __future__ import annotations

import numpy as np
import pytest
from llm.samples import TEXTS, documents, empty
from pyspark.sql import functions as F

from sparkguard.llm import langid
from sparkguard.llm.common import fold, table

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    docs = table(spark, SF, "documents")
    return langid.train(docs, fold(F.col("doc_id"), 4) != 2)


def test_held_out_accuracy(spark, model):
    docs = table(spark, SF, "documents").where(fold(F.col("doc_id"), 4) == 2)
    got = langid.predict(docs, *model).join(docs.select("doc_id", "lang"), "doc_id")
    row = got.agg(F.count("*").alias("n"), F.count_if(F.col("lang") == F.col("lang_pred")).alias("right")).first()
    assert row.n > 200 and row.right / row.n > 0.98


def test_mixed_texts_have_both_languages(spark, model):
    texts = {r.lang: r.text for r in table(spark, SF, "documents").where("length(text) between 2000 and 4000").collect()}
    mixed = [(1, texts["en"][:1500] + " " + texts["de"][:1500], "a"), (2, texts["fr"][:2500] + " " + texts["es"][:500], "a")]
    got = {r.doc_id: r for r in langid.predict(documents(spark, mixed), *model).collect()}
    assert got[1].languages == 2 and 0.3 < got[1].score < 0.75
    assert got[2].lang_pred == "fr" and 0.6 < got[2].score < 0.95


def test_expectation_maximisation_against_a_plain_one():
    rng = np.random.default_rng(1)
    likelihood = rng.normal(0, 2, (200, 3))
    likelihood[:120, 0] += 4
    likelihood[120:, 2] += 4
    value = np.exp(np.maximum(likelihood - likelihood.max(axis=1, keepdims=True), -langid.MOST_RATIO))
    p = np.ones(3) / 3
    for _ in range(langid.EM_STEPS):
        r = value * p
        p = (r / r.sum(axis=1, keepdims=True)).mean(axis=0)
    got, whole = langid._shares(value.astype(np.float32), np.array([0]), np.array([200]), np.ones((1, 3), np.float32))
    assert np.allclose(got[0], p, atol=1e-3) and np.isclose(whole[0], np.log(value @ p).sum(), rtol=1e-3)
    shares = langid.mixtures(likelihood, np.array([200]))[0]
    assert (shares > 0).tolist() == [True, False, True]


def test_awkward_rows(spark, model):
    got = langid.predict(documents(spark), *model).collect()
    assert len(got) == len(TEXTS)
    none = [r for r in got if r.lang_pred == "und"]
    assert sorted(str(r.doc_id) for r in none) == ["1", "16", "2", "3", "None"] and all(r.score == 0 for r in none)
    assert all(r.lang_pred in model[0] and 0 <= r.score <= 1 for r in got if r.lang_pred != "und")
    assert langid.predict(empty(spark), *model).count() == 0
    assert {r.lang_pred for r in langid.predict(documents(spark), *langid.train(empty(spark), F.lit(True))).collect()} == {"und"}


def test_grams_keep_words_apart():
    places, owner = langid.grams(["ab", "c"])
    assert np.bincount(owner).tolist() == [10, 6]
    alone = [langid.grams([w])[0] for w in ("ab", "c")]
    assert sorted(places.tolist()) == sorted(np.concatenate(alone).tolist())


def test_pieces_of_a_long_text(monkeypatch):
    text = "Ab cd-ef gh1ij " * 50
    whole = [w for part in langid.words_in(text) for w in part]
    monkeypatch.setattr(langid, "PIECE", 7)
    assert [w for part in langid.words_in(text) for w in part] == whole
