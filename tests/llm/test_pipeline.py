from __future__ import annotations

import collections
import re

import public_tokenizers
from llm.samples import documents, empty
from llm.test_packing import check
from llm.test_simhash_dedup import linked, simhash
from pyspark.sql import functions as F

import corpus_pipeline
from sparkguard.llm import toxicity
from sparkguard.llm.common import saved, table

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_version(spark):
    docs = table(spark, SF, "documents")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, saved(stage(spark, docs, SF), f"test-{name}")
        outs[name] = (before, docs)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "exact_dedup", "simhash_dedup", "mixing", "packing"]
    for n in names[:-1]:
        assert outs[n][1].columns == table(spark, SF, "documents").columns

    before, after = outs["toxicity"]
    scored = toxicity.scores(before, toxicity.fit(before, table(spark, SF, "labels")))
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in scored.where("predicted = 0").collect()}

    before, after = outs["exact_dedup"]
    first = {}
    for r in sorted(before.collect(), key=lambda r: r.doc_id):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
    assert sorted(after.collect(), key=lambda r: r.doc_id) == sorted(first.values(), key=lambda r: r.doc_id)

    before, after = outs["simhash_dedup"]
    rows = before.collect()
    roots = linked(sorted({simhash(r.text) for r in rows}))
    least = {}
    for r in rows:
        c = roots[simhash(r.text)]
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert {r.doc_id for r in after.collect()} == set(least.values())

    before, after = outs["mixing"]
    texts = {r.doc_id: r for r in before.collect()}
    words = lambda t: len((t or "").split(None))
    read = collections.Counter()
    for r in after.collect():
        own = texts[r.doc_id]
        assert r.source == own.source and (r.text == own.text or " ".join(own.text.split()).startswith(r.text))
        read[r.doc_id] += words(r.text)
    assert all(n <= 2 * words(texts[i].text) for i, n in read.items())
    assert abs(sum(read.values()) - 1.5 * sum(words(r.text) for r in texts.values())) <= len({r.source for r in texts.values()})

    before, after = outs["packing"]
    sequences, bound = check(after.collect(), [(r.doc_id, r.text, r.source) for r in before.collect()])
    assert sequences <= 1.02 * bound + 1
    assert sorted(map(repr, corpus_pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32").collect())) == sorted(
        map(repr, after.select("doc_id", "piece", "start", "length", "ids_crc32").collect())
    )


def test_awkward_rows(spark, tmp_path):
    spark.createDataFrame([(4, 1, 1), (None, 0, 1), (5, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for docs in (documents(spark), empty(spark)):
        for _, stage in corpus_pipeline.STAGES:
            docs = saved(stage(spark, docs, str(tmp_path)), "test-awkward")
        assert set(docs.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
        assert docs.where(F.col("offset") + F.col("length") > 1024).isEmpty()


def test_vocabularies_are_there():
    assert public_tokenizers.path(corpus_pipeline.VOCABULARY).endswith(".json")
