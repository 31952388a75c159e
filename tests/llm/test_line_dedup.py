from __future__ import annotations

import random

import pytest
from llm.samples import TEXTS, documents, empty, words
from pyspark.sql import functions as F

from sparkguard.llm import line_dedup, queries


def brute(rows, least=50):
    """Remaining text per row: every line goes that lies in a run which any earlier place has."""
    lines = [(t or "").split("\n") for _, t, _ in rows]
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    places = [(k, i) for k in order for i in range(len(lines[k]))]
    gone = {k: set() for k in order}
    for at, (k, a) in enumerate(places):
        for j, c in places[:at]:
            n = 0
            while a + n < len(lines[k]) and c + n < len(lines[j]) and lines[k][a + n] == lines[j][c + n]:
                n += 1
            if sum(max(1, len(x.split())) for x in lines[k][a : a + n]) >= least:
                gone[k].update(range(a, a + n))
    return {rows[k][0]: "\n".join(x for i, x in enumerate(lines[k]) if i not in gone[k]) for k in order}


def result(df):
    return {r.doc_id: r.text for r in df.collect()}


@pytest.mark.parametrize("seed", range(4))
def test_runs_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng.choice([0, 1, 5, 20, 30, 60]), k) for k in range(12)]
    rows = []
    for i in range(40):
        body = [rng.choice(pool) for _ in range(rng.randint(0, 4))] + [words(rng.randint(1, 40), 1000 + i)]
        at = rng.randint(0, 6)
        body += pool[at : at + rng.randint(0, 5)] + [rng.choice(pool) for _ in range(rng.randint(0, 3))]
        rows.append((i, "\n".join(body), "a"))
    assert result(line_dedup.without_repeats(documents(spark, rows))) == brute(rows)


def test_a_passage_in_many_documents(spark):
    passage = words(55, 7)
    rows = [(i, f"own line {i}\n{passage}\nlast line {i}" if i % 3 else f"only {i}", "a") for i in range(300)]
    got = result(line_dedup.without_repeats(documents(spark, rows)))
    assert got == {i: (t if i == 1 else t.replace(passage + "\n", "")) for i, t, _ in rows}


def test_short_repeats_stay(spark):
    rows = [(i, f"Released under some licence.\n{words(60, i)}", "a") for i in range(5)]
    assert result(line_dedup.without_repeats(documents(spark, rows))) == {i: t for i, t, _ in rows}


def test_awkward_rows(spark):
    out = line_dedup.without_repeats(documents(spark)).collect()
    assert sorted(str(r.doc_id) for r in out) == sorted(str(i) for i, _, _ in TEXTS)
    assert all(r.text is not None and 0 <= r.dropped_lines <= r.n_lines for r in out)
    assert line_dedup.without_repeats(empty(spark)).count() == 0
    twice = documents(spark, [(1, words(60, 1), "a"), (1, words(60, 1), "a"), (None, words(60, 1), "a")])
    assert sorted((str(r.doc_id), r.text) for r in line_dedup.without_repeats(twice).collect()) == [("1", ""), ("1", words(60, 1)), ("None", "")]


def test_no_python_in_the_plan(spark):
    plan = line_dedup.without_repeats(documents(spark))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "Cartesian", "NestedLoop"))


@pytest.mark.parametrize("seed", range(3))
def test_every_place_against_brute_force(spark, seed):
    rng = random.Random(seed)
    pool = [words(rng.choice([0, 1, 5, 20, 30, 60]), k) for k in range(12)]
    rows = [(i, "\n".join([rng.choice(pool) for _ in range(rng.randint(0, 9))] + [words(9, 1000 + i)]), "a") for i in range(30)]
    assert result(line_dedup.without_repeats(documents(spark, rows))) == brute(rows)


def test_the_tail_of_a_hot_head(spark, tmp_path):
    """A later document's tail goes too, although the first place of its head continues differently."""
    head, tail = words(60, 1), words(30, 2)
    rows = [(1, f"{head}\n{words(5, 3)}", "a"), (2, f"{head}\n{tail}\n{words(7, 4)}", "a"), (3, f"{head}\n{tail}\n{words(8, 5)}", "a")]
    want = {1: rows[0][1], 2: f"{tail}\n{words(7, 4)}", 3: words(8, 5)}
    assert result(line_dedup.without_repeats(documents(spark, rows))) == want
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    assert {r.doc_id: r.dropped_lines for r in queries.op2_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 2}


def test_picks_are_few_and_shared(spark):
    """Windows that two places share have the same pick, and only windows with a repeated pick go on."""
    rng = random.Random(5)
    passage = [words(12, 900 + k) for k in range(9)]
    own = lambda k: [words(rng.randint(5, 15), 10_000 + 50 * k + j) for j in range(40)]
    rows = [(i, "\n".join(own(i)[:20] + (passage if i % 2 else []) + own(1000 + i)[:20]), "a") for i in range(12)]
    texts = documents(spark, rows).select("doc_id", "text").withColumn("row_id", F.col("doc_id"))
    marked = line_dedup.windows(line_dedup.line_rows(texts)).cache()
    picks = marked.select("row_id", "pick_no").distinct().count()
    assert picks < 0.6 * sum(t.count("\n") + 1 for _, t, _ in rows)
    near = marked.join(line_dedup.repeated_picks(marked), "least")
    assert 0 < near.count() < 0.4 * marked.count()
    assert result(line_dedup.without_repeats(documents(spark, rows))) == brute(rows)
    by_key = marked.groupBy("key").agg(F.count_distinct("least").alias("n"), F.count_distinct(F.col("pick_no") - F.col("no")).alias("m"))
    assert by_key.where("n > 1 or m > 1").count() == 0
