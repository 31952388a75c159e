"""Whitening against a plain eigendecomposition of the whole covariance matrix."""

from __future__ import annotations

import math

import numpy as np
import pytest

from sparkguard.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, d string, n long, whitened double, `odd.name` int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, 1, "x", "d", 7, 0.5, 1) for i, e in rows], SCHEMA)


def plain(vectors):
    """Eigenvalues, eigenvectors, exact deviations and the centred matrix."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(v, sums, strict=True)) for v in x]
    centred = np.array([[(n * a - s) / n for a, s in zip(v, sums, strict=True)] for v in x])
    values, turn = np.linalg.eigh(centred.T @ centred / n)
    return values[::-1], turn[:, ::-1], deviation, centred


def check(result, ids, vectors, components):
    values, turn, deviation, centred = plain(vectors)
    got = {}
    for r in result.collect():
        got.setdefault(r.vec_id, {})[r.component] = r
    assert sorted(got) == sorted(ids)
    signs = {}
    for i, at in zip(ids, range(len(ids)), strict=True):
        assert sorted(got[i]) == list(range(1, components + 1))
        for k, r in got[i].items():
            want = centred[at] @ turn[:, k - 1] / math.sqrt(values[k - 1])
            sign = signs.setdefault(k, 1 if r.whitened * want >= 0 or abs(want) < 1e-9 else -1)
            assert r.whitened == pytest.approx(sign * want, abs=1e-8)
            assert (r.n, r.deviation) == (len(ids), deviation[at])
            assert r.explained == pytest.approx(values[k - 1] / values.sum(), rel=1e-10)
            assert r.identity_error < 1e-9


def spread(n, d, seed):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((n, d)) * (0.9 ** np.arange(d)) + rng.standard_normal(d)).astype(np.float32).tolist()


def whitened(df):
    rows = whitening.whole_rows(df)
    return whitening.whitened(rows, whitening.fit(rows))


@pytest.mark.parametrize(("n", "d"), [(400, 48), (200, 64), (50, 3), (2, 5)])
def test_against_a_plain_version(spark, n, d):
    vectors = spread(n, d, n)
    check(whitened(table(spark, list(enumerate(vectors)))), list(range(n)), vectors, min(8, d, n - 1))


def test_close_eigenvalues(spark):
    """Hardly any gap below the wanted components."""
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((500, 40)).astype(np.float32).tolist()
    rows = whitening.whole_rows(table(spark, list(enumerate(vectors))))
    model = whitening.fit(rows)
    values = plain(vectors)[0]
    assert np.allclose(model.values, values[:8], rtol=1e-12)
    assert model.residuals.max() < 1e-12 * values[0]


def test_what_is_dropped(spark):
    good = spread(30, 6, 1)
    bad = [None, [], [1.0, None, 1.0, 1.0, 1.0, 1.0], [float("nan")] * 6, [float("inf")] + [0.0] * 5, [float("-inf")] * 6, [1e30] * 6, [1.0, 2.0]]
    rows = [*enumerate(good), *((100 + k, v) for k, v in enumerate(bad))]
    check(whitened(table(spark, rows)), list(range(30)), good, 6)


def test_repeated_and_null_ids(spark):
    good = spread(20, 4, 2)
    rows = [(1, good[0]), (1, good[0]), (None, good[1]), (None, good[1]), *((k, good[k]) for k in range(2, 20))]
    out = whitened(table(spark, rows)).collect()
    assert len(out) == 22 * 4 and sum(r.vec_id is None for r in out) == 8 and {r.n for r in out} == {22}


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0])], [(k, [0.5, 0.25, 3.0]) for k in range(9)], [(1, None)]])
def test_nothing_to_whiten(spark, rows):
    out = whitened(table(spark, rows))
    assert out.count() == 0 and out.columns[:4] == ["vec_id", "component", "n", "deviation"]


def test_a_direction_without_variance(spark):
    vectors = [[float(k), 2.0 * k, 1.0] for k in range(40)]
    check(whitened(table(spark, list(enumerate(vectors)))), list(range(40)), vectors, 1)


def test_large_entries(spark):
    """Entries of double precision whose deviations do not fit have none."""
    rows = spark.createDataFrame([(k, [float(k) * 1e12, 1.0 * (k % 3)]) for k in range(12)], "vec_id long, embedding array<double>")
    out = whitened(rows).collect()
    assert len(out) == 12 and {r.deviation for r in out} == {None}


def test_the_query(spark):
    sf = "/root/testdata/sf0.001"
    read = spark.read.parquet(f"{sf}/embeddings.parquet").collect()
    good = [(r.vec_id, r.embedding) for r in read if r.embedding and all(c is not None and math.isfinite(c) for c in r.embedding)]
    check(queries.op11_whitening(spark, sf), [i for i, _ in good], [v for _, v in good], 8)
