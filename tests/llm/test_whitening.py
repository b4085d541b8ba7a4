"""Whitening against numpy's eigenvectors and exact whole-number sums."""

import numpy as np
import pytest

from structmine.llm import queries, whitening


def symmetric(seed, n, values):
    q, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, n)))
    m = q @ np.diag(values) @ q.T
    return (m + m.T) / 2


@pytest.mark.parametrize("n", [1, 2, 7, 40])
def test_spectrum_slicing(n):
    rng = np.random.default_rng(n)
    for values in (rng.random(n), np.ones(n), np.repeat([5.0, 1.0], [n // 3, n - n // 3]), 10.0 ** -np.arange(n), rng.standard_normal(n)):
        m = symmetric(n, n, values)
        found, vectors = whitening.leading(m, 8)
        right = np.sort(values)[::-1][:8]
        assert np.allclose(found, right, rtol=1e-12, atol=1e-14 * n)
        assert np.abs(vectors @ vectors.T - np.eye(len(found))).max() < 1e-12
        assert np.abs(m @ vectors.T - vectors.T * found).max() < 1e-13 * max(n, 10)
        for shift in rng.standard_normal(6):
            assert whitening.above(m, shift) == (values > shift).sum()


def expected(rows):
    good = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = np.floor(1024 * np.array([v for _, v in good], np.float32).astype(float)).astype(int) + 100_000
    n, sums = len(x), [int(s) for s in x.sum(axis=0)]
    deviation = [sum((n * int(c) - s) ** 2 for c, s in zip(row, sums)) for row in x]
    centred = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    return [i for i, _ in good], deviation, values[::-1], vectors[:, ::-1], centred


def test_query(spark, folder):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.standard_normal(12) * np.arange(1, 13)).astype(np.float32).tolist()) for i in range(200)]
    rows += [(3, rows[3][1]), (None, rows[5][1]), (300, None), (301, [float("nan")] + [0.0] * 11), (302, [None] + [0.0] * 11)]
    rows += [(303, [float("inf")] + [0.0] * 11)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = queries.op12_whitening(spark, folder(embeddings=df)).collect()
    ids, deviation, values, vectors, centred = expected(rows)
    assert len(got) == 8 * len(ids) and {r["n"] for r in got} == {len(ids)}
    by_id = dict(zip(ids, range(len(ids))))
    sign = {}
    for r in sorted(got, key=lambda r: r["component"]):
        i, k = by_id[r["vec_id"]], r["component"] - 1
        right = centred[i] @ vectors[:, k] / values[k] ** 0.5
        sign.setdefault(k, 1.0 if right * r["whitened"] > 0 else -1.0)
        assert abs(sign[k] * r["whitened"] - right) < 1e-9 and r["deviation"] == deviation[i]
        assert abs(r["explained"] - values[k] / values.sum()) < 1e-12 and r["identity_error"] < 1e-10


def test_edges(spark, folder):
    make = lambda rows: queries.op12_whitening(
        spark, folder(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<float>"))
    ).collect()
    assert make([]) == [] and make([(1, None), (2, [])]) == []
    assert make([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []  # no variance
    few = make([(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, [0.0, 0.0]), (4, [9.0])])  # one direction; another length
    assert sorted((r["vec_id"], r["component"]) for r in few) == [(1, 1), (2, 1), (3, 1)] and abs(few[0]["explained"] - 1) < 1e-9
    far = make([(1, [3e38]), (2, [-3e38])])
    assert [r["deviation"] for r in far] == [None, None] and {round(abs(r["whitened"]), 9) for r in far} == {1.0}
