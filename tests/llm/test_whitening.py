"""Whitening against numpy on the whole covariance, exact sums, ties, and odd inputs."""

import math

import numpy as np
import pytest

from pennant.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x string, n string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, 1, "a", "b") for i, v in rows], SCHEMA)


def direct(rows):
    """The contract on one machine: x, n, S and the eigenvectors of the whole covariance."""
    whole = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.floor(64 * np.array([np.float32(v) for _, v in whole], float)).astype(np.int64) + 1_000_000
    fit = np.unique(x, axis=0)
    c = fit - fit.mean(axis=0)
    values, axes = np.linalg.eigh(c.T @ c / len(fit))
    return [i for i, _ in whole], x, fit, values[::-1], axes[:, ::-1]


def compare(spark, rows, wanted=16, tol=1e-8):
    ids, x, fit, values, axes = direct(rows)
    got = whitening.whiten(vectors_of(spark, rows), wanted).toPandas()
    k = got["component"].max()
    sums, n = fit.sum(axis=0), len(fit)
    by = {}
    for r in got.itertuples():
        r = r._replace(vec_id=None if math.isnan(r.vec_id) else int(r.vec_id), deviation=int(r.deviation))
        by.setdefault((r.vec_id, r.deviation), {})[r.component] = r
    for i, v in zip(ids, x, strict=True):
        deviation = int(((n * v.astype(object) - sums) ** 2).sum())
        w = np.array([by[i, deviation][c].whitened for c in range(1, k + 1)])
        assert np.abs(np.abs(w) - np.abs((v - sums / n) @ axes[:, :k] / np.sqrt(values[:k]))).max() < tol
    first = got[got.vec_id == got.vec_id.iloc[0]].drop_duplicates("component").sort_values("component")
    assert np.allclose(first["explained"], values[:k] / values.sum(), rtol=1e-10)
    assert got["identity_error"].nunique() == 1 and got["identity_error"].iloc[0] < 1e-9 and set(got["n"]) == {n}
    return k


def test_flat_spectrum_and_repeated_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((500, 40)))]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(300)]
    rows += [(None, rows[3][1])]
    assert compare(spark, rows) == 16


def test_falling_spectrum_ends_before_the_block_is_whole(spark):
    rng = np.random.default_rng(2)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((400, 60)) * 3.0 * 0.6 ** np.arange(60))]
    compare(spark, rows, 4, 1e-6)
    quantised = whitening.quantised(vectors_of(spark, rows)).select("x").distinct()
    x = np.stack(quantised.toPandas()["x"].to_numpy())
    values, axes, _, passes = whitening.components(quantised, len(x), [int(s) for s in x.sum(axis=0)], 4)
    assert 2 < passes < 30
    v = np.cov(x.T.astype(float), bias=True)
    assert np.abs(v @ axes - axes * values).max() < 1e-10 * values[0]


def test_fewer_components_than_wanted(spark):
    rng = np.random.default_rng(3)
    flat = rng.standard_normal((50, 3)) @ np.diag([4.0, 2.0, 1.0])
    assert compare(spark, [(i, v.tolist()) for i, v in enumerate(flat)]) == 3
    line = [(i, [float(i), 0.0, 5.0, 0.0]) for i in range(20)]
    assert compare(spark, line) == 1


def test_exact_where_no_long_holds_the_square(spark):
    rows = [(i, [float(1 << 29) * (i % 2), float(i)]) for i in range(100)]
    got = whitening.whiten(vectors_of(spark, rows)).collect()
    _, x, fit, *_ = direct(rows)
    n, sums = len(fit), fit.sum(axis=0)
    for r in got:
        want = int(((n * x[r.vec_id].astype(object) - sums) ** 2).sum())
        assert r.deviation == (want if want < 1 << 63 else None)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    bad = [(10, None), (11, []), (12, [1.0, None]), (13, [nan, 1.0]), (14, [inf, 1.0]), (15, [1.0]), (16, [3e38, 1.0])]
    good = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [0.0, 0.0]), (None, [3.0, 1.0]), (4, [-2.0, 0.5])]
    got = whitening.whiten(vectors_of(spark, bad + good)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(str(i) for i, _ in good for _ in range(2))
    assert {r.n for r in got} == {4}
    for rows in ([], bad[:3], [(1, [1.0, 2.0])], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(vectors_of(spark, rows)).collect() == []


@pytest.mark.parametrize("d", [1, 2000])
def test_narrow_and_very_long_vectors(spark, d):
    rng = np.random.default_rng(d)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.standard_normal((30, d)))]
    assert compare(spark, rows, 3, 1e-6) == min(3, d)
