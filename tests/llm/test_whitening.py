"""Whitening against numpy's eigendecomposition of the whole covariance."""

import numpy as np
import pytest

from turnloom.llm import whitening
from turnloom.llm.spectrum import Spectrum, secular_roots


def _plain(rows, dims, components=16):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(np.int64) + 1_000_000) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and abs(64 * c) < 2 ** 44 for c in v)]
    fit = np.unique(np.array([x for _, x in kept]), axis=0)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    real = values[:components] > 1e-12 * values.sum()
    w = {i: ((x - sums / n) @ vectors[:, :components] / np.sqrt(np.maximum(values[:components], 1e-300)))[real] for i, x in kept}
    exact = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(x, sums)) for i, x in kept}
    return n, w, exact, values[:components][real] / values.sum()


def _compare(spark, rows, dims, **options):
    df = spark.createDataFrame(rows, "vec_id LONG, embedding ARRAY<DOUBLE>").repartition(5)
    found = whitening.whiten(df, **options).collect()
    n, w, exact, shares = _plain(rows, dims, options.get("components", 16))
    assert len(found) == sum(len(w[i]) for i, v in rows if i in w and v is not None and len(v) == dims)
    sign = {}
    for r in found:
        assert r.n == n and int(r.deviation) == exact[r.vec_id] and r.identity_error <= 1e-9
        assert abs(r.explained - shares[r.component - 1]) <= 1e-9
        want = w[r.vec_id][r.component - 1]
        if abs(want) > 1e-6:
            assert sign.setdefault(r.component, np.sign(want * r.whitened)) == np.sign(want * r.whitened)
        assert abs(abs(r.whitened) - abs(want)) < 1e-7
    return found


def test_equals_the_whole_covariance(spark):
    rng = np.random.default_rng(1)
    shape = rng.normal(size=(24, 24))
    rows = [(i, (rng.normal(size=24) @ shape).tolist()) for i in range(400)]
    rows += [(1000 + i, rows[7][1]) for i in range(300)]  # copies are fitted once and returned each
    rows += [(2000, None), (2001, []), (2002, [1.0] * 23), (2003, [None] + [0.0] * 23), (2004, [float("inf")] * 24),
             (2005, [float("nan")] * 24), (2006, [1e300] * 24)]
    _compare(spark, rows, 24)


def test_fewer_directions_than_components(spark):
    rng = np.random.default_rng(2)
    flat = rng.normal(size=(3, 6))
    rows = [(i, np.round(rng.normal(size=3) @ flat * 4).tolist()) for i in range(60)]
    found = _compare(spark, rows, 6)
    assert max(r.component for r in found) <= 6
    rows = [(i, [float(i % 2), 5.0, 5.0]) for i in range(10)]
    assert {r.component for r in _compare(spark, rows, 3)} == {1}


def test_nothing_to_whiten(spark):
    schema = "vec_id LONG, embedding ARRAY<FLOAT>"
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_clashing_columns(spark):
    rows = [(i, [float(i % 7), float(i % 5)], 1, 2, 3) for i in range(35)]
    found = whitening.whiten(spark.createDataFrame(rows, "n LONG, x ARRAY<DOUBLE>, id INT, w INT, component INT"), "n", "x").collect()
    assert len(found) == 70 and {r[0] for r in found} == set(range(35))


@pytest.mark.parametrize("n, offset", [(10 ** 9, 0), (7, 2 ** 50)])
def test_deviations_are_exact(n, offset):
    rng = np.random.default_rng(3)
    x = rng.integers(-1000, 1000, (20, 5)) + offset // 1024
    rest = [int(v) for v in rng.integers(-10 ** 9, 10 ** 9, 5)]
    assert whitening.deviations(x, n, rest) == [sum((n * int(a) - r) ** 2 for a, r in zip(row, rest)) for row in x]


@pytest.mark.parametrize("dims", [1, 2, 7, 40])
def test_rank_one_updates_and_joins(dims):
    rng = np.random.default_rng(dims)
    x = np.floor(rng.normal(size=(300, dims)) * 8)
    x[:100] = x[0]
    if dims > 2:
        x[:, 2] = x[:, 1]
    parts = []
    for piece in np.array_split(x, 4):
        s = Spectrum.empty(dims)
        for row in piece:
            s.add(row)
        parts.append(s)
    first = parts[0]
    for other in parts[1:]:
        first.join(other)
    centred = x - x.mean(axis=0)
    scatter = centred.T @ centred
    scale = max(np.abs(scatter).max(), 1.0)
    assert first.n == 300 and np.allclose(first.mean, x.mean(axis=0), atol=1e-10)
    assert np.abs(first.vectors.T @ first.vectors - np.eye(dims)).max() < 1e-12
    assert np.abs((first.vectors * first.values) @ first.vectors.T - scatter).max() < 1e-12 * scale * dims


def test_secular_roots_lie_between_the_poles():
    rng = np.random.default_rng(9)
    for gap in (1.0, 1e-6, 1e-12):
        d = np.cumsum(rng.random(30) * gap)
        z = rng.random(30) ** 4 + 1e-6
        z /= np.linalg.norm(z)
        roots, gaps = secular_roots(d, z * z, 3.0)
        assert (gaps[np.arange(30), np.arange(30)] < 0).all()  # behind their own pole
        assert (np.diag(gaps, -1) > 0).all()  # and before the next
        assert np.abs(1 + 3.0 * (z * z) @ (1 / gaps)).max() < 1e-9 * (3.0 * (z * z) @ np.abs(1 / gaps)).max()
