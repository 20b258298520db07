"""Clustering against plain Lloyd rounds, and the tree against all distances."""

import hashlib

import numpy as np
import pytest

from turnloom.llm import centroid_clustering as clustering


def _plain(rows, k, rounds, dims):
    kept = [(i, np.floor(64 * np.array(v, float)).astype(np.int64)) for i, v in rows
            if v is not None and len(v) == dims and all(c is not None and np.isfinite(c) and abs(64 * c) < 2 ** 27 for c in v)]
    if not kept:
        return []
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1].tolist()))
    centroids = [x.tolist() for _, x in order[:k]]

    def nearest(x):
        return min((sum((int(a) - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(nearest(x)[1], []).append(x)
        for n, members in groups.items():
            centroids[n] = [int(sum(int(m[j]) for m in members)) // len(members) for j in range(dims)]
    found = [(i, *nearest(x)) for i, x in kept]
    total = sum(f[1] for f in found)
    return sorted(((i, n, d, sum(f[1] for f in found if f[2] == n), total,
                    hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, d, n in found), key=repr)


def _run(spark, rows, k=5, rounds=3, dims=4, schema="vec_id LONG, embedding ARRAY<DOUBLE>"):
    df = spark.createDataFrame(rows, schema).repartition(3)
    return sorted((tuple(r) for r in clustering.cluster(df, k=k, rounds=rounds, dims=dims).collect()), key=repr)


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_equals_plain_rounds(spark, seed):
    rng = np.random.default_rng(seed)
    # few values, so that equal distances and equal vectors are common
    rows = [(int(i), (rng.integers(-3, 4, 4) / 64).tolist()) for i in range(300)]
    rows += [rows[5]] * 120 + [(300, None), (301, [0.0, None, 0.0, 0.0]), (302, [float("nan")] * 4), (303, [float("inf")] * 4),
                               (304, [1.0]), (305, []), (306, [1e300] * 4), (None, [0.5] * 4), (307, [-1000.25, 3.5, 0.01, 9e5])]
    assert _run(spark, rows) == _plain(rows, 5, 3, 4)


def test_few_vectors_and_empty_tables(spark):
    rows = [(1, [0.0, 0.0]), (2, [1.0, 1.0])]
    assert _run(spark, rows, dims=2) == _plain(rows, 5, 3, 2)
    assert _run(spark, [], dims=2) == []
    assert _run(spark, [(1, None)], dims=2) == []
    same = [(i, [0.25, 0.25]) for i in range(40)]
    assert _run(spark, same, dims=2) == _plain(same, 5, 3, 2)


def test_clashing_columns_are_ignored(spark):
    df = spark.createDataFrame([(1, [0.5, 0.5], 7, 8, 9), (2, [0.1, 0.1], 7, 8, 9)],
                               "cluster LONG, x ARRAY<FLOAT>, id INT, distance INT, v INT")
    found = clustering.cluster(df, "cluster", "x", k=1, dims=2)
    assert found.columns == ["cluster", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(r[0] for r in found.collect()) == [1, 2]


@pytest.mark.parametrize("k, dims, spread", [(1, 3, 5), (16, 2, 2), (200, 3, 4), (300, 8, 50), (40, 1, 0)])
def test_tree_finds_the_nearest_with_the_smallest_number(k, dims, spread):
    rng = np.random.default_rng(k)
    points = rng.integers(-spread, spread + 1, (k, dims))
    queries = rng.integers(-spread - 2, spread + 3, (500, dims))
    tree = clustering.VantageTree(points)
    number, squared, computed = tree.nearest(queries)
    all_squared = ((queries[:, None] - points[None]) ** 2).sum(2)
    assert (squared == all_squared.min(1)).all() and (number == all_squared.argmin(1)).all()
    assert computed <= k * len(queries)
    if k == 200:
        assert computed < 0.7 * k * len(queries)  # most subtrees are passed over where dimensions are few


def test_large_entries_stay_exact():
    points = np.array([[2 ** 27 - 1] * 64, [-(2 ** 27) + 1] * 64, [0] * 64])
    number, squared, _ = clustering.VantageTree(points, leaf=1).nearest(points)
    assert number.tolist() == [0, 1, 2] and squared.tolist() == [0, 0, 0]
