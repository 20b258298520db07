"""Lloyd's clustering of integer vectors with a vantage-point tree over the centroids.

Each round builds a tree over the current centroids and broadcasts it. A task searches it best first for every
vector: the subtree with the smallest lower bound is opened next, and a subtree is passed over only if its bound
lies above the best distance found, so centroids at an equal distance are always met and the smaller number wins.
Bounds are floating point and taken a little too low; distances are exact integers. A task advances the searches
of a block of vectors together, each vector in its own order.

New centroids are the exact floor of sum by count per component; empty clusters keep theirs. Tasks add up their
own vectors first, so one cluster may hold any share of them, and the driver sees centroids only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom.llm import vectors
from turnloom.llm.storage import stored

LIMIT = 1 << 27  # scaled entries below this have squared distances that fit a long
LEAF = 3
BLOCK = 1 << 21  # bounds held at a time: vectors of a block times nodes of the tree


class VantageTree:
    """Nearest of some integer points, with ties going to the smaller number.

    A node has a vantage point and two subtrees: the points up to its median distance and the others, each with
    the smallest and largest distance from the vantage point. A leaf has a few points.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = np.asarray(points, np.int64)
        self.leaf = leaf
        self.members: list[np.ndarray] = []  # of a leaf: its points; of a node: its vantage point
        self.children: list[list[tuple[int, float, float]]] = []
        waiting = [(np.arange(len(self.points)), None, 0.0, 0.0)]
        while waiting:
            inside, parent, low, high = waiting.pop()
            node = len(self.members)
            if parent is not None:
                self.children[parent].append((node, low, high))
            self.children.append([])
            if len(inside) <= leaf:
                self.members.append(inside)
                continue
            centre = self.points[inside].mean(axis=0)
            vantage = inside[np.argmax(((self.points[inside] - centre) ** 2).sum(axis=1))]
            rest = inside[inside != vantage]
            squared = self._squared(self.points[rest], self.points[vantage])
            near = squared <= np.partition(squared, len(squared) // 2)[len(squared) // 2]
            if near.all():
                near = squared < squared.max()
            if not near.any():  # all at one distance: nothing to divide by
                self.members.append(inside)
                continue
            self.members.append(np.array([vantage]))
            for side in (near, ~near):
                distances = np.sqrt(squared[side].astype(float))
                waiting.append((rest[side], node, distances.min(), distances.max()))

    @staticmethod
    def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        difference = a - b
        return np.einsum("ij,ij->i", difference, difference)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """For each row its nearest point and the squared distance, and how many distances were computed."""
        count = len(queries)
        best = np.full(count, np.iinfo(np.int64).max)
        number = np.full(count, len(self.points), np.int64)
        computed = 0
        if not len(self.points) or not count:
            return number, best, computed
        bound = np.full((count, len(self.members)), np.inf)
        bound[:, 0] = 0.0
        rows = np.arange(count)
        while len(rows):
            node = np.argmin(bound[rows], axis=1)
            low = bound[rows, node]
            open_ = low <= np.sqrt(best[rows].astype(float))  # inclusive: an equal distance may have a smaller number
            rows, node, low = rows[open_], node[open_], low[open_]
            bound[rows, node] = np.inf
            for v in np.unique(node):
                at = rows[node == v]
                block = queries[at]
                for p in self.members[v]:
                    squared = self._squared(block, self.points[p])
                    computed += len(at)
                    better = (squared < best[at]) | ((squared == best[at]) & (p < number[at]))
                    best[at[better]], number[at[better]] = squared[better], p
                if self.children[v]:
                    distance = np.sqrt(squared.astype(float))
                    for child, least, most in self.children[v]:
                        gap = np.maximum(distance - most, least - distance) - 1e-12 * (distance + most)
                        bound[at, child] = np.maximum(gap, low[node == v])
        return number, best, computed

    def blocks(self, count: int):
        """Ranges of vectors whose bounds fit the block size."""
        size = max(1, BLOCK // max(1, len(self.members)))
        return ((start, min(start + size, count)) for start in range(0, count, size))


def _assigned(df: DataFrame, centroids: np.ndarray, keep: list[str]) -> DataFrame:
    """``df`` (``x`` and others) with ``cluster`` and ``distance``, without ``x``."""
    shared = df.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def assign(batches):
        tree = shared.value
        for batch in batches:
            x = vectors.matrix(batch.column("x"), tree.points.shape[1])
            for start, end in tree.blocks(len(x)):
                number, squared, _ = tree.nearest(x[start:end])
                part = batch.slice(start, end - start)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), pa.array(number.astype(np.int32)), pa.array(squared)],
                    names=[*keep, "cluster", "distance"])

    fields = [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep]
    return df.mapInArrow(assign, ", ".join([*fields, "cluster int", "distance bigint"]))


def _moved(df: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round; tasks give sums and counts per cluster."""
    k, dims = centroids.shape
    shared = df.sparkSession.sparkContext.broadcast(VantageTree(centroids))

    def add_up(batches):
        tree = shared.value
        sums = np.zeros((k, dims + 1), np.int64)
        for batch in batches:
            x = vectors.matrix(batch.column("x"), dims)
            for start, end in tree.blocks(len(x)):
                number, _, _ = tree.nearest(x[start:end])
                order = np.argsort(number, kind="stable")
                found, first = np.unique(number[order], return_index=True)
                sums[found, :dims] += np.add.reduceat(x[start:end][order], first, axis=0)
                sums[found, dims] += np.diff(np.append(first, end - start))
        used = np.flatnonzero(sums[:, dims])
        rows = vectors.cells(sums[used])
        yield pa.RecordBatch.from_arrays(
            [pa.array(used[rows.column("i").to_numpy()].astype(np.int32)), rows.column("j"), rows.column("value")], names=["i", "j", "value"])

    parts = df.select("x").mapInArrow(add_up, vectors.cells_schema("bigint"))
    sums = vectors.summed(parts, k, dims + 1, object)
    shared.unpersist()
    moved = centroids.copy()
    for c in range(k):
        if sums[c, dims]:
            moved[c] = [int(s) // int(sums[c, dims]) for s in sums[c, :dims]]
    return moved


def cluster(
    df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 16, rounds: int = 3, dims: int = 64,
    seed: str = "1:", scale: int = vectors.SCALE,
) -> DataFrame:
    """``id_col, cluster int, distance long, cluster_inertia, inertia, centroid_sha256`` of every usable vector.

    * Used are vectors of exactly ``dims`` entries, none null, non-finite or so large that a squared distance would
      not fit a long (``2**27`` after scaling). All others, and null vectors, have no row.
    * Entries become ``floor(scale * entry)``. The ``k`` vectors with the smallest SHA-256 of seed and id are the
      first centroids, in that order (equal ids: by their entries; null ids last); fewer vectors make fewer.
    * Repeated rows count and are returned as often as they occur. Extra columns are ignored, whatever their names.
      An empty table gives no rows. An
      inertia that does not fit a long is null.
    """
    key = "id"
    held = df.select(F.col(f"`{id_col}`").alias(key), F.col(f"`{vector_col}`").alias("v"))
    held = held.filter((F.size("v") == dims) & vectors.usable("v", LIMIT, scale))
    held = stored(held.select(key, vectors.integers("v", scale).cast("array<int>").alias("x")), "clustering-vectors")
    order = F.sha2(F.concat(F.lit(seed), F.col(key).cast("string")), 256)
    first = held.orderBy(order.asc_nulls_last(), "x").limit(k).select("x").collect()
    centroids = np.array([row.x for row in first], np.int64).reshape(-1, dims)
    spark = df.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {held.schema[key].dataType.simpleString()}, cluster int, distance bigint, "
                                         "cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    for _ in range(rounds):
        centroids = _moved(held, centroids)
    found = stored(_assigned(held, centroids, [key]), "clustering-assigned")
    sums = found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"))
    inertia = {row.cluster: int(row.total) for row in sums.collect()}
    total = sum(inertia.values())

    def long(value):
        return F.lit(value if value < 1 << 63 else None).cast("long")

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    at = F.col("cluster") + 1
    return found.select(
        F.col(key).alias(id_col), "cluster", "distance",
        F.element_at(F.array(*(long(inertia.get(c, 0)) for c in range(len(centroids)))), at).alias("cluster_inertia"),
        long(total).alias("inertia"),
        F.element_at(F.array(*map(F.lit, digests)), at).alias("centroid_sha256"))
