"""Dense text encoder: randomised singular value decomposition of the hashed TF-IDF matrix of all texts.

Terms are hashed to a fixed number of cells, so the matrix has a row a text and ``features`` columns, and all that leaves
a task has a size set by ``features`` and ``dimensions`` alone. A round multiplies the matrix with a block of vectors and
its transpose with the result: each task adds up its own rows, the sums of 32 tasks are joined level by level, and the
driver orthonormalises the small side. A last pass finds the singular values within the block (Rayleigh-Ritz).
The texts are tokenised once and stored as lists of cells.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import text as T
from turnloom.scaling import stored

DIMENSIONS = 384
FEATURES = 1 << 14
_FAN_IN = 32  # sums joined by one task
_BLOCK = 256  # rows of a sum that travel together
_PRODUCTS = 8_192  # entries taken together
_FEW = 3  # entries a row below which rows are not multiplied one by one
_GATHERED = 512  # rows of a product held at once then: they stay in the processor's cache


def _cells(text: Column, features: int) -> Column:
    return F.transform(T.intent_terms(F.coalesce(text, F.lit(""))),
                       lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))


def _entries(cells: pa.ListArray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, column and value of the unit TF-IDF rows, by row and column. A text without terms is a zero row."""
    rows = np.repeat(np.arange(len(cells)), np.diff(cells.offsets.to_numpy()))
    places, counts = np.unique(rows * len(idf) + cells.flatten().to_numpy(zero_copy_only=False), return_counts=True)
    rows, columns = np.divmod(places, len(idf))
    values = counts * idf[columns]
    norms = np.sqrt(np.bincount(rows, values * values, minlength=len(cells)))
    return rows, columns, values / norms[rows]


def _add_product(total: np.ndarray, rows: np.ndarray, columns: np.ndarray, values: np.ndarray, right: np.ndarray) -> None:
    """Add the sparse matrix of the given entries, ordered by row, times ``right`` to ``total``."""
    for start in range(0, len(rows), _PRODUCTS):
        stop = min(start + _PRODUCTS, len(rows))
        starts = np.flatnonzero(np.diff(rows[start:stop], prepend=-1)) + start
        if len(starts) * _FEW <= stop - start:  # enough entries a row for a vector times a matrix
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), stop]):
                total[rows[a]] += values[a:b] @ right[columns[a:b]]
            continue
        for a in range(start, stop, _GATHERED):
            part = slice(a, min(a + _GATHERED, stop))
            firsts = np.flatnonzero(np.diff(rows[part], prepend=-1))
            total[rows[part][firsts]] += np.add.reduceat(values[part, None] * right[columns[part]], firsts)


def _projected(cells: pa.ListArray, idf: np.ndarray, basis: np.ndarray):
    entries = _entries(cells, idf)
    product = np.zeros((len(cells), basis.shape[1]))
    _add_product(product, *entries, basis)
    return entries, product


def _tree_sum(rows: DataFrame, step: Callable, idf: np.ndarray, basis: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sum over all rows of what ``step(total, entries, product)`` adds to a zero matrix of ``shape``."""
    held = rows.sparkSession.sparkContext.broadcast((idf, basis))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                step(total, *_projected(batch.column("cells"), *held.value))
        number = TaskContext.get().partitionId()
        for block, start in enumerate(range(0, len(total), _BLOCK)):
            if (part := total[start:start + _BLOCK]).any():
                yield pa.RecordBatch.from_pylist([{"task": number, "block": block, "total": part.tobytes()}], schema)

    def joined(table: pa.Table) -> pa.Table:
        sums = sum(np.frombuffer(value.as_buffer()) for value in table.column("total"))
        row = {"task": table.column("task")[0].as_py() // _FAN_IN, "block": table.column("block")[0].as_py(),
               "total": sums.tobytes()}
        return pa.Table.from_pylist([row], schema)

    schema = pa.schema([("task", pa.int64()), ("block", pa.int64()), ("total", pa.binary())])
    names = "task BIGINT, block BIGINT, total BINARY"
    sums, tasks = rows.mapInArrow(task, names), rows.rdd.getNumPartitions()
    while tasks > 1:
        sums = sums.groupBy("block", F.expr(f"task div {_FAN_IN}")).applyInArrow(joined, names)
        tasks = -(-tasks // _FAN_IN)
    total = np.zeros(shape)
    for row in sums.select("block", "total").collect():  # one row a block
        part = np.frombuffer(row.total).reshape(-1, shape[1])
        total[row.block * _BLOCK:row.block * _BLOCK + len(part)] += part
    held.unpersist()
    return total


def _transposed_product(total: np.ndarray, entries, product: np.ndarray) -> None:
    rows, columns, values = entries
    order = np.argsort(columns, kind="stable")
    _add_product(total, columns[order], rows[order], values[order], product)


def _gram(total: np.ndarray, entries, product: np.ndarray) -> None:
    total += product.T @ product


@dataclass(frozen=True)
class DenseEncoder:
    """Adds ``embedding`` to rows with a ``text``: a unit vector in the space of the leading singular vectors.

    A null text counts as empty; a text without any term gets the zero vector.
    """

    idf: np.ndarray
    basis: np.ndarray  # features x dimensions
    singular_values: np.ndarray

    def __call__(self, rows: DataFrame) -> DataFrame:
        return self._encoded(rows, unit=True)

    def projected(self, rows: DataFrame) -> DataFrame:
        """As a call, but vectors keep the length that is left of their unit TF-IDF vector."""
        return self._encoded(rows, unit=False)

    def _encoded(self, rows: DataFrame, unit: bool) -> DataFrame:
        held = rows.sparkSession.sparkContext.broadcast((self.idf, self.basis))

        @F.arrow_udf("array<float>")
        def embed(cells: pa.Array) -> pa.Array:
            product = _projected(cells, *held.value)[1] if len(cells) else np.zeros((0, 1))
            if unit:
                norms = np.linalg.norm(product, axis=1, keepdims=True)
                product = np.divide(product, norms, out=np.zeros_like(product), where=norms > 0)
            flat = pa.array(product.astype(np.float32).ravel())
            return pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * product.shape[1]), flat)

        return rows.withColumn("embedding", embed(_cells(F.col("text"), len(self.idf))))


def fit(texts: DataFrame, dimensions: int = DIMENSIONS, features: int = FEATURES, rounds: int = 2,
        oversample: int = 16, seed: int = 7) -> DenseEncoder:
    """Encoder of ``dimensions`` numbers from every row of ``texts(text)``.

    More ``rounds`` sharpen the smaller singular values. Directions beyond the rank of the matrix are arbitrary and
    have the singular value 0; an empty table gives such an encoder.
    """
    if not 0 < dimensions <= features:
        raise ValueError("dimensions must lie in 1 to features")
    rows = stored(texts.select(_cells(F.col("text"), features).alias("cells")), "cells")
    found = rows.select(F.explode(F.array_distinct("cells")).alias("cell")).groupBy("cell").count().collect()
    frequency = np.zeros(features)
    for row in found:  # one row a feature at most
        frequency[row.cell] = row["count"]
    idf = np.log((1 + rows.count()) / (1 + frequency)) + 1
    width = min(dimensions + oversample, features)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((features, width)))[0]
    for _ in range(rounds):
        basis = np.linalg.qr(_tree_sum(rows, _transposed_product, idf, basis, (features, width)))[0]
    values, turned = np.linalg.eigh(_tree_sum(rows, _gram, idf, basis, (width, width)))
    leading = np.argsort(-values, kind="stable")[:dimensions]
    basis = basis @ turned[:, leading]
    basis *= np.where(basis[np.abs(basis).argmax(axis=0), np.arange(dimensions)] < 0, -1.0, 1.0)
    return DenseEncoder(idf, basis, np.sqrt(np.maximum(values[leading], 0)))
