"""Vectors as exact integers, and helpers to add up model-sized arrays over many tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SCALE = 64


def usable(vector: str, limit: int, scale: int = SCALE) -> Column:
    """No null, and every entry finite and below ``limit`` in size after scaling."""
    entries = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < F.lit(float(limit))))
    return F.col(vector).isNotNull() & F.coalesce(entries, F.lit(False))


def integers(vector: str, scale: int = SCALE, add: int = 0) -> Column:
    """``floor(scale * c) + add`` of every entry; for usable vectors."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(add).cast("long"))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A column of arrays of ``dims`` numbers, row by row, as int64."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False).reshape(-1, dims)


def cells(array: np.ndarray) -> pa.RecordBatch:
    """The entries of a matrix as rows ``i, j, value``."""
    rows, columns = array.shape
    return pa.RecordBatch.from_pydict({
        "i": np.repeat(np.arange(rows, dtype=np.int32), columns), "j": np.tile(np.arange(columns, dtype=np.int32), rows),
        "value": np.ascontiguousarray(array).reshape(-1)})


def cells_schema(kind: str) -> str:
    return f"i int, j int, value {kind}"


def summed(parts: DataFrame, rows: int, columns: int, dtype=float) -> np.ndarray:
    """The sum of matrices that tasks gave as cells; as large as the model, whatever the table's size."""
    out = np.zeros((rows, columns), dtype)
    for row in parts.groupBy("i", "j").agg(F.sum("value").alias("value")).collect():
        out[row.i, row.j] = row.value
    return out
