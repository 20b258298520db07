"""Helpers for functions over Arrow batches."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame


def drop_column(df: DataFrame, name: str) -> DataFrame:
    """``df`` without a column of that name, in any case of letters."""
    return df.select([df[f"`{c}`"] for c in df.columns if c.lower() != name.lower()])


def mapped(batch: pa.RecordBatch, name: str, column: pa.Array, without: Iterable[str] = ()) -> pa.RecordBatch:
    """``batch`` without some of its columns and with one more."""
    names = [n for n in batch.schema.names if n not in without]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), column], names=[*names, name])


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of so many rows, to hold fewer results at a time."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)
