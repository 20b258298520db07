"""Hashed n-gram vectors of texts, and bounded samples to fit models on."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnloom.llm.storage import stored
from turnloom.llm.words import blocks, text_bytes

SCALE = 1 << 30
SENT = 50_000
SALTS = 64


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: CRC-32 of its id modulo 4 is 2. Never for a null id."""
    crc = F.crc32(F.col(f"`{doc_id}`").cast("string").cast("binary"))
    return F.coalesce(crc % 4 == 2, F.lit(False))


def sample(df: DataFrame, by: str | None, size: int, key: str) -> DataFrame:
    """At most ``size`` rows of each value of ``by`` (or of all rows), chosen by a hash of ``key``.

    With ``by``, rows of one value that share ``key`` count as one and give one row. Counts set a threshold on the
    hash, so hardly more rows than these are moved or sorted, however large a group is. Thresholds are sent
    to the tasks as long as there are at most ``SENT``; otherwise rows of a value are dealt over ``SALTS`` keys.
    """
    def threshold(n):
        return F.least(F.lit(1.0), F.lit(1.3 * size + 20) / F.greatest(n, F.lit(1))) * SCALE

    hashed = df.withColumn("_h", F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(SCALE)))
    if by is None:
        return hashed.filter(F.col("_h") < threshold(F.lit(df.count()))).orderBy("_h", key).limit(size).drop("_h")
    counts = (df.select(F.col(f"`{by}`").alias("_by"), F.xxhash64(F.col(f"`{key}`")).alias("_x")).filter("_by IS NOT NULL").distinct()
              .groupBy("_by").agg(F.count("*").alias("n")))
    limits = stored(counts.select("_by", threshold(F.col("n")).cast("long").alias("_limit")), "sample-limits")
    if limits.count() <= SENT:
        near = hashed.join(F.broadcast(limits), hashed[f"`{by}`"] == limits["_by"])
    else:
        salted = hashed.withColumn("_salt", F.pmod(F.col("_h"), F.lit(SALTS)).cast("int"))
        every = limits.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("_salt", "_of")
        near = salted.join(every, (salted[f"`{by}`"] == every["_by"]) & (salted["_salt"] == every["_of"])).drop("_salt", "_of")
    near = near.filter(F.col("_h") < F.col("_limit")).withColumn("_x", F.xxhash64(F.col(f"`{key}`")))
    once = near.dropDuplicates([by, "_x"]).withColumn("_k", F.row_number().over(W.partitionBy(by).orderBy("_h", key)))
    return once.filter(F.col("_k") <= size).drop("_h", "_k", "_x", "_by", "_limit")


def counted(data: np.ndarray, row: np.ndarray, n: int, sizes: tuple[int, ...], width: int) -> np.ndarray:
    """Counts of hashed n-grams, a row of ``width`` (a power of two) for each text.

    ``data`` holds byte codes and ``row`` their texts' numbers, in order. N-grams stay within a text.
    """
    out = np.zeros(n * width, np.float32)
    for size in sizes:
        m = len(data) - size + 1
        if m <= 0:
            continue
        code = np.full(m, size, np.uint32)
        for i in range(size):
            code = code * np.uint32(0x01000193) ^ data[i:i + m]
        code = (code * np.uint32(0x9E3779B1)) >> np.uint32(32 - (width - 1).bit_length())
        same = row[:m] == row[size - 1:]
        out += np.bincount(row[:m][same] * width + code[same], minlength=n * width).astype(np.float32)
    return out.reshape(n, width)


def vectors(column: pa.Array, features, idf: np.ndarray | None = None, block_bytes: int = 1 << 18):
    """Blocks of at most 256 texts: their range and TF-IDF vectors of length one (zero for empty texts).

    ``features(data, row, n)`` gives counts; without ``idf`` the counts themselves come back.
    """
    for start, end in blocks(column, block_bytes):
        for a in range(start, end, 256):
            b = min(a + 256, end)
            data, bounds = text_bytes(column.slice(a, b - a))
            row = np.repeat(np.arange(b - a), np.diff(bounds))
            x = features(data, row, b - a)
            yield a, b, x if idf is None else weighted(x, idf)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return unit(x)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


def inverse_frequency(counts: np.ndarray) -> np.ndarray:
    """IDF of the columns of a count matrix."""
    found = (counts > 0).sum(axis=0)
    return np.log((1 + len(counts)) / (1 + found)).astype(np.float32) + 1
