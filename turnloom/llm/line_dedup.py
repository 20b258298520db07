"""Removal of lines that many documents share, with two Bloom filters in front of the shuffle.

A line's key is the line without ASCII spaces at its ends and with A-Z in lower case. Keys of at least
``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines except in the
document with the largest id among those that hold them.

1. Every task adds the keys of its documents to a filter of keys seen once, and those it has met before to a
   filter of keys seen twice. The filters of all tasks are put together segment by segment: a bit is set in
   the twice filter if it is set in the once filter of two tasks. No repeated key is missed.
2. Only keys that the twice filter suspects are shuffled. Counting them confirms the repeats and finds the
   largest id. Counts are combined in the tasks, so a line may stand in any share of the documents.
3. The keys to remove are gathered per document and joined with the texts.

The filters have ``bits`` bits each, by default 256 for each document between 2^20 and 2^29 (64 MB). With
more keys than they can tell apart, more keys are suspected and counted; the result stays the same.

Keys are compared by two 64-bit hashes. A null or empty text is one empty line. Rows with one id are one
document, those without an id too; rows that share the largest id all keep their lines, and a null id is smaller
than any other.
An empty table gives an empty table; other columns pass through, ones named like an output are replaced.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import bloom
from turnloom.llm.rows import Carried
from turnloom.llm.storage import stored

SPACES = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_LOWER = str.maketrans(UPPER, UPPER.lower())


def _with_keys(df: DataFrame, text: str, min_chars: int) -> DataFrame:
    """``_a, _b``: two hashes of each different key that is long enough."""
    lines = F.split(F.translate(F.coalesce(F.col(f"`{text}`"), F.lit("")), UPPER, UPPER.lower()), "\n")
    keys = F.transform(lines, lambda line: F.btrim(line, F.lit(SPACES)))
    long = F.array_distinct(F.filter(keys, lambda k: F.length(k) >= min_chars))
    return (df.withColumn("_k", long)
            .withColumn("_a", F.transform("_k", lambda k: F.xxhash64(k)))
            .withColumn("_b", F.transform("_k", lambda k: F.xxhash64(F.lit(1), k))).drop("_k"))


def dedup_lines(df: DataFrame, text: str = "text", doc_id: str = "doc_id", out: str = "kept_text",
                min_chars: int = 40, min_docs: int = 5, bits: int | None = None) -> DataFrame:
    """``df`` with ``n_lines``, ``n_dropped`` and the text that is left, in ``out``."""
    spark = df.sparkSession
    own = Carried(df, ["n_lines", "n_dropped", out])
    work = df.select(own.packed(), F.col(f"`{doc_id}`").alias("_id"), F.col(f"`{text}`").cast("string").alias("_t"))
    bits = bits or bloom.size_for(df.count(), 256)
    keyed = _with_keys(work.select("_id", "_t"), "_t", min_chars)
    keyed = keyed.select("_id", "_a", "_b").filter(F.size("_a") > 0)
    suspected = spark.sparkContext.broadcast(zlib.compress(bloom.build(keyed.select("_a"), bits, True), 1))
    id_type = work.schema["_id"].dataType

    def suspects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_ = None
        for batch in batches:
            if filter_ is None:
                filter_ = np.frombuffer(zlib.decompress(suspected.value), np.uint8)
            a = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            found = np.flatnonzero(bloom.has(filter_, bloom.places(a, bits)))
            row = batch.column(1).value_parent_indices().to_numpy(zero_copy_only=False)[found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(row)), pa.array(a[found]), batch.column(2).flatten().take(pa.array(found))],
                names=["_id", "_a", "_b"])

    pairs = stored(keyed.mapInArrow(suspects, T.StructType([
        T.StructField("_id", id_type), T.StructField("_a", T.LongType()), T.StructField("_b", T.LongType())])), "lines-suspects")
    # Stored as well, so that the join is dealt out anew and can split a line that very many documents share.
    repeats = stored(pairs.groupBy("_a", "_b", "_id").agg(F.lit(1).alias("one")).groupBy("_a", "_b")
                     .agg(F.count("*").alias("n"), F.max("_id").alias("_last"))
                     .filter(F.col("n") >= min_docs).select("_a", "_b", "_last"), "lines-repeats")
    drops = (pairs.join(repeats, ["_a", "_b"]).filter(~F.col("_id").eqNullSafe(F.col("_last")))
             .groupBy("_id").agg(F.collect_set("_a").alias("_drop")).withColumnRenamed("_id", "_of"))
    joined = work.join(drops, work["_id"].eqNullSafe(drops["_of"]), "left").select("row", "_t", "_drop")

    def removed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, n_lines, n_dropped = [], [], []
            for value, drop in zip(batch.column("_t"), batch.column("_drop")):
                value = value.as_py() or ""
                lines = n = value.count("\n") + 1
                if drop.is_valid:
                    gone = set(drop.as_py())
                    left = [line for line in value.split("\n") if _key_hash(line, min_chars) not in gone]
                    value, n = "\n".join(left), len(left)
                kept.append(value)
                n_lines.append(lines)
                n_dropped.append(lines - n)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(kept, pa.string())],
                names=["row", "n_lines", "n_dropped", "kept"])

    done = joined.mapInArrow(removed, T.StructType([
        joined.schema["row"], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
        T.StructField("kept", T.StringType())]))
    return done.select(*own.columns(), "n_lines", "n_dropped", F.col("kept").alias(out))


def _key_hash(line: str, min_chars: int) -> int | None:
    """Spark's ``xxhash64`` of the line's key, if that is long enough."""
    key = line.strip(SPACES).translate(_LOWER)
    if len(key) < min_chars:
        return None
    value = xxhash.xxh64_intdigest(key.encode("utf-8", "replace"), 42)
    return value - (1 << 64) if value >> 63 else value
