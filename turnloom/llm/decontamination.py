"""Benchmark decontamination by greedy string tiling.

A benchmark item is found in a document as far as its words can be tiled with pieces of the document: the
longest common piece of at least ``min_match`` words first, each word used once, until none is left. The order
of the pieces does not matter, so passages whose parts were moved are found too. A document is contaminated
if the tiles cover at least ``coverage`` of an item.

Karp-Rabin hashes of ``min_match`` consecutive words, of items and documents, are the seeds; an item of fewer words
is one seed of all its words. A Bloom filter of the items' seeds passes over nearly everything else in the
documents; what is left is joined with the items' seeds, a row for each seed with all its places, so neither
side is held whole anywhere and a phrase that repeats in both makes no pairs of places. A common piece shows as a
run of seeds that advance together in item and document; the longest run of unused words is marked, and
what that leaves of other runs goes back to the queue.

Words are compared by hashes (``words``); in scripts without spaces every character is a word. Items without words
are never found, nor do null and empty texts hold anything. Rows are judged one by one, repeated rows alike. Of
items that cover alike, the smallest id is named. An empty benchmark contaminates nothing. All columns pass
through, whatever their names; ones named like an output are replaced.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.llm import bloom
from turnloom.llm.rows import Carried
from turnloom.llm.storage import stored
from turnloom.llm.words import blocks, words

MIN_MATCH = 4
COVERAGE = 0.6


def runs(at_document: list[np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """Longest runs ``(-words, item word, document word)`` of places that advance together.

    ``at_document[i]`` are the rising places in the document whose ``size`` words from there on are those from place
    ``i`` on in the item. Places are taken one item word at a time, so their products are never held.
    """
    out = []
    after, length = np.zeros(0, np.int64), np.zeros(0, np.int64)  # of the next item word
    for i in range(len(at_document) - 1, -1, -1):
        here = at_document[i]
        spot = np.minimum(np.searchsorted(after, here + 1), max(len(after) - 1, 0))
        goes_on = after[spot] == here + 1 if len(after) else np.zeros(len(here), bool)
        mine = np.where(goes_on, length[spot] + 1 if len(after) else size, size)
        before = at_document[i - 1] if i else here[:0]
        spot = np.minimum(np.searchsorted(before, here - 1), max(len(before) - 1, 0))
        begins = before[spot] != here - 1 if len(before) else np.ones(len(here), bool)
        out += [(-n, i, d) for n, d in zip(mine[begins].tolist(), here[begins].tolist())]
        after, length = here, mine
    return out


def tiles(at_document: list[np.ndarray], size: int) -> list[tuple[int, int, int]]:
    """Tiles ``(document word, item word, words)`` in the order they are marked; arguments as for ``runs``.

    Of runs of equal length, the one earliest in the item, then in the document, comes first.
    """
    queue = runs(at_document, size)
    heapq.heapify(queue)
    reach = max((d - n for n, _, d in queue), default=0)
    used_item = np.zeros(len(at_document) + size, bool)
    used_document = np.zeros(reach + 1, bool)
    out = []
    while queue:
        n, item, document = heapq.heappop(queue)
        n = -n
        used = used_item[item:item + n] | used_document[document:document + n]
        if not used.any():
            out.append((document, item, n))
            used_item[item:item + n] = used_document[document:document + n] = True
            continue
        edges = np.flatnonzero(np.diff(np.concatenate(([True], used, [True])).astype(np.int8)))
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= size:
                heapq.heappush(queue, (start - end, item + start, document + start))
    return out


def _seeds(df: DataFrame, key: list[str], sizes: list[int], short: bool, filter_: "tuple | None" = None) -> DataFrame:
    """``key``, each seed of the last column's texts with its places, the text's number of words and the seed's."""
    bits, sent = filter_ or (0, None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.frombuffer(zlib.decompress(sent.value), np.uint8) if sent else None
        for batch in batches:
            texts = batch.column(len(key))
            for start, end in blocks(texts):
                w = words(texts.slice(start, end - start))
                counts = np.bincount(w.row, minlength=w.n)
                begin = np.concatenate(([0], np.cumsum(counts)))[:-1]
                for size in sizes:
                    row, value, first = w.windows(size, short=short)
                    if held is not None:
                        found = bloom.has(held, bloom.places(value, bits))
                        row, value, first = row[found], value[found], first[found]
                    order = np.lexsort((first, value, row))
                    row, value, first = row[order], value[order], first[order]
                    new = np.ones(len(row), bool)
                    new[1:] = (row[1:] != row[:-1]) | (value[1:] != value[:-1])
                    lists = np.append(np.flatnonzero(new), len(row))
                    place = pa.array((first - begin[row]).astype(np.int32))
                    row, value = row[new], value[new]
                    at = pa.array(row + start)
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(k).take(at) for k in range(len(key))), pa.array(value.view(np.int64)),
                         pa.ListArray.from_arrays(pa.array(lists.astype(np.int32)), place), pa.array(counts[row].astype(np.int32)),
                         pa.array(np.minimum(counts[row], size).astype(np.int32))],
                        names=[*key, "seed", "places", "n", "size"])

    return df.mapInArrow(run, T.StructType([
        *(df.schema[k] for k in key), T.StructField("seed", T.LongType()), T.StructField("places", T.ArrayType(T.IntegerType())),
        T.StructField("n", T.IntegerType()), T.StructField("size", T.IntegerType())]))


def overlaps(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id",
             item_text: str = "text", item_id: str = "item_id", min_match: int = MIN_MATCH) -> DataFrame:
    """``_id, _hash, item, covered``: share of each item that tiles of each document cover, where they share a seed.

    ``_hash`` is a hash of the document's text, which tells rows with one id apart.
    """
    spark = docs.sparkSession
    asked = benchmark.select(F.col(f"`{item_id}`").alias("item"), F.col(f"`{item_text}`").cast("string").alias("t"))
    # Items that share an id are told apart by their texts.
    items = asked.select("item", F.xxhash64("t").alias("which"), "t").distinct()
    items = stored(_seeds(items, ["item", "which"], [min_match], True), "benchmark-seeds")
    sizes = sorted(row.size for row in items.select("size").distinct().collect())  # at most min_match of them
    bits = bloom.size_for(items.count())
    # A row of a few thousand seeds at a time keeps Arrow batches small.
    chunks = items.groupBy(F.pmod("seed", F.lit(1024))).agg(F.collect_set("seed").alias("s")).select("s")
    sent = spark.sparkContext.broadcast(zlib.compress(bloom.build(chunks, bits, False), 1))
    keyed = docs.select(F.col(f"`{doc_id}`").alias("_id"), _text_hash(text).alias("_hash"), F.col(f"`{text}`").cast("string").alias("t"))
    points = _seeds(keyed, ["_id", "_hash"], sizes or [min_match], False, (bits, sent))
    points = points.select("_id", "_hash", "seed", "size", F.col("places").alias("at"))
    joined = (points.join(items, ["seed", "size"]).groupBy("_id", "_hash", "item", "which", "n", "size")
              .agg(F.collect_set(F.struct("at", "places")).alias("seeds")))

    def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            share = []
            for n, size, seeds in zip(batch.column("n").to_pylist(), batch.column("size").to_pylist(), batch.column("seeds")):
                at_document = [np.zeros(0, np.int64)] * (n - size + 1)
                for seed in seeds.values:
                    at = seed["at"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                    for place in seed["places"].as_py():
                        at_document[place] = at
                share.append(sum(k for _, _, k in tiles(at_document, size)) / n)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_id", "_hash", "item")), pa.array(share, pa.float64())],
                                             names=["_id", "_hash", "item", "covered"])

    fields = [joined.schema[c] for c in ("_id", "_hash", "item")]
    return joined.mapInArrow(tiled, T.StructType([*fields, T.StructField("covered", T.DoubleType())]))


def _text_hash(text: str):
    return F.xxhash64(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")))


def flag(docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id", item_text: str = "text",
         item_id: str = "item_id", min_match: int = MIN_MATCH, coverage: float = COVERAGE, keep_text: bool = True) -> DataFrame:
    """``docs`` with ``contaminated``, ``n_items`` found, and the ``covered`` share and id of the best ``item``.

    ``item`` is null and ``covered`` 0 for documents that share no seed with any item.
    """
    own = Carried(docs, ["contaminated", "n_items", "covered", "item", *([] if keep_text else [text])])
    found = (overlaps(docs, benchmark, text, doc_id, item_text, item_id, min_match).groupBy("_id", "_hash")
             .agg(F.max("covered").alias("covered"), F.max(F.when(F.col("covered") >= coverage, True)).alias("contaminated"),
                  F.sum((F.col("covered") >= coverage).cast("long")).alias("n_items"),
                  F.min_by("item", F.struct(-F.col("covered"), F.col("item"))).alias("item")))
    # Stored, so that its size is known: as a rule it is small, and then no text is shuffled.
    found = stored(found, "benchmark-found").withColumnsRenamed({"_id": "_of", "_hash": "_text"})
    work = docs.select(own.packed(), F.col(f"`{doc_id}`").alias("_id"), _text_hash(text).alias("_hash"))
    joined = work.join(found, work["_id"].eqNullSafe(found["_of"]) & (work["_hash"] == found["_text"]), "left")
    return joined.select(*own.columns(), F.coalesce("contaminated", F.lit(False)).alias("contaminated"),
                         F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
                         F.coalesce("covered", F.lit(0.0)).alias("covered"), "item")
