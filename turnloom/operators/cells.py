"""Approximate search for batches of queries: vectors in cells around centroids, queries sent to the nearest cells.

The centroids are fitted on a bounded sample (``FIT_ROWS`` vectors, chosen by a hash of their ids); every vector is
indexed. A cell is split into parts of about ``PART_ROWS`` vectors by a hash of the id, and the queries that ask for
it into blocks, so a cell may hold any share of either. A task multiplies one part with one block and passes
on k candidates a query; scores inside the cells are exact. How many cells a query asks for is measured: as many as
hold the wanted share of the true neighbours of a sample of the vectors, found by the exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from turnloom import constants as K
from turnloom.operators import vectors as exact
from turnloom.scaling import stored

FIT_ROWS = 20_000
PART_ROWS = 8_192
BLOCK_QUERIES = 2_048
PROBES = 64  # vectors whose true neighbours set the number of cells to ask


@dataclass
class Index:
    """``rows``: ``cell, part, id, embedding`` of every vector; ``centroids`` of the cells, and parts of each."""

    rows: DataFrame
    centroids: np.ndarray
    parts: dict[int, int]


def _centroids(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means over the rows of ``x``, which come in the order of their hashes."""
    centres = x[:cells].copy()
    for _ in range(rounds):
        nearest = (x @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        used = np.bincount(nearest, minlength=len(centres)) > 0
        centres[used] = exact._unit(sums[used])
    return centres


def build(vectors: DataFrame, cells: int | None = None) -> Index:
    """Index every row of ``vectors(id, embedding)`` that has an embedding; about the root of their number of cells."""
    vectors = vectors.filter(F.col("embedding").isNotNull()).select("id", "embedding")
    total = vectors.count()
    # A threshold on the hash in the scan, so that hardly more rows than the sample are sorted.
    few = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(min(1.0, (1.3 * FIT_ROWS + 20) / max(total, 1)) * (1 << 30))
    sample = vectors.filter(few).orderBy(F.xxhash64("id"), "id").limit(FIT_ROWS).select("embedding").collect()
    if not sample:
        return Index(vectors.selectExpr("0 AS cell", "0 AS part", "id", "embedding").limit(0), np.zeros((0, 1)), {})
    x = exact._unit(np.array([r.embedding for r in sample], dtype=np.float64))
    centroids = _centroids(x, min(cells or max(1, round(total ** 0.5)), len(x)))

    def assign(batches):
        for batch in batches:
            nearest = (exact._unit(exact._matrix(batch.column("embedding"))) @ centroids.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nearest.astype(np.int32)), batch.column("id"), batch.column("embedding")],
                                             names=["cell", "id", "embedding"])

    id_type, kind = (vectors.schema[c].dataType.simpleString() for c in ("id", "embedding"))
    placed = stored(vectors.mapInArrow(assign, f"cell INT, id {id_type}, embedding {kind}"), "cells")
    counts = {r.cell: r.n for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # a row a cell
    parts = {c: -(-n // PART_ROWS) for c, n in counts.items()}
    number = F.element_at(F.create_map(*(F.lit(v) for c in parts.items() for v in c)), F.col("cell"))
    return Index(placed.withColumn("part", F.pmod(F.xxhash64("id"), number).cast("int")), centroids, parts)


def cells_to_ask(index: Index, vectors: DataFrame, k: int = K.TOP_K, share: float = 0.95) -> int:
    """The least number of nearest cells that hold ``share`` of the true ``k`` neighbours of some of the vectors."""
    if not len(index.centroids):
        return 0
    asked = vectors.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64(F.lit(1), "id"), "id").limit(PROBES)
    asked = asked.select(F.monotonically_increasing_id().alias("qid"), "embedding").collect()
    queries = vectors.sparkSession.createDataFrame([(i, r.embedding) for i, r in enumerate(asked)], "qid BIGINT, embedding ARRAY<DOUBLE>")
    found = exact.top_k(queries, vectors, k).join(index.rows.select("id", "cell"), "id").select("qid", "cell").collect()
    order = np.argsort(-(exact._unit(np.array([r.embedding for r in asked], float)) @ index.centroids.T), axis=1)
    place = np.argsort(order, axis=1)
    ranks = np.sort([place[r.qid, r.cell] for r in found])
    return int(ranks[max(int(np.ceil(share * len(ranks))) - 1, 0)]) + 1


def search(queries: DataFrame, index: Index, k: int = K.TOP_K, ask: int = 8) -> DataFrame:
    """``qid, cosine_rank, id, cosine``: the best ``k`` of the ``ask`` cells nearest to each of ``queries(qid, embedding)``.

    Queries without an embedding have no hits; fewer vectors in the cells than ``k`` make fewer. Equal cosines are
    ordered by id.
    """
    id_type = index.rows.schema["id"].dataType.simpleString()
    queries = queries.filter(F.col("embedding").isNotNull()).select("qid", F.col("embedding").cast("array<double>").alias("embedding"))
    centroids = index.centroids
    spark = queries.sparkSession
    if not len(centroids):
        return spark.createDataFrame([], f"qid BIGINT, cosine_rank INT, id {id_type}, cosine DOUBLE")

    def nearest(batches):
        for batch in batches:
            similarity = exact._unit(exact._matrix(batch.column("embedding"))) @ centroids.T
            chosen = np.argsort(-similarity, axis=1)[:, :ask].astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("qid"), batch.column("embedding"),
                 pa.FixedSizeListArray.from_arrays(pa.array(chosen.reshape(-1)), chosen.shape[1]).cast(pa.list_(pa.int32()))],
                names=["qid", "embedding", "cells"])

    asked = queries.mapInArrow(nearest, "qid BIGINT, embedding ARRAY<DOUBLE>, cells ARRAY<INT>")
    asked = stored(asked.select("qid", "embedding", F.explode("cells").alias("cell")), "cells-asked")
    counts = {r.cell: r.n for r in asked.groupBy("cell").agg(F.count("*").alias("n")).collect()}
    sizes = spark.createDataFrame([(c, index.parts[c], -(-n // BLOCK_QUERIES)) for c, n in counts.items() if c in index.parts],
                                  "cell INT, parts INT, blocks INT")
    left = (asked.join(sizes, "cell").withColumn("block", F.expr("pmod(xxhash64(qid), blocks)").cast("int"))
            .withColumn("part", F.explode(F.expr("sequence(0, parts - 1)"))).select("cell", "part", "block", "qid", "embedding"))
    right = (index.rows.join(sizes, "cell").withColumn("block", F.explode(F.expr("sequence(0, blocks - 1)")))
             .select("cell", "part", "block", "id", "embedding"))

    def best(mine: pa.Table, others: pa.Table) -> pa.Table:
        names = ["qid", "id", "cosine"]
        if not mine.num_rows or not others.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), others.schema.field("id").type, pa.float64())], names=names)
        q, v = (exact._unit(exact._matrix(t.column("embedding").combine_chunks())) for t in (mine, others))
        similarity = q @ v.T
        few = min(k, v.shape[0])
        kth = np.partition(similarity, -few, axis=1)[:, -few]
        rows, columns = np.nonzero(similarity >= kth[:, None])
        ids = others.column("id").combine_chunks().to_numpy(zero_copy_only=False)
        chosen = exact._best(rows, ids[columns], similarity[rows, columns], k)
        return pa.table([mine.column("qid").combine_chunks().take(pa.array(rows[chosen])),
                         others.column("id").combine_chunks().take(pa.array(columns[chosen])),
                         pa.array(similarity[rows, columns][chosen])], names=names)

    keys = ["cell", "part", "block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(best, f"qid BIGINT, id {id_type}, cosine DOUBLE")
    order = W.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return found.withColumn("cosine_rank", F.row_number().over(order)).filter(F.col("cosine_rank") <= k).select(
        "qid", "cosine_rank", "id", "cosine")


def recall(found: DataFrame, wanted: DataFrame) -> float:
    """Share of the hits ``wanted(qid, id)`` that are among ``found(qid, id)``; 1 if none are wanted."""
    total, hit = wanted.join(found.select("qid", "id", F.lit(1).alias("hit")), ["qid", "id"], "left").agg(
        F.count("*"), F.count("hit")).first()
    return hit / total if total else 1.0
