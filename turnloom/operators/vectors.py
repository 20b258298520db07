"""Embeddings and exact top-k cosine search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.feature import IDF, BucketedRandomProjectionLSH, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.operators.intent import with_terms

# Query vectors held by every task at once; larger batches go through several scans.
MAX_QUERIES = 2_048


def fit_encoder(texts: DataFrame, dimensions: int = 256) -> PipelineModel:
    """Hashed TF-IDF encoder: unit vectors of ``dimensions`` numbers, no vocabulary to hold."""
    counts = HashingTF(numFeatures=dimensions, inputCol="terms", outputCol="counts")
    idf = IDF(inputCol="counts", outputCol="unused").fit(counts.transform(with_terms(texts.select("text"))))
    weigh = ElementwiseProduct(scalingVec=DenseVector(idf.idf.toArray() + 1.0), inputCol="counts",
                               outputCol="weighted")
    return PipelineModel([counts, weigh, Normalizer(p=2.0, inputCol="weighted", outputCol="vector")])


def encode(rows: DataFrame, encoder: PipelineModel) -> DataFrame:
    """Add ``embedding``. Any function adding such a column (a ``mapInPandas`` model) can replace it."""
    kept = rows.columns
    return encoder.transform(with_terms(rows)).select(
        *kept, vector_to_array("vector", "float32").alias("embedding"))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return np.divide(matrix, norms, out=np.zeros_like(matrix), where=norms > 0)


def _best(cols: np.ndarray, ids: np.ndarray, similarity: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best entries of each query: most similar first, then smallest id."""
    order = np.lexsort((np.argsort(np.argsort(ids, kind="stable"), kind="stable"), -similarity, cols))
    sorted_cols = cols[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_cols, sorted_cols)
    return order[place < k]


def _scorer(query_ids: list[int], queries: np.ndarray, k: int):
    """Per Arrow batch one matrix product; per task the k best rows of each query."""
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, id_type = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            id_type = batch.column("id").type
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            similarity = _unit(_matrix(batch.column("embedding"))) @ queries.T
            if batch.num_rows > k:
                kth = np.partition(similarity, -k, axis=0)[-k]
                rows, cols = np.nonzero(similarity >= kth)
            else:
                rows, cols = np.indices(similarity.shape).reshape(2, -1)
            found = (cols, ids[rows], similarity[rows, cols])
            if kept is not None:
                found = tuple(np.concatenate(both) for both in zip(kept, found))
            chosen = _best(*found, k)
            kept = tuple(part[chosen] for part in found)
        if kept is not None:
            cols, ids, similarity = kept
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.asarray(query_ids, dtype=np.int64)[cols]), pa.array(ids, type=id_type),
                 pa.array(similarity)], names=["qid", "id", "cosine"])
    return score


def top_k(queries: DataFrame, vectors: DataFrame, k: int = K.TOP_K) -> DataFrame:
    """``qid, cosine_rank, id, cosine``: exact k nearest of ``vectors(id, embedding)`` for each of
    ``queries(qid, embedding)``; fewer when there are fewer vectors.

    Each task multiplies its vectors with the query block, batch by batch, and passes on k candidates
    per query, so the shuffle holds candidates only, however many copies of a vector there are. A block has
    a fixed maximum size; a larger batch of queries is split by hash and scans the vectors once per block.
    Rows without an embedding are neither found nor asked for.
    """
    queries, vectors = (t.filter(F.col("embedding").isNotNull()) for t in (queries, vectors))
    n = queries.count()
    blocks = -(-n // MAX_QUERIES) if n > MAX_QUERIES else 1
    id_type = vectors.schema["id"].dataType.simpleString()
    found = None
    for block in range(blocks):
        part = queries if blocks == 1 else queries.filter(
            F.pmod(F.xxhash64("qid"), F.lit(blocks)) == block)
        rows = part.select("qid", "embedding").collect()
        if not rows:
            continue
        score = _scorer([r.qid for r in rows], _unit(np.array([r.embedding for r in rows], dtype=np.float64)), k)
        hits = vectors.select("id", "embedding").mapInArrow(score, f"qid BIGINT, id {id_type}, cosine DOUBLE")
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = vectors.sparkSession.createDataFrame([], f"qid BIGINT, id {id_type}, cosine DOUBLE")
    order = W.partitionBy("qid").orderBy(F.desc("cosine"), "id")
    return (found.withColumn("cosine_rank", F.row_number().over(order)).filter(F.col("cosine_rank") <= k)
            .select("qid", "cosine_rank", "id", "cosine"))


def approximate_top_k(query: list[float], vectors: DataFrame, k: int = K.TOP_K,
                      bucket_length: float = 0.5, tables: int = 4) -> DataFrame:
    """Approximate neighbours of one query through random projections; may return fewer than k."""
    prepared = vectors.withColumn("vector", array_to_vector(F.col("embedding").cast("array<double>")))
    lsh = BucketedRandomProjectionLSH(inputCol="vector", outputCol="hashes", bucketLength=bucket_length,
                                      numHashTables=tables, seed=42).fit(prepared)
    near = lsh.approxNearestNeighbors(prepared, DenseVector(query), k)
    # On unit vectors the distance d and the cosine c obey d^2 = 2 - 2c.
    return near.select("id", (1 - F.col("distCol") * F.col("distCol") / 2).alias("cosine"))
