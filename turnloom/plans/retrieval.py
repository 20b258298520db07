"""Chunks, their index, search and conflict-resolving answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.operators import answers, conflicts, ranking, vectors
from turnloom.scaling import materialize, stored


def build_chunks(natural: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    return natural if seeds is None else natural.unionByName(seeds)


# Adds ``embedding`` to rows with a ``text``: a fitted pipeline, or any function such as a ``mapInPandas`` model.
Encoder = PipelineModel | Callable[[DataFrame], DataFrame]


def encoded(rows: DataFrame, encoder: Encoder) -> DataFrame:
    return vectors.encode(rows, encoder) if isinstance(encoder, PipelineModel) else encoder(rows)


def index_chunks(chunks: DataFrame, dimensions: int = 256, encoder: Encoder | None = None) -> tuple[DataFrame, Encoder]:
    """Chunks with embeddings, and the encoder to use for queries: the given one, or hashed TF-IDF fitted on the chunks.

    The index is stored once as Parquet: a search reads its vectors first and its texts for the hits only.
    """
    encoder = encoder or vectors.fit_encoder(chunks, dimensions)
    return stored(encoded(chunks, encoder), "index"), encoder


def search(queries: DataFrame, index: DataFrame, k: int = K.TOP_K, max_day: int = K.MAX_DAY) -> DataFrame:
    """Re-ranked k nearest chunks for ``queries(qid, embedding)``.

    Only ids and vectors go through the search; the text and metadata of the k rows per query are
    looked up afterwards, so no task carries the texts of the corpus.
    """
    # Stored, so that its size is known and Spark chooses the join; k rows per query.
    nearest = stored(vectors.top_k(queries, index, k), "nearest")
    return ranking.rerank(index.drop("embedding").join(nearest, "id"), max_day)


def resolve(queries: DataFrame, index: DataFrame, encoder: Encoder | None = None, k: int = K.TOP_K,
            scorer: conflicts.Scorer = conflicts.rule_scores, max_day: int = K.MAX_DAY) -> DataFrame:
    """Answer a batch of ``queries(qid, query, entity)``; embeddings are made unless given."""
    if "embedding" not in queries.columns:
        queries = encoded(queries.withColumn("text", F.col("query")), encoder).drop("text")
    ranked = materialize(search(queries, index, k, max_day))
    scored = conflicts.score_pairs(conflicts.top_pairs(ranked), scorer)
    return answers.assemble(queries, ranked, scored)
