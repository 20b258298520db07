"""Composite re-rank of retrieved chunks and what it changes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import measures


def rerank(hits: DataFrame, max_day: int = K.MAX_DAY) -> DataFrame:
    """Score the hits of each query by scaled cosine, recency and emotional weight.

    Needs ``qid, id, cosine, cosine_rank, day_bucket, sentiment``. Sub-scores stay visible, all
    rounded to 4; equal scores keep their cosine order. A query has at most k rows here.
    """
    of_query = W.partitionBy("qid")
    sentiment = F.coalesce("sentiment", F.lit(0.0))
    day = F.coalesce("day_bucket", F.lit(0))
    recency = day / F.lit(max_day) if max_day else F.lit(0.0)
    scored = hits.withColumns({
        "norm": measures.minmax(F.col("cosine"), of_query),
        "recency": recency,
        "emotion": F.abs(sentiment),
    })
    score = (K.WEIGHT_COSINE * F.col("norm") + K.WEIGHT_RECENCY * F.col("recency")
             + K.WEIGHT_EMOTION * F.col("emotion"))
    rounded = scored.withColumns({
        "cosine_sim": F.round("cosine", 4),
        "cosine_norm": F.round("norm", 4),
        "recency_norm": F.round("recency", 4),
        "emotional_weight": F.round("emotion", 4),
        "score": F.round(score, 4),
    }).drop("cosine", "norm", "recency", "emotion")
    order = of_query.orderBy(F.desc("score"), "cosine_rank")
    return rounded.withColumn("rank", F.row_number().over(order))


def rank_ablation(ranked: DataFrame) -> DataFrame:
    """Both ranks of every hit and how far the re-rank moved it."""
    by_cosine = W.partitionBy("qid").orderBy(F.desc("cosine_sim"), "rank")
    return (
        ranked.withColumn("cosine_only_rank", F.row_number().over(by_cosine))
        .withColumn("moved", F.col("cosine_only_rank") - F.col("rank")))


def ablation_summary(ranked: DataFrame) -> DataFrame:
    return rank_ablation(ranked).groupBy("qid").agg(
        F.count("*").alias("n_hits"), F.count_if(F.col("moved") != 0).alias("n_moved"))


def top_changes(ranked: DataFrame, n: int = K.TOP_FOR_PAIRS) -> DataFrame:
    """Ids the re-rank brought into the first ``n`` and those it dropped, per query, sorted."""
    first = F.col("rank") <= n
    first_by_cosine = F.col("cosine_only_rank") <= n
    return rank_ablation(ranked).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.when(first & ~first_by_cosine, F.col("id")))).alias("gained"),
        F.array_sort(F.collect_list(F.when(first_by_cosine & ~first, F.col("id")))).alias("dropped"))


def synthetic_positions(ranked: DataFrame, n: int = K.TOP_FOR_PAIRS) -> DataFrame:
    """Seed rows wherever they rank, next to the first ``n`` of each query."""
    return ranked.filter(F.col("synthetic") | (F.col("rank") <= n))


def sign_groups(ranked: DataFrame, n: int = K.TOP_FOR_PAIRS) -> DataFrame:
    """The first ``n`` hits of each query grouped by sentiment sign, in rank order."""
    from turnloom.functions.sentiment import sign
    top = ranked.filter(F.col("rank") <= n)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id")))
    return top.groupBy("qid", sign(F.col("sentiment")).alias("sign")).agg(
        F.transform(ordered, lambda x: x["id"]).alias("ids"))
