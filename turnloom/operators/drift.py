"""Change between consecutive periods and its likely trigger.

Everything here works on one row (or k rows) per day, never on turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import measures

_ALTERNATIVE = ["value", "label", "score", "count", "distinct_convos", "concentration"]


def is_drift(delta: Column, overlap: Column, mood_changed: Column, tone_changed: Column,
             delta_min: float = K.SENTIMENT_DELTA_MIN, overlap_max: float = K.TOPIC_JACCARD_MAX) -> Column:
    return (delta > delta_min) | (overlap < overlap_max) | mood_changed | tone_changed


def drift_score(delta: Column, overlap: Column, mood_changed: Column, tone_changed: Column) -> Column:
    bump = F.when(mood_changed, 0.10).otherwise(0.0) + F.when(tone_changed, 0.10).otherwise(0.0)
    return F.least(delta / 0.5, F.lit(1.0)) * 0.45 + (1.0 - overlap) * 0.35 + bump


def detect_drift(profile: DataFrame, **limits: float) -> DataFrame:
    """Compare each day with the one before it; the first day shows no change. A row without a day is no day.

    ``limits`` are those of ``is_drift``.
    """
    profile = profile.filter(F.col("day").isNotNull())
    terms = F.transform("top_topics", lambda t: t["term"])
    days = profile.select("day", "avg_compound", "mood", "tone", terms.alias("terms"))
    by_day = W.orderBy("day")  # one row per day
    before = F.lag(F.struct("avg_compound", "mood", "tone", "terms")).over(by_day)
    changes = days.withColumn("before", before).select(
        "day",
        F.coalesce(F.abs(F.col("avg_compound") - F.col("before.avg_compound")), F.lit(0.0)).alias("delta"),
        F.when(F.col("before").isNull(), 1.0)
        .otherwise(measures.jaccard(F.col("before.terms"), F.col("terms"))).alias("overlap"),
        F.coalesce(F.col("before.mood") != F.col("mood"), F.lit(False)).alias("mood_changed"),
        F.coalesce(F.col("before.tone") != F.col("tone"), F.lit(False)).alias("tone_changed"),
    )
    measured = [F.col(c) for c in ("delta", "overlap", "mood_changed", "tone_changed")]
    return changes.select(
        "day",
        F.round("delta", 4).alias("sentiment_delta"),
        F.round("overlap", 4).alias("topic_jaccard"),
        "mood_changed", "tone_changed",
        F.round(drift_score(*measured), 4).alias("drift_score"),
        is_drift(*measured, **limits).alias("drift_from_prev"),
    )


def _top_items(profile: DataFrame) -> DataFrame:
    """Top entities and topics of all days as rows ``day, kind, place, value, …``."""
    entities = profile.select("day", F.posexplode("top_entities").alias("place", "item")).select(
        "day", F.lit("entity").alias("kind"), "place", F.col("item.text").alias("value"),
        F.col("item.label").alias("label"), F.lit(None).cast("double").alias("score"),
        "item.count", "item.distinct_convos")
    topics = profile.select("day", F.posexplode("top_topics").alias("place", "item")).select(
        "day", F.lit("topic").alias("kind"), "place", F.col("item.term").alias("value"),
        F.lit(None).cast("string").alias("label"), "item.score",
        "item.count", "item.distinct_convos")
    return entities.unionByName(topics)


def find_triggers(profile: DataFrame, drift: DataFrame) -> DataFrame:
    """``day, trigger`` for drift days that have one.

    A trigger is an entity, else a topic, that no earlier day's top list holds and that few
    conversations repeat often; the next two of its kind are its alternatives.
    """
    items = _top_items(profile)
    first_day = F.min("day").over(W.partitionBy("kind", "value"))
    mentions, convos = F.col("count"), F.col("distinct_convos")
    new = (
        items.withColumn("first_day", first_day)
        .filter((F.col("first_day") == F.col("day")) & measures.is_concentrated(mentions, convos))
        .withColumn("concentration", F.round(measures.concentration(mentions, convos), 4))
        .join(drift.filter("drift_from_prev").select("day"), "day")
    )
    strength = F.when(F.col("kind") == "entity", F.col("count")).otherwise(F.col("score"))
    order = W.partitionBy("day", "kind").orderBy(F.desc(strength), "place")
    ranked = new.withColumn("rank", F.row_number().over(order)).filter("rank <= 3")
    picked = ranked.groupBy("day", "kind").agg(
        F.array_sort(F.collect_list(F.struct("rank", *_ALTERNATIVE))).alias("ranked"))
    alternatives = F.transform(F.slice("ranked", 2, 2),
                               lambda x: F.struct(*[x[f].alias(f) for f in _ALTERNATIVE]))
    trigger = F.struct("kind", *[F.col("ranked")[0][f].alias(f) for f in _ALTERNATIVE],
                       alternatives.alias("alternatives"))
    return picked.groupBy("day").agg(F.min_by(trigger, "kind").alias("trigger"))


def timeline(profile: DataFrame) -> DataFrame:
    """Profile, change and trigger of every day in the stored record's shape."""
    drift = detect_drift(profile)
    triggers = find_triggers(profile, drift)
    return profile.join(drift, "day").join(triggers, "day", "left").select(
        "day", "mood", "tone", "avg_compound", "features", "top_topics", "top_entities",
        "drift_from_prev", "drift_score",
        F.struct("sentiment_delta", "topic_jaccard", "mood_changed", "tone_changed").alias("drift_detail"),
        "trigger")


def timeline_summary(stored: DataFrame, n: int = 5) -> DataFrame:
    """The fields a timeline view needs, with the first ``n`` topic and entity names."""
    def names(column: str, field: str) -> Column:
        # A null list becomes an empty one.
        listed = F.transform(F.slice(column, 1, n), lambda item: item[field])
        return F.coalesce(listed, F.array().cast("array<string>")).alias(column)

    return stored.select("day", "mood", "tone", "avg_compound", "drift_score", "drift_from_prev",
                         names("top_topics", "term"), names("top_entities", "text"), "trigger")


def sentiment_range(profile: DataFrame) -> DataFrame:
    """Lowest and highest daily sentiment, a missing value counting as 0."""
    value = F.coalesce("avg_compound", F.lit(0.0))
    return profile.agg(F.min(value).alias("min_compound"), F.max(value).alias("max_compound"))
