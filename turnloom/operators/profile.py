"""Per-period rollup of volume, sentiment and style."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom.functions import sentiment, style
from turnloom.functions import text as T
from turnloom.functions.sentiment import Lexicon
from turnloom.operators import topics

_RATES = {
    "question_rate": ("n_question", 5),
    "exclamation_rate": ("n_exclaim", 5),
    "caps_ratio": ("n_caps", 5),
    "avg_word_len": ("n_word_chars", 4),
    "contraction_rate": ("n_contractions", 5),
}


def scored_turns(turns: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Add the sentiment ``compound`` of every turn."""
    return turns.withColumn("compound", sentiment.compound(F.col("text"), lexicon))


def _counts() -> dict:
    counts = style.counts(F.col("text"))
    counts.pop("n_chars")
    return counts


def projected_turns(turns: DataFrame, lexicon: Lexicon | None = None, stop_words=None) -> DataFrame:
    """Turns with everything that per-period tables are made of: sentiment, style counts and topic tokens.

    One pass over the text; write the result once and let each rollup read the columns it needs.
    """
    words = topics.default_stop_words() if stop_words is None else stop_words
    return scored_turns(turns, lexicon).select(
        "day", "conversation_id", "turn_index", "text", "compound",
        *[column.alias(name) for name, column in _counts().items()],
        T.topic_tokens(F.col("text"), list(words)).alias("tokens"))


def daily_rollup(turns: DataFrame, distinct: Callable[[str], Column] = F.count_distinct) -> DataFrame:
    """One row per ``day`` from ``day, conversation_id, text, compound``, or from projected turns.

    All measures are sums of per-turn counts, so tasks combine them before the shuffle and a day
    holding most of the corpus costs no more than any other.
    """
    counts = _counts()
    per_turn = turns.select("day", "conversation_id", "compound",
                            *[F.col(name) if name in turns.columns else column.alias(name)
                              for name, column in counts.items()])
    sums = per_turn.groupBy("day").agg(
        F.count("*").alias("n_turns"),
        distinct("conversation_id").alias("n_conversations"),
        F.avg("compound").alias("mean_compound"),
        *[F.sum(name).alias(name) for name in counts],
    )
    denominator = F.greatest(F.col("n_words"), F.lit(1))
    rates = sums.select(
        "day", "n_turns", "n_conversations", "mean_compound",
        *[F.round(F.col(count) / denominator, digits).alias(rate)
          for rate, (count, digits) in _RATES.items()])
    return rates.select(
        "day", "n_turns", "n_conversations",
        F.round("mean_compound", 4).alias("avg_compound"),
        *_RATES,
        style.daily_mood(F.col("mean_compound"), F.col("exclamation_rate"), F.col("caps_ratio"),
                         F.col("question_rate")).alias("mood"),
        style.daily_tone(F.col("exclamation_rate"), F.col("caps_ratio"), F.col("avg_word_len"),
                         F.col("contraction_rate")).alias("tone"),
    )


def daily_profile(rollup: DataFrame, topics: DataFrame, entities: DataFrame) -> DataFrame:
    """Rollup joined with top topics and entities as nested lists; a missing list is empty.

    All three tables have one row per day.
    """
    features = F.struct(*_RATES).alias("features")
    nested = rollup.select("day", "n_turns", "n_conversations", "avg_compound", features, "mood", "tone")
    topic_lists = _listed(topics, "term", ["term", "score", "count", "distinct_convos"], "top_topics")
    entity_lists = _listed(entities, "text", ["text", "label", "count", "distinct_convos"], "top_entities")
    joined = nested.join(topic_lists, "day", "left").join(entity_lists, "day", "left")
    for name, listed in (("top_topics", topic_lists), ("top_entities", entity_lists)):
        empty = F.array().cast(listed.schema[name].dataType)
        joined = joined.withColumn(name, F.coalesce(name, empty))
    return joined


def _listed(ranked: DataFrame, item: str, fields: list[str], name: str) -> DataFrame:
    """Rows ranked within a day (at most k of them) as one ordered array per day."""
    ordered = F.array_sort(F.collect_list(F.struct("rank", *fields)))
    return ranked.groupBy("day").agg(
        F.transform(ordered, lambda x: F.struct(*[x[f].alias(f) for f in fields])).alias(name))
