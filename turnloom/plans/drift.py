"""From turns to the drift timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions.sentiment import Lexicon
from turnloom.operators import drift, entities, profile, topics
from turnloom.scaling import materialize, stored


def daily_profiles(turns: DataFrame, gazetteer: DataFrame, lexicon: Lexicon | None = None,
                   stop_words=None, extractor=entities.gazetteer_mentions) -> DataFrame:
    """One nested record per day of ``day, conversation_id, turn_index, text``.

    ``extractor(turns, gazetteer)`` may be any DataFrame function, such as a ``mapInPandas`` model.
    Turns are projected in one pass and stored; each part of the profile reads its columns of that table.
    """
    turns = stored(profile.projected_turns(turns, lexicon, stop_words), "projected-turns")
    rollup = profile.daily_rollup(turns)
    top_terms = topics.topic_concentration(turns, topics.top_topics(turns, stop_words=stop_words))
    mentions = entities.keep_mentions(
        extractor(turns.select("day", "conversation_id", "turn_index", "text"), gazetteer),
        K.PROFILE_ENTITY_LABELS, K.PROFILE_PRONOUNS)
    return profile.daily_profile(rollup, top_terms, entities.top_entities(mentions))


def drift_timeline(turns: DataFrame, gazetteer: DataFrame, lexicon: Lexicon | None = None,
                   stop_words=None, extractor=entities.gazetteer_mentions) -> DataFrame:
    """Profiles, drift and triggers. The profile has one row per day but reading it is expensive
    and four comparisons do, so it is computed once. Turns without a day are left out."""
    turns = turns.filter(F.col("day").isNotNull())
    return drift.timeline(materialize(daily_profiles(turns, gazetteer, lexicon, stop_words, extractor)))
