"""Entities that the corpus speaks about in conflicting moods."""

from __future__ import annotations

from pyspark.sql import DataFrame

from turnloom import constants as K
from turnloom.functions.sentiment import Lexicon
from turnloom.operators import entities, profile
from turnloom.scaling import stored


def scored_mentions(turns: DataFrame, gazetteer: DataFrame, lexicon: Lexicon | None = None,
                    extractor=entities.gazetteer_mentions) -> DataFrame:
    """Mentions with the sentiment of their turn; write them once and reuse them."""
    scored = profile.scored_turns(
        turns.select("day", "conversation_id", "turn_index", "text"), lexicon)
    return entities.keep_mentions(extractor(scored, gazetteer), K.CANDIDATE_ENTITY_LABELS, K.CANDIDATE_PRONOUNS)


def candidate_record(turns: DataFrame, gazetteer: DataFrame, lexicon: Lexicon | None = None,
                     extractor=entities.gazetteer_mentions, **settings) -> DataFrame:
    """The candidates with their filters and counts, as one record to be written with ``sinks.write_json``."""
    rollup = stored(entities.entity_rollup(scored_mentions(turns, gazetteer, lexicon, extractor)), "entity-rollup")
    return entities.candidate_record(rollup, **settings)


def contradiction_candidates(turns: DataFrame, gazetteer: DataFrame, lexicon: Lexicon | None = None,
                             extractor=entities.gazetteer_mentions, **limits) -> DataFrame:
    return entities.contradiction_candidates(
        entities.entity_rollup(scored_mentions(turns, gazetteer, lexicon, extractor)), **limits)
