"""Lexicon sentiment with published context rules, as one map-only array expression."""

from __future__ import annotations

import json
import string
import zlib
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions.text import let as _let

# Words per map on average: a map is searched from its beginning, so these stay small.
_PER_MAP = 4


def _default_boosters() -> dict[str, float]:
    return {**{w: K.BOOST_INCREMENT for w in K.BOOSTERS_UP},
            **{w: -K.BOOST_INCREMENT for w in K.BOOSTERS_DOWN}}


@dataclass(frozen=True)
class Lexicon:
    """Word valences plus the words that modify them."""

    valences: dict[str, float] = field(default_factory=lambda: dict(K.STARTER_LEXICON))
    boosters: dict[str, float] = field(default_factory=_default_boosters)
    negations: tuple[str, ...] = tuple(K.NEGATIONS)
    contrast: str = "but"


def _lookup(table: dict[str, float], word: Column) -> Column:
    if not table:
        return F.lit(0.0)
    # One literal that the planner folds to an array of small maps; a word's checksum says in which to look,
    # so a look-up takes as long in a large table as in a small one.
    size = -(-len(table) // _PER_MAP)
    maps: list[dict[str, float]] = [{} for _ in range(size)]
    for entry, value in table.items():
        maps[zlib.crc32(entry.encode("utf-8")) % size][entry] = value
    entries = F.from_json(F.lit(json.dumps(maps)), "array<map<string,double>>")
    at = (F.crc32(word.cast("binary")) % size).cast("int")
    return F.coalesce(F.get(entries, at)[word], F.lit(0.0))


def _token(raw: Column) -> Column:
    bare = F.btrim(raw, F.lit(string.punctuation))
    return F.when(F.length(bare) <= 2, raw).otherwise(bare)


def compound(text: Column, lexicon: Lexicon | None = None) -> Column:
    """Sentiment of a text in [-1, 1], rounded to 4 digits; null or empty text scores 0.

    Context is looked at only around the words the lexicon knows, so the cost per ordinary word
    is one hash lookup and no row leaves its task.
    """
    lexicon = lexicon or Lexicon()
    text = F.coalesce(text, F.lit(""))
    tokens = F.transform(F.filter(F.split(text, r"(?U)\s+"), lambda w: w != ""), _token)

    def describe(token: Column, at: Column) -> Column:
        lowered = F.lower(token)
        return F.struct(
            at.alias("at"),
            lowered.alias("word"),
            ((token != lowered) & (token == F.upper(token))).alias("caps"),
            _lookup(lexicon.valences, lowered).alias("valence"),
        )

    def total(items: Column) -> Column:
        n_caps = F.size(F.filter(items, lambda x: x["caps"]))
        shouting = (n_caps > 0) & (n_caps < F.size(items))
        contrast = F.array_position(items["word"], lexicon.contrast)
        return _let(F.struct(shouting.alias("shouting"), contrast.alias("contrast")),
                    lambda state: _total(items, state, lexicon))

    score = _let(F.transform(tokens, describe), total)
    exclaims = F.least(F.length(text) - F.length(F.replace(text, F.lit("!"))), F.lit(K.EXCLAIM_MAX))
    questions = F.length(text) - F.length(F.replace(text, F.lit("?")))
    emphasis = exclaims * K.EXCLAIM_INCREMENT + (
        F.when(questions <= 1, 0.0).when(questions <= 3, questions * K.QUESTION_INCREMENT)
        .otherwise(K.QUESTION_CAP))

    def normalise(s: Column) -> Column:
        return F.round(s / F.sqrt(s * s + K.NORMALISATION_ALPHA), 4)

    return _let(_let(score, lambda s: s + F.signum(s) * emphasis), normalise)


def _total(items: Column, state: Column, lexicon: Lexicon) -> Column:
    """Sum of the valences in context."""

    def raised(item: Column) -> Column:
        return F.when(item["caps"] & state["shouting"], K.CAPS_INCREMENT).otherwise(0.0)

    negations = {word: 1.0 for word in lexicon.negations}

    def effect(near: Column) -> Column:
        previous = near["item"]
        boost = _lookup(lexicon.boosters, previous["word"])
        return F.struct(
            F.when(boost != 0, (boost + raised(previous)) * near["damping"]).otherwise(0.0).alias("add"),
            F.when(_lookup(negations, previous["word"]) != 0, K.NEGATION_FACTOR).otherwise(1.0).alias("factor"),
        )

    def in_context(item: Column) -> Column:
        at = item["at"]
        start = item["valence"] + F.signum(item["valence"]) * raised(item)
        nearby = F.array(*[F.struct(F.get(items, at - d - 1).alias("item"), F.lit(damping).alias("damping"))
                           for d, damping in enumerate(K.BOOST_DAMPING)])
        # Words with a valence of their own do not modify the next one.
        effects = F.transform(F.filter(nearby, lambda near: near["item"]["valence"] == 0), effect)
        value = F.aggregate(effects, start, lambda v, e: (v + F.signum(v) * e["add"]) * e["factor"])
        weight = (
            F.when(state["contrast"] == 0, 1.0)
            .when(at + 1 < state["contrast"], K.CONTRAST_BEFORE)
            .when(at + 1 > state["contrast"], K.CONTRAST_AFTER)
            .otherwise(1.0))
        return value * weight

    hits = F.filter(items, lambda item: item["valence"] != 0)
    return F.aggregate(hits, F.lit(0.0), lambda acc, item: acc + in_context(item))


def sign(sentiment: Column, threshold: float = K.SIGN_THRESHOLD) -> Column:
    return F.when(sentiment > threshold, "pos").when(sentiment < -threshold, "neg").otherwise("neutral")
