"""Surface style of a text and the labels derived from it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import text as T

# A word in capitals, two letters or more; apostrophes count as letters. The first thing tested is a
# plain character class, so ordinary text is skipped without any look-around.
_CAPS_WORD = r"(?:[A-Z]|'(?='*[A-Z]))(?<![A-Za-z'].)[A-Z']++(?![A-Za-z'])"


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def counts(text: Column) -> dict[str, Column]:
    """Additive counts of one text: they sum over any group, so a rollup needs one pass."""
    text = F.coalesce(text, F.lit(""))
    return {
        "n_chars": F.length(text),
        "n_words": _count(text, K.WORD),
        "n_question": _count(text, r"\?"),
        "n_exclaim": _count(text, "!"),
        "n_caps": _count(text, _CAPS_WORD),
        "n_word_chars": F.length(F.array_join(T.words(text), "")),
        "n_contractions": _count(text, T.words_regex(K.CONTRACTIONS)),
    }


def surface_features(text: Column) -> dict[str, Column]:
    c = counts(text)
    denominator = F.greatest(c["n_words"], F.lit(1))
    return {
        "n_chars": c["n_chars"],
        "n_words": c["n_words"],
        "question_rate": c["n_question"] / denominator,
        "exclaim_rate": c["n_exclaim"] / denominator,
        "caps_ratio": c["n_caps"] / denominator,
        "avg_word_len": c["n_word_chars"] / denominator,
    }


def mood_label(compound: Column, exclaim: Column, caps: Column, word_len: Column,
               question: Column) -> Column:
    """Label of a single text from its valence, energy and formality."""
    energy = exclaim * 3 + caps * 2
    formal = word_len + F.when(question < 0.05, 0.5).otherwise(0.0) >= 4.8
    positive, negative = compound >= 0.25, compound <= -0.25
    high, low = energy >= 0.6, energy < 0.15
    return (
        F.when(negative, F.when(high, "frustrated").otherwise("down"))
        .when(positive, F.when(high, "playful").when(low, "content").otherwise("warm"))
        .when(question >= 0.08, "curious")
        .when(formal, "formal")
        .otherwise("neutral")
    )


def daily_mood(compound: Column, exclaim: Column, caps: Column, question: Column) -> Column:
    lively = (exclaim >= 0.05) | (caps >= 0.03)
    return (
        F.when((compound >= 0.5) & lively, "playful")
        .when(compound >= 0.4, "happy")
        .when((compound <= -0.4) & lively, "frustrated")
        .when(compound <= -0.2, "sad")
        .when((F.abs(compound) < 0.25) & (question >= 0.06), "curious")
        .otherwise("neutral")
    )


def daily_tone(exclaim: Column, caps: Column, word_len: Column, contractions: Column) -> Column:
    return (
        F.when((exclaim >= 0.08) | (caps >= 0.05), "playful")
        .when((word_len - contractions * 4 >= 4.5) & (exclaim < 0.03), "formal")
        .otherwise("casual")
    )
