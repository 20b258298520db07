"""First-match-wins text rules as one CASE expression."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import text as T


@dataclass(frozen=True)
class Rule:
    """All given conditions must hold. ``{first}`` in ``reason`` becomes the first token."""

    label: str
    reason: str
    phrases: tuple[str, ...] = ()
    first_words: tuple[str, ...] = ()
    max_words: int | None = None

    def matches(self, text: Column) -> Column:
        found = F.lit(True)
        for alternatives in self.phrases:
            found = found & text.rlike(T.words_regex(alternatives))
        if self.first_words:
            found = found & T.first_token(text).isin(list(self.first_words)) & ~text.endswith("?")
        if self.max_words is not None:
            found = found & (T.word_count(text) <= self.max_words)
        return found

    def outcome(self, text: Column) -> Column:
        before, placeholder, after = self.reason.partition("{first}")
        reason = F.concat(F.lit(before), T.first_token(text), F.lit(after)) if placeholder else F.lit(before)
        return F.struct(F.lit(self.label).alias("label"), reason.alias("reason"))


_VERBS = tuple(K.IMPERATIVE_VERBS)

WEAK_RULES = (
    Rule("reminder", "kw:reminder", (K.WEAK_REMINDER,)),
    Rule("action-item", "imperative:{first}", first_words=_VERBS),
    Rule("action-item", "kw:need-to", (K.NEED,)),
    Rule("emotional-support", "kw:emotion", (K.WEAK_EMOTION,)),
    Rule("small-talk", "kw:smalltalk", (K.WEAK_SMALL_TALK,)),
    Rule("small-talk", "short-utterance", max_words=3),
)
GOLD_RULES = (
    Rule("reminder", "explicit remind-me phrase", (K.GOLD_EXPLICIT_REMINDER,)),
    Rule("reminder", "reminder kw + future time", (K.GOLD_REMINDER, K.GOLD_FUTURE_TIME)),
    Rule("emotional-support", "first-person emotion word", (K.GOLD_STRONG_EMOTION, K.GOLD_FIRST_PERSON)),
    Rule("emotional-support", "consoling phrase", (K.GOLD_CONSOLING,)),
    Rule("action-item", "imperative verb '{first}'", first_words=_VERBS),
    Rule("action-item", "need-to + deadline", (K.NEED, K.GOLD_DEADLINE)),
    Rule("small-talk", "greeting/closing keyword", (K.GOLD_SMALL_TALK,)),
    Rule("small-talk", "very short utterance", max_words=3),
)


def first_match(text: Column, rules: Sequence[Rule], fallback: Rule) -> Column:
    """Struct ``(label, reason)`` of the first rule that matches; empty text is ``unknown``."""
    def judged(stripped: Column) -> Column:
        case = F.when(stripped == "", Rule("unknown", "empty").outcome(stripped))
        for rule in rules:
            case = case.when(rule.matches(stripped), rule.outcome(stripped))
        return case.otherwise(fallback.outcome(stripped))

    # Stripped once a text, not once a rule.
    return T.let(T.strip(F.coalesce(text, F.lit(""))), judged)


def weak_label(text: Column, rules: Sequence[Rule] = WEAK_RULES) -> Column:
    return first_match(text, rules, Rule("unknown", "fallback"))


def auto_gold(text: Column, rules: Sequence[Rule] = GOLD_RULES) -> Column:
    return first_match(text, rules, Rule("unknown", "no rule fired"))
