"""Templated extractive answers for a batch of questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import sentiment
from turnloom.functions import text as T

_PAIR = ["a_id", "b_id", "a_day", "b_day", "a_sentiment", "b_sentiment",
         "contradiction_prob", "entailment_prob", "neutral_prob"]
_SOURCE = ["id", "text", "conversation_id", "turn_index", "day_bucket", "sentiment", "synthetic",
           "cosine_sim", "cosine_norm", "recency_norm", "emotional_weight", "score"]


def gather_top(ranked: DataFrame, n: int = K.TOP_FOR_PAIRS) -> DataFrame:
    """``qid, top`` with the first ``n`` hits in rank order, and the confidence base."""
    fields = [c for c in _SOURCE if c in ranked.columns]
    top = ranked.filter(F.col("rank") <= n).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", *fields))).alias("top"),
        F.avg(F.when(F.col("rank") <= 3, F.col("cosine_sim"))).alias("mean_cosine"))
    return top


def gather_contradictions(scored: DataFrame) -> DataFrame:
    """``qid, conflicts``: flagged pairs, strongest first, equal ones in pair order."""
    strength = (-F.col("contradiction_prob")).alias("strength")
    ordered = F.array_sort(F.collect_list(F.struct(strength, "a_rank", "b_rank", "a_text", "b_text", *_PAIR)))
    return scored.filter("flagged").groupBy("qid").agg(ordered.alias("conflicts"))


def _quote(label: str, day: Column, text: Column, entity: Column) -> Column:
    return F.concat(F.lit(f"{label} (day-bucket "), day.cast("string"), F.lit('): "'),
                    T.excerpt(text, entity), F.lit('"'))


def closing_note(a_sentiment: Column, b_sentiment: Column) -> Column:
    signs = F.array(sentiment.sign(a_sentiment), sentiment.sign(b_sentiment))
    opposed = F.array_contains(signs, "pos") & F.array_contains(signs, "neg")
    return F.when(opposed, K.NOTE_TONE).otherwise(K.NOTE_FACTS)


def day_span(days: Column) -> Column:
    first, last = F.array_min(days).cast("string"), F.array_max(days).cast("string")
    return F.when(first == last, F.concat(F.lit("day-bucket "), first)).otherwise(
        F.concat(F.lit("day-buckets "), first, F.lit("–"), last))


def answer_text(entity: Column, top: Column, conflicts: Column) -> Column:
    """The answer sentence; null when nothing was found.

    With a conflict it quotes the strongest pair in day order, otherwise the earliest hit and the
    latest one (the lowest rank on the first day, the highest rank on the last).
    """
    pair = F.get(conflicts, F.lit(0))
    a_first = pair["a_day"] <= pair["b_day"]
    dated = F.transform(top, lambda c: F.struct(
        c["day_bucket"].alias("day"), c["rank"].alias("rank"), c["text"].alias("text")))
    early, late = F.array_min(dated), F.array_max(dated)
    found = pair.isNotNull()

    def pick(of_pair: Column, otherwise: Column) -> Column:
        return F.when(found, of_pair).otherwise(otherwise)

    early_day = pick(F.when(a_first, pair["a_day"]).otherwise(pair["b_day"]), early["day"])
    early_text = pick(F.when(a_first, pair["a_text"]).otherwise(pair["b_text"]), early["text"])
    late_day = pick(F.when(a_first, pair["b_day"]).otherwise(pair["a_day"]), late["day"])
    late_text = pick(F.when(a_first, pair["b_text"]).otherwise(pair["a_text"]), late["text"])
    note = pick(closing_note(pair["a_sentiment"], pair["b_sentiment"]), F.lit(K.NOTE_CONSISTENT))
    return F.concat(
        F.lit("You've mentioned "), entity, F.lit(" across "), F.size(top).cast("string"),
        F.lit(" occasions over "), day_span(F.transform(top, lambda c: c["day_bucket"])), F.lit(". "),
        _quote("Earlier", early_day, early_text, entity), F.lit(". "),
        _quote("Later", late_day, late_text, entity), F.lit(". "), note)


def confidence(mean_cosine: Column, conflicts: Column) -> Column:
    """Mean cosine of the first three hits, lowered when they conflict; 0 without hits."""
    penalty = F.when(F.size(F.coalesce(conflicts, F.array())) > 0, K.CONTRADICTION_PENALTY).otherwise(1.0)
    bounded = F.greatest(F.least(F.coalesce(mean_cosine, F.lit(0.0)) * penalty, F.lit(1.0)), F.lit(0.0))
    return F.round(bounded, 4)


def assemble(queries: DataFrame, ranked: DataFrame, scored: DataFrame) -> DataFrame:
    """One row per query. All three inputs hold at most k rows per query."""
    entity = F.coalesce(F.col("entity"), T.entity_from_query(F.col("query")))
    joined = (
        queries.select("qid", "query", entity.alias("entity"))
        .join(gather_top(ranked), "qid", "left")
        .join(gather_contradictions(scored), "qid", "left"))
    return joined.select(
        "qid", "query", "entity",
        answer_text(F.col("entity"), F.col("top"), F.col("conflicts")).alias("answer"),
        F.col("top").alias("source_chunks"),
        F.transform("conflicts", lambda c: F.struct(*[c[f].alias(f) for f in _PAIR])).alias("contradictions"),
        confidence(F.col("mean_cosine"), F.col("conflicts")).alias("confidence"))


def synthetic_hits(answers: DataFrame) -> DataFrame:
    """How many seed rows each answer rests on."""
    used = F.filter("source_chunks", lambda c: c["synthetic"])
    return answers.select("qid", F.size(F.coalesce(used, F.array())).alias("n_synthetic"))


def without_sources(answers: DataFrame) -> DataFrame:
    return answers.drop("source_chunks")
