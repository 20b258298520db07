"""Pairs of top hits and how strongly they contradict each other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import measures, sentiment
from turnloom.functions import text as T
from turnloom.scaling import stored

BLOCK_SEEDS = 512
_SIDE = ["id", "rank", "day_bucket", "sentiment", "text"]
PROBABILITIES = ["contradiction_prob", "entailment_prob", "neutral_prob"]
VERDICTS = ["contradiction", "entailment", "neutral"]


def top_pairs(ranked: DataFrame, n: int = K.TOP_FOR_PAIRS) -> DataFrame:
    """Every unordered pair of a query's first ``n`` hits: ``a_…`` ranks before ``b_…``.

    The hits of a query are gathered once (n rows at most) and paired in place, without a join.
    """
    top = ranked.filter(F.col("rank") <= n).groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct("rank", *[c for c in _SIDE if c != "rank"]))).alias("top"))
    paired = F.flatten(F.transform("top", lambda a, i: F.transform(
        F.filter("top", lambda b: b["rank"] > a["rank"]), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return top.select("qid", F.explode(paired).alias("pair")).select(
        "qid", *[F.col(f"pair.{side}.{c}").alias(f"{side}_{_short(c)}") for side in "ab" for c in _SIDE])


def _short(column: str) -> str:
    return "day" if column == "day_bucket" else column


def rule_scores(pairs: DataFrame, negations=K.NEGATIONS, number_words=K.NUMBER_WORDS) -> DataFrame:
    """Contradiction, entailment and neutral probabilities from what two texts say differently.

    One text negating, different numbers and opposite sentiment speak for contradiction, shared
    words for entailment. Any function adding the same three columns (a ``pandas_udf`` model) can
    take its place.
    """
    def side(name: str):
        words = F.array_distinct(F.regexp_extract_all(F.lower(f"{name}_text"), F.lit("[a-z0-9']+"), F.lit(0)))
        return words

    def numbers(words: Column) -> Column:
        return F.filter(words, lambda w: w.isin(list(number_words)) | w.rlike("^[0-9]+$"))

    listed = pairs.withColumns({"_a": side("a"), "_b": side("b")})
    a, b = F.col("_a"), F.col("_b")
    negation_words = F.array(*[F.lit(w) for w in negations])
    negated = F.arrays_overlap(a, negation_words) != F.arrays_overlap(b, negation_words)
    counted = ((F.size(numbers(a)) > 0) & (F.size(numbers(b)) > 0)
               & (F.size(F.array_intersect(numbers(a), numbers(b))) == 0))
    signs = F.concat(sentiment.sign(F.col("a_sentiment")), sentiment.sign(F.col("b_sentiment")))
    opposed = signs.isin("posneg", "negpos")
    weights = ((negated, 1.5), (counted, 2.0), (opposed, 2.0))
    against = sum((F.when(condition, weight).otherwise(0.0) for condition, weight in weights), F.lit(0.0))
    listed = listed.withColumns({
        "_c": F.exp(against), "_e": F.exp(4.0 * measures.jaccard(a, b)), "_n": F.exp(F.lit(1.0))})
    total = F.col("_c") + F.col("_e") + F.col("_n")
    return listed.withColumns(
        {name: F.col(part) / total for name, part in zip(PROBABILITIES, ("_c", "_e", "_n"))}
    ).drop("_a", "_b", "_c", "_e", "_n")


Scorer = Callable[[DataFrame], DataFrame]


def score_pairs(pairs: DataFrame, scorer: Scorer = rule_scores, contradiction_min: float = K.CONTRADICTION_MIN) -> DataFrame:
    """Scored pairs with the most probable ``verdict`` and whether they are ``flagged``: contradicting beyond the limit."""
    scored = scorer(pairs)
    probabilities = F.array(*PROBABILITIES)
    best = F.array_position(probabilities, F.array_max(probabilities)).cast("int")
    verdict = F.element_at(F.array(*[F.lit(v) for v in VERDICTS]), best)
    return scored.withColumns({
        "verdict": verdict,
        "flagged": F.col("contradiction_prob") > contradiction_min,
    }).withColumns({name: F.round(name, 4) for name in PROBABILITIES})


def flagged_pairs(scored: DataFrame) -> DataFrame:
    """Contradicting pairs, texts shortened for reading."""
    return scored.filter("flagged").withColumns(
        {c: T.shorten(F.col(c), 200, " | ") for c in ("a_text", "b_text")})


def seed_pairs(seeds: DataFrame) -> DataFrame:
    """Every pair of seed chunks as one query's hits: ``a_…`` comes before ``b_…`` by day, id and text.

    The result has a row for each pair, so the work grows with the square of the seeds. Seeds are dealt to blocks
    of ``BLOCK_SEEDS`` in their order, and block i meets block j in a group of its own for i <= j. A row is copied once a
    block, a group holds two blocks at most, and no seed passes through the driver. Rows without a day come first.
    """
    ranked = _in_order(seeds.select(*[c for c in _SIDE if c != "rank"]), ["day_bucket", "id", "text"])
    ranked = ranked.withColumn("block", F.expr(f"CAST((rank - 1) DIV {BLOCK_SEEDS} AS INT)"))
    last = F.lit(max(0, ranked.count() - 1) // BLOCK_SEEDS)
    sides = {}
    for side, block, other, others in (("a", "i", "j", F.sequence("block", last)), ("b", "j", "i", F.sequence(F.lit(0), "block"))):
        columns = [F.col(c).alias(f"{side}_{_short(c)}") for c in _SIDE]
        sides[side] = ranked.select(*columns, F.col("block").alias(block), F.explode(others).alias(other))
    paired = sides["a"].join(sides["b"], ["i", "j"]).filter("a_rank < b_rank")
    return paired.select(F.lit(0).cast("bigint").alias("qid"),
                         *[f"{side}_{_short(c)}" for side in "ab" for c in _SIDE])


def _in_order(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with their ``rank`` from 1 in ``order``: sorted in ranges, numbered by the rows of the ranges before."""
    placed = stored(rows.orderBy(*order).withColumn("place", F.monotonically_increasing_id()), "in-order")
    # The upper bits of a place name its range; a row for each is sorted to add up the counts.
    ranges = placed.groupBy(F.shiftright("place", 33).alias("range")).agg(F.count("*").alias("n"), F.min("place").alias("first"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.select("range", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("offset"))
    return placed.withColumn("range", F.shiftright("place", 33)).join(offsets, "range").withColumn(
        "rank", F.col("place") + F.col("offset")).drop("place", "range", "offset")
