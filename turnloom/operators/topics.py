"""Distinctive terms of each period (one TF-IDF document per period)."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, reduce

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import text as T
from turnloom.scaling import materialize, stored

# Rows ordered by one task at most when pairing the last word of a turn with the first of the next.
_BLOCK = 65_536
# Days counted side by side in one aggregate: a counter a day and term stays in memory, however rare the term.
_MAX_COUNTERS = 8


@lru_cache(maxsize=1)
def default_stop_words() -> tuple[str, ...]:
    """The base English list plus chat fillers; needs a running session."""
    return tuple(sorted({*StopWordsRemover.loadDefaultStopWords("english"), *K.CHAT_FILLERS}))


@dataclass(frozen=True)
class _Extent:
    """Days present and the range of turn positions: one small aggregate over id columns."""

    days: list[int]
    first_convo: int
    convos: int
    turns: int

    @classmethod
    def of(cls, turns: DataFrame) -> "_Extent":
        rows = turns.groupBy("day").agg(
            F.min("conversation_id").alias("low"), F.max("conversation_id").alias("high"),
            F.max("turn_index").alias("last")).collect()  # one row per day
        low = min((r.low for r in rows), default=0)
        return cls(sorted(r.day for r in rows), low, max((r.high for r in rows), default=0) - low + 1,
                   max((r.last for r in rows), default=0) + 1)

    def positions(self) -> list[Column]:
        """Columns placing a turn in its day, coarse to fine, each with at most ``_BLOCK`` values
        within the one before."""
        convo = F.col("conversation_id").cast("bigint") - F.lit(self.first_convo)
        turn = F.col("turn_index").cast("bigint")
        if self.convos * self.turns < 2**62:
            return _prefixes(convo * F.lit(self.turns) + turn, self.convos * self.turns)
        return _prefixes(convo, self.convos) + _prefixes(turn, self.turns)


def _prefixes(position: Column, span: int) -> list[Column]:
    shifts = range(0, max((span - 1).bit_length(), 1), _BLOCK.bit_length() - 1)
    return [F.shiftright(position, shift) for shift in reversed(shifts)]


def _border_pairs(turns: DataFrame, extent: _Extent) -> DataFrame:
    """Word pairs across turn and conversation borders, from each day's running word sequence.

    The sequence is paired level by level: positions inside a block, blocks inside a larger block, and
    so on up to the day. Each level passes only the first and last word of its groups on, so no task
    orders more than one block however long a conversation or day is; a small table has one level.
    """
    # An empty turn has no ends; dropping it inside the generator keeps the tokens computed once.
    ends = F.transform(F.array("tokens"), lambda t: F.struct(
        F.get(t, F.lit(0)).alias("first"), F.get(t, F.size(t) - 1).alias("last")))
    positions = extent.positions()
    levels = ["day", *[f"p{i}" for i in range(len(positions))]]
    rows = turns.select("day", *[p.alias(name) for p, name in zip(positions, levels[1:])],
                        F.inline(F.filter(ends, lambda e: e["first"].isNotNull())))
    found = []
    for depth in range(len(levels) - 1, 0, -1):
        group, position = levels[:depth], levels[depth]
        rows = rows.repartition(*group)  # one exchange feeds both the pairing and the next level
        sequence = W.partitionBy(*group).orderBy(position)
        found.append(rows.select("day", F.lag("last").over(sequence).alias("before"),
                                 F.col("first").alias("after")).filter("before IS NOT NULL"))
        rows = rows.groupBy(*group).agg(F.min_by("first", position).alias("first"),
                                        F.max_by("last", position).alias("last"))
    pairs = reduce(DataFrame.unionByName, found)
    return pairs.select("day", F.concat("before", F.lit(" "), "after").alias("term"))


def _terms(turns: DataFrame, extent: _Extent, stop_words=None) -> DataFrame:
    """``day, term``, one row per occurrence; a column ``tokens`` of projected turns is taken as it is."""
    stop_words = default_stop_words() if stop_words is None else stop_words
    tokens = F.col("tokens") if "tokens" in turns.columns else T.topic_tokens(F.col("text"), list(stop_words))
    worded = turns.select("day", "conversation_id", "turn_index", tokens.alias("tokens"))
    inside = worded.select("day", F.explode(F.concat("tokens", T.pairs_of(F.col("tokens")))).alias("term"))
    return inside.unionByName(_border_pairs(worded, extent))


def term_counts(turns: DataFrame, stop_words=None) -> DataFrame:
    """``day, term, tf`` over one- and two-word terms of ``day, conversation_id, turn_index, text``.

    Stop words go before pairing, so pairs bridge them as well as turn borders. Turns without a day count nowhere.
    """
    turns = turns.filter(F.col("day").isNotNull())
    return _terms(turns, _Extent.of(turns), stop_words).groupBy("day", "term").agg(F.count("*").alias("tf"))


def _counts_by_term(terms: DataFrame, days: list[int], min_days: int, widest: int = _MAX_COUNTERS) -> DataFrame:
    """``day, term, tf, df`` of the terms found on ``min_days`` days or more.

    With few days a term keeps one counter per day and a bit per day seen, so occurrences are combined
    before the only shuffle and rare terms go before anything else is built. With many, days are
    counted first: a term has one narrow row per day that has it.
    """
    if not days or days[-1] - days[0] >= widest:
        counted = terms.groupBy("day", "term").agg(F.count("*").alias("tf"))
        return counted.withColumn("df", F.count("*").over(W.partitionBy("term"))).filter(F.col("df") >= min_days)
    counters = [F.count_if(F.col("day") == day).alias(f"d{i}") for i, day in enumerate(days)]
    seen = F.bit_count(F.bit_or(F.expr(f"shiftleft(1L, day - ({days[0]}))")))
    found = terms.groupBy("term").agg(seen.alias("df"), *counters).filter(F.col("df") >= min_days)
    listed = F.array(*[F.struct(F.lit(day).alias("day"), F.col(f"d{i}").alias("tf"))
                       for i, day in enumerate(days)])
    return found.select("term", "df", F.inline(listed)).filter("tf > 0")


def top_topics(turns: DataFrame, k: int = K.TOP_TOPICS, min_days: int = 2, stop_words=None) -> DataFrame:
    """``day, rank, term, score``: the k best terms of each day, terms seen in ``min_days`` days only.

    Score is tf × (ln((1 + D) / (1 + df)) + 1), scaled to unit length per day. Ties go to the
    alphabetically later term. Turns without a day count nowhere.
    """
    turns = turns.filter(F.col("day").isNotNull())
    extent = _Extent.of(turns)
    # Counted once and stored; two passes over a few numbers a term follow.
    counted = stored(_counts_by_term(_terms(turns, extent, stop_words), extent.days, min_days)
                     .select("day", "term", "tf", "df"), "term-counts")
    weight = F.col("tf") * (F.log((1 + len(extent.days)) / (1 + F.col("df"))) + 1)
    # Terms of a day with the same counts weigh the same, so the table of counts gives the norm and the weight of the
    # k-th term, and only terms of at least that weight are ranked.
    alike = counted.groupBy("day", "tf", "df").agg(F.count("*").alias("n")).withColumn("weight", weight)
    heavier = W.partitionBy("day").orderBy(F.desc("weight")).rowsBetween(W.unboundedPreceding, -1)
    days = alike.withColumn("above", F.coalesce(F.sum("n").over(heavier), F.lit(0))).groupBy("day").agg(
        F.sqrt(F.sum(F.col("n") * F.col("weight") * F.col("weight"))).alias("norm"),
        F.min(F.when(F.col("above") < k, F.col("weight"))).alias("least"))
    best_first = W.partitionBy("day").orderBy(F.desc("weight"), F.desc("term"))
    heavy = counted.withColumn("weight", weight).join(F.broadcast(days), "day").filter("weight >= least")  # one row per day
    best = heavy.withColumn("rank", F.row_number().over(best_first)).filter(F.col("rank") <= k)
    return best.select("day", "rank", "term", F.round(F.col("weight") / F.col("norm"), 4).alias("score"))


def topic_concentration(turns: DataFrame, topics: DataFrame,
                        distinct: Callable[[str], Column] = F.count_distinct) -> DataFrame:
    """Add ``count`` (whole-word hits) and ``distinct_convos`` to each top term of each day.

    The terms are at most k per day and travel to the turns; a cheap containment test runs before
    any pattern does.
    """
    topics = materialize(topics)  # read twice: for its terms and for its rows
    lists = topics.groupBy("day").agg(F.collect_list("term").alias("terms"))
    lowered = turns.select("day", "conversation_id", F.lower("text").alias("text"))
    present = F.filter("terms", lambda term: F.contains(F.col("text"), term))
    pattern = F.concat(F.lit(r"(?U)\b"), F.col("term"), F.lit(r"\b"))
    hits = (
        lowered.join(F.broadcast(lists), "day")  # one row per day
        .select("day", "conversation_id", "text", F.explode(present).alias("term"))
        .select("day", "conversation_id", "term", F.regexp_count("text", pattern).alias("hits"))
        .filter("hits > 0")
        .groupBy("day", "term")
        .agg(F.sum("hits").alias("count"), distinct("conversation_id").alias("distinct_convos"))
    )
    zero = F.lit(0).cast("bigint")
    return topics.join(hits, ["day", "term"], "left").select(
        "day", "rank", "term", "score",
        F.coalesce("count", zero).alias("count"),
        F.coalesce("distinct_convos", zero).alias("distinct_convos"))
