"""Named mentions, their per-period counts and their rollup across periods."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import measures

# Runs of capitalised words separated by single spaces.
_RUN = r"(?U)(?<![\w'-])\p{Lu}[\w'-]*(?: \p{Lu}[\w'-]*)*"


def _candidates(turns: DataFrame, carry: Sequence[str], max_words: int) -> DataFrame:
    runs = F.regexp_extract_all("text", F.lit(_RUN), F.lit(0))
    words = turns.select(*carry, F.posexplode(runs).alias("run", "phrase")).select(
        *carry, "run", F.split("phrase", " ").alias("words"))

    def grams(n: int):
        starts = F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))
        return F.transform(F.coalesce(starts, F.array().cast("array<int>")), lambda i: F.struct(
            i.alias("start"), F.lit(n).alias("n"),
            F.array_join(F.slice("words", i + 1, n), " ").alias("entity")))

    every = F.concat(*[grams(n) for n in range(1, max_words + 1)])
    return words.select(*carry, "run", F.inline(every))


def gazetteer_mentions(turns: DataFrame, gazetteer: DataFrame, max_words: int = 3) -> DataFrame:
    """Mentions of ``gazetteer(surface, label)`` in ``day, conversation_id, turn_index, text``.

    Candidates are one to three capitalised words in a row; a match inside a longer match is
    dropped. Spark broadcasts the gazetteer while it is below its own size threshold and joins on
    the surface form beyond it. Only matches are shuffled, grouped by turn.
    """
    carry = [c for c in turns.columns if c != "text"]
    known = gazetteer.groupBy("surface").agg(F.min("label").alias("label"))
    matches = _candidates(turns, carry, max_words).join(known, F.col("entity") == F.col("surface"))
    earlier = (W.partitionBy("conversation_id", "turn_index", "run").orderBy("start", F.desc("n"))
               .rowsBetween(W.unboundedPreceding, -1))
    reach = F.max(F.col("start") + F.col("n")).over(earlier)
    return (
        matches.withColumn("reach", reach)
        .filter("reach IS NULL OR reach < start + n")
        .select(*carry, "run", "start", "entity", "label")
    )


def keep_mentions(mentions: DataFrame, labels: Sequence[str], pronouns: Sequence[str]) -> DataFrame:
    """Mentions with a wanted label, two characters or more and not a pronoun."""
    return mentions.filter(
        F.col("label").isin(list(labels)) & (F.length("entity") >= 2)
        & ~F.lower("entity").isin(list(pronouns)))


def top_entities(mentions: DataFrame, k: int = K.TOP_ENTITIES,
                 distinct: Callable[[str], Column] = F.count_distinct) -> DataFrame:
    """``day, rank, text, label, count, distinct_convos``: most frequent first, then first seen.

    The label is the last one seen for the surface form that day. ``distinct=sketches.approximate()`` estimates the spread.
    """
    place = F.struct("conversation_id", "turn_index", "run", "start")
    counted = mentions.groupBy("day", F.col("entity").alias("text")).agg(
        F.max_by("label", place).alias("label"),
        F.count("*").alias("count"),
        distinct("conversation_id").alias("distinct_convos"),
        F.min(place).alias("first_place"))
    order = W.partitionBy("day").orderBy(F.desc("count"), "first_place")
    return (
        counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("day", "rank", "text", "label", "count", "distinct_convos"))


def entity_rollup(mentions: DataFrame, distinct: Callable[[str], Column] = F.count_distinct) -> DataFrame:
    """One row per surface form with its most frequent label, volume, spread and sentiment statistics.

    Labels are counted as they come; of equally frequent ones the first in alphabetical order counts.
    A mention without a day adds to everything but the number of days.
    """
    by_label = mentions.groupBy("entity", "label").agg(F.count("*").alias("n"))
    first = W.partitionBy("entity").orderBy(F.desc("n"), F.asc_nulls_last("label"))
    label = (by_label.withColumn("place", F.row_number().over(first)).filter("place = 1")
             .select(F.col("entity").alias("of"), "label"))
    rolled = mentions.groupBy("entity").agg(
        F.count("*").alias("total_mentions"),
        distinct("conversation_id").alias("distinct_conversations"),
        distinct("day").alias("distinct_day_buckets"),
        F.var_pop("compound").alias("sentiment_variance"),
        F.avg("compound").alias("sentiment_mean"),
        F.min("compound").alias("sentiment_min"),
        F.max("compound").alias("sentiment_max"),
    )
    return rolled.join(label, F.col("entity").eqNullSafe(F.col("of"))).select(
        "entity", "label", "total_mentions", "distinct_conversations", "distinct_day_buckets",
        F.coalesce("sentiment_variance", F.lit(0.0)).alias("sentiment_variance"),
        "sentiment_mean", "sentiment_min", "sentiment_max",
        measures.concentration(F.col("total_mentions"), F.col("distinct_conversations"))
        .alias("concentration_ratio"),
    )


def qualified(rollup: DataFrame, mentions_min: int = K.CANDIDATE_MENTIONS_MIN,
              concentration_min: float = K.CONCENTRATION_MIN,
              days_min: int = K.CANDIDATE_DAYS_MIN) -> DataFrame:
    return rollup.filter(
        (F.col("total_mentions") >= mentions_min) & (F.col("concentration_ratio") > concentration_min)
        & (F.col("distinct_day_buckets") >= days_min))


def contradiction_candidates(rollup: DataFrame, k: int = K.CANDIDATE_LIMIT, **limits) -> DataFrame:
    """The k qualified entities with the most varied sentiment, measures rounded to 4."""
    rounded = ["concentration_ratio", "sentiment_variance", "sentiment_mean", "sentiment_min", "sentiment_max"]
    best = qualified(rollup, **limits).orderBy(F.desc("sentiment_variance"), "entity").limit(k)
    return best.withColumns({name: F.round(name, 4) for name in rounded})


def candidate_counts(rollup: DataFrame, **limits) -> DataFrame:
    """How many surface forms there are and how many qualify."""
    marked = rollup.select("entity").withColumn("ok", F.lit(0)).unionByName(
        qualified(rollup, **limits).select("entity").withColumn("ok", F.lit(1)))
    return marked.agg(F.count_if(F.col("ok") == 0).alias("n_unique_entities"),
                      F.count_if(F.col("ok") == 1).alias("n_qualified"))


def candidate_record(rollup: DataFrame, k: int = K.CANDIDATE_LIMIT, n_bins: int = K.N_BINS,
                     labels: Sequence[str] = K.CANDIDATE_ENTITY_LABELS,
                     mentions_min: int = K.CANDIDATE_MENTIONS_MIN, concentration_min: float = K.CONCENTRATION_MIN,
                     days_min: int = K.CANDIDATE_DAYS_MIN) -> DataFrame:
    """One row: ``info`` with the filters and counts, and ``top``, the k candidates in order.

    Reads ``rollup`` twice; store it where that is expensive.
    """
    limits = {"mentions_min": mentions_min, "concentration_min": concentration_min, "days_min": days_min}
    best = contradiction_candidates(rollup, k, **limits)
    exact = rollup.select(F.col("entity").alias("of"), F.col("sentiment_variance").alias("exact"))
    fields = F.struct(*best.columns)
    order = F.struct((-F.col("exact")).alias("variance"), F.col("entity"), fields.alias("row"))
    top = (best.join(exact, F.col("entity") == F.col("of")).agg(F.transform(F.array_sort(F.collect_list(order)), lambda x: x["row"]).alias("top")))
    filters = F.struct(F.lit(mentions_min).alias("total_mentions_min"),
                       F.lit(concentration_min).alias("concentration_ratio_min_exclusive"),
                       F.lit(days_min).alias("distinct_day_buckets_min"))
    info = F.struct(F.lit(n_bins).alias("n_bins"), F.array(*[F.lit(x) for x in sorted(labels)]).alias("entity_labels"),
                    filters.alias("filters"), F.lit("sentiment_variance_desc").alias("rank_by"),
                    "n_unique_entities", "n_qualified")
    counts = candidate_counts(rollup, **limits).select(F.lit(1).alias("one"), info.alias("info"))
    return counts.join(top.withColumn("one", F.lit(1)), "one").select("info", "top")  # one row each
