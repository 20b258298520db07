"""Reproducible samples, ordered by a hash of the content so that partitioning does not matter."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import rules
from turnloom.functions import text as T


def shuffle_key(seed: int, *parts: Column | str) -> Column:
    """A portable pseudo-random order: md5 of the seed and the given columns."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def stratified_head(rows: DataFrame, per_class: int = K.PER_CLASS, seed: int = K.SAMPLE_SEED,
                    labels: Sequence[str] = K.LABELS, tie: Sequence[str] = ()) -> DataFrame:
    """``per_class`` rows of each label in shuffled order, labels in their fixed order.

    The rank filter prunes inside each task, so a label with most of the rows moves only
    ``per_class`` rows per task. Rows with equal text are interchangeable unless ``tie`` columns
    tell them apart.
    """
    wanted = rows.filter(F.col("label").isin(list(labels)))
    order = W.partitionBy("label").orderBy(shuffle_key(seed, "text", *tie), "text", *tie)
    position = F.array_position(F.array(*[F.lit(label) for label in labels]), F.col("label"))
    return (
        wanted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= per_class)
        .withColumn("class_order", position.cast("int"))
        .orderBy("class_order", "rank"))


def gold_table(sample: DataFrame, gold_rules=rules.GOLD_RULES) -> DataFrame:
    """Automatic gold for sampled weak labels; rows where the two differ need review."""
    gold = sample.withColumn("gold", rules.auto_gold(F.col("text"), gold_rules))
    return gold.select(
        "text", F.col("gold.label").alias("label"), F.col("label").alias("weak_label"),
        F.col("gold.reason").alias("auto_gold_reason"),
        (F.col("gold.label") != F.col("label")).alias("needs_review"))


def sample_messages(conversations: DataFrame, n: int = 100, seed: int = K.MESSAGE_SEED) -> DataFrame:
    """The first ``n`` lines of ``conversation_id, raw`` with conversations in shuffled order.

    Conversations without a line that says something are passed over, so the first ``n`` of the others
    are enough; only they are unfolded. ``limit`` under an order keeps n rows per task.
    """
    said = F.transform(F.split("raw", "\n"), lambda line: T.strip(F.regexp_replace(line, K.TURN_PREFIX, "")))
    order = shuffle_key(seed, F.col("conversation_id").cast("string"))
    spoken = (conversations.select("conversation_id", order.alias("key"), said.alias("lines"))
              .filter(F.exists("lines", lambda line: line != "")))
    first = spoken.orderBy("key", "conversation_id").limit(n)
    lines = (first.select("key", "conversation_id", F.posexplode("lines").alias("line", "text"))
             .filter("text <> ''"))
    return (lines.orderBy("key", "conversation_id", "line").limit(n)
            .select("conversation_id", "line", "text"))
