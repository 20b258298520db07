"""Dialogues to turns, turns to chunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import sentiment
from turnloom.functions import text as T
from turnloom.functions.sentiment import Lexicon


def spoken_lines(raw: Column) -> Column:
    """Array of ``(speaker, text)``: lines with a speaker prefix and something said."""
    def read(line: Column) -> Column:
        return F.struct(
            F.regexp_extract(line, K.TURN_PREFIX, 1).alias("speaker"),
            T.strip(F.regexp_replace(line, K.TURN_PREFIX, "")).alias("text"))

    parsed = F.transform(F.split(raw, "\n"), read)
    return F.filter(parsed, lambda turn: (turn["speaker"] != "") & (turn["text"] != ""))


def explode_turns(conversations: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """One row per turn, numbered over the kept lines; ``keep`` columns (the day) ride along."""
    return (
        conversations
        .select("conversation_id", *keep, F.posexplode(spoken_lines(F.col("raw"))).alias("turn_index", "turn"))
        .select("conversation_id", *keep, "turn_index",
                F.col("turn.speaker").cast("int").alias("speaker"), F.col("turn.text").alias("text"))
    )


def explode_lines(conversations: DataFrame) -> DataFrame:
    """Every non-empty line as ``text``, its speaker prefix removed where there is one."""
    return (
        conversations.select(F.explode(F.split("raw", "\n")).alias("line"))
        .select(T.strip(F.regexp_replace("line", K.TURN_PREFIX, "")).alias("text"))
        .filter("text <> ''")
    )


def attach_days(turns: DataFrame, days: DataFrame) -> DataFrame:
    """Day of each turn when it was not carried along. Spark broadcasts ``days`` if it is small
    and splits skewed conversations if it is not."""
    return turns.join(days.select("conversation_id", "day"), "conversation_id")


def _chunk_text(speaker: Column, text: Column) -> Column:
    return F.concat(F.lit("User "), speaker.cast("string"), F.lit(": "), text)


def _as_chunk(df: DataFrame, lexicon: Lexicon | None) -> DataFrame:
    return df.select(
        F.format_string("c%d_t%d", "conversation_id", "turn_index").alias("id"),
        "text", "conversation_id", "turn_index",
        F.col("day").alias("day_bucket"),
        sentiment.compound(F.col("text"), lexicon).alias("sentiment"),
        F.lit(False).alias("synthetic"),
    )


def turn_pair_chunks(turns: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """Turns (0, 1), (2, 3), … of a conversation as chunks; an odd last turn stands alone.

    ``turn_index`` must be dense from 0. A group has at most two rows, so a conversation of any
    length spreads over the cluster.
    """
    pairs = turns.groupBy("conversation_id", F.expr("turn_index div 2").alias("pair")).agg(
        F.array_sort(F.collect_list(F.struct(
            "turn_index", "day", _chunk_text(F.col("speaker"), F.col("text")).alias("line")))).alias("turns"))
    return _as_chunk(pairs.select(
        "conversation_id",
        F.col("turns")[0]["turn_index"].alias("turn_index"),
        F.col("turns")[0]["day"].alias("day"),
        F.array_join(F.col("turns.line"), "\n").alias("text"),
    ), lexicon)


def dialogue_chunks(conversations: DataFrame, lexicon: Lexicon | None = None) -> DataFrame:
    """The same chunks straight from ``conversation_id, day, raw``, without any shuffle."""
    turns = F.col("turns")
    lines = F.transform(turns, lambda t: _chunk_text(t["speaker"].cast("int"), t["text"]))
    starts = F.when(F.size(turns) > 0, F.sequence(F.lit(0), F.size(turns) - 1, F.lit(2)))
    spread = (
        conversations.select("conversation_id", "day", spoken_lines(F.col("raw")).alias("turns"))
        .select("conversation_id", "day", lines.alias("lines"), F.explode(starts).alias("turn_index"))
    )
    return _as_chunk(spread.select(
        "conversation_id", "day", "turn_index",
        F.array_join(F.slice("lines", F.col("turn_index") + 1, 2), "\n").alias("text")), lexicon)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.agg(
        F.count_if(~F.col("synthetic")).alias("n_natural"),
        F.count_if("synthetic").alias("n_synthetic"),
        F.count("*").alias("n_total"),
    )
