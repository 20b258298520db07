"""From raw documents to tokenised training text, in stages over whole tables.

Each stage works on all that the stage before kept, and its decisions take effect: documents and lines that
it rejects are gone for the next one. All stages but the last return the columns they are given. ``run`` writes
every stage's result to the shared folder and reads it back, so a later failure repeats one stage at most.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom import scaling
from turnloom.llm import decontamination, line_dedup, near_dedup, quality_rules, queries
from turnloom.llm.storage import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that fail the plain rules or lie far from their language and source."""
    return quality_rules.judge(docs).filter("kept").select(docs.columns)


def lines_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop lines that many documents share; ``n_chars`` follows the text."""
    kept = line_dedup.dedup_lines(docs, out="text")
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept.select(docs.columns)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each class of near duplicates."""
    return near_dedup.keep_first(docs).select(docs.columns)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold most of a benchmark item."""
    benchmark = queries.table(spark, sf_dir, "benchmark")
    return decontamination.flag(docs, benchmark).filter("NOT contaminated").select(docs.columns)


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return queries.bpe_digests(docs)


def _shipped(stage):
    """``stage`` after the library has been sent to the executors."""
    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        scaling.ship(spark)
        return stage(spark, docs, sf_dir)

    return run_stage


STAGES = [(name, _shipped(stage)) for name, stage in (
    ("quality_rules", quality_stage),
    ("line_dedup", lines_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("encode", encode_stage),
)]

# Tokenisation, robust estimates and sampling have no SQL form; tests/llm hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = queries.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
