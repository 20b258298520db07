"""Readers: conversations, labelled rows, chunks, vectors, timelines and word lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import sentiment
from turnloom.functions.sentiment import Lexicon
from turnloom.scaling import local_table

CHUNK_SCHEMA = ("id STRING, text STRING, conversation_id BIGINT, turn_index INT, day_bucket INT, "
                "sentiment DOUBLE, synthetic BOOLEAN")
TREND_SCHEMA = ("day INT, mood STRING, tone STRING, avg_compound DOUBLE, drift_score DOUBLE, "
                "drift_from_prev BOOLEAN, top_topics ARRAY<STRUCT<term: STRING>>, "
                "top_entities ARRAY<STRUCT<text: STRING>>, trigger STRUCT<kind: STRING, value: STRING>")
# Cell texts that a CSV reader takes for "missing".
MISSING_MARKERS = ["", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>",
                   "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null"]


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """The conversation column of header-less CSV files, missing cells dropped."""
    cells = (spark.read.schema("raw STRING").option("multiLine", True)
             .option("quote", '"').option("escape", '"').csv(path))
    return cells.filter(F.col("raw").isNotNull() & ~F.col("raw").isin(MISSING_MARKERS))


def read_conversations(spark: SparkSession, path: str) -> DataFrame:
    """``conversation_id, raw`` with ids dense and 0-based in file and row order.

    A quoted cell may span lines, so a file is read by one task; large corpora come as many files.
    Rows keep their place: the id is the number of rows in earlier files plus the place within the
    file. Only one row per file is sorted or broadcast, which the driver's file listing bounds.
    """
    placed = read_raw(spark, path).select(
        "raw",
        F.col("_metadata.file_path").alias("file"),
        F.monotonically_increasing_id().alias("place"),
    )
    files = placed.groupBy("file").agg(F.min("place").alias("first_place"), F.count("*").alias("n"))
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    offsets = files.select("file", "first_place",
                           F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    return placed.join(F.broadcast(offsets), "file").select(
        (F.col("offset") + F.col("place") - F.col("first_place")).alias("conversation_id"), "raw")


def _without_markers(cells: DataFrame) -> DataFrame:
    """String cells that say "missing" as nulls."""
    return cells.select([F.when(~F.col(f"`{c}`").isin(MISSING_MARKERS), F.col(f"`{c}`")).alias(c) for c in cells.columns])


def read_labeled(spark: SparkSession, path: str, keep_missing: bool = False) -> DataFrame:
    """Weakly labelled rows ``text, label, source_rule``; cells that say "missing" are null, and dropped with their rows
    unless ``keep_missing``."""
    rows = (spark.read.option("multiLine", True).option("quote", '"').option("escape", '"')
            .schema("text STRING, label STRING, source_rule STRING").csv(path, header=True))
    rows = _without_markers(rows)
    return rows if keep_missing else rows.dropna(subset=["text", "label"])


def _read_if_present(read):
    try:
        return read()
    except AnalysisException as problem:
        if problem.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def load_dev(spark: SparkSession, hand_path: str, auto_path: str) -> DataFrame:
    """Hand-labelled rows when any exist, else automatic gold; ``dev_source`` says which."""
    def read(path):
        return _without_markers(spark.read.option("multiLine", True).option("quote", '"').option("escape", '"')
                                .csv(path, header=True))

    hand = _read_if_present(lambda: read(hand_path))
    if hand is not None and "label" in hand.columns:
        labelled = hand.filter(F.col("label").isNotNull())
        if not labelled.isEmpty():
            return labelled.withColumn("dev_source", F.lit("hand"))
    return read(auto_path).withColumn("dev_source", F.lit("auto"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunks out of one JSON document ``{info, chunks: [...]}``."""
    document = spark.read.schema(f"chunks ARRAY<STRUCT<{_struct_fields(CHUNK_SCHEMA)}>>").json(
        path, multiLine=True)
    return document.select(F.inline("chunks"))


def _struct_fields(schema: str) -> str:
    return ", ".join(f"{name}: {kind}" for name, kind in
                     (column.strip().split(" ", 1) for column in schema.split(", ")))


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_model(spark: SparkSession, path: str) -> tuple[PipelineModel, DataFrame]:
    """A model and its vocabulary as ``write_model`` stores them."""
    return PipelineModel.load(f"{path}/model"), spark.read.parquet(f"{path}/vocabulary")


def read_timeline(spark: SparkSession, path: str) -> DataFrame:
    """A stored drift timeline, or an empty one when none was written yet."""
    stored = _read_if_present(lambda: spark.read.json(path))
    return spark.createDataFrame([], TREND_SCHEMA) if stored is None else stored


def read_lexicon(spark: SparkSession, path: str, **modifiers) -> Lexicon:
    """Word list in the published tab-separated form: word, mean valence, further columns."""
    table = (spark.read.option("sep", "\t").option("quote", "").schema("word STRING, valence DOUBLE")
             .csv(path).dropna())
    return Lexicon({row.word: row.valence for row in table.collect()}, **modifiers)


def seed_chunks(spark: SparkSession, seeds=None, lexicon: Lexicon | None = None, prefix: str = "syn_sister_") -> DataFrame:
    """Caller-supplied seed rows ``(day, text)`` as chunks marked synthetic, their ids numbered after ``prefix``."""
    rows = [(f"{prefix}{i}", text, day) for i, (day, text) in enumerate(seeds or K.SEED_CHUNKS)]
    return local_table(spark, rows, "id STRING, text STRING, day_bucket INT").select(
        "id", "text",
        F.lit(-1).cast("bigint").alias("conversation_id"),
        F.lit(0).alias("turn_index"),
        "day_bucket",
        sentiment.compound(F.col("text"), lexicon).alias("sentiment"),
        F.lit(True).alias("synthetic"),
    )


def demo_queries(spark: SparkSession) -> DataFrame:
    rows = [(i, query, entity) for i, (query, entity) in enumerate(K.DEMO_QUERIES)]
    return local_table(spark, rows, "qid BIGINT, query STRING, entity STRING")
