"""The stateless projections on unbounded input.

Labels, sentiment and model scores look at one row only, so a stream needs no state, watermark or
shuffle; checkpointing of the query's progress is Spark's.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from turnloom.functions import sentiment
from turnloom.functions.sentiment import Lexicon
from turnloom.operators import intent
from turnloom.plans.intent import label_lines


def score_stream(messages: DataFrame, lexicon: Lexicon | None = None,
                 model: PipelineModel | None = None) -> DataFrame:
    """Weak label, sentiment and, given a model, its prediction for a stream with ``text``."""
    scored = label_lines(messages).withColumn("compound", sentiment.compound(F.col("text"), lexicon))
    if model is None:
        return scored
    named = scored.withColumnsRenamed({"label": "weak_label"})
    return intent.classify(named, model)


def write_stream(scored: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append to a Parquet table; call ``start`` on the result."""
    return (scored.writeStream.format("parquet").outputMode("append")
            .option("path", path).option("checkpointLocation", checkpoint))
