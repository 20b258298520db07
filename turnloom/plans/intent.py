"""Label, sample, train, evaluate."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import rules
from turnloom.operators import intent, sampling, turns
from turnloom.scaling import materialize, stored


def label_lines(lines: DataFrame, weak_rules=rules.WEAK_RULES) -> DataFrame:
    """``text, label, source_rule`` for every line; a projection."""
    labelled = lines.withColumn("weak", rules.weak_label(F.col("text"), weak_rules))
    return labelled.select(*[c for c in lines.columns if c != "text"], "text",
                           F.col("weak.label").alias("label"), F.col("weak.reason").alias("source_rule"))


def label_corpus(conversations: DataFrame, weak_rules=rules.WEAK_RULES) -> DataFrame:
    return label_lines(turns.explode_lines(conversations), weak_rules)


def train_and_evaluate(labelled: DataFrame, dev: DataFrame | None = None, labels=K.LABELS,
                       max_iter: int = 1000) -> tuple[PipelineModel, DataFrame]:
    """Model and its metrics record; without ``dev`` a gold sample is drawn from the rows."""
    labelled = stored(labelled, "labelled")
    source = "hand"
    if dev is None:
        # A bounded number of rows a label, read by each metric.
        dev, source = materialize(sampling.gold_table(sampling.stratified_head(labelled, labels=labels))), "auto"
    model = intent.train(labelled, max_iter=max_iter)
    metrics = intent.evaluate(dev, model, labels)
    return model, intent.metrics_record(metrics, model, labelled.count(), dev.count(), source)
