"""Label distributions and classification metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.scaling import local_table


def _label_table(df: DataFrame, labels: Sequence, name: str) -> DataFrame:
    return local_table(df.sparkSession, list(enumerate(labels)), f"label_order INT, {name} STRING")


def label_distribution(rows: DataFrame, labels: Sequence[str] = K.LABELS) -> DataFrame:
    """Count and percentage per label; absent labels show 0."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    total = F.sum(F.coalesce("n", F.lit(0))).over(W.partitionBy())  # one row per label
    listed = _label_table(rows, labels, "label").join(counts, "label", "left")
    n = F.coalesce("n", F.lit(0)).cast("bigint")
    return listed.select(
        "label_order", "label", n.alias("n"),
        F.when(total > 0, F.round(100.0 * n / total, 1)).otherwise(0.0).alias("percent")
    ).orderBy("label_order")


def agreement(gold: DataFrame) -> DataFrame:
    return gold.agg(
        F.count_if(~F.col("needs_review")).alias("n_agree"),
        F.count("*").alias("n"),
        F.round(F.avg((~F.col("needs_review")).cast("double")), 4).alias("rate"))


def confusion_matrix(predictions: DataFrame, labels: Sequence = K.LABELS) -> DataFrame:
    """``true_order, true_label, pred_order, pred_label, n`` for every pair of labels, zeros kept."""
    counts = predictions.groupBy(F.col("label").alias("true_label"), F.col("prediction").alias("pred_label")
                                 ).agg(F.count("*").alias("n"))
    cells = local_table(
        predictions.sparkSession, [(i, t, j, p) for i, t in enumerate(labels) for j, p in enumerate(labels)],
        "true_order INT, true_label STRING, pred_order INT, pred_label STRING")
    return cells.join(counts, ["true_label", "pred_label"], "left").select(
        "true_order", "true_label", "pred_order", "pred_label",
        F.coalesce("n", F.lit(0)).cast("bigint").alias("n")).orderBy("true_order", "pred_order")


def _rates(counted: DataFrame) -> DataFrame:
    """Unrounded precision, recall and F1 from ``tp, n_true, n_pred``; 0 where undefined."""
    def share(part, whole):
        return F.when(whole > 0, part / whole).otherwise(0.0)

    precision = share(F.col("tp"), F.col("n_pred"))
    recall = share(F.col("tp"), F.col("n_true"))
    f1 = share(2.0 * F.col("tp"), F.col("n_true") + F.col("n_pred"))
    return counted.withColumns({"precision": precision, "recall": recall, "f1": f1})


def _per_label(predictions: DataFrame) -> DataFrame:
    """One row per label seen as truth or prediction, in a single aggregate."""
    hit = (F.col("label") == F.col("prediction")).cast("int")
    pairs = predictions.groupBy("label", "prediction").agg(F.count("*").alias("n"))
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("label").alias("label"), F.col("n").alias("n_true"), F.lit(0).cast("bigint").alias("n_pred"),
                 (hit * F.col("n")).alias("tp")),
        F.struct(F.col("prediction").alias("label"), F.lit(0).cast("bigint").alias("n_true"),
                 F.col("n").alias("n_pred"), F.lit(0).cast("bigint").alias("tp")))))
    return sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("n_true", "n_pred", "tp")])


def class_metrics(predictions: DataFrame, labels: Sequence = K.LABELS) -> DataFrame:
    """Precision, recall, F1 and support of each label in fixed order, rounded to 4."""
    listed = _label_table(predictions, labels, "label").join(_per_label(predictions), "label", "left")
    filled = _rates(listed.fillna(0, ["n_true", "n_pred", "tp"]))
    return filled.select(
        "label_order", "label",
        *[F.round(c, 4).alias(c) for c in ("precision", "recall", "f1")],
        F.col("n_true").alias("support")).orderBy("label_order")


def macro_f1(predictions: DataFrame) -> DataFrame:
    """Mean F1 over the labels that occur as truth or prediction."""
    return _rates(_per_label(predictions)).agg(
        F.count("*").alias("n_labels"), F.round(F.avg("f1"), 4).alias("macro_f1"))
