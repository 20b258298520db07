"""Intent classifier: TF-IDF terms and a class-balanced multinomial logistic regression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, IndexToString, Normalizer, StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnloom import constants as K
from turnloom.functions import text as T
from turnloom.operators import evaluation
from turnloom.scaling import stored


def with_terms(rows: DataFrame) -> DataFrame:
    return rows.withColumn("terms", T.intent_terms(F.col("text")))


def vocabulary(rows: DataFrame, max_features: int = K.MAX_FEATURES, min_df: int = K.MIN_DF) -> DataFrame:
    """``term, tf, df, idf`` of the most frequent terms found in ``min_df`` rows or more.

    Term and row counts come from one explode and one combined aggregate. Ties go to the
    alphabetically first term.
    """
    return _vocabulary(with_terms(rows), max_features, min_df)


def _vocabulary(rows: DataFrame, max_features: int, min_df: int) -> DataFrame:
    """``vocabulary`` of rows that carry their ``terms``."""
    def counted_as(terms, tf, df):
        return F.transform(terms, lambda t: F.struct(t.alias("term"), F.lit(tf).alias("tf"), F.lit(df).alias("df")))

    # Where no term comes twice, one entry a term counts for both.
    seen = T.let(F.struct("terms", F.array_distinct("terms").alias("once")), lambda row: F.when(
        F.size(row["terms"]) == F.size(row["once"]), counted_as(row["terms"], 1, 1)).otherwise(
        F.concat(counted_as(row["terms"], 1, 0), counted_as(row["once"], 0, 1))))
    counted = (
        rows.select(F.inline(seen)).groupBy("term")
        .agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"))
        .filter(F.col("df") >= min_df)
        .orderBy(F.desc("tf"), "term").limit(max_features))
    n_rows = rows.select(F.count("*").alias("n")).scalar()
    return counted.withColumn("idf", F.log((1 + n_rows) / (1 + F.col("df"))) + 1)


def balanced_weights(rows: DataFrame) -> DataFrame:
    """``label, n, weight``: weight = rows / (classes × rows of the class); one row per label."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"))
    totals = counts.agg(F.struct(F.sum("n").alias("rows"), F.count("*").alias("classes"))).scalar()
    return counts.select("label", "n", (totals["rows"] / (totals["classes"] * F.col("n"))).alias("weight"))


def train(rows: DataFrame, max_features: int = K.MAX_FEATURES, min_df: int = K.MIN_DF,
          max_iter: int = 1000) -> PipelineModel:
    """Fit on ``text, label``. The vocabulary (at most ``max_features`` terms) is the only table
    that reaches the driver, as part of the model; gradients are tree-aggregated.

    ``rows`` are read once: their terms are stored, and so are the features that the optimiser reads."""
    kept = stored(with_terms(rows.select("text", "label").dropna()).select("terms", "label"), "intent-terms")
    terms = _vocabulary(kept, max_features, min_df).collect()
    counts = CountVectorizerModel.from_vocabulary([t.term for t in terms], "terms", "counts")
    weigh = ElementwiseProduct(scalingVec=DenseVector([t.idf for t in terms]), inputCol="counts",
                               outputCol="weighted")
    unit = Normalizer(p=2.0, inputCol="weighted", outputCol="features")
    features = PipelineModel([counts, weigh, unit])

    weights = {r.label: r for r in balanced_weights(kept).collect()}  # one row per label
    names, n_rows = sorted(weights), sum(r.n for r in weights.values())
    index = StringIndexerModel.from_labels(names, "label", "label_index")
    weight = F.create_map(*[F.lit(x) for name in names for x in (name, weights[name].weight)])[F.col("label")]
    prepared = stored(index.transform(features.transform(kept)).select(
        "features", "label_index", weight.alias("weight")), "intent-features")
    # Balanced weights sum to the number of rows, over which Spark averages the loss; a summed loss
    # with unit inverse regularisation is therefore 1 / n here.
    regression = LogisticRegression(
        labelCol="label_index", weightCol="weight", family="multinomial", elasticNetParam=0.0,
        regParam=1.0 / n_rows, standardization=False, maxIter=max_iter)
    fitted = regression.fit(prepared)
    name = IndexToString(inputCol="prediction", outputCol="label", labels=names)
    return PipelineModel([counts, weigh, unit, fitted, name])


def classify(rows: DataFrame, model: PipelineModel) -> DataFrame:
    """Add ``label`` and ``confidence`` to rows with ``text``; works on streams too."""
    kept = [c for c in rows.columns if c != "label"]
    scored = model.transform(with_terms(rows.select(*kept)))
    return scored.select(*kept, "label",
                         F.round(F.array_max(vector_to_array("probability")), 4).alias("confidence"))


def evaluate(gold: DataFrame, model: PipelineModel, labels: Sequence[str] = K.LABELS) -> dict[str, DataFrame]:
    """Metrics of the model on ``text, label``."""
    truth = gold.select("text", F.col("label").alias("truth"))
    predictions = classify(truth, model).select(F.col("truth").alias("label"), F.col("label").alias("prediction"))
    return {
        "confusion": evaluation.confusion_matrix(predictions, labels),
        "classes": evaluation.class_metrics(predictions, labels),
        "macro": evaluation.macro_f1(predictions),
    }


def metrics_record(metrics: dict[str, DataFrame], model: PipelineModel, n_train: int, n_dev: int,
                   dev_source: str) -> DataFrame:
    """One nested row holding everything about a training run."""
    classes = metrics["classes"].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(
        "label", F.struct("precision", "recall", "f1", F.col("support").alias("support_in_dev"))))))
        .alias("per_class"))
    rows = metrics["confusion"].groupBy("true_order", "true_label").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pred_order", "n"))), lambda c: c["n"]).alias("cells"))
    matrix = rows.agg(F.array_sort(F.collect_list(F.struct("true_order", "true_label", "cells"))).alias("rows")).select(
        F.struct(F.col("rows.true_label").alias("labels"), F.lit(True).alias("rows_are_true"),
                 F.col("rows.cells").alias("values")).alias("confusion_matrix"))
    vocabulary_size = len(model.stages[0].vocabulary)
    return classes.select(
        F.lit(dev_source).alias("dev_source"), F.lit(n_train).alias("n_train"), F.lit(n_dev).alias("n_dev"),
        F.lit(vocabulary_size).alias("vocab_size"),
        metrics["macro"].select("macro_f1").scalar().alias("macro_f1_dev"),
        "per_class", matrix.scalar().alias("confusion_matrix"))

