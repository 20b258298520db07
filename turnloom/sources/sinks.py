"""Writers. Every one is a plain distributed write; nothing passes through the driver."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnloom.operators.binning import Binning
from turnloom.scaling import local_table, materialize


def write_profile(days: DataFrame, info: Binning, path: str) -> None:
    """One JSON record per period, each carrying how the periods were made."""
    days.withColumn("info", info.column()).write.mode("overwrite").json(path)


write_timeline = write_profile


def write_csv(rows: DataFrame, path: str) -> None:
    """Header CSV, quoted only where needed."""
    (rows.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .csv(path))


def write_dev_sheet(sample: DataFrame, path: str) -> None:
    """Texts with an empty label column to be filled in by hand."""
    write_csv(sample.select("text", F.lit(None).cast("string").alias("label")), path)


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_table(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def write_vectors(vectors: DataFrame, path: str) -> None:
    vectors.withColumn("embedding", F.col("embedding").cast("array<float>")).write.mode(
        "overwrite").parquet(path)


def write_model(model: PipelineModel, spark: SparkSession, path: str) -> None:
    """A trained intent model in ``path/model`` and its vocabulary ``position, term, idf`` in ``path/vocabulary``."""
    model.write().overwrite().save(f"{path}/model")
    terms = zip(model.stages[0].vocabulary, model.stages[1].getScalingVec().toArray().tolist())
    rows = [(i, term, idf) for i, (term, idf) in enumerate(terms)]  # at most the model's number of features
    write_table(local_table(spark, rows, "position INT, term STRING, idf DOUBLE"), f"{path}/vocabulary")


def _row_digest(rows: DataFrame) -> Column:
    """MD5 of a row: every column's name order, length and text form, so neighbouring values cannot run together."""
    parts = []
    for name in sorted(rows.columns):
        value = F.col(f"`{name}`")
        kind = rows.schema[name].dataType
        text = F.to_json(F.struct(value)) if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.md5(F.concat_ws("|", *parts).cast("binary"))


def fingerprints(rows: DataFrame, period: str) -> DataFrame:
    """``period, n, h1, h2``: count and two sums of 60 bits of row digests, whatever the order of rows and columns.

    Sums are exact decimals. Tasks add up first, so one period may have any share of the rows. A null period is one
    of its own; an empty table has none.
    """
    def part(start):
        return F.sum(F.conv(F.substring("_digest", start, 15), 16, 10).cast("decimal(38,0)"))

    return (rows.select(F.col(f"`{period}`").alias("period"), _row_digest(rows).alias("_digest"))
            .groupBy("period").agg(F.count("*").alias("n"), part(1).alias("h1"), part(16).alias("h2")))


def write_stale_periods(rows: DataFrame, path: str, period: str) -> list:
    """Rewrite the periods of the table at ``path`` whose content differs from ``rows``; returns them in order.

    The data lies in ``path/data``, partitioned by ``period``, its fingerprints in ``path/fingerprints``. Data is
    written first, so a job that dies in between writes the same periods once more and never takes old content for
    new. ``read_periods`` reads the table; periods that ``rows`` no longer has are left out there.
    """
    spark = rows.sparkSession
    now = materialize(fingerprints(rows, period))  # a row a period
    target = f"{path}/data"
    try:
        before = spark.read.schema(now.schema).parquet(f"{path}/fingerprints")
    except AnalysisException as problem:
        if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        stale = [row.period for row in now.select("period").collect()]
        rows.write.mode("overwrite").partitionBy(period).parquet(target)
    else:
        old = before.withColumnsRenamed({c: f"_{c}" for c in before.columns})
        both = now.join(old, now["period"].eqNullSafe(old["_period"]), "full_outer")
        same = F.col("n").eqNullSafe(F.col("_n")) & F.col("h1").eqNullSafe(F.col("_h1")) & F.col("h2").eqNullSafe(F.col("_h2"))
        changed = materialize(both.filter(~same).select(F.coalesce("period", "_period").alias("_stale"), F.col("n").isNull().alias("_gone")))
        stale = [row._stale for row in changed.collect()]
        if not stale:
            return []
        fresh = changed.filter(~F.col("_gone"))
        part = rows.join(fresh, rows[f"`{period}`"].eqNullSafe(fresh["_stale"]), "left_semi")
        part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(period).parquet(target)
    now.write.mode("overwrite").parquet(f"{path}/fingerprints")
    return sorted(stale, key=lambda p: (p is not None, p))


def read_periods(spark: SparkSession, path: str, period: str) -> DataFrame:
    """The table that ``write_stale_periods`` keeps at ``path``; its period has the type it was written with."""
    present = spark.read.parquet(f"{path}/fingerprints").select(F.col("period").alias("_period"))
    inferred = spark.read.parquet(f"{path}/data").schema
    kind = present.schema["_period"].dataType
    schema = T.StructType([T.StructField(f.name, kind if f.name == period else f.dataType) for f in inferred])
    rows = spark.read.schema(schema).parquet(f"{path}/data")
    return rows.join(present, rows[f"`{period}`"].eqNullSafe(present["_period"]), "left_semi")


def write_if_stale(rows: DataFrame, path: str, force: bool = False) -> bool:
    """Write unless the stored table already has as many rows; True when written. By content: ``write_stale_periods``."""
    if not force:
        try:
            if rows.sparkSession.read.parquet(path).count() == rows.count():
                return False
        except AnalysisException as problem:
            if problem.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    write_table(rows, path)
    return True
