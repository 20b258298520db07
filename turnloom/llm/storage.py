"""Tables written to the shared folder where several passes read them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from turnloom.scaling import checkpoint_folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``, in a folder named after the application.

    Whoever runs the job clears that folder afterwards: results may be read from it until then.
    """
    folder = checkpoint_folder(spark)
    if folder is None:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{folder.rstrip('/')}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Passes over it read only the columns they need, its lineage ends, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
