"""Helpers for jobs that must hold at cluster scale."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "turnloom", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the library is written for; a cluster's own settings win."""
    defaults = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def local_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A few literal rows as a table the planner knows the size of; no Python worker reads it."""
    names = [column.split()[0] for column in schema.split(",")]
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return spark.createDataFrame(pa.table({n: list(c) for n, c in zip(names, columns)}), schema)


def spread(df: DataFrame) -> DataFrame:
    """Use every core on a source that is read in far fewer pieces than there are cores.

    Meant for a small table in one file, whose rows cost much to process. A table whose splits occupy half of
    the cores or more comes back as it is; for large ones set ``spark.sql.files.minPartitionNum`` instead.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() * 2 <= cores else df


def ship(spark: SparkSession, *folders: str) -> None:
    """Send packages to the executors, each once per application, so that tasks can import them anywhere.

    ``folders`` are package folders; this library's own by default.
    """
    context = spark.sparkContext
    for folder in folders or (os.path.dirname(os.path.abspath(__file__)),):
        if (context.applicationId, folder) in _SHIPPED:
            continue
        path = os.path.join(_own_folder(), f"{os.path.basename(folder)}.zip")
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
            for at, _, names in os.walk(folder):
                for name in sorted(names):
                    if name.endswith(".py"):
                        full = os.path.join(at, name)
                        archive.write(full, os.path.relpath(full, os.path.dirname(folder)))
        context.addPyFile(path)
        _SHIPPED.add((context.applicationId, folder))


_SHIPPED: set[tuple[str, str]] = set()


def _own_folder() -> str:
    """A folder of this process, removed when it ends."""
    folder = tempfile.mkdtemp(prefix="turnloom-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder named by the cluster; one of this process only where all tasks run in it too."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _own_folder()
        spark.conf.set("spark.checkpoint.dir", shared)
    return shared


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below a folder named after the application.

    Whoever runs the job clears that folder afterwards: results may be read from it until then.
    """
    folder = checkpoint_folder(spark).rstrip("/")
    return f"{folder}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as Parquet to the shared folder and read back.

    Passes over it read only the columns they need, its lineage ends, and a lost executor costs nothing.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Compute a small ``df`` once where several passes read it.

    The result goes to the shared folder, so a lost executor costs nothing, and Spark removes it with the
    table when ``spark.cleaner.referenceTracking.cleanCheckpoints`` is set. Large tables: ``stored``.
    """
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_folder(spark))
    return df.checkpoint()
