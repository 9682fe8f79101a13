"""Shared scratch folder and intermediate tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_CONF = "spark.checkpoint.dir"

# Size up to which a side that has been measured may be broadcast.
BROADCAST_BYTES = 64 * 1024 * 1024

# Rows and bytes of texts that a Python worker gets at a time, at most.
BATCH_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
    "spark.sql.execution.arrow.maxBytesPerBatch": "4m",
}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Functions that run in Python workers are pickled by reference, so the workers must be
    able to import the package from any working directory.
    """
    context = spark.sparkContext
    if getattr(context, "_foldsmith_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="foldsmith-ship-"), "foldsmith.zip")
    with zipfile.ZipFile(target, "w") as out:
        for folder, _, files in os.walk(package):
            for name in sorted(files):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(target)
    context._foldsmith_shipped = True


def work_dir(spark: SparkSession) -> str:
    """The folder the session names for checkpoints.

    On a cluster ``spark.checkpoint.dir`` has to point to storage that every executor can
    read; without it an error is raised. Only on a local master one is made.
    """
    folder = spark.conf.get(CHECKPOINT_CONF, None)
    if not folder:
        folder = spark.sparkContext.getConf().get(CHECKPOINT_CONF, None)
    if not folder:
        if not spark.sparkContext.master.partition("[")[0] == "local":
            raise ValueError(f"{CHECKPOINT_CONF} must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="foldsmith-")
        spark.conf.set(CHECKPOINT_CONF, folder)
    return folder.rstrip("/")


# Folders of the tables written by this driver that are still there.
WRITTEN: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    WRITTEN.append(f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return WRITTEN[-1]


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete tables written here that nothing reads any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for path in paths:
        if path in WRITTEN:
            WRITTEN.remove(path)
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def materialize(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it back.

    The written table survives the loss of executors, ends the lineage, and gives
    the planner true sizes, so that it broadcasts only what it has seen to be small.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside passes its rows to Python workers in small batches.

    While a batch is sent, its task holds it several times outside the heap, in buffers that
    are doubled as it grows, and the worker holds it once more; texts fill hundreds of
    megabytes so. The settings are read when a job starts: a table has to be written inside.
    """
    held = {key: spark.conf.get(key, None) for key in BATCH_CONF}
    for key, value in BATCH_CONF.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in held.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def broadcast_if_small(df: DataFrame, size: int, limit: int | None = None) -> DataFrame:
    """Hint a broadcast when the measured size in bytes is within the limit."""
    return F.broadcast(df) if size <= (BROADCAST_BYTES if limit is None else limit) else df
