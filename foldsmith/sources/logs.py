"""Training log: appended scalar events and their wide export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LOG_COLUMNS = ("writer", "tag", "step", "value", "seq")


def read_log(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(f"{path}/scalars")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise


def register_writers(configs: DataFrame, path: str) -> None:
    """Append writers with their configuration as text.

    ``configs`` holds ``writer`` and a ``config`` struct. A name that is
    registered already, or given twice, is an error.
    """
    spark = configs.sparkSession
    if configs.groupBy("writer").count().filter("count > 1").limit(1).count():
        raise ValueError("writer given twice")
    try:
        known = spark.read.parquet(f"{path}/writers")
        if configs.join(known, "writer", "left_semi").limit(1).count():
            raise ValueError("writer already exists")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    configs.select("writer", F.to_json("config").alias("config")).write.mode(
        "append"
    ).parquet(f"{path}/writers")


def append_scalars(events: DataFrame, path: str) -> None:
    """Append scalar events ``(writer, tag, step, value, seq)``."""
    value = events.schema["value"].dataType
    if not isinstance(value, T.NumericType):
        raise ValueError(f"value of type {value.simpleString()} is not a scalar")
    events.select(*LOG_COLUMNS).write.mode("append").parquet(f"{path}/scalars")


def log_pivot(log: DataFrame, tags, keys=("step",)) -> DataFrame:
    """One row per step, one column per tag; the last write of a pair wins.

    The tags are given, so the pivot needs no job to find them.
    """
    return (
        log.groupBy(*keys).pivot("tag", list(tags)).agg(F.max_by("value", "seq"))
    )


def save_log_csv(log: DataFrame, tags, path: str, keys=("step",)) -> None:
    log_pivot(log, tags, keys).write.mode("overwrite").option("header", True).csv(path)
