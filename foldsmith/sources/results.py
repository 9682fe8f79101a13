"""Result rows: append, reload, resume, nested JSON export."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RUN_KEYS = ("random_state", "dataset_id", "fold", "model_name", "augmentation")


def store_results(results: DataFrame, path: str, mode: str = "append") -> None:
    """Write result rows, those of a dataset together and in order, so that the files' own
    statistics let a reader of one dataset skip the others. The number of files follows from
    the rows' measured size, not from the number of datasets."""
    (
        results.hint("rebalance", "dataset_id")
        .sortWithinPartitions("dataset_id")
        .write.mode(mode)
        .parquet(path)
    )


def commit_runs(results: DataFrame, path: str) -> None:
    """Write finished runs, one folder per run, replacing what the same run stored before.

    A run computed twice, as after a crash between its write and its report, has one result.
    Writers of one path take turns: they share the path's staging folder.
    """
    (
        results.coalesce(1)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*RUN_KEYS)
        .parquet(path)
    )


def load_results(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """Stored result rows, or None if nothing was stored. Without ``schema`` the types of
    the folder names are inferred."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error) or "UNABLE_TO_INFER_SCHEMA" in str(error):
            return None
        raise


def pending_runs(grid: DataFrame, stored: DataFrame | None, keys=RUN_KEYS) -> DataFrame:
    """Runs of the grid that have no stored result yet."""
    if stored is None:
        return grid
    return grid.join(stored.select(*keys).distinct(), list(keys), "left_anti")


def results_json(log: DataFrame, metrics) -> DataFrame:
    """Evaluation log as JSON: ``state -> dataset -> fold -> model -> [metrics]``.

    ``log`` holds ``random_state, dataset_id, fold, model, step`` and the
    metrics. One document per random state and dataset, so that a document holds
    the folds, models and steps of one dataset and no more.
    """

    history = F.transform(
        F.array_sort(F.collect_list(F.struct("step", *metrics))),
        lambda s: F.struct(*[s[m].alias(m) for m in metrics]),
    )
    # A map has no order; text lists the keys of every level sorted.
    out = log.groupBy("random_state", "dataset_id", "fold", "model").agg(
        F.to_json(history).alias("body")
    )
    for group, prefix, key in (
        (["random_state", "dataset_id", "fold"], "", "model"),
        (["random_state", "dataset_id"], "fold_", "fold"),
    ):
        pair = F.concat(
            F.lit('"' + prefix), F.col(key).cast("string"), F.lit('":'), F.col("body")
        )
        out = out.groupBy(*group).agg(
            F.concat(
                F.lit("{"), F.array_join(F.array_sort(F.collect_list(pair)), ","), F.lit("}")
            ).alias("body")
        )
    return out.select(
        F.concat(F.lit("random_state_"), F.col("random_state")).alias("random_state"),
        F.concat(F.lit("dataset_"), F.col("dataset_id")).alias("dataset"),
        F.col("body").alias("evaluation"),
    )
