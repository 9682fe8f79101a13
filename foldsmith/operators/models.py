"""Classifiers on fold data: Spark ML baselines, a neighbour model, batch scoring."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.operators.cells import forest_probabilities, with_probabilities
from foldsmith.operators.metrics import metrics_all
from foldsmith.operators.neighbours import knn_join, matrix, vector
from foldsmith.session import materialize
from foldsmith.spec import TableSpec

MODELS: dict[str, Callable] = {
    "random_forest": lambda seed=42, trees=100, depth=10: RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, cacheNodeIds=False
    ),
    "decision_tree": lambda seed=42, depth=10: DecisionTreeClassifier(
        maxDepth=depth, seed=seed
    ),
}


def assemble(df: DataFrame, spec: TableSpec) -> DataFrame:
    """``(row_id, features vector, label)``."""
    return df.select(
        F.col(spec.row_id),
        array_to_vector(vector(spec.features)).alias("features"),
        F.col(spec.target).cast("double").alias("label"),
    )


@contextmanager
def held(df: DataFrame, spec: TableSpec) -> Iterator[DataFrame]:
    """The assembled rows, kept on the executors while they are used: a fit passes over its rows
    several times, each time from the start of their plan. Partitions stay as they are, and with
    them the draws of a forest."""
    rows = assemble(df, spec).persist()
    try:
        yield rows
    finally:
        rows.unpersist()


def fit_predict(
    estimator, train: DataFrame, test: DataFrame, spec: TableSpec
) -> tuple[DataFrame, dict[str, float]]:
    """Fit, score, and time both. The predictions are written once, so that the
    clock covers the scoring and the metrics do not repeat it.

    Returns ``(row_id, y_true, probs)`` and the seconds spent. A forest of a large table grows
    from its counted cells (:mod:`foldsmith.operators.cells`).
    """
    started = time.perf_counter()
    found = forest_probabilities(estimator, train, spec)
    if found is not None:
        fitted = time.perf_counter()
        asked = test.select(
            F.col(spec.row_id),
            F.col(spec.target).cast("int").alias("y_true"),
            *[F.col(f"`{c}`").cast("double").alias(c) for c in spec.features],
        )
        scored = with_probabilities(asked, *found, "probs").select(spec.row_id, "y_true", "probs")
        predictions = materialize(scored, "predictions")
        done = time.perf_counter()
        return predictions, {"time_fit": fitted - started, "time_predict": done - fitted}
    with held(train, spec) as rows:
        return fit_vectors(estimator, rows, assemble(test, spec), spec)


def fit_vectors(
    estimator, train: DataFrame, test: DataFrame, spec: TableSpec
) -> tuple[DataFrame, dict[str, float]]:
    """:func:`fit_predict` of rows that are assembled already."""
    started = time.perf_counter()
    model = estimator.fit(train)
    fitted = time.perf_counter()
    scored = model.transform(test).select(
        spec.row_id,
        F.col("label").cast("int").alias("y_true"),
        vector_to_array("probability").alias("probs"),
    )
    predictions = materialize(scored, "predictions")
    done = time.perf_counter()
    return predictions, {"time_fit": fitted - started, "time_predict": done - fitted}


def evaluate(
    estimator, train: DataFrame, test: DataFrame, spec: TableSpec
) -> dict[str, float]:
    """Metrics and timings of one model on one split."""
    split = getattr(estimator, "fit_predict", None)
    return summary(*(split(train, test, spec) if split else fit_predict(estimator, train, test, spec)))


def summary(predictions: DataFrame, timing: dict[str, float]) -> dict[str, float]:
    """Metrics of one model's predictions, and its timings."""
    row = metrics_all(predictions.withColumn("run", F.lit(0)), ["run"]).first()
    return {
        **{m: row[m] for m in ("accuracy", "auc", "f1", "log_loss")},
        **timing,
    }


def context_knn(
    queries: DataFrame, context: DataFrame, spec: TableSpec, classes: int, k: int = 5, by=("fold_id",)
) -> DataFrame:
    """Class probabilities from the k nearest context rows, weighted by
    ``1 / (distance + 1e-6)``. No training. Returns ``(by, row_id, y_true, probs)``."""
    by = list(by)
    q = queries.select(*by, F.col(spec.row_id).alias("q_id"), vector(spec.features).alias("vec"))
    s = context.select(*by, F.col(spec.row_id).alias("s_id"), vector(spec.features).alias("vec"))
    labels = context.select(*by, F.col(spec.row_id).alias("s_id"), F.col(spec.target).alias("__y"))
    weight = 1 / (F.col("distance") + F.lit(1e-6))
    votes = (
        knn_join(q, s, k, by=by)
        .join(labels, [*by, "s_id"])
        .groupBy(*by, "q_id")
        .agg(
            F.sum(weight).alias("__all"),
            *[
                F.sum(F.when(F.col("__y") == c, weight).otherwise(0.0)).alias(f"__c{c}")
                for c in range(classes)
            ],
        )
        .select(
            *by,
            F.col("q_id").alias(spec.row_id),
            F.array(*[F.col(f"__c{c}") / F.col("__all") for c in range(classes)]).alias("probs"),
        )
    )
    truth = queries.select(*by, spec.row_id, F.col(spec.target).cast("int").alias("y_true"))
    return truth.join(votes, [*by, spec.row_id])


class ContextKnn:
    """:func:`context_knn` as a model of a grid: nothing is fitted, the training rows are
    the context. Labels are 0 up to the largest label of the context."""

    def __init__(self, seed=42, k: int = 5):
        self.k = k

    def fit_predict(self, train: DataFrame, test: DataFrame, spec: TableSpec):
        started = time.perf_counter()
        classes = int(train.agg(F.max(spec.target)).first()[0]) + 1
        fitted = time.perf_counter()
        sides = [df.withColumn(spec.row_id, F.col(spec.row_id).cast("string")) for df in (test, train)]
        scored = context_knn(*sides, spec, classes, self.k)
        predictions = materialize(scored.select(spec.row_id, "y_true", "probs"), "predictions")
        done = time.perf_counter()
        return predictions, {"time_fit": fitted - started, "time_predict": done - fitted}


MODELS["context_knn"] = ContextKnn


def score_external(
    df: DataFrame,
    features,
    predict_proba: Callable[[np.ndarray], np.ndarray],
    keep=(),
) -> DataFrame:
    """Batch scoring with any ``rows x features -> rows x classes`` function.

    Runs per Arrow batch on the executors; the function travels with the tasks.
    """
    keep = list(keep)
    schema = T.StructType(
        [df.schema[c] for c in keep] + [T.StructField("probs", T.ArrayType(T.DoubleType()))]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                out = pdf[keep].copy()
                out["probs"] = list(np.asarray(predict_proba(matrix(pdf["__x"])), dtype=float))
                yield out

    return df.select(*keep, vector(features).alias("__x")).mapInPandas(score, schema)
