"""Runs over seeds, datasets, folds, models and arms; parameter search."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.functions.hashing import uniform
from foldsmith.operators.cells import fold_accuracies, follows
from foldsmith.operators.foldwise import ROLES, fold_count
from foldsmith.operators.models import MODELS, evaluate, fit_vectors, held, summary
from foldsmith.operators.neighbours import vector
from foldsmith.plans.arms import ARMS, augment
from foldsmith.session import materialize
from foldsmith.sources.results import RUN_KEYS, commit_runs, load_results, pending_runs
from foldsmith.spec import TableSpec

RESULT_SCHEMA = (
    "random_state int, dataset_id int, fold int, model_name string, augmentation string, "
    "accuracy double, auc double, f1 double, log_loss double, "
    "time_fit double, time_predict double"
)


def run_grid(
    spark: SparkSession,
    random_states: Iterable[int],
    dataset_ids: Iterable[int],
    folds: Iterable[int],
    models: Iterable[str],
    augmentations: Iterable[str] = ("none",),
) -> DataFrame:
    """One row per combination of the settings."""
    rows = list(itertools.product(random_states, dataset_ids, folds, models, augmentations))
    return spark.createDataFrame(
        rows,
        "random_state int, dataset_id int, fold int, model_name string, augmentation string",
    )


def run_experiments(
    grid: DataFrame,
    load: Callable[[int, int], tuple[DataFrame, TableSpec]],
    path: str,
    models: dict[str, Callable] = MODELS,
    parallel: int = 4,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Compute the runs of the grid that are not stored yet.

    ``load(dataset_id, random_state)`` gives the preprocessed fold-long table, and
    ``options`` the arguments of an arm by its name. Fits are independent Spark jobs,
    submitted from a few threads. Every run is stored as soon as it has ended, so a grid
    that was stopped goes on with the runs that are missing. The first run that fails ends
    the grid with its error, after the runs under way. An arm's rows are made once for all
    models and the folds that pending runs ask for, and written by fold.
    """
    spark = grid.sparkSession
    pending = pending_runs(grid, load_results(spark, path, RESULT_SCHEMA)).collect()  # settings only
    unknown = {r.augmentation for r in pending} - set(ARMS) | {r.model_name for r in pending} - set(models)
    if unknown:
        raise ValueError(f"unknown arms or models: {sorted(unknown)}")
    tables: dict = {}
    arms: dict = {}
    folds: dict = {}
    for run in pending:
        folds.setdefault((run.dataset_id, run.random_state, run.augmentation), set()).add(run.fold)
    for run in pending:
        key = (run.dataset_id, run.random_state)
        if key not in tables:
            tables[key] = load(*key)
        if (*key, run.augmentation) not in arms:
            df, spec = tables[key]
            df = df.filter(F.col("fold_id").isin(folds[(*key, run.augmentation)]))
            made = augment(run.augmentation, df, spec, **(options or {}).get(run.augmentation, {}))
            arms[(*key, run.augmentation)] = materialize(made, "arm", ["fold_id"])
    turn = Lock()

    def one(run):
        key = (run.dataset_id, run.random_state)
        df, spec = tables[key]
        train = arms[(*key, run.augmentation)].filter(F.col("fold_id") == run.fold)
        test = df.filter((F.col("fold_id") == run.fold) & (F.col("role") == "test"))
        scores = evaluate(models[run.model_name](seed=run.random_state), train, test, spec)
        row = (
            *[run[k] for k in RUN_KEYS],
            *[
                scores[m]
                for m in ("accuracy", "auc", "f1", "log_loss", "time_fit", "time_predict")
            ],
        )
        with turn:
            commit_runs(spark.createDataFrame([row], RESULT_SCHEMA), path)

    with ThreadPoolExecutor(parallel) as pool:
        under_way = [pool.submit(one, run) for run in pending]
        try:
            for run in under_way:
                run.result()
        except BaseException:
            pool.shutdown(wait=False, cancel_futures=True)
            raise
    stored = load_results(spark, path, RESULT_SCHEMA)
    if stored is None:
        stored = spark.createDataFrame([], RESULT_SCHEMA)
    return stored.select(*[c.split()[0] for c in RESULT_SCHEMA.split(", ")])


def search_candidates(
    spark: SparkSession, space: dict[str, tuple], trials: int, seed=42
) -> DataFrame:
    """Seeded random draws from a parameter space, one row per trial.

    Kinds: ``("uniform", a, b)``, ``("loguniform", a, b)``, ``("int", a, b)``
    (both ends included) and ``("choice", v1, v2, ...)``.
    """
    table = spark.range(trials).select(F.col("id").cast("int").alias("trial"))
    columns = [F.col("trial")]
    for name, (kind, *args) in space.items():
        u = uniform(f"{seed}:{name}", "trial")
        if kind == "uniform":
            draw = F.lit(args[0]) + u * F.lit(args[1] - args[0])
        elif kind == "loguniform":
            low, high = math.log(args[0]), math.log(args[1])
            draw = F.exp(F.lit(low) + u * F.lit(high - low))
        elif kind == "int":
            draw = (F.lit(args[0]) + F.floor(u * F.lit(args[1] - args[0] + 1))).cast("int")
        elif kind == "choice":
            options = F.array(*[F.lit(a) for a in args])
            draw = F.get(options, F.floor(u * F.lit(len(args))).cast("int"))
        else:
            raise ValueError(f"unknown kind {kind!r}")
        columns.append(draw.alias(name))
    return table.select(*columns)


def grid_candidates(spark: SparkSession, space: dict[str, Iterable]) -> DataFrame:
    """Every combination of the listed values, one row per trial; the last name varies
    fastest. Combinations are settings, not data."""
    rows = [(i, *values) for i, values in enumerate(itertools.product(*space.values()))]
    return spark.createDataFrame(rows, ["trial", *space]).withColumn("trial", F.col("trial").cast("int"))


def search_folds(
    candidates: DataFrame,
    estimator,
    table: DataFrame,
    spec: TableSpec,
    parallel: int = 4,
) -> DataFrame:
    """Score every candidate on the test rows of every fold by Spark's cross-validation.

    ``table`` holds every row once with its ``fold_roles``; in each fold the rows of the other
    roles train. Columns of ``candidates`` but ``trial`` name parameters of the estimator.
    Returns the candidates with ``accuracy`` (mean over the folds), ``accuracy_sd`` and
    ``is_best`` (the earliest on a tie). The trees of a large table grow from its counted cells
    (:mod:`foldsmith.operators.cells`).
    """
    trials = candidates.collect()  # parameter settings only
    names = [c for c in candidates.columns if c != "trial"]
    grid = [{estimator.getParam(n): t[n] for n in names} for t in trials]
    k = fold_count(table)
    test_fold = (F.array_position(ROLES, "test") - 1).cast("int")
    scores = None
    if isinstance(estimator, DecisionTreeClassifier) and follows(estimator, names):
        settings = ("maxDepth", "maxBins", "minInfoGain")
        asked = [{n: t[n] if n in names else estimator.getOrDefault(n) for n in settings} for t in trials]
        scores = fold_accuracies(table, spec, test_fold, k, asked)
    if scores is not None:
        return _scored(candidates, trials, scores.mean(axis=1), scores.std(axis=1))
    rows = table.select(
        array_to_vector(vector(spec.features)).alias("features"),
        F.col(spec.target).cast("double").alias("label"),
        test_fold.alias("fold"),
    )
    fitted = CrossValidator(
        estimator=estimator,
        estimatorParamMaps=grid,
        evaluator=MulticlassClassificationEvaluator(metricName="accuracy"),
        numFolds=k,
        foldCol="fold",
        parallelism=parallel,
    ).fit(rows)
    return _scored(candidates, trials, fitted.avgMetrics, fitted.stdMetrics)


def _scored(candidates: DataFrame, trials: list, means, deviations) -> DataFrame:
    """The candidates with their scores and the best of them."""
    scored = list(zip(trials, means, deviations, strict=True))
    best = max(scored, key=lambda s: (s[1], -s[0]["trial"]))
    schema = candidates.schema.add("accuracy", "double").add("accuracy_sd", "double")
    return candidates.sparkSession.createDataFrame(
        [(*t, float(mean), float(sd), t is best[0]) for t, mean, sd in scored],
        schema.add("is_best", "boolean"),
    )


def search(
    candidates: DataFrame,
    make: Callable[[dict], object],
    train: DataFrame,
    valid: DataFrame,
    spec: TableSpec,
    parallel: int = 4,
) -> DataFrame:
    """Score every candidate on the validation rows; ``is_best`` marks the most
    accurate (the earliest on a tie). Both tables are assembled once for all trials."""
    trials = candidates.collect()  # parameter settings only

    with held(train, spec) as fitted, held(valid, spec) as asked:

        def one(trial):
            model = make(trial.asDict())
            if hasattr(model, "fit_predict"):
                scores = evaluate(model, train, valid, spec)
            else:
                scores = summary(*fit_vectors(model, fitted, asked, spec))
            return (*trial, scores["accuracy"])

        with ThreadPoolExecutor(parallel) as pool:
            rows = list(pool.map(one, trials))
    at = {c: i for i, c in enumerate(candidates.columns)}["trial"]
    best = max(rows, key=lambda r: (r[-1], -r[at]))
    scored = candidates.schema.add("accuracy", "double").add("is_best", "boolean")
    return candidates.sparkSession.createDataFrame(
        [(*r, r is best) for r in rows], scored
    )
