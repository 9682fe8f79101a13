"""Models, scoring, experiment grid, search."""

import numpy as np
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from foldsmith.operators import models as M
from foldsmith.plans import experiment as X
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.queries.base import (
    ORDERS,
    orders_roles,
    query,
    r6,
    sr6,
    table,
    u_sql,
    written,
)
from foldsmith.queries.neighbours import POINT_NEAR, POINTS, POINTS_FOLDS, point_folds
from foldsmith.session import new_path
from foldsmith.spec import TableSpec


def prepared(spark, sf_dir):
    raw = written(orders_roles(spark, sf_dir), "order-roles")
    model = Preprocessor(ORDERS, transform="none").fit(raw)
    return written(model.transform(raw), "prepared"), model.output_spec


def _fold_scores(spark, sf_dir, name, **options):
    df, spec = prepared(spark, sf_dir)
    out = None
    for fold in range(5):
        part = df.filter(F.col("fold_id") == fold)
        train, test = part.filter("role = 'train'"), part.filter("role = 'test'")
        predictions, _ = M.fit_predict(M.MODELS[name](**options), train, test, spec)
        predictions = predictions.withColumn("fold_id", F.lit(fold))
        out = predictions if out is None else out.unionByName(predictions)
    return out


def _flat(predictions, row_id):
    return predictions.select(
        row_id, "fold_id", "y_true", *[r6(F.col("probs")[i]).alias(f"p{i}") for i in range(3)]
    )


@query("model_rf")
def model_rf(spark, sf_dir):
    return _flat(_fold_scores(spark, sf_dir, "random_forest"), "o_orderkey")


@query("model_dt")
def model_dt(spark, sf_dir):
    return _flat(_fold_scores(spark, sf_dir, "decision_tree"), "o_orderkey")


@query("fit_predict")
def fit_predict(spark, sf_dir):
    scores = _fold_scores(spark, sf_dir, "decision_tree")
    return M.metrics_all(scores, ["fold_id"])


@query("timing")
def timing(spark, sf_dir):
    df, spec = prepared(spark, sf_dir)
    rows = []
    for fold in range(5):
        part = df.filter(F.col("fold_id") == fold)
        train, test = (part.filter(F.col("role") == role) for role in ("train", "test"))
        scores = M.evaluate(M.MODELS["decision_tree"](), train, test, spec)
        rows += [(fold, m, float(v)) for m, v in scores.items() if v is not None]
    return spark.createDataFrame(rows, "fold int, metric string, value double")


@query(
    "model_context_knn",
    f"""WITH {POINTS_FOLDS}, {POINT_NEAR}, w AS (SELECT fold_id, q_id,
  sum(CASE WHEN label = 1 THEN 1 / (distance + 1e-6) ELSE 0 END) / sum(1 / (distance + 1e-6)) AS p1
  FROM near GROUP BY 1, 2)
SELECT f.fold_id, c_custkey, label AS y_true, {sr6('1 - p1')} AS p0, {sr6('p1')} AS p1
FROM w JOIN folds f ON w.fold_id = f.fold_id AND w.q_id = f.c_custkey""",
)
def model_context_knn(spark, sf_dir):
    df = point_folds(spark, sf_dir)
    scored = M.context_knn(
        df.filter("role = 'test'"), df.filter("role = 'train'"), POINTS, classes=2
    )
    p = F.col("probs")
    return scored.select(
        "fold_id", "c_custkey", "y_true", r6(p[0]).alias("p0"), r6(p[1]).alias("p1")
    )


def softmax_model(x: np.ndarray) -> np.ndarray:
    """A supplied model: fixed linear scores of two classes."""
    score = 0.4 * x[:, 0] - 0.1 * x[:, 1] - 1.0
    p = 1.0 / (1.0 + np.exp(-score))
    return np.column_stack([1 - p, p])


@query(
    "score_external",
    f"""SELECT c_custkey, {sr6('1 - 1 / (1 + exp(-(0.4 * c_acctbal / 1000 - 0.1 * c_nationkey - 1)))')} AS p0,
  {sr6('1 / (1 + exp(-(0.4 * c_acctbal / 1000 - 0.1 * c_nationkey - 1)))')} AS p1 FROM customer""",
)
def score_external(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey", (F.col("c_acctbal") / 1000).alias("balance"), "c_nationkey"
    )
    scored = M.score_external(df, ["balance", "c_nationkey"], softmax_model, ["c_custkey"])
    p = F.col("probs")
    return scored.select("c_custkey", r6(p[0]).alias("p0"), r6(p[1]).alias("p1"))


def prepared_customers(spark, sf_dir):
    df = written(point_folds(spark, sf_dir), "customer-points")
    return df, POINTS


@query("experiment_grid")
def experiment_grid(spark, sf_dir):
    """Two tables, three models, three arms, two folds; four runs are stored before the rest is asked for."""
    tables = [prepared(spark, sf_dir), prepared_customers(spark, sf_dir)]
    options = {"synthetic": {"share": 0.25}}
    arms = ["none", "neighbours", "synthetic"]
    grid = X.run_grid(spark, [42], [0, 1], range(2), sorted(M.MODELS), arms)
    path = new_path(spark, "experiment")

    def load(dataset_id, _):
        return tables[dataset_id]

    some = (F.col("model_name") == "decision_tree") & (F.col("augmentation") == "none")
    done = X.run_experiments(grid.filter(some), load, path, options=options)
    assert done.count() == 4
    return X.run_experiments(grid, load, path, options=options)


SPACE = {
    "max_depth": ("int", 2, 6),
    "min_gain": ("loguniform", 1e-6, 1e-3),
    "max_bins": ("choice", 8, 16, 32),
}
TRIALS = 50


def _floor_of(name: str, width: int) -> str:
    return f"CAST(floor({u_sql('42:' + name, 'trial')} * {width}) AS INTEGER)"


@query(
    "hp_candidates",
    f"""SELECT CAST(trial AS INTEGER) AS trial, CAST(2 + {_floor_of('max_depth', 5)} AS INTEGER) AS max_depth,
  {sr6(f"exp(ln(1e-6::DOUBLE) + {u_sql('42:min_gain', 'trial')} * (ln(1e-3::DOUBLE) - ln(1e-6::DOUBLE)))", 12)} AS min_gain,
  [8, 16, 32][1 + {_floor_of('max_bins', 3)}] AS max_bins FROM range({TRIALS}) r(trial)""",
)
def hp_candidates(spark, sf_dir):
    """The settings that ``hp_search`` tries."""
    drawn = X.search_candidates(spark, SPACE, TRIALS)
    return drawn.withColumn("min_gain", r6("min_gain", 12))


@query("hp_grid")
def hp_grid(spark, sf_dir):
    """An enumerated grid, each candidate fitted in every fold of the cleaned orders."""
    rows = written(orders_roles(spark, sf_dir), "order-roles")
    classes = ("F", "O", "P")
    ready = rows.select(
        F.coalesce("o_totalprice", F.lit(0.0)).alias("price"),
        F.coalesce(F.substring("o_orderpriority", 1, 1).cast("double"), F.lit(0.0)).alias("priority"),
        (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("o_orderstatus")) - 1).alias("y"),
        "fold_roles",
    )
    grid = X.grid_candidates(spark, {"maxDepth": [3, 6, 10], "maxBins": [16, 32, 64]})
    spec = TableSpec("y", "", ("price", "priority"), ())
    return X.search_folds(grid, DecisionTreeClassifier(seed=42), ready, spec)


@query("hp_search")
def hp_search(spark, sf_dir):
    df, spec = prepared(spark, sf_dir)
    part = df.filter("fold_id = 0")
    candidates = X.search_candidates(spark, SPACE, TRIALS)

    def make(trial):
        return DecisionTreeClassifier(
            maxDepth=trial["max_depth"], minInfoGain=trial["min_gain"], maxBins=trial["max_bins"]
        )

    return X.search(
        candidates, make, part.filter("role = 'train'"), part.filter("role = 'val'"), spec
    )
