"""Trees from counted cells are those of the rows."""

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import functions as F

from foldsmith.operators import cells as C
from foldsmith.operators import models as M
from foldsmith.operators.splits import kfold_roles
from foldsmith.plans import experiment as X
from foldsmith.spec import TableSpec

SPEC = TableSpec("y", "id", ("a", "b"))


@pytest.fixture(scope="module")
def rows(spark):
    """Labels that follow two features in part; the first has 90 values, more than bins."""
    a, b = F.pmod(F.xxhash64("id"), F.lit(90)), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5))
    draw = F.pmod(F.xxhash64("id", F.lit(2)), F.lit(10))
    y = F.when(draw < 3, draw).when(a * (b + 1) > 120, 2).when(a % 7 < 3, 1).otherwise(0)
    df = spark.range(4000).select("id", a.cast("double").alias("a"), b.cast("double").alias("b"), y.cast("int").alias("y"))
    return kfold_roles(df, "y", "id", 3)


def test_grid_over_folds_is_that_of_the_cross_validation(spark, rows, monkeypatch):
    space = {"maxDepth": [2, 5, 9], "maxBins": [8, 32], "minInfoGain": [0.0, 0.003]}
    tree = DecisionTreeClassifier(seed=1)
    wanted = X.search_folds(X.grid_candidates(spark, space), tree, rows, SPEC).orderBy("trial").collect()
    monkeypatch.setattr(C, "CELL_ROWS", 100)
    monkeypatch.setattr(X, "CrossValidator", None)
    got = X.search_folds(X.grid_candidates(spark, space), tree, rows, SPEC).orderBy("trial").collect()
    for a, b in zip(got, wanted, strict=True):
        assert a[:4] == b[:4] and a.is_best == b.is_best
        assert (a.accuracy, a.accuracy_sd) == pytest.approx((b.accuracy, b.accuracy_sd), abs=1e-12)


def test_forest_of_cells_is_as_good_as_that_of_rows(spark, rows, monkeypatch):
    train, test = rows.filter("fold_roles[0] <> 'test'"), rows.filter("fold_roles[0] = 'test'")
    model = RandomForestClassifier(numTrees=60, maxDepth=6, seed=3)
    plain, _ = M.fit_predict(model, train, test, SPEC)
    monkeypatch.setattr(C, "CELL_ROWS", 100)
    monkeypatch.setattr(M, "held", None)
    got, spent = M.fit_predict(model, train, test, SPEC)
    assert got.schema.simpleString() == plain.schema.simpleString() and set(spent) == {"time_fit", "time_predict"}
    pairs = got.join(plain.withColumnRenamed("probs", "other"), ["id", "y_true"]).collect()
    assert len(pairs) == test.count()
    gaps = np.array([np.abs(np.array(r.probs) - np.array(r.other)).max() for r in pairs])
    assert gaps.mean() < 0.03 and gaps.max() < 0.2
    assert all(sum(r.probs) == pytest.approx(1) for r in pairs)
    again, _ = M.fit_predict(model, train.repartition(5), test, SPEC)
    assert sorted(tuple(r) for r in again.collect()) == sorted(tuple(r) for r in got.collect())


def test_tables_that_cells_do_not_hold_are_left_to_rows(spark, rows, monkeypatch):
    model = RandomForestClassifier(numTrees=2, maxDepth=2, seed=3)
    assert C.forest_probabilities(model, rows, SPEC) is None  # few rows
    monkeypatch.setattr(C, "CELL_ROWS", 100)
    assert C.forest_probabilities(model, rows, SPEC) is not None
    assert C.forest_probabilities(RandomForestClassifier(subsamplingRate=0.5), rows, SPEC) is None
    assert C.forest_probabilities(DecisionTreeClassifier(), rows, SPEC) is None
    gap = rows.withColumn("a", F.when(F.col("id") != 7, F.col("a")))
    assert C.forest_probabilities(model, gap, SPEC) is None
    assert C.forest_probabilities(model, rows.withColumn("y", F.col("y") - 1), SPEC) is None
    monkeypatch.setattr(C, "MAX_CELLS", 10)
    assert C.forest_probabilities(model, rows, SPEC) is None


def test_features_of_many_values_are_cut_at_quantiles(spark, rows, monkeypatch):
    monkeypatch.setattr(C, "FEW", 20)
    bins = C.Bins.fit(rows, SPEC, [F.lit(True), F.col("id") < 2000], [8, 4])
    values = np.sort([r.a for r in rows.collect()])
    for size in (8, 4):
        places = np.searchsorted(values, bins.thresholds[0][0, size], "right") / len(values)
        assert places == pytest.approx(np.arange(1, size) / size, abs=0.02)
    placed = bins.placed(rows).select("a", "b", "__b0", "__b1").distinct().collect()
    for r in placed:
        assert (r["__b0"], r["__b1"]) == (np.sum(bins.fine[0] < r.a), np.sum(bins.fine[1] < r.b))
    whole = bins.counted(rows, F.lit(0), 1)[0]
    coarse, _ = bins.coarse(whole, 0, 4)
    assert whole.sum() == coarse.sum() == rows.count() and coarse.shape[0] == len(bins.thresholds[0][0, 4]) + 1
