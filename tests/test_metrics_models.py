import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.sql import functions as F

from foldsmith.operators import analytics as AN
from foldsmith.operators import metrics as M
from foldsmith.operators import models as MO
from foldsmith.operators.models import MODELS
from foldsmith.operators.splits import kfold_long, kfold_roles, size_budget
from foldsmith.operators import ranking as R_
from foldsmith.operators.stats import exact_quantiles, train_rows
from foldsmith.operators.synth import CopulaModel
from foldsmith.plans import arms as AR
from foldsmith.plans import experiment as X
from foldsmith.plans.arms import augment, topup
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.session import materialize, new_path
from foldsmith.sources import logs
from foldsmith.sources import results as R
from foldsmith.spec import TableSpec


def scored(spark, rows):
    return spark.createDataFrame(rows, "run int, y_true int, probs array<double>")


def test_first_maximum_wins(spark):
    assert M.predict_label(scored(spark, [(0, 1, [0.5, 0.5])])).first().y_pred == 0


def test_one_class_has_no_auc(spark):
    df = scored(spark, [(0, 1, [0.2, 0.8]), (0, 1, [0.9, 0.1])])
    assert M.auc_hard(df, ["run"]).first().auc is None
    assert M.auc_prob(df, ["run"]).first().auc is None
    assert M.auc_prob(df, ["run"], "ovr").first().auc is None


def test_rank_auc_counts_ties_half(spark):
    df = scored(spark, [(0, 1, [0.4, 0.6]), (0, 0, [0.4, 0.6]), (0, 0, [0.9, 0.1]), (0, 1, [0.1, 0.9])])
    assert M.auc_prob(df, ["run"]).first().auc == pytest.approx(3.5 / 4)


def test_auc_and_quantiles_do_not_depend_on_ranges(spark, monkeypatch):
    df = spark.range(500).select(
        F.lit(0).alias("run"),
        (F.col("id") % 3 == 0).cast("int").alias("y_true"),
        F.array(F.lit(0.0), (F.col("id") * 7919 % 211 / 211)).alias("probs"),
    )
    values = df.select(F.lit("c").alias("column"), F.col("probs")[1].alias("value"))

    def run():
        auc = M.auc_prob(df, ["run"]).first().auc
        return auc, {(r.i, r.quantile) for r in exact_quantiles(values, ["column"], 50).collect()}

    plain = run()
    monkeypatch.setattr(R_, "RANGE_ROWS", 10)
    ranged = run()
    assert ranged[0] == pytest.approx(plain[0]) and ranged[1] == plain[1]


def test_log_loss_of_a_certain_mistake_is_finite(spark):
    row = M.log_loss(scored(spark, [(0, 1, [1.0, 0.0])]), ["run"]).first()
    assert row.log_loss == pytest.approx(-math.log(M.EPS))


def test_f1_is_zero_without_hits(spark):
    assert M.f1_weighted(scored(spark, [(0, 1, [1.0, 0.0]), (0, 0, [0.0, 1.0])]), ["run"]).first().f1 == 0


def test_all_missing_epoch_metric_is_null(spark):
    df = spark.createDataFrame(
        [(0, 1, "auc", float("nan")), (0, 1, "acc", 0.5), (0, 1, "acc", float("nan"))],
        "run int, epoch int, metric string, value double",
    )
    assert {r.metric: r.value for r in M.epoch_metrics(df).collect()} == {"auc": None, "acc": 0.5}


def test_best_epoch_counts_strict_improvements(spark):
    losses = [0.9, 0.8, 0.8, 0.85, 0.7, 0.75]
    log = spark.createDataFrame([(0, e, v) for e, v in enumerate(losses)], "run int, epoch int, log_loss double")
    row = M.best_epoch(log).first()
    assert (row.best_epoch, row.log_loss, row.improvements) == (4, 0.7, 2)
    assert M.best_epoch(log, min_delta=0.095).first().improvements == 2
    assert M.best_epoch(log, min_delta=0.2).first().improvements == 0


def test_bootstrap_interval_holds_the_mean(spark):
    df = spark.range(400).select("id", F.lit("g").alias("g"), (F.col("id") % 20).cast("double").alias("x"))
    row = AN.bootstrap_ci(df, ["g"], "x", "id", 400).first()
    half = 1.96 * 5.77 / 20
    assert row.mean == 9.5 and row.ci_low < 9.5 < row.ci_high
    assert (row.ci_high - row.ci_low) / 2 == pytest.approx(half, rel=0.2)


def test_histogram_of_a_single_value(spark):
    df = spark.createDataFrame([("new", 3.0), ("new", 3.0)], "origin string, x double")
    row = AN.histograms(df, ["x"]).first()
    assert row.density * (row.right - row.left) == pytest.approx(1.0)


def test_per_group_standard_error(spark):
    df = spark.createDataFrame([(0, 1.0, 1.0), (0, 3.0, 1.0), (1, 5.0, 2.0), (1, 9.0, 2.0)], "fold int, pre_eval double, post_eval double")
    rows = {r.fold: r for r in AN.fold_pre_post(df, per_group=True).collect()}
    assert rows[0].pre_eval_high - rows[0].pre_eval == pytest.approx(1.959964 * 1.0, abs=1e-5)
    assert rows[1].pre_eval_high - rows[1].pre_eval == pytest.approx(1.959964 * 2.0, abs=1e-5)


def test_results_are_none_before_the_first_store(spark):
    path = new_path(spark, "none-yet")
    assert R.load_results(spark, path) is None
    grid = X.run_grid(spark, [1], [0], range(3), ["m"])
    assert R.pending_runs(grid, None).count() == 3


def test_log_refuses_known_writers_and_text(spark):
    path = new_path(spark, "log")
    configs = spark.createDataFrame([("w", 1)], "writer string, lr int").select(
        "writer", F.struct("lr").alias("config")
    )
    logs.register_writers(configs, path)
    with pytest.raises(ValueError):
        logs.register_writers(configs, path)
    text = spark.createDataFrame([("w", "t", 0, "x", 1)], "writer string, tag string, step int, value string, seq long")
    with pytest.raises(ValueError):
        logs.append_scalars(text, path)


SPEC = TableSpec("y", "id", ("a",), ("c",))


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(300).select(
        "id",
        F.when(F.col("id") % 3 == 0, "no").otherwise("yes").alias("y"),
        F.when(F.col("id") % 17 != 0, (F.col("id") % 29) + F.when(F.col("id") % 3 == 0, 20).otherwise(0))
        .cast("double").alias("a"),
        F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("c"),
    )
    return kfold_long(df, "y", "id", 3)


def test_chain_scales_training_rows(spark, table):
    model = Preprocessor(SPEC, transform="none").fit(table)
    train = train_rows(model.transform(table)).filter("fold_id = 1")
    row = train.agg(F.avg("a"), F.stddev("a"), F.avg("c"), F.stddev("c"), F.count("a")).first()
    assert row[0] == pytest.approx(0, abs=1e-9) and row[1] == pytest.approx(1)
    assert row[2] == pytest.approx(0, abs=1e-9) and row[3] == pytest.approx(1)


def test_chain_ignores_values_of_test_rows(spark, table):
    changed = table.withColumn(
        "a", F.when(F.col("role") == "test", F.col("a") * 0 + 1).otherwise(F.col("a"))
    )
    def train(df):
        out = Preprocessor(SPEC).fit(df).transform(df)
        return sorted(tuple(r) for r in train_rows(out).collect())
    assert train(table) == train(changed)


def test_transform_plans_have_no_python(spark, table):
    for transform in ("quantile", "power", "none"):
        out = Preprocessor(SPEC, transform=transform).fit(table).transform(table)
        plan = out._jdf.queryExecution().toString()
        assert "Python" not in plan and "CartesianProduct" not in plan


def test_unknown_transform(spark, table):
    with pytest.raises(ValueError):
        Preprocessor(SPEC, transform="log").fit(table)


def test_synthetic_rows_look_like_the_table(spark, table):
    train = train_rows(table).dropna().select("fold_id", "a", "c", "y")
    wanted = spark.createDataFrame([(0, 3000), (1, 0), (2, 10)], "fold_id int, n long")
    made = CopulaModel.fit(train, SPEC).sample(wanted)
    assert {r.fold_id: r["count"] for r in made.groupBy("fold_id").count().collect()} == {0: 3000, 2: 10}
    real = train.filter("fold_id = 0").groupBy("y").agg(F.avg("a").alias("m"), F.stddev("a").alias("s"), F.count("a").alias("n"))
    fake = made.filter("fold_id = 0").groupBy("y").agg(F.avg("a").alias("m"), F.stddev("a").alias("s"), F.count("a").alias("n"))
    real, fake = ({r.y: r for r in d.collect()} for d in (real, fake))
    for y in real:
        assert fake[y].m == pytest.approx(real[y].m, abs=0.15 * real[y].s)
        assert fake[y].s == pytest.approx(real[y].s, rel=0.1)
        assert fake[y].n / 3000 == pytest.approx(real[y].n / sum(r.n for r in real.values()), abs=0.05)
    assert {r.c for r in made.collect()} <= {"v0", "v1", "v2", "v3"}


def test_topup_reaches_the_cap_and_full_folds_stay(spark, table):
    settings = Preprocessor(SPEC, transform="none", outlier_limit=100.0)
    sizes = size_budget(table, ["fold_id"], 0).collect()
    n = {r.fold_id: (r.n_train, r.n_test) for r in sizes}
    out = topup(table, settings, cap=280)
    kinds = {(r.fold_id, r.origin): r["count"] for r in out.groupBy("fold_id", "origin").count().collect()}
    for fold, (n_train, n_test) in n.items():
        assert kinds[fold, "train"] == n_train and kinds[fold, "test"] == n_test
        assert kinds[fold, "synthetic"] == 280 - n_train - n_test and kinds[fold, "test again"] == n_test
    full = topup(table, settings, cap=100)
    assert {r.origin for r in full.collect()} == {"train"}


def test_unknown_arm_changes_nothing(spark, table):
    model = Preprocessor(SPEC, transform="none").fit(table)
    ready = model.transform(table)
    out = augment("nothing", ready, model.output_spec)
    assert out.count() == train_rows(ready).count()


def test_runs_resume_and_search_marks_one_best(spark, table):
    model = Preprocessor(SPEC, transform="none").fit(table)
    ready = model.transform(table)
    calls = []
    def make(seed):
        from pyspark.ml.classification import DecisionTreeClassifier
        calls.append(seed)
        return DecisionTreeClassifier(maxDepth=3, seed=seed)
    path = new_path(spark, "runs")
    grid = X.run_grid(spark, [7], [0], [0, 1], ["tree"])
    load = lambda *_: (ready, model.output_spec)
    first = X.run_experiments(grid, load, path, {"tree": make})
    assert first.count() == 2 and len(calls) == 2
    assert X.run_experiments(grid, load, path, {"tree": make}).count() == 2 and len(calls) == 2
    majority = 2 / 3
    assert all(r.accuracy >= majority - 0.05 for r in first.collect())
    trials = X.search_candidates(spark, {"depth": ("int", 1, 4), "lr": ("loguniform", 1e-6, 1e-3)}, 3)
    assert all(1 <= r.depth <= 4 and 1e-6 <= r.lr <= 1e-3 for r in trials.collect())


def plain_auc(rows, a, others):
    """Share of pairs that rank right, ties half; None without pairs."""
    own = [p[a] for y, p in rows if y == a]
    rest = [p[a] for y, p in rows if y in others]
    pairs = [(x > z) + (x == z) / 2 for x in own for z in rest]
    return sum(pairs) / len(pairs) if pairs else None


@pytest.mark.parametrize("seed, labels", [(0, 3), (1, 4), (2, 2)])
def test_all_schemes_come_from_one_ranking(spark, seed, labels):
    rng = random.Random(seed)
    rows = [(f"r{k % 2}", k, rng.randrange(labels), [rng.randrange(5) / 4 for _ in range(4)]) for k in range(90)]
    df = spark.createDataFrame(rows, "run string, id long, y_true int, probs array<double>")
    got = {r.run: r for r in M.auc_schemes(df, ["run"]).collect()}
    for run, r in got.items():
        own = [(y, p) for name, _, y, p in rows if name == run]
        if labels == 2:
            wanted = plain_auc(own, 1, {0}), plain_auc(own, 1, {0, 2, 3})
        else:
            ovo = [plain_auc(own, a, {b}) for a in range(4) for b in range(4) if a != b]
            ovr = [plain_auc(own, a, {*range(4)} - {a}) for a in range(4)]
            wanted = [None if None in x else sum(x) / len(x) for x in (ovo, ovr)]
        assert (r.ovo, r.ovr) == pytest.approx(tuple(wanted)) or (r.ovo, r.ovr) == tuple(wanted)
        for scheme in M.SCHEMES:
            alone = {x.run: x.auc for x in M.auc_prob(df, ["run"], scheme).collect()}
            assert alone[run] == pytest.approx(r[scheme]) if r[scheme] is not None else alone[run] is None
    assert M.auc_schemes(df.where("false"), ["run"]).count() == 0


def test_groupings_share_their_draws(spark):
    rng = random.Random(1)
    rows = [(f"d{k % 5}", f"m{k % 3}", str(k), rng.random(), None if k % 7 == 0 else rng.random()) for k in range(300)]
    df = spark.createDataFrame(rows, "d string, m string, id string, a double, b double")
    both = AN.model_means_sets(df, ["a", "b"], [["d", "m"], ["m"]], "id", 100)
    for number, by in enumerate((["d", "m"], ["m"])):
        alone = {tuple(r[c] for c in (*by, "metric")): r for r in AN.model_means(df, ["a", "b"], by, "id", 100).collect()}
        found = both.where(F.col("grouping") == number).collect()
        assert len(found) == len(alone)
        for r in found:
            other = alone[tuple(r[c] for c in (*by, "metric"))]
            for c in ("mean", "ci_low", "ci_high"):
                assert r[c] == pytest.approx(other[c])
            assert number == 0 or r.d is None
            assert r.ci_low < r["mean"] < r.ci_high


@pytest.fixture(scope="module")
def prepared(spark, table):
    model = Preprocessor(SPEC, transform="none").fit(table)
    return materialize(model.transform(table), "prepared"), model.output_spec


def test_a_stopped_grid_goes_on_with_the_missing_runs(spark, prepared, tmp_path):
    ready, spec = prepared
    calls, path = [], str(tmp_path / "stopped")

    def failing(seed):
        calls.append(seed)
        if len(calls) == 3:
            raise RuntimeError("the driver stops here")
        return MODELS["decision_tree"](seed=seed, depth=2)

    def load(*_):
        return ready, spec

    grid = X.run_grid(spark, [7], [0], [0, 1], ["tree"], ["none", "synthetic"])
    share = {"synthetic": {"share": 0.5}}
    with pytest.raises(RuntimeError):
        X.run_experiments(grid, load, path, {"tree": failing}, parallel=1, options=share)
    kept = spark.read.parquet(path).count()
    assert 2 <= kept <= 3  # the next run may have begun when the error arrives
    out = X.run_experiments(grid, load, path, {"tree": failing}, parallel=1, options=share)
    assert len(calls) == 5  # what was stored is not computed again
    assert out.select("fold", "augmentation").distinct().count() == out.count() == 4
    with pytest.raises(ValueError):
        X.run_experiments(X.run_grid(spark, [7], [0], [0], ["tree"], ["no arm"]), load, path, {"tree": failing})


def test_context_model_and_synthetic_arm(spark, prepared, tmp_path):
    ready, spec = prepared
    grid = X.run_grid(spark, [7], [0], [0], ["context_knn"], ["none"])
    row = X.run_experiments(grid, lambda *_: (ready, spec), str(tmp_path / "context")).first()
    assert 0 <= row.accuracy <= 1 and row.model_name == "context_knn"
    train = ready.filter("role = 'train'").groupBy("fold_id").count().collect()
    out = augment("synthetic", ready, spec, share=0.5).groupBy("fold_id", "origin").count().collect()
    got = {(r.fold_id, r.origin): r["count"] for r in out}
    for r in train:
        assert got[r.fold_id, "train"] == r["count"]
        assert got[r.fold_id, "synthetic"] == math.floor(r["count"] * 0.5)


def test_grid_over_folds_finds_the_depth_that_separates(spark):
    """Labels need two cuts: depth 1 cannot give them, deeper trees tie, the earliest wins."""
    df = spark.range(300).select(
        "id", (F.col("id") % 30).cast("double").alias("a"), ((F.col("id") % 30).between(10, 19)).cast("int").alias("y")
    )
    once = kfold_roles(df, "y", "id", 3)
    grid = X.grid_candidates(spark, {"maxDepth": [1, 2, 4], "maxBins": [32, 64]})
    assert [tuple(r) for r in grid.orderBy("trial").collect()][:3] == [(0, 1, 32), (1, 1, 64), (2, 2, 32)]
    spec = TableSpec("y", "id", ("a",), ())
    out = X.search_folds(grid, DecisionTreeClassifier(seed=1), once, spec).orderBy("trial").collect()
    assert [r.is_best for r in out] == [False, False, True, False, False, False]
    assert out[2].accuracy == 1.0 and out[0].accuracy < 0.9


def test_missing_values_and_large_marginals(spark, table, monkeypatch):
    """Missing values stay out of the fit; salted and broadcast marginals make the same rows."""
    train = train_rows(table).select("fold_id", "a", "c", "y")
    wanted = spark.createDataFrame([(0, 200), (1, 50)], "fold_id int, n long")
    made = sorted(tuple(r) for r in CopulaModel.fit(train, SPEC).sample(wanted).collect())
    assert len(made) == 250 and not any(v is None for r in made for v in r)
    monkeypatch.setattr("foldsmith.operators.synth.BROADCAST_BYTES", 0)
    again = sorted(tuple(r) for r in CopulaModel.fit(train, SPEC).sample(wanted).collect())
    assert [r[:2] for r in again] == [r[:2] for r in made]
    assert all(a[2] == pytest.approx(b[2]) and a[3:] == b[3:] for a, b in zip(again, made, strict=True))
    empty = train.withColumn("a", F.when(F.col("y") == "yes", F.col("a")))
    rows = CopulaModel.fit(empty, SPEC).sample(wanted).collect()
    assert len(rows) == 250 and {r.y for r in rows if r.a is None} == {"no"}


def test_draws_of_large_groups_and_nulls_are_those_of_single_rows(spark, monkeypatch):
    monkeypatch.setattr(AN, "PART_ROWS", 40)
    rows = [(None if k % 5 == 0 else k % 2, None if k == 3 else f"{k}-{'x' * (k % 90)}", None if k % 7 == 0 else k * 0.37)
            for k in range(301)]
    df = spark.createDataFrame(rows, "g int, id string, x double")
    found = {r.g: r for r in AN.bootstrap_ci(df, ["g"], "x", "id", 100).collect()}
    assert set(found) == {None, 0, 1}
    for g, r in found.items():
        means = []
        some = [(i, x) for h, i, x in rows if h == g and x is not None]
        for draw in range(100):
            weights = []
            for i, _ in some:
                text = f"42:{draw // 8}" + ("" if i is None else f":{i}")
                u = (int(hashlib.md5(text.encode()).hexdigest()[4 * (draw % 8) :][:4], 16) + 0.5) / 65536
                weights.append(sum(u > p for p in AN.POISSON_CDF))
            means.append(sum(w * x for w, (_, x) in zip(weights, some)) / sum(weights))
        low, high = np.quantile(means, [0.025, 0.975])
        assert (r["mean"], r.ci_low, r.ci_high) == pytest.approx((sum(x for _, x in some) / len(some), low, high))


def test_small_groups_leave_no_draws_behind(spark):
    df = spark.range(600).selectExpr("id % 50 AS g", "id", "id * 0.5 AS x", "id * 0.1 AS y")
    drawn = AN._drawn(df, ["g"], ["x", "y"], "id", 1000, 0.95, 42).collect()
    assert len(drawn) == 100
    assert all(r.draw_sums is None and r.ci_low < r.ci_high for r in drawn)


def test_stored_results_have_files_by_size_not_by_dataset(spark, tmp_path):
    path = str(tmp_path / "stored")
    runs = spark.range(400).selectExpr("CAST(if(id = 7, NULL, id) AS int) AS dataset_id", "id * 0.5 AS accuracy")
    for _ in range(2):
        R.store_results(runs, path)
    assert len(list((tmp_path / "stored").rglob("*.parquet"))) <= 8
    stored = R.load_results(spark, path)
    assert stored.schema["dataset_id"].dataType.simpleString() == "int"
    assert sorted(stored.collect(), key=str) == sorted(runs.select(*stored.columns).collect() * 2, key=str)


def test_a_grid_makes_the_rows_of_its_folds_only(spark, prepared, tmp_path, monkeypatch):
    ready, spec = prepared
    asked = []

    def arm(df, spec, **_):
        asked.append({r.fold_id for r in df.select("fold_id").distinct().collect()})
        return AR.augment_none(df, spec)

    monkeypatch.setitem(AR.ARMS, "marked", arm)
    grid = X.run_grid(spark, [7], [0], [0, 2], ["tree"], ["marked"])
    tree = {"tree": lambda seed: MODELS["decision_tree"](seed=seed, depth=2)}
    out = X.run_experiments(grid, lambda *_: (ready, spec), str(tmp_path / "folds"), tree)
    assert asked == [{0, 2}] and {r.fold for r in out.collect()} == {0, 2}


def test_a_search_reads_its_rows_once(spark, prepared, monkeypatch):
    """All trials take the rows that are held; a fit of one model holds its own."""
    ready, spec = prepared
    calls = []
    plain = MO.assemble
    monkeypatch.setattr(MO, "assemble", lambda *a: calls.append(1) or plain(*a))
    part = ready.filter("fold_id = 0")
    sides = part.filter("role = 'train'"), part.filter("role = 'val'")
    trials = X.grid_candidates(spark, {"depth": [1, 2, 3]})
    found = X.search(trials, lambda t: MODELS["decision_tree"](depth=t["depth"]), *sides, spec).collect()
    assert len(calls) == 2
    for r in found:
        alone = MO.evaluate(MODELS["decision_tree"](depth=r.depth), *sides, spec)
        assert r.accuracy == pytest.approx(alone["accuracy"])
    assert not spark._jsparkSession.sharedState().cacheManager().cachedData().size()
