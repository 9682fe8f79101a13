"""The generative adversarial network of topup, and the steps around it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import gan
from foldsmith.operators.splits import kfold_long, size_budget
from foldsmith.operators.stats import train_rows
from foldsmith.plans import arms
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.spec import TableSpec

SPEC = TableSpec("y", "id", ("a",), ("c",))


@pytest.fixture(scope="module")
def table(spark):
    df = spark.range(300).select(
        "id",
        F.when(F.col("id") % 3 == 0, "no").otherwise("yes").alias("y"),
        F.when(F.col("id") % 17 != 0, (F.col("id") % 29) * 1.0).alias("a"),
        F.concat(F.lit("v"), (F.col("id") % 4).cast("string")).alias("c"),
    )
    return kfold_long(df, "y", "id", 3)


def test_gradients_are_those_of_the_losses():
    rng = np.random.default_rng(1)
    nets = gan.Networks(5, 2, 4)
    state = nets.start(rng, np.float64)
    x, z = rng.normal(size=(7, 5)), rng.normal(size=(7, 6))
    kept = (rng.random((14, 256)) >= 0.3) / 0.7
    truth = np.repeat([1.0, 0.0], 7)[:, None]

    def losses(flat):
        p = nets.views(flat)
        made, _ = nets.forward(p, z)
        both, _ = nets.judge(p, np.concatenate([x, made]), kept)
        own, _ = nets.judge(p, made, kept[:7])
        judged = -(truth * np.log(both) + (1 - truth) * np.log(1 - both)).mean()
        return judged, -np.log(own).mean()

    p, g = nets.views(state), np.zeros(nets.n)
    made, way = nets.forward(p, z)
    both, held = nets.judge(p, np.concatenate([x, made]), kept)
    nets.judge_backward(p, nets.views(g), held, (both - truth) / 14)
    own, held = nets.judge(p, made, kept[:7])
    nets.backward(p, nets.views(g), way, nets.judge_backward(p, None, held, (own - 1) / 7))
    for at in rng.choice(nets.n, 200, replace=False):
        ends = []
        for step in (1e-6, -1e-6):
            moved = state.copy()
            moved[at] += step
            ends.append(losses(moved)[int(at < nets.n_generator)])
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-3, abs=1e-7)


def test_generator_learns_where_the_rows_are():
    rng = np.random.default_rng(2)
    nets = gan.Networks(2, 1)
    x = np.column_stack([rng.normal(0.6, 0.05, 600), np.ones(600)]).astype("float32")
    state = nets.start(rng)
    z = np.column_stack([rng.standard_normal((500, 100)), np.ones(500)]).astype("float32")
    before = nets.generate(state, z)[:, 0].mean()
    nets.train(state, x, range(60), 64, (1,))
    after = nets.generate(state, z)
    assert abs(after[:, 0].mean() - 0.6) < 0.15 < abs(before - 0.6)
    assert after[:, 1].mean() > 0.6


def test_rows_do_not_depend_on_partitions_and_shards_are_trained_together(spark, table, monkeypatch):
    train = train_rows(table).filter("fold_id < 2")
    wanted = spark.createDataFrame([(0, 30), (1, 5), (7, 4)], "fold_id int, n long")

    def made(rows):
        return sorted(tuple(r) for r in gan.GanModel.fit(rows, SPEC, epochs=3).sample(wanted).collect())

    whole = made(train)
    assert [r[:2] for r in whole] == [(0, i) for i in range(30)] + [(1, i) for i in range(5)]
    assert not any(v is None for r in whole for v in r) and {r[3] for r in whole} <= {"v0", "v1", "v2", "v3"}
    assert all(r[2] == round(r[2]) for r in whole) and {r[4] for r in whole} <= {"yes", "no"}
    assert made(train.repartition(5)) == whole
    calls = []
    plain = gan._round
    monkeypatch.setattr(gan, "SHARD_ROWS", 40)
    monkeypatch.setattr(gan, "_round", lambda *a: calls.append(a[4]) or plain(*a))
    assert [r[:2] for r in made(train)] == [r[:2] for r in whole]
    assert calls == [range(0, 1), range(1, 2), range(2, 3)]


def test_topup_trains_the_network_and_fits_the_chain_of_its_rows(spark, table, monkeypatch):
    """The chain was that of the training rows, and no network was trained."""
    fits, trained = [], []
    fit, train = Preprocessor.fit, gan.GanModel.fit.__func__
    monkeypatch.setattr(Preprocessor, "fit", lambda s, df: fits.append(df) or fit(s, df))
    monkeypatch.setattr(gan.GanModel, "fit", classmethod(lambda c, df, *a, **o: trained.append(o) or train(c, df, *a, **o)))
    sizes = {r.fold_id: r for r in size_budget(table, ["fold_id"], 250).collect()}
    out = arms.topup(table, Preprocessor(SPEC, transform="none", outlier_limit=100.0), cap=250)
    kinds = {(r.fold_id, r.origin): r["count"] for r in out.groupBy("fold_id", "origin").count().collect()}
    assert len(fits) == 2 and trained == [{"epochs": 100, "batch_size": 128, "seed": 42}]
    assert {r.role for r in fits[1].select("role").distinct().collect()} == {"train"}
    for fold, r in sizes.items():
        assert fits[1].filter(F.col("fold_id") == fold).count() == r.budget == kinds[fold, "synthetic"]
    assert out.filter("a IS NULL OR c IS NULL").count() == 0


def test_synthetic_rows_over_the_cap_are_sampled_down(spark):
    budget = spark.createDataFrame([(0, 10, 4, 6), (1, 10, 0, 10)], "fold_id int, n_train long, n_test long, budget long")
    rows = spark.range(32).select((F.col("id") % 2).cast("int").alias("fold_id"), "id").filter("fold_id = 0 OR id < 19")
    kept = arms._sampled(rows, budget, "id", 20)
    assert {r.fold_id: r["count"] for r in kept.groupBy("fold_id").count().collect()} == {0: 6, 1: 9}
