"""Fits of tables that hold every row once against the fold-long form."""

import pytest
from pyspark.sql import functions as F

from foldsmith.operators import clean as C
from foldsmith.operators import encode as E
from foldsmith.operators import foldwise as W
from foldsmith.operators import scale as S
from foldsmith.operators.splits import kfold_long, kfold_roles
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.spec import TableSpec

SPEC = TableSpec("y", "id", ("a", "whole"), ("c", "same", "own"))


@pytest.fixture(scope="module")
def source(spark):
    n = F.col("id")
    return spark.range(400).select(
        "id",
        F.when(n % 3 == 0, "no").otherwise("yes").alias("y"),
        F.when(n % 17 != 0, (n * n) % 29 + F.when(n % 50 == 0, 400).otherwise(0)).cast("double").alias("a"),
        F.when(n % 11 != 0, n % 7).cast("int").alias("whole"),
        F.when(n % 13 != 0, F.concat(F.lit("v"), ((n * 7) % 5).cast("string"))).alias("c"),
        F.lit("s").alias("same"),
        n.cast("string").alias("own"),
    )


@pytest.fixture(scope="module")
def both(source):
    args = ("y", "id", 4, 0.2)
    return kfold_roles(source, *args), kfold_long(source, *args)


def rows(df):
    out = []
    for r in df.collect():
        cells = {c: round(v, 8) + 0.0 if isinstance(v, float) else v for c, v in r.asDict().items()}
        out.append(str(sorted(cells.items())))
    return sorted(out)


def test_roles_are_the_folds(both):
    once, long = both
    assert once.count() * 4 == long.count()
    assert rows(W.by_fold(once)) == rows(long)


@pytest.mark.parametrize(
    "operator",
    [
        lambda df: C.drop_constant(df, ["c", "same"]),
        lambda df: C.drop_near_unique(df, ["c", "own"]),
        lambda df: C.impute_numeric(df, ["a", "whole"]),
        lambda df: C.impute_mode(df, ["c"], apply_to=("train",)),
        lambda df: C.impute_simple(df, ["a"], ["c"]),
        lambda df: C.outlier_filter(df, ["a", "whole"], 2.0),
        lambda df: S.standard_scale(df, ["a", "whole"]),
        lambda df: S.quantile_normal(df, ["a", "whole"], n_quantiles=10),
        lambda df: E.ordinal_encode(df, ["c", "own"]),
        lambda df: E.label_encode(df, "y"),
    ],
)
def test_operators_take_both_forms(both, operator):
    once, long = both
    assert rows(operator(once)) == rows(operator(long))


@pytest.mark.parametrize(
    "settings",
    [
        {"transform": "quantile", "n_quantiles": 20, "outlier_limit": 2.0},
        {"transform": "quantile", "impute_roles": ("val", "test"), "outlier_limit": 2.0},
        {"transform": "none", "outlier_roles": ("val", "test")},
        {"transform": "power"},
    ],
)
def test_chain_of_both_forms(both, settings):
    once, long = both
    chain = Preprocessor(SPEC, **settings)
    a, b = chain.fit(once), chain.fit(long)
    assert a.features == b.features == ["a", "whole", "c"]
    assert rows(a.scaling) == rows(b.scaling)
    assert rows(a.transform(once)) == rows(b.transform(long))


def test_a_fit_repeats_no_row(both):
    """No generator over the folds reads the table: only columns are unpivoted."""
    once, _ = both
    counts = W.counts_by_fold(once, ["a", "c"], k=4)
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate") == 1 and "inline" in plan and "posexplode" not in plan
    assert counts.count() == counts.select("column", "value").distinct().count()


def test_sums_of_few_combinations(spark, both):
    once, long = both
    sums = W.merged_sums(once, ["a"])
    for r in long.filter("role = 'train'").groupBy("fold_id").agg(
        F.count("a"), F.avg("a"), F.var_pop("a") * F.count("a"), F.count(F.lit(1))
    ).collect():
        assert sums[r[0]]["a"] == pytest.approx((r[1], r[2], r[3])) and sums[r[0]]["rows"] == r[4]


def test_missing_and_empty(spark, source):
    empty = kfold_roles(source.limit(0), "y", "id", 3)
    chain = Preprocessor(SPEC, transform="none")
    assert C.impute_mode(empty, ["c"]).count() == 0
    assert S.standard_scale(empty, ["a"]).count() == 0
    assert S.quantile_normal(empty, ["a"]).count() == 0
    assert chain.fit(empty).fills == {}
    nothing = kfold_roles(source.withColumn("a", F.lit(None).cast("double")), "y", "id", 3)
    assert S.standard_scale(nothing, ["a"]).filter("a is not null").count() == 0
    assert C.impute_simple(nothing, ["a"], []).filter("a <> 0").count() == 0
