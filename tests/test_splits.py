import itertools
from collections import Counter

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from foldsmith.functions.hashing import hash_key
from foldsmith.operators import ranking as R
from foldsmith.operators import splits as S


@pytest.fixture(scope="module")
def people(spark):
    """97 rows of three unequal classes; one class holds most rows."""
    return spark.range(97).select(
        F.col("id"),
        F.when(F.col("id") % 10 == 0, "rare").when(F.col("id") % 10 == 1, "some").otherwise("big").alias("y"),
    )


def test_folds_partition_the_rows_and_balance(people):
    rows = S.stratified_kfold(people, "y", "id", 5).collect()
    assert sorted(r.id for r in rows) == list(range(97))
    sizes = Counter(r.fold_id for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for y in ("rare", "some", "big"):
        per = Counter(r.fold_id for r in rows if r.y == y)
        counts = [per.get(f, 0) for f in range(5)]
        assert max(counts) - min(counts) <= 1


def test_splits_do_not_depend_on_partitioning(spark, people):
    def run(df):
        return {(r.id, r.fold_id, r.role) for r in S.kfold_long(df, "y", "id").collect()}

    first = run(people.repartition(2))
    assert first == run(people.repartition(8, "y"))


def test_kfold_long_roles(people):
    rows = S.kfold_long(people, "y", "id", 5, 0.2).collect()
    assert len(rows) == 5 * 97
    for fold in range(5):
        part = [r for r in rows if r.fold_id == fold]
        assert sorted(r.id for r in part) == list(range(97))
        assert sum(r.role == "val" for r in part) == 20  # ceil(0.2 * 97)
    tested = [r.id for r in rows if r.role == "test"]
    assert sorted(tested) == list(range(97))


def test_kfold_agrees_with_kfold_long(people):
    folds = {r.id: r.fold_id for r in S.stratified_kfold(people, "y", "id", 5).collect()}
    long = {r.id: r.fold_id for r in S.kfold_long(people, "y", "id", 5).collect() if r.role == "test"}
    assert folds == long


def test_validation_quota_by_largest_remainder():
    assert S.validation_quota([50, 30, 20], 125, 0.2) == [13, 7, 5]
    assert sum(S.validation_quota([7, 7, 7], 30, 0.2)) == 6
    assert S.validation_quota([3], 100, 0.9) == [3]


def test_samples_have_exact_size(people):
    assert S.sample_n(people, "id", 10).count() == 10
    assert S.sample_n(people, "id", 500).count() == 97
    weighted = people.withColumn("w", F.col("id") + 1)
    assert S.sample_weighted(weighted, "id", "w", 10).count() == 10
    assert S.sample_weighted(weighted, "id", "w", 500).count() == 97


def test_large_samples_take_the_ranked_path(people, monkeypatch):
    weighted = people.withColumn("w", F.col("id") + 1)
    small = {r.id for r in S.sample_n(people, "id", 30).collect()}
    small_weighted = {r.id for r in S.sample_weighted(weighted, "id", "w", 30).collect()}
    monkeypatch.setattr(S, "TOP_N_ROWS", 5)
    assert {r.id for r in S.sample_n(people, "id", 30).collect()} == small
    assert {r.id for r in S.sample_weighted(weighted, "id", "w", 30).collect()} == small_weighted


def test_batches(people):
    rows = S.mini_batches(people, "id", 10).collect()
    sizes = Counter(r.batch_id for r in rows)
    assert sorted(sizes.values()) == [7] + [10] * 9
    full = S.mini_batches(people, "id", "full").collect()
    assert {r.batch_id for r in full} == {0} and {r.batch_rows for r in full} == {97}
    parts = Counter(r.part for r in S.context_query_split(S.mini_batches(people, "id", "full")).collect())
    assert parts == {"context": 77, "query": 20}


def test_budget_is_never_negative(people):
    row = S.size_budget(S.kfold_long(people, "y", "id"), ["fold_id"], 10).first()
    assert row.budget == 0 and row.budget_train == 0


def test_too_many_classes_are_refused(people, monkeypatch):
    monkeypatch.setattr(S, "MAX_CLASSES", 50)
    with pytest.raises(ValueError):
        S.stratified_kfold(people, "id", "id")


def test_ranks_equal_plain_ranks_with_null_groups(spark):
    rows = [(k, None if k % 3 == 0 else f"g{k % 2}", k % 7) for k in range(60)]
    df = spark.createDataFrame(rows, "id long, g string, v int").repartition(5)
    for by in ([], ["g"], ["g", "v"]):
        plain = df.withColumn(
            "wanted", F.row_number().over(Window.partitionBy(*by).orderBy(hash_key(1, "id"), "id"))
        )
        wanted = {r.id: r.wanted for r in plain.collect()}
        assert {r.id: r.rn for r in R.hash_rank(df, 1, "id", by).collect()} == wanted


@pytest.mark.parametrize("ranges", [1, 16, 2000])
def test_running_totals_do_not_depend_on_ranges(spark, ranges):
    rows = [(None if k % 3 == 0 else f"g{k % 2}", float(k), k) for k in range(90)]
    rows.append((None, None, 5))
    df = spark.createDataFrame(rows, "g string, v double, n long").repartition(4)
    got = R.running_total(df, ["g"], "v", {"n": "before"}, {"n": "all"}, ranges=ranges).collect()
    wanted = set()
    for g in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is not None, r[1] or 0))
        sums = [0, *itertools.accumulate(r[2] for r in own)]
        wanted |= {(g, r[1], r[2], s, sums[-1]) for r, s in zip(own, sums)}
    assert {(r.g, r.v, r.n, r.before, r.all) for r in got} == wanted and len(got) == len(rows)


def test_ranged_plans_part_no_group_and_no_table(spark):
    """With 2000 ranges, AQE and automatic broadcasts off: no exchange by the group alone."""
    df = spark.range(300).select((F.col("id") % 2).alias("g"), F.col("id").alias("v"), F.lit(1).alias("n"))
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        total = R.running_total(df, ["g"], "v", {"n": "before"}, ranges=2000)
        ranked = R.value_rank(df, "v", "n", "rank", ranges=2000)
        rows = R.hash_rank(df, 1, "v", ["g"])
        for out in (total, ranked, rows):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "SinglePartition" not in plan and "NestedLoop" not in plan and "Cartesian" not in plan
            # The rows: every exchange of them is by group and range together.
            exchanges = [x for x in plan.split("\n") if "Exchange hashpartitioning(" in x]
            rows_by_group = [x for x in exchanges if "__range" not in x and "__a_" not in x]
            sums = plan.count("Window [")
            assert len(rows_by_group) <= 1 and sums <= 4  # only the range sums meet by group
        assert total.count() == ranked.count() == rows.count() == 300
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_range_digits_grow_with_the_table():
    assert [R.range_digits(n) for n in (10, 10**9, 10**12, 10**15)] == [2, 3, 5, 8]


def test_ranges_are_counted_by_hashing(people):
    """A text column in the counts would have them sorted."""
    plan = R.hash_rank(people, 1, "id", ["y"])._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_many_folds_have_the_roles_of_few_by_the_same_rule(people, monkeypatch):
    few = {r.id: r.fold_roles for r in S.kfold_roles(people, "y", "id", 5).collect()}
    monkeypatch.setattr(S, "CODED_FOLDS", 0)
    assert {r.id: r.fold_roles for r in S.kfold_roles(people, "y", "id", 5).collect()} == few
