import math
import statistics

import pytest
from pyspark.sql import functions as F

from foldsmith.functions.normal import inverse_normal, with_inverse_normal
from foldsmith.operators import clean as C
from foldsmith.operators import encode as E
from foldsmith.operators import scale as S
from foldsmith.operators import stats as ST
from foldsmith.operators.ranking import running_total


def frame(spark, rows, schema):
    """Rows of one fold, training rows unless a role is given."""
    df = spark.createDataFrame(rows, schema)
    if "role" not in df.columns:
        df = df.withColumn("role", F.lit("train"))
    return df.withColumn("fold_id", F.lit(0)).withColumn("id", F.monotonically_increasing_id())


def test_mode_takes_the_smallest_on_a_tie_and_skips_null(spark):
    df = frame(spark, [("b",), ("b",), ("a",), ("a",), (None,)], "c string")
    assert ST.modes(df, ["fold_id"], ["c"]).first().c == "a"
    assert [r.c for r in C.impute_mode(df, ["c"]).filter("c = 'a'").collect()] == ["a"] * 3


def test_zero_deviation_scales_to_null(spark):
    df = frame(spark, [(5.0,), (5.0,), (5.0,)], "x double")
    assert [r.x for r in S.standard_scale(df, ["x"]).collect()] == [None] * 3
    stats = S.population_stats(df, ["x"])
    assert [r.x for r in S.standard_scale_pop(df, stats, ["x"]).collect()] == [0.0] * 3


def test_scaled_training_column_has_mean_0_and_sd_1(spark):
    df = frame(spark, [(float(i * i),) for i in range(20)], "x double")
    values = [r.x for r in S.standard_scale(df, ["x"]).collect()]
    assert abs(statistics.mean(values)) < 1e-9 and abs(statistics.stdev(values) - 1) < 1e-9
    stats = S.population_stats(df, ["x"])
    back = S.inverse_scale_pop(S.standard_scale_pop(df, stats, ["x"]), stats, ["x"])
    assert sorted(round(r.x, 6) for r in back.collect()) == [float(i * i) for i in range(20)]


def test_statistics_come_from_training_rows_only(spark):
    df = frame(
        spark,
        [(1.0, "train"), (3.0, "train"), (None, "train"), (None, "test"), (1000.0, "val")],
        "x double, role string",
    )
    out = C.impute_numeric(df, ["x"])
    assert [r.x for r in out.filter("role = 'test'").collect()] == [2.0]
    only = C.impute_numeric(df, ["x"], apply_to=("train",))
    assert [r.x for r in only.filter("role = 'test'").collect()] == [None]


def test_integers_take_the_mode(spark):
    df = frame(spark, [(10,), (2,), (2,), (10,), (None,)], "x int")
    assert sorted(r.x for r in C.impute_numeric(df, ["x"]).collect()) == [2, 2, 2, 10, 10]


def test_all_missing_columns(spark):
    df = frame(spark, [(None, None), (None, None)], "x double, c string")
    row = C.impute_simple(df, ["x"], ["c"]).first()
    assert row.x == 0.0 and row.c == "Unknown"


def test_outliers_keep_missing_and_one_row_splits(spark):
    rows = [(float(i % 3),) for i in range(30)] + [(500.0,), (None,)]
    kept = [r.x for r in C.outlier_filter(frame(spark, rows, "x double"), ["x"]).collect()]
    assert 500.0 not in kept and None in kept and len(kept) == 31
    assert C.outlier_filter(frame(spark, [(7.0,)], "x double"), ["x"]).count() == 1


def test_constant_and_near_unique_columns(spark):
    rows = [("k", str(i), "ab"[i % 2], None) for i in range(40)]
    df = frame(spark, rows, "const string, uniq string, kept string, empty string")
    columns = ["const", "uniq", "kept", "empty"]
    assert set(columns) & set(C.drop_constant(df, columns).columns) == {"uniq", "kept"}
    assert "uniq" not in C.drop_near_unique(df, columns).columns


def test_column_dropped_in_one_fold_only_is_null_there(spark):
    df = frame(spark, [("a",), ("a",)], "c string").unionByName(
        frame(spark, [("a",), ("b",)], "c string").withColumn("fold_id", F.lit(1))
    )
    rows = C.drop_constant(df, ["c"]).collect()
    assert [r.c for r in rows if r.fold_id == 0] == [None, None]
    assert sorted(r.c for r in rows if r.fold_id == 1) == ["a", "b"]


def test_labels_are_ordered_as_numbers(spark):
    out = E.label_encode(frame(spark, [(2,), (10,), (1,)], "y int"), "y")
    assert [r.y for r in out.orderBy("id").collect()] == [1, 2, 0]


def test_unseen_label_raises_and_unseen_category_is_minus_one(spark):
    df = frame(spark, [("a", "train"), ("b", "train"), ("z", "test")], "c string, role string")
    with pytest.raises(Exception, match="not seen in training"):
        E.label_encode(df, "c").collect()
    coded = {r.role: r.c for r in E.ordinal_encode(df, ["c"]).filter("role = 'test'").collect()}
    assert coded == {"test": -1}


def test_broadcast_and_shuffled_codes_agree(spark):
    df = frame(spark, [(f"v{i % 37}",) for i in range(200)], "c string")
    encoder = E.OrdinalEncoder.fit(df, ["c"])
    small = {(r.id, r.c) for r in encoder.transform(df).collect()}
    assert small == {(r.id, r.c) for r in encoder.transform(df, limit=0).collect()}
    expected = {v: i for i, v in enumerate(sorted({f"v{i}" for i in range(37)}))}
    first = encoder.transform(df.withColumn("raw", F.col("c")))
    assert all(expected[r.raw] == r.c for r in first.collect())


def test_one_hot_round_trip_and_unknown(spark):
    df = frame(spark, [("a_b",), ("c",), ("a_b",)], "g string")
    vocab = E.vocabulary(df, ["g"])
    wide = E.one_hot_encode(df, vocab)
    assert {"g_a_b", "g_c"} <= set(wide.columns)
    assert sorted(r.g for r in E.one_hot_decode(wide, vocab).collect()) == ["a_b", "a_b", "c"]
    unknown = E.one_hot_encode(frame(spark, [("x",), (None,)], "g string"), vocab)
    assert all(r["g_a_b"] == 0.0 and r["g_c"] == 0.0 for r in unknown.collect())
    with pytest.raises(ValueError):
        E.vocabulary(df, ["g"], limit=1)


def test_running_total_over_many_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("v"), F.lit(1).alias("n"))
    grouped = df.withColumn("g", F.lit("x"))
    for ranges in (None, 1, 9):
        rows = running_total(grouped, ["g"], "v", {"n": "before"}, {"n": "all"}, ranges)
        assert all(r.before == r.v and r["all"] == 1000 for r in rows.collect())


def test_exact_quantiles(spark):
    values = [float((i * 37) % 101) ** 1.5 for i in range(60)] + [5.0] * 20
    df = spark.createDataFrame([("c", v) for v in values], "column string, value double")
    got = {r.i: r.quantile for r in ST.exact_quantiles(df, ["column"], 11).collect()}
    data = sorted(values)
    for i in range(11):
        pos = i / 10 * (len(data) - 1)
        low = math.floor(pos)
        high = min(low + 1, len(data) - 1)
        assert got[i] == pytest.approx(data[low] + (data[high] - data[low]) * (pos - low))
    one = spark.createDataFrame([("c", 3.0)], "column string, value double")
    assert [r.quantile for r in ST.exact_quantiles(one, ["column"], 5).collect()] == [3.0]
    assert len(ST.exact_quantiles(one, ["column"], 3, at_most_rows=False).collect()) == 3


def test_inverse_normal(spark):
    points = [1e-7, 1e-4, 0.02, 0.075, 0.3, 0.5, 0.7, 0.95, 0.9999, 1 - 1e-7]
    df = spark.createDataFrame([(p,) for p in points], "p double")
    both = with_inverse_normal(df.withColumn("z", inverse_normal(F.col("p"))), {"w": F.col("p")})
    many = with_inverse_normal(df, {f"w{i}": F.col("p") for i in range(6)})
    for r in both.collect():
        exact = statistics.NormalDist().inv_cdf(r.p)
        assert r.z == pytest.approx(exact, abs=1e-9) and r.w == pytest.approx(exact, abs=1e-9)
    assert all(r.w5 == pytest.approx(statistics.NormalDist().inv_cdf(r.p), abs=1e-9) for r in many.collect())


def test_quantile_normal_edges_and_null(spark):
    df = frame(spark, [(float(i),) for i in range(11)] + [(None,)], "x double")
    out = S.quantile_normal(df, ["x"]).orderBy("id").collect()
    assert out[0].x == pytest.approx(-5.199337582605575, abs=1e-6)
    assert out[10].x == pytest.approx(5.199337582605575, abs=1e-6)
    assert out[5].x == pytest.approx(0.0, abs=1e-12)
    assert out[11].x is None


def test_yeo_johnson_finds_the_most_likely_exponent(spark):
    values = [math.exp(i / 10) - 3 for i in range(40)]
    df = frame(spark, [(v,) for v in values], "x double")
    lam = S.fit_yeo_johnson(df, ["x"]).first().lam

    def score(a):
        def y(x):
            if x >= 0:
                return math.log1p(x) if abs(a) < 1e-12 else ((x + 1) ** a - 1) / a
            b = 2 - a
            return -math.log1p(-x) if abs(b) < 1e-12 else -((1 - x) ** b - 1) / b

        jac = sum(math.copysign(math.log1p(abs(v)), v) for v in values)
        return -len(values) / 2 * math.log(statistics.pvariance([y(v) for v in values])) + (a - 1) * jac

    assert score(lam) >= max(score(lam - 1e-3), score(lam + 1e-3))
    out = [r.x for r in S.power_yeo_johnson(df, ["x"]).collect()]
    assert statistics.mean(out) == pytest.approx(0, abs=1e-9)
    assert statistics.pstdev(out) == pytest.approx(1, abs=1e-9)


@pytest.mark.parametrize(
    "values",
    [
        [-math.exp(i / 10) + 2 for i in range(40)],  # exponent above 1
        [1e6 * math.exp(i / 8) for i in range(50)],  # large, exponent near 0
        [math.exp((i - 30) / 6) - math.exp((30 - i) / 9) for i in range(70)],  # both signs
    ],
)
def test_yeo_johnson_slope_is_zero_at_the_exponent(spark, values):
    df = frame(spark, [(v,) for v in values], "x double")
    fit = S.fit_yeo_johnson(df, ["x"]).first()

    def score(a):
        def y(x):
            e = a if x >= 0 else 2 - a
            t = e * math.log1p(abs(x))
            size = math.log1p(abs(x)) if e == 0 else math.expm1(t) / e
            return math.copysign(size, x)

        jac = sum(math.copysign(math.log1p(abs(v)), v) for v in values)
        return -len(values) / 2 * math.log(statistics.pvariance([y(v) for v in values])) + (a - 1) * jac

    assert all(score(fit.lam) >= score(fit.lam + h) for h in (-1, -0.1, -1e-3, 1e-3, 0.1, 1))


def test_yeo_johnson_of_constant_empty_and_unbounded_columns(spark):
    df = frame(spark, [(5.0, None, 0.0), (5.0, None, 3.0)], "x double, y double, z double")
    fits = {r.column: r for r in S.fit_yeo_johnson(df, ["x", "y", "z"]).collect()}
    assert set(fits) == {"x", "z"}
    assert (fits["x"].lam, fits["x"].sd) == (1.0, 1.0)
    assert abs(fits["z"].lam) <= S.LAMBDA_BOUND
    out = S.power_yeo_johnson(df, ["x", "y", "z"]).orderBy("id").collect()
    assert [r.x for r in out] == [0.0, 0.0] and [r.y for r in out] == [None, None]


@pytest.mark.parametrize("limit", [None, 0])
def test_sparse_places(spark, limit):
    """Hot, rare, unknown and missing values, by broadcast and by shuffle."""
    n = F.col("id")
    df = spark.range(3000).select(
        "id",
        F.when(n % 3 == 0, "hot").when(n % 7 != 0, n.cast("string")).alias("a"),
        (n % 4).cast("int").alias("b"),
        F.lit(None).cast("string").alias("none"),
    )
    encoder = E.OneHotIndices.fit(df, ["a", "none", "b"])
    values = sorted({r.a for r in df.select("a").collect()} - {None})
    assert encoder.width == len(values) + 4 and encoder.sizes["none"] == 0
    assert encoder.vocabulary.filter("hot").filter("column = 'a'").collect()[0].value == "hot"
    more = df.unionByName(spark.createDataFrame([(-1, "new", 9, None)], "id long, a string, b int, none string"))
    place = {v: i for i, v in enumerate(values)}
    want = {
        r.id: [place[x] for x in [r.a] if x in place] + [len(values) + x for x in [r.b] if x < 4]
        for r in more.collect()
    }
    got = encoder.transform(more, limit=limit)
    assert {r.id: r.indices for r in got.collect()} == want
    pairs = encoder.decode(got.filter("id < 30"))
    assert sorted((r.id, r["column"], r.value) for r in pairs.collect()) == sorted(
        (r.id, c, str(r[c])) for r in df.filter("id < 30").collect() for c in ("a", "b") if r[c] is not None
    )
    vectors = {r.id: r.features for r in encoder.vectors(more, limit=limit).collect()}
    assert all(list(v.indices) == want[i] and v.size == encoder.width for i, v in vectors.items())


def test_sparse_places_of_no_rows(spark):
    df = spark.createDataFrame([], "a string")
    encoder = E.OneHotIndices.fit(df, ["a"])
    assert encoder.width == 0 and encoder.transform(df).count() == 0
    with pytest.raises(ValueError):
        encoder.vectors(df)


def test_broadcasts_stay_within_the_limit_together():
    sizes = {"a": 40, "b": 30, "c": 50}
    assert E.within(sizes, 70) == {"a", "b"} and E.within(sizes, 69) == {"b"}
    assert E.within(sizes, 0) == set() and E.within({"none": 0}, 0) == {"none"}


@pytest.mark.parametrize("noise", [0.0, 1e-10])
@pytest.mark.parametrize("root", [-3.7, 0.3, 2.5])
def test_the_climb_ends_where_the_sign_of_the_slope_is_chance(root, noise):
    """Sums over many rows: near the root the slope's sign changes from round to round."""
    climb, rounds = S._Climb(), 0
    while not climb.done:
        rounds += 1
        assert rounds <= 12
        gap = root - climb.lam + noise * (-1) ** rounds
        climb.move(1e6 * (gap + gap**3 / 9), -1e6 * (1 + gap**2 / 3))
    assert climb.lam == pytest.approx(root, abs=1e-8)
