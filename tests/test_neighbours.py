import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import augment as A
from foldsmith.operators import neighbours as N
from foldsmith.spec import TableSpec


def sides(spark, queries, train):
    q = spark.createDataFrame([(i, v) for i, v in enumerate(queries)], "q_id long, vec array<double>")
    s = spark.createDataFrame([(i, v) for i, v in enumerate(train)], "s_id long, vec array<double>")
    return q, s


def brute(queries, train, k, distance):
    out = {}
    for i, q in enumerate(queries):
        best = sorted((distance(q, s), j) for j, s in enumerate(train))[:k]
        out[i] = [(j, round(d, 9)) for d, j in best]
    return out


def found(df):
    out = {}
    for r in df.orderBy("q_id", "rank").collect():
        out.setdefault(r.q_id, []).append((r.s_id, round(r.distance, 9)))
    return out


@pytest.fixture(scope="module")
def skewed():
    """A third of the training rows are copies of one point."""
    rng = random.Random(7)
    train = [[0.5, 0.5, 0.5]] * 60 + [[rng.gauss(0, 3) for _ in range(3)] for _ in range(120)]
    queries = [[rng.gauss(0, 3) for _ in range(3)] for _ in range(35)] + [[0.5, 0.5, 0.5]] * 5
    return queries, train


EUCLID = math.dist


@pytest.mark.parametrize(
    "p, distance",
    [
        (1, lambda a, b: sum(abs(x - y) for x, y in zip(a, b))),
        (2, EUCLID),
        (3, lambda a, b: sum(abs(x - y) ** 3 for x, y in zip(a, b)) ** (1 / 3)),
        (math.inf, lambda a, b: max(abs(x - y) for x, y in zip(a, b))),
    ],
)
def test_cells_find_what_brute_force_finds(spark, skewed, p, distance):
    queries, train = skewed
    got = found(N.knn_join(*sides(spark, queries, train), 5, p=p, pivots=9))
    assert got == brute(queries, train, 5, distance)


def test_hot_cells_are_cut_into_blocks(spark, skewed, monkeypatch):
    queries, train = skewed
    whole = found(N.knn_join(*sides(spark, queries, train), 5, pivots=1))
    monkeypatch.setattr(N, "TRAIN_BLOCK", 16)
    monkeypatch.setattr(N, "QUERY_BLOCK", 4)
    monkeypatch.setattr(N, "TILE", 64)
    assert found(N.knn_join(*sides(spark, queries, train), 5, pivots=9)) == whole


def test_cells_skip_far_away_training_rows(spark):
    train = [[float(100 * c + i % 7), float(i % 5)] for c in range(6) for i in range(40)]
    queries = [[float(100 * c) + 0.3, 0.2] for c in range(6)]
    q, s = sides(spark, queries, train)
    points = np.array([[100.0 * c + 3, 2.0] for c in range(6)])
    cells, _ = N._describe(N._assign(s, points, 2, ["s_id", "vec"]), [], points, 5)
    assert N._visits(q, cells, [], 5, 2, None).count() < 6 * len(queries) / 2


def test_cosine_and_zero_vectors(spark, skewed):
    queries, train = skewed
    queries, train = queries[:10] + [[0.0, 0.0, 0.0]], [*train[55:], [0.0, 0.0, 0.0]]

    def cosine(a, b):
        size = math.hypot(*a) * math.hypot(*b)
        return 1.0 if size == 0 else 1 - sum(x * y for x, y in zip(a, b)) / size

    got = found(N.knn_join(*sides(spark, queries, train), 7, "cosine", pivots=5))
    want = brute(queries, train, 7, cosine)
    for i in range(10):  # equal directions tie up to rounding
        assert [d for _, d in got[i]] == pytest.approx([d for _, d in want[i]], abs=1e-9)
    assert [d for _, d in got[10]] == pytest.approx([1.0] * 7)  # similarity 0 to all


def test_cosine_similarity_threshold(spark, skewed):
    queries, train = skewed
    pairs = N.cosine_similarity(*sides(spark, [*queries, [0.0] * 3], train), 0.9).collect()
    got = {(r.q_id, r.s_id): r.similarity for r in pairs}
    want = {}
    for i, q in enumerate(queries):
        for j, s in enumerate(train):
            sim = sum(x * y for x, y in zip(q, s)) / (math.hypot(*q) * math.hypot(*s))
            if sim >= 0.9:
                want[i, j] = sim
    assert set(got) == set(want)
    assert all(got[p] == pytest.approx(want[p]) for p in want)


def test_ties_go_to_the_lower_id_and_groups_stay_apart(spark):
    q = spark.createDataFrame([(0, 1, [0.0]), (1, 1, [0.0])], "fold_id int, q_id long, vec array<double>")
    s = spark.createDataFrame(
        [(0, 5, [1.0]), (0, 3, [-1.0]), (1, 9, [4.0]), (1, 8, [2.0])],
        "fold_id int, s_id long, vec array<double>",
    )
    rows = N.knn_join(q, s, 1, by=["fold_id"]).collect()
    assert {(r.fold_id, r.s_id) for r in rows} == {(0, 3), (1, 8)}


def test_too_few_training_rows(spark):
    with pytest.raises(ValueError):
        N.knn_join(*sides(spark, [[0.0]], [[1.0], [2.0]]), 3)
    with pytest.raises(ValueError):
        N.knn_join(*sides(spark, [[0.0]], [[1.0]]), 1, metric="hamming")


def test_aggregations(spark):
    near = spark.createDataFrame(
        [(1, 10, 1.0, 1), (1, 11, 2.0, 2), (1, 12, 4.0, 3)],
        "q_id long, s_id long, distance double, rank int",
    )
    train = spark.createDataFrame([(10, 1.0), (11, 5.0), (12, 9.0)], "s_id long, x double")

    def value(how):
        return N.neighbour_aggregate(near, train, ["x"], how).first().x

    assert (value("median"), value("mean"), value("max"), value("min"), value("first")) == (5, 5, 9, 1, 1)
    weights = [1 / (d + 1e-6) for d in (1.0, 2.0, 4.0)]
    assert value("weighted_average") == pytest.approx(
        (weights[0] + 5 * weights[1] + 9 * weights[2]) / sum(weights)
    )
    assert value("random") in (1.0, 5.0, 9.0)
    with pytest.raises(ValueError):
        value("sum")


SPEC = TableSpec("y", "id", ("a", "b"))


def fold_rows(spark, n=30):
    rng = random.Random(3)
    rows = [
        (0, "train" if i < n - 8 else "test", i, rng.random(), rng.random(), i % 2) for i in range(n)
    ]
    return spark.createDataFrame(rows, "fold_id int, role string, id long, a double, b double, y int")


def test_augment_keeps_training_rows_and_adds_one_row_per_query(spark):
    df = fold_rows(spark)
    out = A.augment_knn(df, SPEC, k=3)
    kinds = {r.origin: r["count"] for r in out.groupBy("origin").count().collect()}
    assert kinds == {"train": 22, "neighbours": 8}
    made = A.augment_dataset(df, SPEC, k=3)
    assert {r.y for r in made.collect()} <= {0, 1}


def test_label_of_the_query_does_not_leak(spark):
    df = fold_rows(spark)
    flipped = df.withColumn("y", F.when(F.col("role") == "test", 1 - F.col("y")).otherwise(F.col("y")))
    first = A.augment_knn(df, SPEC, k=3).collect()
    assert sorted(first) == sorted(A.augment_knn(flipped, SPEC, k=3).collect())
    with_label = A.augment_knn(df, SPEC, k=3, include_target=True).collect()
    assert sorted(with_label) != sorted(first)


def test_weighted_sample_per_group_is_exact(spark):
    df = spark.range(50).select(
        (F.col("id") % 2).cast("int").alias("fold_id"), F.col("id"), F.lit(0.5).alias("w")
    )
    needed = spark.createDataFrame([(0, 4), (1, 100)], "fold_id int, __needed int")
    counts = A.weighted_per_group(df, needed, "id", "w", ["fold_id"]).groupBy("fold_id").count()
    assert {r.fold_id: r["count"] for r in counts.collect()} == {0: 4, 1: 25}


def test_first_round_closes_most_cells_of_vectors_without_clusters(spark):
    """4000 vectors of 64 numbers on a bent surface, evenly spread."""
    rng = np.random.default_rng(3)
    spread = rng.uniform(0, 1, (4040, 2))
    waves = rng.normal(0, 2, (2, 64))
    points = np.sin(spread @ waves + rng.uniform(0, 6, 64))
    train, queries = points[:4000], points[4000:]
    q, s = sides(spark, queries.tolist(), train.tolist())
    pivots = np.unique(train[:63], axis=0)
    cells, counts = N._describe(N._assign(s, pivots, 2, ["s_id", "vec"]), [], pivots, 5)
    gaps = np.sort(N.distances(queries, train, 2), axis=1)[:, :5]
    bound = spark.createDataFrame([(i, float(g[4])) for i, g in enumerate(gaps)], "q_id long, bound double")
    visits = N._visits(q.join(bound, "q_id"), cells, [], 5, 2, None)
    assert visits.count() < 0.2 * len(queries) * len(cells.pivots)
    # No cell that holds a neighbour is closed.
    open_cells = {(r.q_id, r.cell) for r in visits.collect()}
    heads = N._heads(pivots, 2)
    own, gap = N._closest(train, pivots, heads, 2)
    apart = N.distances(train, pivots, 2)
    assert np.array_equal(gap, apart.min(axis=1))
    for i, row in enumerate(N.distances(queries, train, 2)):
        assert all((i, own[j]) in open_cells for j in np.argsort(row)[:5])
    # The join takes its own bound from the nearest block.
    got = found(N.knn_join(q, s, 5))
    for i, row in enumerate(N.distances(queries, train, 2)):
        best = np.lexsort((np.arange(4000), row))[:5]
        assert got[i] == [(int(j), round(float(row[j]), 9)) for j in best]


def test_blocks_are_bounded_and_second_round_leaves_out_the_first(spark, skewed, monkeypatch):
    queries, train = skewed
    monkeypatch.setattr(N, "TRAIN_BLOCK", 20)
    q, s = sides(spark, queries, train)
    points = np.unique(np.array(train[55:75]), axis=0)
    assigned = N._assign(s, points, 2, ["s_id", "vec"])
    cells, counts = N._describe(assigned, [], points, 5)
    blocks = N._deal(cells, counts, 2)
    held = {}
    for (c,), n in counts.items():
        for part in range(blocks.parts[0, c]):
            at = blocks.first[0, c] + part
            held[at] = held.get(at, 0) + -(-n // blocks.parts[0, c])
    assert sum(held.values()) >= len(train) and max(held.values()) <= 20
    homes = N._visits(q, cells, [], 5, 2, None, blocks, home=True)
    assert homes.count() == len(queries)
    again = N._visits(homes.withColumnRenamed("cell", "seen"), cells, [], 5, 2, None, blocks)
    pairs = again.join(homes.select("q_id", F.col("cell").alias("home")), "q_id").collect()
    assert all(r.cell != r.home for r in pairs)
    assert len({(r.q_id, r.cell) for r in pairs}) == len(pairs)


def test_close_pairs_of_wide_vectors_are_those_of_all_distances():
    rng = np.random.default_rng(3)
    for scale, shift in ((1.0, 0.0), (1e-6, 1000.0)):
        a = rng.normal(size=(60, 16)) * scale + shift
        b = np.vstack([rng.normal(size=(200, 16)) * scale + shift, a[:20], a[:20]])
        d = N.distances(a, b, 2)
        limit = np.sort(d, axis=1)[:, 7]
        q, c, near = N._close(a, b, 2, limit)
        assert (near == d[q, c]).all()
        assert {*zip(q.tolist(), c.tolist())} == {*zip(*(x.tolist() for x in np.nonzero(d <= limit[:, None])))}
        best = N._Best(len(a), 5)
        best.add(np.arange(len(a)), np.arange(len(b)), N._close(a, b, 2, np.full(len(a), np.inf), 5))
        assert (best.row == np.argsort(d, axis=1, kind="stable")[:, :5]).all()


def test_wide_vectors_get_few_exact_distances(monkeypatch):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(50, 16)), rng.normal(size=(400, 16))
    monkeypatch.setattr(N, "distances", None)  # all pairs are not measured coordinate by coordinate
    q, _, d = N._close(a, b, 2, np.full(50, np.inf), 5)
    assert len(q) < 50 * 10 and len(d) == len(q)


def test_equal_vectors_are_searched_once_and_few_of_them_are_searched(spark, monkeypatch):
    train = [[0.5, 0.5]] * 2000 + [[float(i), 1.0] for i in range(20)]
    queries = [[0.5, 0.5]] * 300 + [[0.5, 0.6]] * 200 + [[7.2, 1.0]]
    taken = []
    join = N._blocked_join

    def counted(q, s, *rest):
        taken.append((q.count(), s.count()))
        return join(q, s, *rest)

    monkeypatch.setattr(N, "_blocked_join", counted)
    got = found(N.knn_join(*sides(spark, queries, train), 5))
    assert got == brute(queries, train, 5, EUCLID)
    assert taken == [(3, 25)]
