"""Neighbours of narrow vectors: trees of boxes find what all distances give."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldsmith.operators import neighbours as N
from foldsmith.operators.boxes import Tree


def points(width, seed=0):
    """Half of them on a few lines, some equal, some far away."""
    rng = np.random.default_rng(seed)
    train, queries = rng.normal(size=(900, width)), rng.normal(size=(120, width))
    for side in (train, queries):
        side[: len(side) // 2, -1] = rng.integers(0, 3, len(side) // 2)
        side[:20] = side[20]
        side[-3:] *= 1e6
    queries[30:50] = train[30:50]
    return queries, train


@pytest.mark.parametrize("p", [1, 2, 3, math.inf])
@pytest.mark.parametrize("width", [1, 2, 7])
def test_a_tree_finds_the_nearest_rows(width, p):
    queries, train = points(width)
    d = N.distances(queries, train, p)
    wanted = np.argsort(d, axis=1, kind="stable")[:, :5]
    q, s, near = Tree.build(train).search(queries, np.full(len(queries), np.inf), train, 5, p)
    assert (s.reshape(-1, 5) == wanted).all() and (near == d[q, s]).all()
    limit = np.full(len(queries), np.median(d[np.arange(len(d)), wanted[:, 2]]))
    q, s, near = Tree.build(train).search(queries, limit, train, 5, p)
    assert {*zip(q.tolist(), s.tolist())} == {(i, int(j)) for i, row in enumerate(wanted) for j in row if d[i, j] <= limit[i]}


def test_few_rows_and_equal_rows():
    train = np.array([[1.0, 2.0]] * 70)
    q, s, d = Tree.build(train).search(train[:2], np.full(2, np.inf), train, 3, 2)
    assert q.tolist() == [0, 0, 0, 1, 1, 1] and s.tolist() == [0, 1, 2] * 2 and not d.any()
    q, s, _ = Tree.build(train[:1]).search(train[:2], np.full(2, np.inf), train[:1], 3, 2)
    assert q.tolist() == [0, 1] and s.tolist() == [0, 0]


def test_cuts_deal_rows_into_like_boxes_and_reach_all_neighbours():
    queries, train = points(2)
    cuts = Tree.cut(train[::2], 12)
    own = cuts.place(train)
    assert np.unique(own).tolist() == list(range(12)) and np.bincount(own).max() < 3 * len(train) / 12
    low, high = (np.array([end(train[own == c], axis=0) for c in range(12)]) for end in (np.min, np.max))
    d = N.distances(queries, train, 2)
    wanted = np.argsort(d, axis=1, kind="stable")[:, :5]
    limit = d[np.arange(len(d)), wanted[:, 4]] * (1 + 1e-9)
    at, leaf, _ = cuts.bounded(low, high).reached(queries, limit, 2)
    opened = {*zip(at.tolist(), leaf.tolist())}
    assert all((i, own[j]) in opened for i, row in enumerate(wanted) for j in row)
    assert len(opened) < 0.4 * 12 * len(queries)


@pytest.mark.parametrize("ids", ["long", "string"])
def test_boxed_join_of_groups_in_two_rounds(spark, monkeypatch, ids):
    """Narrow vectors are not compared with pivots, and boxes beyond the k-th row stay closed."""
    monkeypatch.setattr(N, "TRAIN_BLOCK", 60)
    monkeypatch.setattr(N, "_assign", None)
    queries, train = points(2)
    rows = [(g, str(i) if ids == "string" else i, v.tolist()) for g in (3, 5) for i, v in enumerate(train[g:])]
    s = spark.createDataFrame(rows, f"fold_id int, s_id {ids}, vec array<double>")
    q = spark.createDataFrame([(g, i, v.tolist()) for g in (3, 5) for i, v in enumerate(queries)], "fold_id int, q_id long, vec array<double>")
    found = {}
    for r in N.knn_join(q, s, 5, by=["fold_id"]).orderBy("rank").collect():
        found.setdefault((r.fold_id, r.q_id), []).append((r.s_id, r.distance))
    assert len(found) == 2 * len(queries)
    for g in (3, 5):
        d = N.distances(queries, train[g:], 2)
        names = [str(i) if ids == "string" else i for i in range(len(train) - g)]
        for i, row in enumerate(d):
            assert found[g, i] == sorted(zip(names, row.tolist()), key=lambda x: (x[1], x[0]))[:5]


def test_vectors_of_different_widths_are_an_error(spark):
    q = spark.createDataFrame([(0, [1.0, 2.0])], "q_id long, vec array<double>")
    s = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 2.0, 3.0]), (2, [0.0, 0.0])], "s_id long, vec array<double>")
    with pytest.raises(Exception, match="different widths"):
        N.knn_join(q, s, 2).collect()


def test_medians_and_modes_of_lists_are_those_of_aggregates(spark):
    rows = [(q, 10 * q + i, float(i), i + 1) for q in range(6) for i in range(q)]
    near = spark.createDataFrame(rows, "q_id long, s_id long, distance double, rank int")
    values = [(s, None if s % 7 == 0 else (s * 37 % 11) / 3, (s * 5) % 3) for _, s, _, _ in rows]
    values += values[:4]  # an id that comes twice counts twice
    train = spark.createDataFrame(values, "s_id long, x double, y int")
    got = N.neighbour_aggregate(near, train, ["x", "y"], majority=("y",))
    grouped = near.join(train, "s_id").groupBy("q_id")
    wanted = grouped.agg(F.median("x").alias("x"), F.mode("y", True).alias("y"))
    assert got.schema.simpleString() == wanted.schema.simpleString()
    assert sorted(got.collect()) == sorted(wanted.collect())
