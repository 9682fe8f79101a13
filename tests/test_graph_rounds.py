"""The graph's first edges and later rounds: nothing is measured twice, nothing is lost."""

import random

import pytest
from pyspark.sql import functions as F

from foldsmith.operators import neighbour_graph as G
from foldsmith.session import materialize


@pytest.fixture(scope="module")
def nodes(spark):
    rng = random.Random(3)
    rows = [(0, k, [rng.gauss(0, 1) for _ in range(8)]) for k in range(400)]
    train = spark.createDataFrame(rows, "fold_id int, s_id long, vec array<float>").repartition(3)
    return G._nodes(train.where("s_id % 10 = 0").withColumnRenamed("s_id", "q_id"), train, ["fold_id"])


def test_first_edges_are_measured_in_their_order(spark, nodes):
    first = G._first_edges(nodes, 3, 4, 1)
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 1 and "Broadcast" not in plan  # vectors join nodes, not pairs
    edges = first.collect()
    wanted = {(r.u, r.v): r.d for r in G._measured(first.select("u", "asks", "v"), nodes).collect()}
    assert edges and all(r.d == pytest.approx(wanted[r.u, r.v]) for r in edges)
    asking = {r.node for r in nodes.where("asks").collect()}
    assert {r.v for r in edges}.isdisjoint(asking) and all(r.asks == (r.u in asking) and r.u != r.v for r in edges)
    out = {}
    for r in edges:
        out.setdefault(r.u, set()).add(r.v)
    assert len(out) == nodes.count() and max(len(v) for v in out.values()) <= 3 * 2 * 4


def test_pairs_that_met_before_change_nothing(spark, nodes):
    """Edges of rounds that leave them out are those of rounds that compare all lists."""
    first = materialize(G._nearest(G._first_edges(nodes, 2, 2, 1), 6), "edges")

    def edges_of(rounds, again):
        edges, lists, made = first, None, []
        for _ in range(rounds):
            lists = None if again else materialize(G._lists(edges, 6, lists), "lists")
            more = G._candidates(edges, nodes, 6, lists)
            made.append(more.count())
            edges = materialize(G._nearest(edges.unionByName(more), 6), "edges")
        return sorted((r.u, r.v, r.d) for r in edges.collect()), made

    (plain, all_pairs), (found, new_pairs) = edges_of(4, True), edges_of(4, False)
    assert found == plain
    assert new_pairs[0] == all_pairs[0] and new_pairs[3] < 0.6 * all_pairs[3]
    assert nodes.schema["vec"].dataType.elementType.simpleString() == "float"
    assert first.where(F.col("u") == F.col("v")).count() == 0
