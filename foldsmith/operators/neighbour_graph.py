"""Approximate neighbour joins by refining a graph of near rows.

Training rows and queries are the nodes of one graph; each points to at most ``degree``
training rows. The first edges join nodes that stand next to each other in the order of a
few random projections. Then neighbours of neighbours are tried: every node lists the rows
near it (those it points to, and the nearest of those that point to it), and any two rows of
such a list are candidates for each other (Dong, Charikar and Li 2011). Distances are exact;
edges that improve on a node's worst are kept, until a round changes next to nothing. Two rows
that stood on a list together before were compared then, so only lists with new rows are made
again and only pairs with a new row are compared. Each
round reads and writes tables, and joins of nodes and edges are by shuffle at every size:
their columns are wider in memory than in the files, whose size would choose a broadcast
through the driver. Lists are bounded, so a vector that is near to a third of all
rows has a list of the same size as any other, and no bucket of rows is compared as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.operators.neighbours import check_sides, knn_join, matrix, with_unit_vector
from foldsmith.operators.ranking import group_key, value_ranges
from foldsmith.session import materialize, small_batches

DEGREE = 20
PROJECTIONS = 6
REACH = 6  # places to the right in the order of a projection
TOLERANCE = 0.001  # share of edges; fewer changes end the refinement
EDGE = "u long, asks boolean, v long, d double"

# Pairs that are measured at a time.
PAIRS = 20_000


def _nodes(queries: DataFrame, train: DataFrame, by) -> DataFrame:
    """One numbered row per training row and query, written."""
    sides = [
        queries.select(*by, "q_id", F.lit(None).cast(train.schema["s_id"].dataType).alias("s_id"), "vec"),
        train.select(*by, F.lit(None).cast(queries.schema["q_id"].dataType).alias("q_id"), "s_id", "vec"),
    ]
    asks = [F.lit(True), F.lit(False)]
    rows = [side.withColumn("asks", flag) for side, flag in zip(sides, asks, strict=True)]
    both = rows[0].unionByName(rows[1])
    numbered = both.withColumn("g", group_key(by)).withColumn("node", F.monotonically_increasing_id())
    return materialize(numbered, "nodes")


def _shuffled(df: DataFrame, side: DataFrame, on, how: str = "inner") -> DataFrame:
    """Join of tables that grow with the rows, never by a broadcast."""
    return df.hint("merge").join(side.hint("merge"), on, how)


def _nearest(edges: DataFrame, degree: int) -> DataFrame:
    """The ``degree`` shortest edges of every node, each once; ``kept``, if it is there, where
    one of the equal edges was."""
    kept = [F.bool_or("kept").alias("kept")] if "kept" in edges.columns else []
    once = edges.groupBy("u", "asks", "v").agg(F.min("d").alias("d"), *kept)
    order = Window.partitionBy("u").orderBy("d", "v")
    return once.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).drop("r")


def _measured(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (u, asks, v) with their distance."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gap = matrix(frame["a"]) - matrix(frame["b"])
            yield frame[["u", "asks", "v"]].assign(d=np.sqrt((gap * gap).sum(axis=1)))

    a = nodes.select(F.col("node").alias("u"), F.col("vec").alias("a"))
    b = nodes.select(F.col("node").alias("v"), F.col("vec").alias("b"))
    both = _shuffled(_shuffled(pairs, a, "u"), b, "v")
    return both.select("u", "asks", "v", "a", "b").mapInPandas(measure, EDGE)


def _first_edges(nodes: DataFrame, projections: int, reach: int, seed: int) -> DataFrame:
    """Edges between nodes that are close in the order of random projections, with their distance.

    Vectors are sent once a projection to the task that holds their part of its order, and
    measured there, not once a pair.
    """
    width = nodes.select(F.size("vec")).first()[0]
    directions = np.random.default_rng(seed).normal(size=(width, projections))

    def project(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                value = matrix(frame["vec"]) @ directions
                for p in range(projections):
                    yield frame[["g", "node", "asks"]].assign(p=p, value=value[:, p])

    rows = nodes.select("g", "node", "asks", "vec").mapInPandas(
        project, "g string, node long, asks boolean, p int, value double"
    )
    ranged = value_ranges(rows, ["g", "p"], "value").select("__group", "__range", "node", "asks", "value")
    # Training rows among the next places on both sides; queries in between are passed over.
    places = 4 * reach

    def beside(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["value", "node"], ignore_index=True)
        node, asks, vec = frame["node"].to_numpy(), frame["asks"].to_numpy(bool), np.stack(frame["vec"].to_numpy())
        given, here = np.flatnonzero(~asks), np.arange(len(frame))
        u, v = [], []
        for j in range(reach):
            for at in (np.searchsorted(given, here, "right") + j, np.searchsorted(given, here, "left") - 1 - j):
                some = np.flatnonzero((at >= 0) & (at < len(given)))
                place = given[at[some]]
                close = np.abs(place - some) <= places
                u.append(some[close])
                v.append(place[close])
        u, v = np.concatenate(u), np.concatenate(v)
        d = np.empty(len(u))
        for start in range(0, len(u), PAIRS):
            part = slice(start, start + PAIRS)
            gap = vec[u[part]].astype(float) - vec[v[part]].astype(float)
            d[part] = np.sqrt((gap * gap).sum(axis=1))
        return pd.DataFrame({"u": node[u], "asks": asks[u], "v": node[v], "d": d})

    placed = _shuffled(ranged, nodes.select("node", "vec"), "node")
    return placed.groupBy("__group", "__range").applyInPandas(beside, EDGE)


def _lists(edges: DataFrame, degree: int, before: DataFrame | None = None) -> DataFrame:
    """The rows near every node ``w``: those it points to, and the nearest of those that point to
    it; ``new`` where they did not stand on its list ``before``."""
    out = edges.select(F.col("u").alias("w"), F.col("v").alias("m"), F.lit(False).alias("asks"), "d")
    back = edges.select(F.col("v").alias("w"), F.col("u").alias("m"), "asks", "d")
    order = Window.partitionBy("w", "asks").orderBy("d", "m")
    near = out.unionByName(back).groupBy("w", "m", "asks").agg(F.min("d").alias("d"))
    near = near.withColumn("r", F.row_number().over(order)).where(F.col("r") <= degree).select("w", "m", "asks")
    if before is None:
        return near.withColumn("new", F.lit(True))
    known = before.select("w", "m", "asks", F.lit(True).alias("known"))
    return _shuffled(near, known, ["w", "m", "asks"], "left").select("w", "m", "asks", F.col("known").isNull().alias("new"))


def _candidates(edges: DataFrame, nodes: DataFrame, degree: int, lists: DataFrame | None = None) -> DataFrame:
    """Pairs out of the lists of all nodes, one of them new there, that are shorter than the worst
    edge of their first. ``lists`` are those of :func:`_lists`, by default all of them new."""
    near = _lists(edges, degree) if lists is None else lists
    if lists is not None:
        near = _shuffled(near, lists.where("new").select("w").distinct(), "w", "left_semi")
    full: Column = F.count(F.lit(1)) >= degree
    worst = edges.groupBy(F.col("u").alias("node")).agg(F.when(full, F.max("d")).alias("worst"))
    known = _shuffled(nodes.select("node", "vec"), worst, "node", "left").withColumnRenamed("node", "m")
    member = F.struct("m", "asks", "new", F.coalesce("worst", F.lit(float("inf"))).alias("worst"), "vec")
    listed = _shuffled(near.select("w", "m", "asks", "new"), known, "m")
    members = listed.groupBy("w").agg(F.collect_list(member).alias("members"))
    names = ["u", "asks", "v", "d"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(pc.list_value_length(batch.column(0)).to_numpy())
            rows = pc.list_flatten(batch.column(0))
            columns = {c: pc.struct_field(rows, c) for c in ("m", "asks", "new", "worst", "vec")}
            vecs = pc.list_flatten(columns.pop("vec")).to_numpy().reshape(len(rows), -1)
            node, asks, new, worst = (c.to_numpy(zero_copy_only=False) for c in columns.values())
            found = []
            for start, end in zip(np.concatenate([[0], ends[:-1]]), ends, strict=True):
                at = np.arange(start, end)
                to = at[~asks[at]]
                vec = vecs[at].astype(float)
                gap = vec[:, None] - vec[None, to - start]
                d = np.sqrt((gap * gap).sum(axis=2))
                near = (d < worst[at][:, None]) & (node[at][:, None] != node[to])
                i, j = np.nonzero(near & (new[at][:, None] | new[to]))
                if len(i):
                    found.append((node[at[i]], asks[at[i]], node[to[j]], d[i, j]))
            if found:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], names=names
                )

    return members.select("members").mapInArrow(compare, EDGE)


def knn_join_approx(
    queries: DataFrame,
    train: DataFrame,
    k: int = 5,
    metric: str = "minkowski",
    by=(),
    degree: int = DEGREE,
    projections: int = PROJECTIONS,
    tolerance: float = TOLERANCE,
    seed: int = 42,
) -> DataFrame:
    """Nearly the k nearest training rows of every query, with exact distances and ranks.

    The columns are those of ``knn_join``; metrics are ``minkowski`` (Euclidean) and
    ``cosine``. A group with fewer than k training rows gives what it has.
    """
    by = list(by)
    if k > degree:
        raise ValueError("the graph's degree must be at least k")
    check_sides(queries, train, by)
    if metric == "cosine":
        queries, train = with_unit_vector(queries, "query"), with_unit_vector(train, "train")
    elif metric == "minkowski":
        # Single precision stays as it is between tasks; distances are in double precision.
        kinds = {side.schema["vec"].dataType.elementType for side in (queries, train)}
        kind = "array<float>" if kinds == {T.FloatType()} else "array<double>"
        queries = queries.withColumn("vec", F.col("vec").cast(kind))
        train = train.withColumn("vec", F.col("vec").cast(kind))
    else:
        raise ValueError(f"unsupported metric {metric!r}")
    nodes = _nodes(queries, train, by)
    if nodes.limit(1).count():
        spark = nodes.sparkSession
        edges = materialize(_nearest(_first_edges(nodes, projections, REACH, seed), degree), "edges")
        lists = None
        while True:
            lists = materialize(_lists(edges, degree, lists), "lists")
            more = _candidates(edges, nodes, degree, lists).withColumn("kept", F.lit(False))
            found = edges.withColumn("kept", F.lit(True)).unionByName(more)
            with small_batches(spark):
                edges = materialize(_nearest(found, degree), "edges")
            changed = edges.where("NOT kept").count()
            if changed <= tolerance * edges.count():
                break
    else:
        edges = queries.sparkSession.createDataFrame([], EDGE)
    asked = nodes.where("asks").select(F.col("node").alias("u"), *by, "q_id")
    given = nodes.where("NOT asks").select(F.col("node").alias("v"), "s_id")
    best = Window.partitionBy(*by, "q_id").orderBy("distance", "s_id")
    distance = F.col("d") * F.col("d") / 2 if metric == "cosine" else F.col("d")
    return (
        _shuffled(_shuffled(edges.where("asks"), asked, "u"), given, "v")
        .withColumn("distance", distance)
        .withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select(*by, "q_id", "s_id", "distance", "rank")
    )


def recall(found: DataFrame, queries: DataFrame, train: DataFrame, k: int, metric: str = "minkowski", by=()) -> DataFrame:
    """Share of the k nearest rows' distances reached, over all queries: ``recall``, ``queries``.

    A row as near as the k-th is as good as it, so equal vectors do not count as misses.
    """
    by = list(by)
    limit = knn_join(queries, train, k, metric, by=by).where(F.col("rank") == k)
    limit = limit.select(*by, "q_id", F.col("distance").alias("limit"))
    near = F.col("distance") <= F.col("limit") * (1 + 1e-9) + 1e-12
    joined = _shuffled(limit, found, [*by, "q_id"], "left")
    return joined.agg(
        (F.count_if(near) / (F.count_distinct(*by, "q_id") * k)).alias("recall"),
        F.count_distinct(*by, "q_id").alias("queries"),
    )
