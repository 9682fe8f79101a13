"""Exact nearest-neighbour joins without comparing every pair.

Training rows are assigned to the nearest of about ``sqrt(rows)`` pivots, found through
an upper level of ``sqrt(pivots)`` heads. The distances to the pivots bound, by the
triangle inequality and by the borders between cells, which cells can hold a neighbour
(after Lu, Shen, Chen and Ooi 2012). Cells below one head travel together in blocks of
bounded size, and a cell that holds a third of all rows becomes many blocks. A query
first visits the block of its nearest cell; the k-th distance found there bounds which
other blocks it visits, and within a block which cells it is compared with. Inside a
block NumPy computes distances and passes on the best ``k`` rows per query, never pairs.

Vectors of fewer than eight numbers need no pivots: training rows are dealt into boxes by median
cuts, a query visits the box that the cuts lead it to and then the boxes within the k-th distance
found there, and inside a box both sides meet in a tree (:mod:`foldsmith.operators.boxes`).

How many cells stay open depends on the intrinsic dimension of the vectors, not on
clusters. Vectors drawn at random in many dimensions leave nothing to skip, by any bound.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.functions.arrays import norm
from foldsmith.functions.hashing import hash_key, uniform
from foldsmith.operators.boxes import LEAF, SLACK, Tree
from foldsmith.operators.ranking import group_key
from foldsmith.session import BROADCAST_BYTES, materialize

# The most a task holds of either side.
TRAIN_BLOCK = 50_000
QUERY_BLOCK = 10_000

# Distance cells computed at a time inside a block, and of those at a time in the fast memory
# of a core.
TILE, CACHED = 500_000, 16_000

# From this width on, squared distances come from matrix products first; below, rows are dealt
# into boxes, by a sample of so many rows a box.
WIDE = 8
BOX_SAMPLE = 64


def distances(a: np.ndarray, b: np.ndarray, p: float) -> np.ndarray:
    """Minkowski distances of all rows of ``a`` to all rows of ``b``.

    Terms are added coordinate by coordinate, so equal vectors give equal bits
    whatever block they are in.
    """
    out = np.zeros((len(a), len(b)))
    columns = np.ascontiguousarray(b.T)
    step = max(1, CACHED // max(1, len(b)))
    gaps = np.empty((min(step, len(a)), len(b)))
    for start in range(0, len(a), step):
        some, sums = a[start : start + step], out[start : start + step]
        gap = gaps[: len(some)]
        for i in range(a.shape[1]):
            np.subtract(some[:, i, None], columns[i], out=gap)
            np.abs(gap, out=gap)
            if p == math.inf:
                np.maximum(sums, gap, out=sums)
                continue
            if p == 2:
                np.multiply(gap, gap, out=gap)
            elif p != 1:
                np.power(gap, p, out=gap)
            sums += gap
    if p == 2:
        return np.sqrt(out, out=out)
    return out if p in (1, math.inf) else out ** (1.0 / p)


def _close(a: np.ndarray, b: np.ndarray, p: float, limit: np.ndarray, k: int | None = None):
    """(row of a, row of b, distance) of all pairs within the limit of the row of ``a``, but
    with ``k`` no more than the k nearest and their ties are needed.

    Wide vectors are compared by a matrix product, and only pairs that may be close, by a bound
    of its rounding, get distances coordinate by coordinate.
    """
    squares = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    if p != 2 or a.shape[1] < WIDE or not all(np.isfinite(s).all() for s in squares):
        d = distances(a, b, p)
        if k is not None and len(b) > k:
            limit = np.minimum(limit, np.partition(d, k - 1, axis=1)[:, k - 1])
        q, c = np.nonzero(d <= limit[:, None])
        return q, c, d[q, c]
    about = a @ b.T
    about *= -2
    about += squares[0][:, None]
    about += squares[1]
    slip = 8 * (a.shape[1] + 4) * np.finfo(float).eps * (squares[0] + squares[1].max(initial=0.0))
    edge = limit * limit * (1 + SLACK) + slip
    near = about <= edge[:, None]
    if k is not None and len(b) > k and np.count_nonzero(near) > 4 * k * len(a):
        edge = np.minimum(edge, np.partition(about, k - 1, axis=1)[:, k - 1] + 2 * slip)
        near = about <= edge[:, None]
    q, c = np.nonzero(near)
    d = np.empty(len(q))
    for at in range(0, len(q), TILE):
        some = slice(at, at + TILE)
        total = np.zeros(len(q[some]))
        for i in range(a.shape[1]):
            gap = np.abs(a[q[some], i] - b[c[some], i])
            total += gap * gap
        d[some] = np.sqrt(total)
    kept = d <= limit[q]
    return q[kept], c[kept], d[kept]


def _pieces(rows: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Rows in pieces of at most ``TILE`` distances to ``width`` others."""
    step = max(1, TILE // max(1, width))
    for start in range(0, len(rows), step):
        yield rows[start : start + step]


def matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()).astype(float) if len(column) else np.zeros((0, 0))


def vector(columns) -> Column:
    """Feature columns as one vector."""
    return F.array(*[F.col(f"`{c}`").cast("double") for c in columns])


def with_unit_vector(df: DataFrame, side: str) -> DataFrame:
    """Scale ``vec`` to length 1; Euclidean then orders like cosine distance.

    A zero vector has similarity 0 to everything; one extra coordinate per side
    puts it at right angles to all others. The length is computed once per row,
    in a projection of its own.
    """
    v = F.col("vec").cast("array<double>")
    measured = df.withColumn("vec", v).withColumn("__length", norm(F.col("vec")))
    zero = F.col("__length") == 0
    extra = [
        F.when(zero, 1.0).otherwise(0.0) if side == s else F.lit(0.0)
        for s in ("query", "train")
    ]
    divisor = F.when(zero, 1.0).otherwise(F.col("__length"))
    scaled = measured.withColumn("__divisor", divisor)
    unit = F.transform("vec", lambda x: x / F.col("__divisor"))
    return scaled.withColumn("vec", F.concat(unit, F.array(*extra))).drop("__length", "__divisor")


@dataclass(frozen=True)
class _Cells:
    """Pivots and what is known of the training rows around them."""

    pivots: np.ndarray
    radius: np.ndarray  # groups x pivots, -1 where a cell is empty
    inner: np.ndarray  # groups x pivots, distance of the closest row to its pivot
    nearest: np.ndarray  # groups x pivots x k, infinity where fewer
    groups: dict

    def group(self, pdf: pd.DataFrame, by) -> np.ndarray:
        keys = zip(*[pdf[c] for c in by], strict=True) if by else [()] * len(pdf)
        return np.array([self.groups.get(key, -1) for key in keys], dtype=int)

    def kth(self, d: np.ndarray, g: int, k: int) -> np.ndarray:
        """At least the distance of the k-th row, from the rows nearest to the pivots around."""
        around = np.argpartition(d, k, axis=1)[:, : k + 1] if d.shape[1] > k + 1 else np.arange(d.shape[1])[None]
        sums = np.take_along_axis(d, around, axis=1)[:, :, None] + self.nearest[g][around]
        return np.partition(sums.reshape(len(d), -1), k - 1, axis=1)[:, k - 1]

    def floor(self, d: np.ndarray, g: int, p: float) -> np.ndarray:
        """Least distance of a query to the rows of each cell, from its distances to the pivots.

        Three bounds: the ball around the pivot, the empty ball inside it, and the border
        between the cell and the query's own, as every row is in the cell of its nearest pivot.
        """
        low = np.maximum(d - self.radius[g], self.inner[g] - d)
        own = d.argmin(axis=1)
        least = d[np.arange(len(d)), own][:, None]
        border = (d - least) / 2
        if p == 2:
            homes, at = np.unique(own, return_inverse=True)
            apart = distances(self.pivots[homes], self.pivots, p)[at.ravel()]
            wide = apart > d * 1e-3  # pivots close together lose the digits of the difference
            steep = (d - least) * (d + least) / np.where(wide, 2 * apart, 1.0)
            border = np.where(wide, np.maximum(border, steep), border)
        low = np.maximum(low, border) - SLACK * d
        return np.where(self.radius[g] >= 0, low, np.inf)


def _heads(pivots: np.ndarray, p: float) -> list:
    """The upper level: every ``sqrt(pivots)``-th pivot of a fixed shuffle, the pivots
    nearest to it, and the radius around them."""
    chosen = np.random.default_rng(0).permutation(len(pivots))[: math.ceil(math.sqrt(len(pivots)))]
    d = distances(pivots, pivots[chosen], p)
    own = d.argmin(axis=1)
    members = [np.flatnonzero(own == j) for j in range(len(chosen))]
    return [(pivots[c], m, d[m, j].max()) for j, (c, m) in enumerate(zip(chosen, members)) if len(m)]


def _closest(x: np.ndarray, pivots: np.ndarray, heads: list, p: float):
    """Nearest pivot of every row and the distance to it. A head is opened for the rows
    that may have their nearest pivot below it, the nearest heads first."""
    far = distances(x, np.stack([h[0] for h in heads]), p)
    cell = np.full(len(x), -1)
    gap = np.full(len(x), np.inf)
    first = far.argmin(axis=1)
    for opened in (True, False):
        for j, (_, members, radius) in enumerate(heads):
            open_for = first == j if opened else (first != j) & (
                far[:, j] * (1 - SLACK) - radius <= gap * (1 + SLACK)
            )
            at = np.flatnonzero(open_for)
            for part in _pieces(at, len(members)):
                d = distances(x[part], pivots[members], p)
                best = d.argmin(axis=1)
                least = d[np.arange(len(part)), best]
                nearer = least < gap[part]
                gap[part[nearer]] = least[nearer]
                cell[part[nearer]] = members[best[nearer]]
    return cell, gap


def _assign(df: DataFrame, pivots: np.ndarray, p: float, columns) -> DataFrame:
    """Add the nearest pivot and the distance to it."""
    schema = T.StructType(
        [df.schema[c] for c in columns]
        + [T.StructField("cell", T.IntegerType()), T.StructField("gap", T.DoubleType())]
    )
    heads = _heads(pivots, p)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                cell, gap = _closest(matrix(pdf["vec"]), pivots, heads, p)
                yield pdf.assign(cell=cell.astype("int32"), gap=gap)

    return df.select(*columns).mapInPandas(assign, schema)


def _describe(assigned: DataFrame, by, pivots: np.ndarray, k: int) -> tuple[_Cells, dict]:
    """Radius, size and the k smallest pivot distances of every cell.

    One row per group and cell, each with at most k numbers. The group limit
    runs before the shuffle, so a hot cell sends k rows per task.
    """
    closest = Window.partitionBy(*by, "cell").orderBy("gap", "s_id")
    sizes = assigned.groupBy(*by, "cell").agg(
        F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius")
    )
    near = (
        assigned.withColumn("r", F.row_number().over(closest))
        .filter(F.col("r") <= k)
        .groupBy(*by, "cell")
        .agg(F.array_sort(F.collect_list("gap")).alias("near"))
    )
    rows = sizes.join(near, [*by, "cell"]).collect()
    groups: dict = {}
    for r in rows:
        groups.setdefault(tuple(r[c] for c in by), len(groups))
    radius = np.full((len(groups), len(pivots)), -1.0)
    nearest = np.full((len(groups), len(pivots), k), np.inf)
    counts = {}
    for r in rows:
        g = groups[tuple(r[c] for c in by)]
        radius[g, r.cell] = r.radius
        nearest[g, r.cell, : len(r.near)] = r.near
        counts[(*[r[c] for c in by], r.cell)] = r.n
    return _Cells(pivots, radius, nearest[:, :, 0].copy(), nearest, groups), counts


@dataclass(frozen=True)
class _Blocks:
    """Which blocks hold a cell: ``parts`` of them from ``first`` on."""

    first: np.ndarray  # groups x pivots
    parts: np.ndarray

    def visited(self, g: int, r: np.ndarray, c: np.ndarray, draws: np.ndarray, home: bool):
        """Rows and the blocks they visit for their cells; at ``home`` one part of a cut cell."""
        parts = self.parts[g][c]
        if home:
            return r, self.first[g][c] + draws[r] % parts
        ends = np.cumsum(parts)
        step = np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - parts, parts)
        pairs = np.stack([np.repeat(r, parts), np.repeat(self.first[g][c], parts) + step])
        return np.unique(pairs, axis=1)


def _deal(cells: _Cells, counts: dict, p: float) -> _Blocks:
    """Cells below one head share blocks of bounded size; a larger cell is cut into several."""
    sizes = np.zeros(cells.radius.shape, dtype=int)
    for (*group, cell), n in counts.items():
        sizes[cells.groups[tuple(group)], cell] = n
    order = np.concatenate([members for _, members, _ in _heads(cells.pivots, p)])
    first = np.zeros(sizes.shape, dtype=int)
    parts = np.maximum(1, -(-sizes // TRAIN_BLOCK))
    block = 0
    for g in range(len(sizes)):
        filled = 0
        for c in order:
            if filled + sizes[g, c] > TRAIN_BLOCK and filled:
                block, filled = block + 1, 0
            first[g, c] = block
            filled += sizes[g, c]
            if parts[g, c] > 1:
                block, filled = block + parts[g, c], 0
        block += 1
    return _Blocks(first, parts)


def _visits(
    queries: DataFrame,
    cells: _Cells,
    by,
    k: int,
    p: float,
    reach: float | None,
    blocks: _Blocks | None = None,
    home: bool = False,
) -> DataFrame:
    """Each query once per place that can hold one of its neighbours.

    A place is a cell, or with ``blocks`` a block of cells. The k-th smallest of
    (distance to pivot + distance of a training row to the pivot), over the pivots around,
    bounds the distance of the k-th neighbour; so does the column ``bound``, and ``reach`` when given. A
    cell whose rows all lie beyond that bound is skipped, and so is the place named in
    the column ``seen``. With ``home`` a query goes to its nearest cell alone.
    """
    by = list(by)
    given = [c for c in ("bound", "seen") if c in queries.columns]
    schema = T.StructType(
        [queries.schema[c] for c in (*by, "q_id", "vec")]
        + [T.StructField("cell", T.IntegerType()), T.StructField("bound", T.DoubleType())]
    )
    draw = F.pmod(F.xxhash64("q_id"), F.lit(1 << 31)).alias("__draw")

    def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, group = matrix(pdf["vec"]), cells.group(pdf, by)
            draws = pdf["__draw"].to_numpy()
            for g in np.unique(group[group >= 0]):
                at = np.flatnonzero(group == g)
                for part in _pieces(at, len(cells.pivots)):
                    d = distances(x[part], cells.pivots, p)
                    if reach is None:
                        bound = cells.kth(d, g, k)
                    else:
                        bound = np.full(len(part), reach)
                    if "bound" in given:
                        bound = np.minimum(bound, pdf["bound"].to_numpy()[part])
                    limit = bound * (1 + SLACK) + SLACK
                    if home:
                        full = np.where(cells.radius[g] >= 0, d, np.inf)
                        r, c = np.arange(len(part)), full.argmin(axis=1)
                    else:
                        r, c = np.nonzero(cells.floor(d, g, p) <= limit[:, None])
                    r, place = (r, c) if blocks is None else blocks.visited(g, r, c, draws[part], home)
                    if "seen" in given:
                        new = pdf["seen"].to_numpy()[part][r] != place
                        r, place = r[new], place[new]
                    out = pdf.iloc[part[r]].drop(columns=["__draw", "bound", "seen"], errors="ignore")
                    yield out.assign(cell=place.astype("int32"), bound=limit[r])

    return queries.select(*by, "q_id", "vec", *given, draw).mapInPandas(visit, schema)


class _Best:
    """The k best training rows of every query so far. Rows are numbered in id order,
    which settles ties."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.distance = np.full((queries, k), np.inf)
        self.row = np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at: np.ndarray, rows: np.ndarray, pairs) -> None:
        """``pairs`` of the queries ``at`` and ``rows`` with their distances; none that could
        be among the best is missing."""
        k = self.k
        q, c, d = pairs
        if not len(q):
            return
        changed = np.unique(q)
        owner = np.concatenate([np.repeat(changed, k), q])
        distance = np.concatenate([self.distance[at[changed]].ravel(), d])
        row = np.concatenate([self.row[at[changed]].ravel(), rows[c]])
        order = np.lexsort((row, distance, owner))
        place = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        order = order[place < k]
        self.distance[at[changed]] = distance[order].reshape(-1, k)
        self.row[at[changed]] = row[order].reshape(-1, k)


def _top_k(query, limit, train, cell, cells: _Cells, g: int, k: int, p: float) -> _Best:
    """Best k rows of one block. Every query looks into its nearest cell of the block
    first; the distances found there close most of the others."""
    best = _Best(len(query), k)
    present = np.unique(cell)
    rows = [np.flatnonzero(cell == c) for c in present]
    pivots = cells.pivots[present]
    for part in _pieces(np.arange(len(query)), len(present)):
        d = distances(query[part], pivots, p)
        low = np.maximum(d - cells.radius[g, present], cells.inner[g, present] - d) - SLACK * d
        first = d.argmin(axis=1)
        for nearest in (True, False):
            for j, members in enumerate(rows):
                closed = np.minimum(limit[part], best.distance[part, k - 1] * (1 + SLACK) + SLACK)
                at = part[((first == j) == nearest) & (low[:, j] <= closed)]
                for some in _pieces(at, len(members)):
                    pairs = _close(query[some], train[members], p, best.distance[some, k - 1], k)
                    best.add(some, members, pairs)
    return best


def _within(query, train, p: float, reach: float):
    """(query row, train row, distance) of all pairs within reach."""
    for part in _pieces(np.arange(len(query)), len(train)):
        q, s, d = _close(query[part], train, p, np.full(len(part), reach))
        yield part[q], s, d


def check_sides(queries: DataFrame, train: DataFrame, by) -> None:
    """An error for vectors with NULL or NaN, and for queries of a group without training rows."""
    by = list(by)
    vec = F.col("vec")
    bad = vec.isNull() | F.exists(vec, lambda x: x.isNull() | F.isnan(x))

    def groups(side: DataFrame) -> DataFrame:
        sums = side.groupBy(group_key(by).alias("__group"))
        return sums.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"))

    asked, given = groups(queries), groups(train)
    both = asked.alias("q").join(given.alias("s"), "__group", "full").agg(
        F.sum("q.bad"), F.sum("s.bad"), F.count_if(F.col("s.rows").isNull())
    )
    bad_queries, bad_train, alone = (n or 0 for n in both.first())
    if bad_queries or bad_train:
        raise ValueError(f"vectors without a value in every place: {bad_queries} queries, {bad_train} training rows")
    if alone:
        raise ValueError(f"{alone} groups of queries have no training rows")


def _pivots(train: DataFrame, by, wanted: int) -> np.ndarray:
    """The rows with the smallest digests, at most ``wanted`` different vectors."""
    # Few rows have digests below this share, so tasks pass on little to the top-n.
    total = train.count()
    share = 16 * wanted / total
    few = train.filter(uniform("pivot", *by, "s_id") <= share) if share < 1 else train
    chosen = few.orderBy(hash_key("pivot", *by, "s_id"), "s_id").limit(wanted).collect()
    chosen = chosen or train.limit(1).collect()
    return np.unique(np.array([r.vec for r in chosen], dtype=float), axis=0)


def _meet(
    visits: DataFrame, assigned: DataFrame, places, groups: dict, by, schema, search, values=("vec",), most=None
):
    """``search(group, queries, rows)`` for every block and the queries that visit it.

    ``places`` has a row ``(by, cell, first block, parts)`` per cell, and ``values`` are the
    columns of the vectors. Visits are counted, and a block with more than ``most`` is met by
    several tasks, each with a part of its queries. Blocks nobody visits are not shuffled.
    """
    by, values, most = list(by), list(values), most or QUERY_BLOCK
    spark = visits.sparkSession
    visits = visits.withColumnRenamed("cell", "block")
    held = spark.createDataFrame(
        places,
        T.StructType(
            [assigned.schema[c] for c in by]
            + [T.StructField(n, T.IntegerType()) for n in ("cell", "first", "parts")]
        ),
    )
    asked = spark.createDataFrame(
        [
            (r.block, math.ceil(r["count"] / most))
            for r in visits.groupBy("block").count().collect()
        ],
        "block int, q_blocks int",
    )
    left = visits.join(F.broadcast(asked), "block").withColumn(
        "q_block", F.pmod(F.xxhash64("q_id"), F.col("q_blocks")).cast("int")
    )
    part = F.pmod(F.xxhash64("s_id"), F.col("parts")).cast("int")
    right = (
        assigned.join(F.broadcast(held), [*by, "cell"])
        .withColumn("block", F.col("first") + part)
        .join(F.broadcast(asked), "block")
        .withColumn("q_block", F.explode(F.sequence(F.lit(0), F.col("q_blocks") - 1)))
    )
    keys = [*by, "block", "q_block"]
    names = [f.name for f in schema.fields]

    def both(key, q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(s):
            return pd.DataFrame({n: [] for n in names}, dtype=object)
        s = s.sort_values("s_id", kind="stable", ignore_index=True)
        out = search(groups[tuple(key[: len(by)])], q, s)
        for c, value in zip([*by, "seen"], key, strict=False):
            out[c] = value
        return out[names]

    return (
        left.select(*keys, "q_id", *values, "bound")
        .groupBy(*keys)
        .cogroup(right.select(*keys, "s_id", *values, "cell").groupBy(*keys))
        .applyInPandas(both, schema)
    )


def _blocked_join(
    queries: DataFrame,
    train: DataFrame,
    k: int,
    p: float,
    by=(),
    reach: float | None = None,
    pivots: int | None = None,
) -> DataFrame:
    """Best k rows per query and block, or all rows within ``reach``.

    A query first visits the block of its nearest cell. The distance of the k-th row found
    there bounds the second round, which leads to the other blocks within that bound only.
    """
    by = list(by)
    train = materialize(train.select(*by, "s_id", "vec"), "train")
    largest = train.groupBy(*by).count().agg(F.max("count")).first()[0]
    if pivots is None:
        width = len(train.select("vec").first().vec)
        if reach is None and 0 < width < WIDE:
            return _boxed_join(queries, train, k, p, by, width)
        pivots = max(1, min(math.isqrt(largest), BROADCAST_BYTES // (8 * max(1, width))))
    points = _pivots(train, by, pivots)
    assigned = materialize(_assign(train, points, p, [*by, "s_id", "vec"]), "cells")
    cells, counts = _describe(assigned, by, points, k)
    blocks = _deal(cells, counts, p)
    groups = [train.schema[c] for c in by]
    q_id, s_id = queries.schema["q_id"], train.schema["s_id"]
    pairs = T.StructType([*groups, q_id, s_id, T.StructField("distance", T.DoubleType())])

    def listed(q, s, parts) -> pd.DataFrame:
        qi, si, d = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pd.DataFrame(
            {"q_id": q["q_id"].to_numpy()[qi], "s_id": s["s_id"].to_numpy()[si], "distance": d}
        )

    def near(g, q, s) -> _Best:
        return _top_k(
            matrix(q["vec"]), q["bound"].to_numpy(), matrix(s["vec"]), s["cell"].to_numpy(), cells, g, k, p
        )

    def search(g, q, s) -> pd.DataFrame:
        if reach is not None:
            return listed(q, s, list(_within(matrix(q["vec"]), matrix(s["vec"]), p, reach)))
        best = near(g, q, s)
        qi, at = np.nonzero(best.distance < np.inf)
        return listed(q, s, [(qi, best.row[qi, at], best.distance[qi, at])])

    places = [
        (*key, int(c), int(blocks.first[g, c]), int(blocks.parts[g, c]))
        for key, g in cells.groups.items()
        for c in np.flatnonzero(cells.radius[g] >= 0)
    ]

    def meet(visits, schema, fn):
        return _meet(visits, assigned, places, cells.groups, by, schema, fn)

    if reach is not None:
        visits = materialize(_visits(queries, cells, by, k, p, reach, blocks), "visits")
        return meet(visits, pairs, search)

    def search_home(g, q, s) -> pd.DataFrame:
        best = near(g, q, s)
        ids = s["s_id"].to_numpy()
        found = [np.flatnonzero(d < np.inf) for d in best.distance]
        return pd.DataFrame(
            {
                "q_id": q["q_id"],
                "vec": q["vec"],
                "bound": best.distance[:, k - 1],
                "near_ids": [ids[r[f]] for r, f in zip(best.row, found, strict=True)],
                "near": [d[f] for d, f in zip(best.distance, found, strict=True)],
            }
        )

    first_round = T.StructType(
        [
            *groups,
            q_id,
            queries.schema["vec"],
            T.StructField("bound", T.DoubleType()),
            T.StructField("seen", T.IntegerType()),
            T.StructField("near_ids", T.ArrayType(s_id.dataType)),
            T.StructField("near", T.ArrayType(T.DoubleType())),
        ]
    )
    homes = materialize(_visits(queries, cells, by, k, p, None, blocks, home=True), "visits")
    met = materialize(meet(homes, first_round, search_home), "first-round")
    visits = materialize(_visits(met, cells, by, k, p, None, blocks), "visits")
    in_home = met.select(
        *by, "q_id", F.inline(F.arrays_zip(F.col("near_ids").alias("s_id"), F.col("near").alias("distance")))
    ).toDF(*[f.name for f in pairs.fields])
    return in_home.unionByName(meet(visits, pairs, search))


def _group_numbers(pdf: pd.DataFrame, by, groups: dict) -> np.ndarray:
    """Number of each row's group, -1 where it is not known."""
    if not by:
        return np.zeros(len(pdf), dtype=int)
    code = pdf.groupby(by, sort=False, dropna=False).ngroup().to_numpy()
    firsts = np.unique(code, return_index=True)[1]
    return np.array([groups.get(tuple(pdf[c].iat[i] for c in by), -1) for i in firsts])[code]


def _box_trees(train: DataFrame, names, by, sizes: dict) -> dict:
    """The cuts of each group, by a sample of its rows that grows with its boxes."""
    wanted = {key: math.ceil(n / TRAIN_BLOCK) for key, n in sizes.items()}
    samples: dict = {key: [] for key in sizes}
    if max(wanted.values(), default=1) > 1:
        most = 1 << 30
        rows = [(*key, min(most, math.ceil(most * BOX_SAMPLE * wanted[key] / n))) for key, n in sizes.items()]
        schema = T.StructType([*[train.schema[c] for c in by], T.StructField("__share", T.LongType())])
        shares = F.broadcast(train.sparkSession.createDataFrame(rows, schema))
        drawn = train.join(shares, by) if by else train.crossJoin(shares)
        drawn = drawn.filter(F.pmod(F.xxhash64("s_id", *names), F.lit(most)) < F.col("__share"))
        for *key, x in drawn.select(*by, F.array(*names)).collect():
            samples[tuple(key)].append(x)
    return {
        key: Tree.cut(np.array(sorted(samples[key]), dtype=float).reshape(-1, len(names)), wanted[key])
        for key in sizes
    }


def _boxed_join(queries: DataFrame, train: DataFrame, k: int, p: float, by, width: int) -> DataFrame:
    """Best k rows per query and block, for narrow vectors.

    Boxes take the place of cells: each is a block, cut into several where the sample behind the
    cuts made it too large. The first round leads a query to its own box, the second to the other
    boxes within the distance of the k-th row found there.
    """
    by, names = list(by), [f"__x{i}" for i in range(width)]

    def placed(side: DataFrame, id_: str) -> DataFrame:
        other = F.raise_error(F.lit("vectors of different widths")).cast("double")
        first = F.when(F.size("vec") == width, F.get("vec", F.lit(0))).otherwise(other)
        rest = [F.get("vec", F.lit(i)).alias(names[i]) for i in range(1, width)]
        return side.select(*by, id_, first.alias(names[0]), *rest)

    train, queries = placed(train, "s_id"), placed(queries, "q_id")
    sizes = {tuple(r[c] for c in by): r["count"] for r in train.groupBy(*by).count().collect()}
    groups = {key: g for g, key in enumerate(sizes)}
    trees = list(_box_trees(train, names, by, sizes).values())
    single = all(tree.left[0] < 0 for tree in trees)

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, group = pdf[names].to_numpy(float), _group_numbers(pdf, by, groups)
            cell = np.zeros(len(pdf), dtype="int32")
            for g in np.unique(group[group >= 0]):
                at = np.flatnonzero(group == g)
                cell[at] = trees[g].place(x[at])
            yield pdf.assign(cell=cell)

    if single:
        assigned = train.withColumn("cell", F.lit(0))
    else:
        schema = T.StructType([*train.schema.fields, T.StructField("cell", T.IntegerType())])
        assigned = materialize(train.mapInPandas(assign, schema), "cells")
    ends = [end(c).alias(f"{label}{i}") for i, c in enumerate(names) for label, end in (("low", F.min), ("high", F.max))]
    found: list[dict] = [{} for _ in trees]
    for r in assigned.groupBy(*by, "cell").agg(F.count(F.lit(1)).alias("n"), *ends).collect():
        found[groups[tuple(r[c] for c in by)]][r.cell] = r
    most = max(int(tree.number.max()) + 1 for tree in trees)
    first, parts = np.zeros((len(trees), most), dtype=int), np.ones((len(trees), most), dtype=int)
    places, block = [], 0
    for key, g in groups.items():
        low, high = np.full((most, width), np.inf), np.full((most, width), -np.inf)
        for c, r in sorted(found[g].items()):
            low[c], high[c] = [r[f"low{i}"] for i in range(width)], [r[f"high{i}"] for i in range(width)]
            first[g, c], parts[g, c] = block, math.ceil(r.n / (2 * TRAIN_BLOCK))
            places.append((*key, c, block, int(parts[g, c])))
            block += int(parts[g, c])
        trees[g] = trees[g].bounded(low, high)
    blocks = _Blocks(first, parts)

    def visits(asked: DataFrame, home: bool) -> DataFrame:
        given = [] if home else ["bound", "seen"]
        schema = T.StructType(
            [asked.schema[c] for c in (*by, "q_id", *names)]
            + [T.StructField("cell", T.IntegerType()), T.StructField("bound", T.DoubleType())]
        )

        def visit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                x, group = pdf[names].to_numpy(float), _group_numbers(pdf, by, groups)
                draws = pdf["__draw"].to_numpy()
                for g in np.unique(group[group >= 0]):
                    at = np.flatnonzero(group == g)
                    if home:
                        limit, r, c = np.full(len(at), np.inf), np.arange(len(at)), trees[g].place(x[at])
                    else:
                        limit = pdf["bound"].to_numpy()[at] * (1 + SLACK) + SLACK
                        r, c, _ = trees[g].reached(x[at], limit, p)
                    r, place = blocks.visited(g, r, c, draws[at], home)
                    if not home:
                        new = pdf["seen"].to_numpy()[at][r] != place
                        r, place = r[new], place[new]
                    out = pdf.iloc[at[r]].drop(columns=["__draw", "bound", "seen"], errors="ignore")
                    yield out.assign(cell=place.astype("int32"), bound=limit[r])

        draw = F.pmod(F.xxhash64("q_id"), F.lit(1 << 31)).alias("__draw")
        return asked.select(*by, "q_id", *names, *given, draw).mapInPandas(visit, schema)

    def search(q: pd.DataFrame, s: pd.DataFrame):
        rows = s[names].to_numpy(float)
        tree = Tree.build(rows, max(LEAF, 4 * k))
        return tree.search(q[names].to_numpy(float), q["bound"].to_numpy(), rows, k, p)

    q_id, s_id = queries.schema["q_id"], train.schema["s_id"]
    keys = [train.schema[c] for c in by]
    distance = T.StructField("distance", T.DoubleType())

    def search_home(_, q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        qi, si, d = search(q, s)
        turn = np.arange(len(qi)) - np.searchsorted(qi, qi)
        near, rows = np.full((len(q), k), np.inf), np.zeros((len(q), k), dtype=int)
        near[qi, turn], rows[qi, turn] = d, si
        ids = s["s_id"].to_numpy()
        out = {"q_id": q["q_id"], **{c: q[c] for c in names}, "bound": near[:, k - 1]}
        for i in range(k):
            out[f"near{i}"], out[f"id{i}"] = near[:, i], ids[rows[:, i]]
        return pd.DataFrame(out)

    def search_away(_, q: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        qi, si, d = search(q, s)
        return pd.DataFrame({"q_id": q["q_id"].to_numpy()[qi], "s_id": s["s_id"].to_numpy()[si], "distance": d})

    fields = [*keys, q_id, *[queries.schema[c] for c in names]]
    fields += [T.StructField("bound", T.DoubleType()), T.StructField("seen", T.IntegerType())]
    for i in range(k):
        fields += [T.StructField(f"near{i}", T.DoubleType()), T.StructField(f"id{i}", s_id.dataType)]

    def meet(asked: DataFrame, schema: T.StructType, fn) -> DataFrame:
        return _meet(asked, assigned, places, groups, by, schema, fn, names, TRAIN_BLOCK)

    homes = materialize(visits(queries, True), "visits")
    met = materialize(meet(homes, T.StructType(fields), search_home), "first-round")
    pairs = F.array(*[F.struct(F.col(f"id{i}").alias("s_id"), F.col(f"near{i}").alias("distance")) for i in range(k)])
    in_home = met.select(*by, "q_id", F.inline(pairs)).filter(F.col("distance") < math.inf)
    if block == len(trees):  # one box a group
        return in_home
    away = materialize(visits(met, False), "visits")
    return in_home.unionByName(meet(away, T.StructType([*keys, q_id, s_id, distance]), search_away))


def _lowest_of_equal(train: DataFrame, by, k: int) -> DataFrame:
    """Of equal vectors the k rows with the lowest ids: ties go to the lower id, so no other
    is among the k nearest of any query. The digest settles nearly all comparisons of vectors."""
    keyed = train.select(*by, "s_id", "vec", F.xxhash64("vec").alias("__digest"))
    same = Window.partitionBy(*by, "__digest", "vec").orderBy("s_id")
    first = keyed.withColumn("__r", F.row_number().over(same)).filter(F.col("__r") <= k)
    return first.drop("__r", "__digest")


def knn_join(
    queries: DataFrame,
    train: DataFrame,
    k: int = 5,
    metric: str = "minkowski",
    p: float = 2,
    by=(),
    pivots: int | None = None,
) -> DataFrame:
    """The k nearest training rows of every query with distance and rank.

    ``queries`` holds ``(by, q_id, vec)`` and ``train`` ``(by, s_id, vec)``;
    ``by`` are group columns such as the fold, which have few values. Ties go
    to the lower ``s_id``. Metrics: ``minkowski`` (with ``p`` >= 1, also
    infinity) and ``cosine``. Fewer than k training rows are an error.

    Many rows may have one vector, such as the mean put in for missing values. Equal queries
    are searched once, and of equal training rows those with the lowest ids take part.
    """
    by = list(by)
    if metric == "cosine":
        queries = with_unit_vector(queries, "query")
        train = with_unit_vector(train, "train")
        p = 2
    elif metric == "minkowski":
        if p < 1:
            raise ValueError("minkowski distance needs p >= 1")
        queries = queries.withColumn("vec", F.col("vec").cast("array<double>"))
        train = train.withColumn("vec", F.col("vec").cast("array<double>"))
    else:
        raise ValueError(f"unsupported metric {metric!r}")
    train = train.select(*by, "s_id", "vec")
    check_sides(queries, train, by)
    few = train.groupBy(*by).count().agg(F.min("count")).first()[0] or 0
    if few < k:
        raise ValueError(f"{k} neighbours asked for, {few} training rows given")
    same = [*by, "__digest", "vec"]
    queries = queries.select(*by, "q_id", "vec", F.xxhash64("vec").alias("__digest"))
    asked = queries.select(same).distinct().withColumn("__asked", F.monotonically_increasing_id())
    asked = materialize(asked, "asked")
    once = asked.select(*by, F.col("__asked").alias("q_id"), "vec")
    nearest = _blocked_join(once, _lowest_of_equal(train, by, k), k, p, by, None, pivots)
    first = Window.partitionBy("__asked").orderBy("distance", "s_id")
    nearest = (
        nearest.select(F.col("q_id").alias("__asked"), "s_id", "distance")
        .withColumn("rank", F.row_number().over(first))
        .filter(F.col("rank") <= k)
        .drop("rank")
    )
    found = queries.join(asked, same).select(*by, "q_id", "__asked").join(nearest, "__asked")
    best = Window.partitionBy(*by, "q_id").orderBy("distance", "s_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    if metric == "cosine":
        ranked = ranked.withColumn("distance", F.col("distance") * F.col("distance") / 2)
    return ranked.select(*by, "q_id", "s_id", "distance", "rank")


def cosine_similarity(
    queries: DataFrame, train: DataFrame, min_similarity: float, by=()
) -> DataFrame:
    """All (query, training row) pairs of at least the given cosine similarity.

    The threshold bounds the result: cells beyond its radius are not visited.
    A vector of length zero has no similarity and no pairs.
    """
    queries = with_unit_vector(queries.filter(norm(F.col("vec").cast("array<double>")) > 0), "query")
    train = with_unit_vector(train.filter(norm(F.col("vec").cast("array<double>")) > 0), "train")
    reach = math.sqrt(max(0.0, 2.0 - 2.0 * min_similarity)) * (1 + SLACK) + SLACK
    check_sides(queries, train, by)
    if not train.limit(1).count():
        raise ValueError("1 neighbours asked for, 0 training rows given")
    found = _blocked_join(queries, train, 1, 2, by, reach)
    similarity = 1 - F.col("distance") * F.col("distance") / 2
    return found.select(*by, "q_id", "s_id", similarity.alias("similarity")).filter(
        F.col("similarity") >= min_similarity
    )


AGGREGATIONS = ("median", "mean", "weighted_average", "max", "min", "random", "first")


def neighbour_aggregate(
    neighbours: DataFrame,
    train: DataFrame,
    columns,
    aggregation: str = "median",
    by=(),
    seed=42,
    majority=(),
) -> DataFrame:
    """Collapse the k neighbours of every query into one row per query.

    ``train`` holds ``(by, s_id, columns)``. A group is k rows. Columns in
    ``majority`` take the most frequent neighbour value instead.
    """
    if aggregation not in AGGREGATIONS:
        raise ValueError(f"unsupported aggregation {aggregation!r}")
    by = list(by)
    joined = neighbours.join(train.select(*by, "s_id", *columns), [*by, "s_id"])
    if aggregation == "median":
        # One list a query: medians and modes as aggregates would each keep a map of values.
        rows = F.collect_list(F.struct(*[F.col(f"`{c}`") for c in columns])).alias("__rows")
        lists = joined.groupBy(*by, "q_id").agg(rows).select(
            *by, "q_id", *[F.sort_array(F.array_compact(F.col("__rows")[c])).alias(f"__{c}") for c in columns]
        )
        return lists.select(*by, "q_id", *[(_mode if c in majority else _median)(F.col(f"`__{c}`")).alias(c) for c in columns])
    weight = 1 / (F.col("distance") + F.lit(1e-6))
    draw = hash_key(seed, "q_id", "s_id")

    def collapse(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c in majority:
            return F.mode(x, True)
        return {
            "mean": lambda: F.avg(x),
            "weighted_average": lambda: F.sum(weight * x) / F.sum(weight),
            "max": lambda: F.max(x),
            "min": lambda: F.min(x),
            "random": lambda: F.min_by(x, draw),
            "first": lambda: F.min_by(x, F.col("rank")),
        }[aggregation]()

    return joined.groupBy(*by, "q_id").agg(*[collapse(c).alias(c) for c in columns])


def _median(ordered: Column) -> Column:
    """Middle of an ascending array, half of each of two middles; NULL if it is empty."""
    n = F.size(ordered)
    low = F.get(ordered, F.floor((n - 1) / 2).cast("int")).cast("double")
    high = F.get(ordered, F.floor(n / 2).cast("int")).cast("double")
    return F.when(n % 2 == 1, low).otherwise(0.5 * low + 0.5 * high)


def _mode(ordered: Column) -> Column:
    """Most frequent value of an ascending array, the smallest on a tie."""
    values = F.array_distinct(ordered)
    counts = F.transform(values, lambda v: F.size(F.filter(ordered, lambda x: x == v)))
    return F.get(values, (F.array_position(counts, F.array_max(counts)) - 1).cast("int"))
