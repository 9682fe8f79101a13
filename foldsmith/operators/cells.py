"""Trees of large tables from counted cells.

A tree of Spark ML sees of a row its bins, at most ``maxBins`` a feature, and its label. Rows of
one cell (the same bins) and label are the same to it, so a table of any size is one count of
cells, and a tree grows from that. In a forest each row enters a tree as often as a Poisson draw
of mean 1 says; the draws of the ``n`` rows of a cell add up to one draw of mean ``n``.

:func:`grow` splits as Spark ML does: the gain in Gini impurity, the first of equal splits, nodes
pure or without gain are leaves, and pairs of leaves with one prediction are merged. Features of
up to ``FEW`` values are cut where Spark ML cuts them, others at quantiles of all rows (Spark ML
takes those of some 10,000).

Tables of up to ``CELL_ROWS`` rows are left to Spark ML, as are those with more than ``MAX_CELLS``
cells, which a few features have and many features pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.classification import DecisionTreeClassifier, RandomForestClassifier
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.arrays import with_upper_bound
from foldsmith.spec import TableSpec

CELL_ROWS = 200_000
MAX_CELLS = 65_536

# Different values of a feature up to which they are counted one by one.
FEW = 2_000

ACCURACY = 10_000
EPSILON = 2.0**-52

# What of an estimator is followed here; other settings have to be the defaults.
FOLLOWED = {"maxDepth", "maxBins", "minInfoGain", "seed", "numTrees", "cacheNodeIds"}


def follows(estimator, names=()) -> bool:
    """Whether :func:`grow` does what the estimator does, and the named settings with it."""
    if type(estimator) not in (DecisionTreeClassifier, RandomForestClassifier):
        return False
    plain = type(estimator)()
    changed = {p.name for p in plain.params if estimator.isSet(p.name) and estimator.getOrDefault(p.name) != plain.getOrDefault(p.name)}
    return changed | set(names) <= FOLLOWED


def value_splits(values: np.ndarray, counts: np.ndarray, max_bins: int) -> np.ndarray:
    """Thresholds of a feature from its counted values in order: between any two, or if they are
    too many, where the count passes a multiple of the rows by ``max_bins``."""
    middles = (values[:-1] + values[1:]) / 2
    if len(values) <= max_bins:
        return middles
    stride, found = counts.sum() / max_bins, []
    target, current = stride, float(counts[0])
    for index in range(1, len(values)):
        before, current = current, current + float(counts[index])
        if abs(before - target) < abs(current - target):
            found.append(middles[index - 1])
            target += stride
    return np.array(found)


class Bins:
    """Thresholds of every feature for several sets of rows (``parts``) and numbers of bins."""

    def __init__(self, spec: TableSpec, thresholds: list[dict]):
        self.spec = spec
        self.thresholds = thresholds  # per feature: (part, max_bins) -> ascending numbers
        self.fine = [np.unique(np.concatenate([*t.values(), np.zeros(0)])) for t in thresholds]

    @property
    def cells(self) -> int:
        out = 1
        for t in self.fine:
            out *= len(t) + 1
        return out

    @classmethod
    def fit(cls, df: DataFrame, spec: TableSpec, parts: list[Column], sizes: list[int]) -> Bins | None:
        """Thresholds of the rows of each part, by one pass, and one more over features of few
        values. None where a feature has missing values, which Spark ML refuses or bins itself."""
        columns = [F.col(f"`{c}`").cast("double") for c in spec.features]
        first = df.agg(
            *[F.approx_count_distinct(x).alias(f"n{i}") for i, x in enumerate(columns)],
            *[F.count_if(x.isNull() | F.isnan(x)).alias(f"bad{i}") for i, x in enumerate(columns)],
        ).first()
        if any(first[f"bad{i}"] for i in range(len(columns))):
            return None
        found: list[dict] = [{} for _ in columns]
        many = [i for i in range(len(columns)) if first[f"n{i}"] > FEW]
        for i in set(range(len(columns))) - set(many):
            sums = [F.count_if(part).alias(f"p{j}") for j, part in enumerate(parts)]
            rows = sorted(df.groupBy(columns[i].alias("x")).agg(*sums).collect())
            for j in range(len(parts)):
                known = np.array([(r.x, r[f"p{j}"]) for r in rows if r[f"p{j}"]]).reshape(-1, 2)
                for size in sizes:
                    found[i][j, size] = value_splits(known[:, 0], known[:, 1], size)
        shares = [[n / size for n in range(1, size)] for size in sizes]
        asked = [
            F.percentile_approx(F.when(part, columns[i]), F.array(*[F.lit(s) for s in sum(shares, [])]), ACCURACY)
            for i in many
            for part in parts
        ]
        if asked:
            row = list(df.agg(*asked).first())
            for i in many:
                for j in range(len(parts)):
                    values, at = row.pop(0) or [], 0
                    for size in sizes:
                        found[i][j, size] = np.unique(np.array(values[at : at + size - 1], dtype=float))
                        at += size - 1
        return cls(spec, found)

    def placed(self, df: DataFrame) -> DataFrame:
        """Add each feature's bin, ``__b0`` and so on: how many of the fine thresholds lie below."""
        searches = {}
        for i, (c, fine) in enumerate(zip(self.spec.features, self.fine, strict=True)):
            # The search counts elements up to a value; seen from above, those are the others.
            above = F.array(*[F.lit(float(-t)) for t in fine[::-1]]).cast("array<double>")
            searches[f"__a{i}"] = (above, -F.col(f"`{c}`").cast("double"))
        most = max(len(fine) for fine in self.fine)
        out = with_upper_bound(df, searches, most)
        return out.withColumns({f"__b{i}": F.lit(len(f)) - F.col(f"__a{i}") for i, f in enumerate(self.fine)})

    def counted(self, df: DataFrame, parts: Column, n_parts: int) -> np.ndarray | None:
        """Rows by part, bins and label. None where a label is no class number."""
        bins = [f"__b{i}" for i in range(len(self.fine))]
        label = F.col(f"`{self.spec.target}`").cast("double")
        placed = self.placed(df).select(parts.alias("__part"), *bins, label.alias("__y"))
        rows = placed.groupBy("__part", *bins, "__y").count().collect()  # cells, bounded above
        labels = [r["__y"] for r in rows]
        if any(y is None or y < 0 or y != int(y) for y in labels):
            return None
        out = np.zeros((n_parts, *[len(f) + 1 for f in self.fine], int(max(labels)) + 1))
        for r in rows:
            if r["__part"] is not None and 0 <= r["__part"] < n_parts:
                out[(r["__part"], *[r[b] for b in bins], int(r["__y"]))] = r["count"]
        return out

    def coarse(self, counts: np.ndarray, part: int, size: int) -> tuple[np.ndarray, list]:
        """Counts by bins and label of one part's thresholds, and the fine bins they begin at."""
        starts = []
        for i, fine in enumerate(self.fine):
            begin = np.concatenate([[0], np.searchsorted(fine, self.thresholds[i][part, size]) + 1])
            counts = np.add.reduceat(counts, begin, axis=i)
            starts.append(begin)
        return counts, starts


def _impurity(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    out = np.ones(len(counts))
    for c in range(counts.shape[1]):
        share = counts[:, c] / total
        out -= share * share
    return out


def grow(counts: np.ndarray, depth: int, min_gain: float = 0.0, some: int | None = None, rng=None) -> np.ndarray:
    """Class counts of the leaf that each cell falls into, of one tree. ``counts`` holds the rows
    by bins and, last, label; a node looks at ``some`` features, drawn by ``rng``."""
    features = counts.ndim - 1
    out = np.zeros(counts.shape)

    def split(box: tuple, own: np.ndarray):
        """Feature and place of the best split, with the impurities of its sides."""
        total = own.sum()
        impurity = _impurity(own[None], total)[0]
        best = (0.0, None, None, None, None)
        chosen = range(features) if some is None or some >= features else rng.choice(features, some, replace=False)
        here = counts[box]
        for f in chosen:
            by = here.sum(axis=tuple(a for a in range(features) if a != f))
            left = by.cumsum(axis=0)[:-1]
            right = own - left
            n_left, n_right = left.sum(axis=1), right.sum(axis=1)
            valid = np.flatnonzero((n_left >= 1) & (n_right >= 1))
            if not len(valid):
                continue
            sides = [_impurity(side[valid], n[valid]) for side, n in ((left, n_left), (right, n_right))]
            gain = impurity - n_left[valid] / total * sides[0] - n_right[valid] / total * sides[1]
            at = int(gain.argmax())
            if gain[at] >= min_gain and gain[at] > best[0]:
                best = (gain[at], f, int(valid[at]), sides[0][at], sides[1][at])
        return best[1:]

    def node(box: tuple, level: int, pure: bool) -> int | None:
        """Fills the box; the prediction if it became a leaf."""
        own = counts[box].reshape(-1, counts.shape[-1]).sum(axis=0)
        if level < depth and not pure:
            f, place, *sides = split(box, own)
            if f is not None:
                cut = box[f].start + place + 1
                ends = []
                for part, side in ((slice(box[f].start, cut), sides[0]), (slice(cut, box[f].stop), sides[1])):
                    ends.append(node((*box[:f], part, *box[f + 1 :]), level + 1, abs(side) < EPSILON))
                if ends[0] is None or ends[0] != ends[1]:
                    return None
        out[box] = own
        return int(own.argmax())

    node(tuple(slice(0, n) for n in counts.shape[:-1]), 0, False)
    return out


def forest(spark, counts: np.ndarray, trees: int, depth: int, min_gain: float, seed: int) -> np.ndarray:
    """Class probabilities of every cell: the mean of the trees' shares. Trees grow on the
    executors, and each task passes on one sum."""
    features = counts.ndim - 1
    some = int(np.ceil(np.sqrt(features)))
    held = spark.sparkContext.broadcast(counts)
    tasks = min(trees, 2 * spark.sparkContext.defaultParallelism)

    def sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(held.value.shape)
        for frame in frames:
            for tree in frame["id"]:
                rng = np.random.default_rng([seed % (1 << 32), int(tree)])
                drawn = rng.poisson(held.value).astype(float)
                leaf = grow(drawn, depth, min_gain, some, rng)
                n = leaf.sum(axis=-1, keepdims=True)
                total += np.divide(leaf, n, out=np.zeros(leaf.shape), where=n > 0)
        yield pd.DataFrame({"total": [total.tobytes()]})

    parts = spark.range(0, trees, 1, tasks).mapInPandas(sums, "total binary").collect()
    held.unpersist()
    # Sums of doubles, in the order of the tasks.
    total = sum(np.frombuffer(r.total).reshape(counts.shape) for r in parts)
    return total / total.sum(axis=-1, keepdims=True)


def forest_probabilities(estimator, train: DataFrame, spec: TableSpec) -> tuple[Bins, np.ndarray] | None:
    """Bins and the forest's class probabilities per cell, or None where the forest is left to
    Spark ML over the rows."""
    if type(estimator) is not RandomForestClassifier or not spec.features or not follows(estimator):
        return None
    if train.limit(CELL_ROWS + 1).count() <= CELL_ROWS:
        return None
    size = estimator.getMaxBins()
    bins = Bins.fit(train, spec, [F.lit(True)], [size])
    if bins is None or bins.cells > MAX_CELLS:
        return None
    counts = bins.counted(train, F.lit(0), 1)
    if counts is None:
        return None
    return bins, forest(
        train.sparkSession, counts[0], estimator.getNumTrees(), estimator.getMaxDepth(),
        estimator.getMinInfoGain(), estimator.getSeed(),
    )


def with_probabilities(df: DataFrame, bins: Bins, probabilities: np.ndarray, name: str) -> DataFrame:
    """Add the probabilities of each row's cell."""
    shape = probabilities.shape[:-1]
    number = F.lit(0)
    for i, n in enumerate(shape):
        number = number * n + F.col(f"__b{i}")
    table = df.sparkSession.createDataFrame(
        [(i, p.tolist()) for i, p in enumerate(probabilities.reshape(-1, probabilities.shape[-1]))],
        f"__cell int, `{name}` array<double>",
    )
    placed = bins.placed(df).withColumn("__cell", number.cast("int"))
    return placed.join(F.broadcast(table), "__cell").select(*[F.col(f"`{c}`") for c in df.columns], name)


def fold_accuracies(df: DataFrame, spec: TableSpec, fold: Column, k: int, trials: list[dict]) -> np.ndarray | None:
    """Accuracy of a decision tree of each trial's settings on the rows of each fold, grown from
    the rows of the others: trials x folds. None where it is left to Spark ML."""
    sizes = sorted({t["maxBins"] for t in trials})
    if df.limit(CELL_ROWS + 1).count() <= CELL_ROWS or not spec.features:
        return None
    marked = df.withColumn("__fold", fold)
    bins = Bins.fit(marked, spec, [F.col("__fold") != f for f in range(k)], sizes)
    if bins is None or bins.cells > MAX_CELLS:
        return None
    counts = bins.counted(marked, F.col("__fold"), k)
    if counts is None or not all(c.sum() for c in counts):
        return None
    out = np.zeros((len(trials), k))
    for f in range(k):
        for size in sizes:
            seen, _ = bins.coarse(counts.sum(axis=0) - counts[f], f, size)
            asked, _ = bins.coarse(counts[f], f, size)
            for t, trial in enumerate(trials):
                if trial["maxBins"] == size:
                    leaf = grow(seen, trial["maxDepth"], trial["minInfoGain"])
                    right = np.take_along_axis(asked, leaf.argmax(axis=-1)[..., None], axis=-1)
                    out[t, f] = right.sum() / asked.sum()
    return out
