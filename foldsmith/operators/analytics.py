"""Tables behind the result plots: means, intervals, histograms, curves."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.functions.digests import md5_words
from foldsmith.operators.ranking import group_key
from foldsmith.operators.stats import unpivot
from foldsmith.session import materialize

# Fixed value: 97.5 % point of the standard normal distribution.
Z_975 = 1.959963984540054

# Poisson(1) probabilities of at most 0, 1, 2, ... events.
POISSON_CDF = tuple(
    math.exp(-1.0) * sum(1.0 / math.factorial(j) for j in range(i + 1)) for i in range(12)
)


# A digest of 32 hex digits gives the draws of this many resamples, four digits each.
WORDS, DIGITS = 8, 4
SUMS = "metric string, sum double, count long, ci_low double, ci_high double, draw_sums array<double>, draw_counts array<double>"


# Texts whose digests are made at a time.
TEXTS = 512
# A group with more rows is cut into parts, unless a thousandth of all rows is more.
PART_ROWS = 20_000


@lru_cache(maxsize=1)
def _poisson_weights() -> np.ndarray:
    """Poisson(1) draws by two bytes of a digest, as the machine reads them.

    With ``u = (number + 0.5) / 2**16`` of four hex digits the draw is the number of CDF
    steps below ``u``.
    """
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    draws = (u[:, None] > np.array(POISSON_CDF)).sum(axis=1).astype(float)
    return draws[np.arange(1 << 16, dtype=np.uint16).byteswap()]


def _draw(texts: list[bytes], x: np.ndarray, draws: int, seed) -> np.ndarray:
    """Sums over rows of every column of ``x`` by resample: draws x columns.

    A resample weights every row by a Poisson(1) count. One digest of seed, block and row
    gives the weights of a block of ``WORDS`` resamples; all columns share them.
    """
    table = _poisson_weights()
    prefixes = [f"{seed}:{block}".encode() for block in range(-(-draws // WORDS))]
    sums = np.zeros((len(prefixes), x.shape[1], WORDS))
    for at in range(0, len(texts), TEXTS):
        some = md5_words(prefixes, texts[at : at + TEXTS])
        sums += x[at : at + TEXTS].T @ table[some.view("<u2")]
    return sums.transpose(0, 2, 1).reshape(-1, x.shape[1])[:draws]


def _interval(sums: np.ndarray, counts: np.ndarray, level: float) -> list:
    """Percentiles of the resampled means; a resample without a row has none."""
    means = sums[counts > 0] / counts[counts > 0]
    tail = (1 - level) / 2
    return [float(q) for q in np.quantile(means, [tail, 1 - tail])] if len(means) else [None, None]


def _drawn(df: DataFrame, by, values, row_id: str, draws: int, level: float, seed) -> DataFrame:
    """One row per group and value: its interval, or its sums by resample where the group has
    several parts.

    The rows of a group, or of a part of a large one, meet in one task, which draws their
    weights; so rows are shuffled once, and draws only for large groups, of which there are
    at most a thousand.
    """
    by, k = list(by), len(values)
    text = F.coalesce(F.concat(F.lit(":"), F.col(row_id).cast("string")), F.lit("")).cast("binary")
    named = [F.col(v).cast("double").alias(f"__x{i}") for i, v in enumerate(values)]
    rows = df.select(*by, text.alias("__text"), *named)
    sizes = materialize(rows.groupBy(*by).agg(F.count(F.lit(1)).alias("__n")), "group-sizes")
    total = sizes.agg(F.sum("__n")).first()[0] or 0
    size = max(PART_ROWS, math.ceil(total / 1000))
    large = sizes.where(F.col("__n") > size).select(
        group_key(by).alias("__group"), F.ceil(F.col("__n") / size).alias("__parts")
    )
    part = F.coalesce(F.pmod(F.xxhash64("__text"), F.col("__parts")), F.lit(0))
    parted = rows.withColumn("__group", group_key(by)).join(F.broadcast(large), "__group", "left")
    parted = parted.drop("__group").withColumn("__part", part)
    # As many tasks as the draws need, not as the rows' bytes would.
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, math.ceil(total / size))
    columns = ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by] + [SUMS])

    def draw(key: tuple, table: pa.Table) -> pa.Table:
        texts = table["__text"].to_pylist()
        raw = [table[f"__x{i}"] for i in range(k)]
        x = np.column_stack([pc.fill_null(c, 0.0).to_numpy() for c in raw] + [c.is_valid().to_numpy() for c in raw])
        sums = _draw(texts, x.astype(float), draws, seed)
        whole = pc.max(table["__parts"]).as_py() is None
        out = []
        for i, metric in enumerate(values):
            s, n = sums[:, i], sums[:, k + i]
            given = (float(x[:, i].sum()), int(x[:, k + i].sum()))
            out.append((metric, *given, *(_interval(s, n, level) if whole else (None, None)), *((None, None) if whole else (s, n))))
        return _rows(key[: len(by)], by, out)

    return parted.repartition(tasks, *by, "__part").groupBy(*by, "__part").applyInArrow(draw, columns)


def _rows(key: tuple, by: list, rows: list) -> pa.Table:
    types = [pa.string(), pa.float64(), pa.int64(), *[pa.float64()] * 2, *[pa.list_(pa.float64())] * 2]
    names = [c.split()[0] for c in SUMS.split(", ")]
    held = [pa.array([v.as_py()] * len(rows), v.type) for v in key]
    made = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.table([*held, *made], [*by, *names])


def intervals(
    df: DataFrame, by, values, row_id: str, draws: int, level: float = 0.95, seed=42
) -> DataFrame:
    """Mean and percentile interval of the resampled means of every value, per group."""
    by = list(by)
    drawn = materialize(_drawn(df, by, values, row_id, draws, level, seed), "draws")

    def add(key: tuple, table: pa.Table) -> pa.Table:
        s, n = (np.sum(table[c].to_pylist(), axis=0) for c in ("draw_sums", "draw_counts"))
        given = (pc.sum(table["sum"]).as_py(), pc.sum(table["count"]).as_py())
        return _rows(key[:-1], by, [(key[-1].as_py(), *given, *_interval(s, n, level), None, None)])

    in_parts = F.col("draw_sums").isNotNull()
    added = drawn.where(in_parts).groupBy(*by, "metric").applyInArrow(add, drawn.schema)
    found = drawn.where(~in_parts).unionByName(added).where(F.col("count") > 0)
    return found.select(*by, "metric", (F.col("sum") / F.col("count")).alias("mean"), "ci_low", "ci_high")


def bootstrap_ci(
    df: DataFrame,
    by,
    value: str,
    row_id: str,
    draws: int = 1000,
    level: float = 0.95,
    seed=42,
) -> DataFrame:
    """Mean and percentile interval of resampled means per group."""
    return intervals(df, by, [value], row_id, draws, level, seed).drop("metric")


def model_means(results: DataFrame, metrics, by, row_id: str, draws: int = 1000) -> DataFrame:
    """Mean and bootstrap interval of each metric by ``by``: within a dataset
    over folds, or over all datasets, as ``by`` says."""
    return intervals(results, by, metrics, row_id, draws)


def model_means_sets(results: DataFrame, metrics, sets, row_id: str, draws: int = 1000) -> DataFrame:
    """``model_means`` of several groupings, the first of which holds the columns of all others.

    A row has the same weights in all groupings. Columns that a grouping lacks are NULL,
    ``grouping`` is its number in ``sets``.
    """
    out = None
    for number, by in enumerate(sets):
        missing = [F.lit(None).cast(results.schema[c].dataType).alias(c) for c in sets[0] if c not in by]
        part = intervals(results, by, metrics, row_id, draws).select("*", *missing, F.lit(number).alias("grouping"))
        out = part if out is None else out.unionByName(part)
    return out


def model_sd(results: DataFrame, metrics, by) -> DataFrame:
    """Mean and standard deviation of each metric."""
    long = unpivot(results, by, metrics, "double").withColumnRenamed("column", "metric")
    return long.groupBy(*by, "metric").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")
    )


def time_vs_accuracy(results: DataFrame, dataset_id=None) -> DataFrame:
    """Mean prediction time per model and accuracy; unparsable values are left out."""
    if dataset_id is not None:
        results = results.filter(F.col("dataset_id") == dataset_id)
    numbers = results.select(
        "dataset_id",
        "model_name",
        F.col("accuracy").try_cast("double").alias("accuracy"),
        F.col("time_predict").try_cast("double").alias("time_predict"),
    ).dropna(subset=["accuracy", "time_predict"])
    return numbers.groupBy("dataset_id", "model_name", "accuracy").agg(
        F.avg("time_predict").alias("time_predict")
    )


def fold_pre_post(
    df: DataFrame, columns=("pre_eval", "post_eval"), per_group: bool = False
) -> DataFrame:
    """Mean of each column by fold with a normal 95 % interval.

    The standard error is that of the whole column unless ``per_group`` is set.
    It is put together from the moments of the folds, so the rows are read once.
    """
    aggregates = []
    for c in columns:
        aggregates += [
            F.count(c).alias(f"{c}__n"),
            F.avg(c).alias(f"{c}__mean"),
            F.var_pop(c).alias(f"{c}__var"),
        ]
    folds = df.groupBy("fold").agg(*aggregates)
    whole = Window.partitionBy("fold") if per_group else Window.partitionBy()
    out = folds
    for c in columns:
        n = F.col(f"{c}__n")
        out = out.withColumn(f"{c}__all", F.sum(n).over(whole)).withColumn(
            f"{c}__centre",
            F.sum(n * F.col(f"{c}__mean")).over(whole) / F.col(f"{c}__all"),
        )
    for c in columns:
        n, off = F.col(f"{c}__n"), F.col(f"{c}__mean") - F.col(f"{c}__centre")
        squares = F.sum(n * (F.col(f"{c}__var") + off * off)).over(whole)
        total = F.col(f"{c}__all")
        out = out.withColumn(
            f"{c}__half", F.lit(Z_975) * F.sqrt(F.try_divide(squares, total - 1) / total)
        )
    picks = [F.col("fold")]
    for c in columns:
        mean, half = F.col(f"{c}__mean"), F.col(f"{c}__half")
        picks += [mean.alias(c), (mean - half).alias(f"{c}_low"), (mean + half).alias(f"{c}_high")]
    return out.select(*picks)


def histograms(df: DataFrame, columns, by=("origin",), bins: int = 30) -> DataFrame:
    """Density histogram per column and group over the group's own range."""
    by = list(by)
    long = unpivot(df, by, columns, "double").filter(F.col("value").isNotNull())
    return _histograms(long, by, bins).select(
        *by, "column", "bin", "left", (F.col("left") + F.col("width")).alias("right"), "density"
    )


def _histograms(long: DataFrame, by, bins: int) -> DataFrame:
    ranges = long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("total"),
        F.min("value").alias("low"),
        F.max("value").alias("high"),
        F.stddev_samp("value").alias("sd"),
    )
    flat = F.col("high") == F.col("low")  # a single value gets a range of width 1
    ranges = ranges.select(
        *by,
        "column",
        "total",
        "sd",
        F.when(flat, F.col("low") - 0.5).otherwise(F.col("low")).alias("low"),
        F.when(flat, 1.0 / bins).otherwise((F.col("high") - F.col("low")) / bins).alias("width"),
    )
    place = F.least(
        F.floor((F.col("value") - F.col("low")) / F.col("width")), F.lit(bins - 1)
    )
    # Written, so that the planner sees the size: one row per group and column.
    ranges = materialize(ranges, "ranges")
    return (
        long.join(ranges, [*by, "column"])
        .groupBy(*by, "column", "total", "sd", "low", "width", place.cast("int").alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("left", F.col("low") + F.col("bin") * F.col("width"))
        .withColumn("density", F.col("n") / (F.col("total") * F.col("width")))
    )


def density_curves(
    df: DataFrame, columns, by=("origin",), bins: int = 30, points: int = 50
) -> DataFrame:
    """Gaussian kernel density on a grid, from the histogram counts.

    Bandwidth by Scott's rule. One row per group holds the ``bins`` counts; the
    sum over them is an array expression.
    """
    by = list(by)
    long = unpivot(df, by, columns, "double").filter(F.col("value").isNotNull())
    counted = _histograms(long, by, bins)
    keys = [*by, "column", "total", "sd", "low", "width"]
    whole = counted.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct((F.col("left") + F.col("width") / 2).alias("x"), F.col("n"))
            )
        ).alias("bars")
    )
    sd = F.when(F.col("sd") > 0, F.col("sd")).otherwise(1.0)
    wide = whole.withColumn("h", sd * F.pow(F.col("total"), F.lit(-0.2))).withColumn(
        "point", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))
    )
    x = F.col("low") + F.col("point") * F.col("width") * F.lit(bins) / F.lit(points - 1)
    wide = wide.withColumn("x", x)
    norm = F.col("total") * F.col("h") * F.lit(math.sqrt(2 * math.pi))
    kernel = F.aggregate(
        "bars",
        F.lit(0.0),
        lambda s, b: s
        + b["n"] * F.exp(F.lit(-0.5) * F.pow((F.col("x") - b["x"]) / F.col("h"), F.lit(2.0))),
    )
    return wide.select(*by, "column", "point", "x", (kernel / norm).alias("density"))


def mean_over_runs(df: DataFrame, by, columns) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns])
