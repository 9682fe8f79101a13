"""Scalers and distribution transforms, fitted per fold on training rows."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.arrays import let, upper_bound
from foldsmith.functions.normal import with_inverse_normal
from foldsmith.operators.foldwise import (
    by_fold,
    counts_by_fold,
    fold_count,
    has_roles,
    quantiles_by_fold,
    train_moments,
)
from foldsmith.operators.stats import (
    FOLD,
    exact_quantiles,
    moments,
    train_rows,
    unpivot,
    with_stats,
)
from foldsmith.session import materialize

# Fixed values of the quantile transform: distance to the outermost quantiles
# that counts as outside, and the probability the result is clipped at.
BOUND = 1e-7
CLIP = 1e-7 - 2.220446049250313e-16


def _replace(df: DataFrame, new: dict[str, Column]) -> list[Column]:
    return [new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns]


def standard_scale(df: DataFrame, columns) -> DataFrame:
    """``(x - mean) / sd`` with the sample deviation; NULL where it is 0 or NULL."""
    stats = train_moments(df, columns)
    df = by_fold(df)
    new = {
        c: F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd")) for c in columns
    }
    return with_stats(df, stats).select(*_replace(df, new))


def population_stats(df: DataFrame, columns, by=FOLD) -> DataFrame:
    """Mean and population deviation; a zero deviation counts as 1."""
    stats = moments(df, by, columns, population=True)
    return stats.select(
        *by,
        *[f"{c}__mean" for c in columns],
        *[
            F.coalesce(F.nullif(F.col(f"{c}__sd"), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__sd")
            for c in columns
        ],
    )


def standard_scale_pop(df: DataFrame, stats: DataFrame, columns, by=FOLD) -> DataFrame:
    new = {c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__sd") for c in columns}
    return with_stats(df, stats, by).select(*_replace(df, new))


def inverse_scale_pop(df: DataFrame, stats: DataFrame, columns, by=FOLD) -> DataFrame:
    new = {c: F.col(c) * F.col(f"{c}__sd") + F.col(f"{c}__mean") for c in columns}
    return with_stats(df, stats, by).select(*_replace(df, new))


def quantile_map(long: DataFrame, by, n_quantiles: int = 1000) -> DataFrame:
    """Per group the distinct quantiles with the lowest and highest probability
    each stands for: arrays ``v``, ``lo``, ``hi`` of at most ``n_quantiles``."""
    return _as_map(exact_quantiles(long, by, n_quantiles), by)


def _as_map(quantiles: DataFrame, by) -> DataFrame:
    by = list(by)
    probability = F.when(F.col("q") > 1, F.col("i") / (F.col("q") - 1)).otherwise(0.0)
    distinct = (
        quantiles.withColumn("p", probability)
        .groupBy(*by, "quantile")
        .agg(F.min("p").alias("lo"), F.max("p").alias("hi"))
    )
    return distinct.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("quantile", "lo", "hi"))).alias("__m")
    ).select(
        *by,
        F.col("__m.quantile").alias("v"),
        F.col("__m.lo").alias("lo"),
        F.col("__m.hi").alias("hi"),
    )


def fit_quantile_normal(df: DataFrame, columns, n_quantiles: int = 1000) -> DataFrame:
    """Quantile maps of all columns, one row per fold."""
    if has_roles(df):
        k = fold_count(df)
        counts = counts_by_fold(df, columns, "double", k=k)
        return maps_of_quantiles(quantiles_by_fold(counts, k, n_quantiles), columns)
    long = unpivot(train_rows(df), FOLD, columns, "double")
    return maps_of_quantiles(exact_quantiles(long, [*FOLD, "column"], n_quantiles), columns)


def maps_of_quantiles(quantiles: DataFrame, columns) -> DataFrame:
    """Quantiles per fold and column as one row of maps per fold."""
    return _as_map(quantiles, [*FOLD, "column"]).groupBy(*FOLD).agg(
        *[
            F.first(
                F.when(F.col("column") == c, F.struct("v", "lo", "hi")), True
            ).alias(f"{c}__map")
            for c in columns
        ]
    )


def quantile_normal(
    df: DataFrame, columns, maps: DataFrame | None = None, n_quantiles: int = 1000
) -> DataFrame:
    """Empirical CDF by interpolation, then the normal quantile. NULL stays.

    The maps, at most ``n_quantiles`` numbers per fold and column, enter the
    plan as literals: as joined columns they would be copied with every row.
    """
    if maps is None:
        maps = fit_quantile_normal(df, columns, n_quantiles)
    df = by_fold(df)
    literals = _map_literals(maps, columns)
    steps = max(1, n_quantiles.bit_length())
    placed = df.select(
        *df.columns,
        *[
            _mapped(F.col(c).cast("double"), F.get(literals[c], F.col("fold_id")), steps).alias(
                f"{c}__p"
            )
            for c in columns
        ],
    )
    scored = with_inverse_normal(
        placed,
        {
            f"{c}__n": F.when(
                F.col(f"{c}__p").isNotNull(),
                F.least(F.greatest(F.col(f"{c}__p"), F.lit(CLIP)), F.lit(1.0 - CLIP)),
            )
            for c in columns
        },
    )
    return scored.select(*_replace(df, {c: F.col(f"{c}__n") for c in columns}))


def _map_literals(maps: DataFrame, columns) -> dict[str, Column]:
    """Quantile maps as array literals indexed by the fold."""
    rows = {r.fold_id: r for r in maps.collect()}  # one row per fold
    schema = "array<struct<v:array<double>,lo:array<double>,hi:array<double>>>"
    out = {}
    for c in columns:
        by_fold = [
            rows[f][f"{c}__map"].asDict() if f in rows and rows[f][f"{c}__map"] else None
            for f in range(max(rows, default=-1) + 1)
        ]
        out[c] = F.from_json(F.lit(json.dumps(by_fold)), schema)
    return out


def _mapped(x: Column, fold_map: Column, steps: int) -> Column:
    return let(upper_bound(fold_map["v"], x, steps), lambda at: _probability(x, at, fold_map))


def _probability(x: Column, at: Column, fold_map: Column) -> Column:
    v, lo, hi = (fold_map[part] for part in ("v", "lo", "hi"))
    left = F.get(v, at - 1)
    right = F.get(v, at)
    between = F.get(hi, at - 1) + (x - left) / (right - left) * (
        F.get(lo, at) - F.get(hi, at - 1)
    )
    return (
        F.when(x.isNull() | v.isNull(), F.lit(None).cast("double"))
        .when(x - BOUND < F.get(v, F.lit(0)), 0.0)
        .when(x + BOUND > F.get(v, F.size(v) - 1), 1.0)
        .when(x == left, (F.get(lo, at - 1) + F.get(hi, at - 1)) / 2)
        .otherwise(between)
    )


def yeo_johnson(x: Column, lam: Column) -> Column:
    """Yeo-Johnson power transform (2000)."""
    tiny = F.lit(1e-12)
    up = F.when(F.abs(lam) < tiny, F.log1p(x)).otherwise(
        (F.pow(x + 1, lam) - 1) / F.when(F.abs(lam) < tiny, 1.0).otherwise(lam)
    )
    rest = F.lit(2.0) - lam
    down = F.when(F.abs(rest) < tiny, -F.log1p(-x)).otherwise(
        (F.lit(1.0) - F.pow(F.lit(1.0) - x, rest))
        / F.when(F.abs(rest) < tiny, 1.0).otherwise(rest)
    )
    return F.when(x >= 0, up).otherwise(down)


# Exponents are sought between these; a likelihood that grows beyond ends there.
LAMBDA_BOUND = 32.0

# Terms of the series used where the closed forms lose their digits.
SERIES_BELOW, SERIES_TERMS = 0.1, 9


def _moment(t: Column, m: int) -> Column:
    """Integral of ``s ** m * exp(t * s)`` over 0..1, for m = 0, 1, 2: the function
    ``(exp(t) - 1) / t`` and its derivatives."""
    e = F.exp(t)
    closed = {
        0: (e - 1) / t,
        1: (e * (t - 1) + 1) / (t * t),
        2: (e * (t * t - 2 * t + 2) - 2) / (t * t * t),
    }[m]
    series = F.lit(0.0)
    for j in reversed(range(SERIES_TERMS)):
        series = series * t + F.lit(1.0 / (math.factorial(j) * (j + m + 1)))
    return F.when(F.abs(t) < SERIES_BELOW, series).otherwise(closed)


def _slopes(spark, long: DataFrame, lams: dict) -> dict:
    """First and second derivative of the log-likelihood at one exponent per fold and
    column, from one aggregate over the values."""
    rows = [(f, c, float(lam)) for (f, c), lam in lams.items()]
    table = spark.createDataFrame(rows, "fold_id int, column string, lam double")
    u, sign, lam = F.col("u"), F.col("sign"), F.col("lam")
    t = F.when(sign > 0, lam).otherwise(2 - lam) * u
    parts = long.join(F.broadcast(table), ["fold_id", "column"]).select(
        "fold_id", "column", "u", "sign", t.alias("t")
    )
    parts = parts.select(
        "fold_id",
        "column",
        (sign * u).alias("jacobian"),
        (sign * u * _moment(F.col("t"), 0)).alias("y"),
        (u * u * _moment(F.col("t"), 1)).alias("y1"),
        (sign * u * u * u * _moment(F.col("t"), 2)).alias("y2"),
    )
    sums = parts.groupBy("fold_id", "column").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("jacobian").alias("jacobian"),
        F.var_pop("y").alias("v"),
        F.covar_pop("y", "y1").alias("c1"),
        (F.var_pop("y1") + F.covar_pop("y", "y2")).alias("c2"),
    )
    out = {}
    for r in sums.collect():  # folds x columns
        if not r.v:  # a constant column fits every exponent
            out[r.fold_id, r.column] = (0.0, 0.0)
        else:
            slope = 2 * r.c1 / r.v
            first = r.jacobian - r.n / 2 * slope
            out[r.fold_id, r.column] = (first, -r.n / 2 * (2 * r.c2 / r.v - slope * slope))
    return out


# A Newton step below this share of the exponent ends the climb: the next one would be about its
# square, less than what sums over many rows lose to rounding.
LAST_STEP = 1e-8


class _Climb:
    """Newton steps to the root of the slope, kept between the exponents seen on either
    side of it; where they would leave these, the middle is taken.

    A step that is small ends the climb whatever the sides say: so near to the root the sign
    of a slope summed over many rows is chance, and the middle would lead away again.
    """

    def __init__(self):
        self.lam, self.low, self.high, self.stride, self.done = 1.0, -LAMBDA_BOUND, LAMBDA_BOUND, 1.0, False

    def move(self, first: float, second: float) -> None:
        if first == 0 or self.high - self.low < 1e-13:
            self.done = True
            return
        if not math.isfinite(first):  # out of range: back towards 1
            if self.lam > 1:
                self.high = self.lam
            else:
                self.low = self.lam
            self.lam = (self.low + self.high) / 2 if abs(self.lam - 1) > 1e-9 else 1.0
            return
        newton = math.isfinite(second) and second < 0
        if newton and abs(first / second) <= LAST_STEP * max(1.0, abs(self.lam)):
            self.lam = max(-LAMBDA_BOUND, min(LAMBDA_BOUND, self.lam - first / second))
            self.done = True
            return
        if first > 0:
            self.low = self.lam
        else:
            self.high = self.lam
        step = -first / second if newton else math.copysign(self.stride, first)
        step = max(-self.stride, min(self.stride, step))
        self.stride *= 2 if abs(step) == self.stride else 1
        target = self.lam + step
        if not self.low < target < self.high:
            target = (self.low + self.high) / 2
        self.done = abs(target - self.lam) < 1e-12 * max(1.0, abs(target))
        self.lam = target


def fit_yeo_johnson(df: DataFrame, columns, rounds: int = 60) -> DataFrame:
    """Maximum-likelihood exponent per fold and column, with mean and population
    deviation of the transformed training values: ``(fold_id, column, lam, mean, sd)``.

    Each round is one aggregate of the likelihood's first and second derivative for the
    folds and columns still moving, usually four to eight rounds. A constant column keeps
    exponent 1; values without a most likely exponent get the border, 32 or -32.
    """
    spark = df.sparkSession
    df = by_fold(df)
    values = unpivot(train_rows(df), FOLD, columns, "double").filter(F.col("value").isNotNull())
    long = materialize(
        values.withColumns(
            {"u": F.log1p(F.abs("value")), "sign": F.when(F.col("value") >= 0, 1).otherwise(-1)}
        ),
        "power-values",
    )
    keys = long.select("fold_id", "column").distinct().collect()
    climbs = {(r.fold_id, r.column): _Climb() for r in keys}
    for _ in range(rounds):
        moving = {key: c.lam for key, c in climbs.items() if not c.done}
        if not moving:
            break
        for key, slopes in _slopes(spark, long, moving).items():
            climbs[key].move(*slopes)
    table = spark.createDataFrame(
        [(f, c, float(climb.lam)) for (f, c), climb in climbs.items()],
        "fold_id int, column string, lam double",
    )
    y = yeo_johnson(F.col("value"), F.col("lam"))
    return (
        long.join(F.broadcast(table), ["fold_id", "column"])
        .groupBy("fold_id", "column", "lam")
        .agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"))
        .withColumn("sd", F.coalesce(F.nullif(F.col("sd"), F.lit(0.0)), F.lit(1.0)))
    )


def power_yeo_johnson(df: DataFrame, columns, fitted: DataFrame | None = None) -> DataFrame:
    """Yeo-Johnson with fitted exponents, then zero mean and unit deviation."""
    if fitted is None:
        fitted = fit_yeo_johnson(df, columns)
    df = by_fold(df)
    wide = fitted.groupBy(*FOLD).agg(
        *[
            F.first(F.when(F.col("column") == c, F.struct("lam", "mean", "sd")), True).alias(
                f"{c}__pt"
            )
            for c in columns
        ]
    )
    new = {
        c: (
            yeo_johnson(F.col(c).cast("double"), F.col(f"{c}__pt.lam"))
            - F.col(f"{c}__pt.mean")
        )
        / F.col(f"{c}__pt.sd")
        for c in columns
    }
    return with_stats(df, wide).select(*_replace(df, new))
