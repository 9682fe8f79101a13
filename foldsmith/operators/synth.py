"""Synthetic rows: preparation, a class-conditional Gaussian copula, decoding."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.arrays import with_upper_bound
from foldsmith.functions.hashing import uniform
from foldsmith.functions.normal import inverse_normal
from foldsmith.operators.clean import impute_synth_prep
from foldsmith.operators.encode import one_hot_decode, one_hot_encode
from foldsmith.operators.ranking import attach
from foldsmith.operators.scale import (
    inverse_scale_pop,
    population_stats,
    quantile_map,
    standard_scale_pop,
)
from foldsmith.operators.stats import unpivot, value_counts
from foldsmith.session import BROADCAST_BYTES, materialize
from foldsmith.spec import TableSpec

# Values of one categorical column that a marginal may hold.
MAX_CATEGORIES = 10_000

# Probabilities closer to 0 or 1 than this have no finite normal score.
EDGE = 1e-7

# Parts of a class's rows where the marginals are too large to be broadcast.
SALTS = 32


def synth_prepare(
    df: DataFrame, numeric, categorical, vocab: dict[str, list[str]], by=("fold_id",)
) -> tuple[DataFrame, DataFrame]:
    """Impute, standardise numeric columns (population deviation) and one-hot
    encode the others. Returns the matrix rows and the scaling statistics."""
    filled = impute_synth_prep(df, numeric, categorical, by)
    filled = filled.withColumns({c: F.col(c).cast("double") for c in numeric})
    stats = population_stats(filled, numeric, by)
    scaled = standard_scale_pop(filled, stats, numeric, by)
    return one_hot_encode(scaled, vocab), stats


def synth_decode(
    df: DataFrame,
    stats: DataFrame,
    numeric,
    vocab: dict[str, list[str]],
    columns,
    by=("fold_id",),
) -> DataFrame:
    """Undo the scaling, round numbers half to even, take the largest indicator
    of every feature, and put the columns in the original order."""
    plain = one_hot_decode(inverse_scale_pop(df, stats, numeric, by), vocab)
    numeric = set(numeric)
    return plain.select(
        *[F.bround(F.col(c), 0).alias(c) if c in numeric else F.col(f"`{c}`") for c in columns]
    )


class CopulaModel:
    """Rows that look like the table: marginals per class and group, joined by
    the correlation of their normal scores.

    The fit is one frequency table, one quantile pass and one correlation
    aggregate. Only features x features correlations reach the driver.

    A missing value takes no part in its column's marginal and correlations; a column
    without any value in a class stays missing there. Impute the rows first
    (:func:`impute_synth_prep`) to have them filled.
    """

    def __init__(
        self,
        spec: TableSpec,
        by,
        marginals: DataFrame,
        classes: DataFrame,
        n_quantiles: int,
        size: int,
    ):
        self.spec = spec
        self.n_quantiles = n_quantiles
        self.by = list(by)
        self.marginals = marginals
        self.classes = classes
        self.size = size

    @classmethod
    def fit(
        cls, df: DataFrame, spec: TableSpec, by=("fold_id",), n_quantiles: int = 1000
    ) -> CopulaModel:
        by = list(by)
        keys = [*by, spec.target]
        numeric, categorical = list(spec.numeric), list(spec.categorical)
        parts = []
        if numeric:
            maps = quantile_map(
                unpivot(df, keys, numeric, "double"), [*keys, "column"], n_quantiles
            )
            scored = F.struct(
                "v",
                "lo",
                "hi",
                F.transform("lo", _score).alias("z_lo"),
                F.transform("hi", _score).alias("z_hi"),
            )
            parts.append(
                maps.groupBy(*keys).agg(
                    *[
                        F.first(F.when(F.col("column") == c, scored), True).alias(f"{c}__map")
                        for c in numeric
                    ]
                )
            )
        if categorical:
            parts.append(_category_marginals(df, keys, categorical))
        # A class without a value in any numeric, or any categorical, column stays.
        marginals = df.select(*keys).distinct()
        for part in parts:
            marginals = attach(marginals, part, keys, "left")
        marginals = materialize(marginals, "marginals")
        size = _bytes(marginals, spec)
        factors = _factors(df, marginals, spec, keys, n_quantiles, size)
        classes = (
            df.groupBy(*keys)
            .agg(F.count(F.lit(1)).alias("n"))
            .groupBy(*by)
            .agg(
                F.array_sort(F.collect_list(F.struct(spec.target, "n"))).alias("__classes")
            )
        )
        return cls(spec, by, attach(marginals, factors, keys), classes, n_quantiles, size)

    def sample(self, wanted: DataFrame, seed=42) -> DataFrame:
        """``n`` new rows per group; ``wanted`` holds the group columns and ``n``.

        Row ids are dense per group and every draw is a digest of the seed, the
        group and the row id.
        """
        spec, by = self.spec, self.by
        # One row per group is broadcast, whatever the planner takes the made row ids for: with
        # the ids broadcast instead, all rows would be drawn in the few tasks of the classes.
        rows = attach(_row_ids(wanted, by), F.broadcast(self.classes), by)
        counts = F.transform("__classes", lambda s: s["n"])
        total = F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)
        drawn = F.floor(uniform(f"{seed}:class", *by, "synth_id") * total) + 1
        rows = rows.withColumn("__draw", drawn)
        # The class whose range of running counts holds the draw.
        chosen = F.aggregate(
            "__classes",
            F.struct(F.lit(0).cast("long").alias("seen"), F.lit(0).alias("at")),
            lambda s, x: F.struct(
                (s["seen"] + x["n"]).alias("seen"),
                F.when(s["seen"] + x["n"] < F.col("__draw"), s["at"] + 1)
                .otherwise(s["at"])
                .alias("at"),
            ),
        )["at"]
        rows = rows.withColumn(
            spec.target, F.get(F.col("__classes"), chosen)[spec.target]
        ).select(*by, "synth_id", spec.target)
        features = [*spec.numeric, *spec.categorical]
        scores = F.array(
            *[inverse_normal(uniform(f"{seed}:{c}", *by, "synth_id")) for c in features]
        )
        wide = _with_marginals(
            rows.withColumn("__z", scores), self.marginals, [*by, spec.target], self.size
        )
        # Plain sums stay in generated code; a higher-order function would copy the marginals'
        # arrays, some 80 kB, with every row.
        correlated = wide.select(
            "*",
            *[_dot("__factor", i, "__z", len(features)).alias(f"{c}__y") for i, c in enumerate(features)],
        )
        placed = with_upper_bound(
            correlated,
            {f"{c}__at": (F.col(f"{c}__map.z_hi"), F.col(f"{c}__y")) for c in spec.numeric},
            self.n_quantiles,
        )
        placed = with_upper_bound(
            placed,
            {f"{c}__at": (F.col(f"{c}__cat.z"), F.col(f"{c}__y")) for c in spec.categorical},
            MAX_CATEGORIES,
        )
        return placed.select(
            *by,
            "synth_id",
            *[_number(c).alias(c) for c in spec.numeric],
            *[
                F.get(
                    F.col(f"{c}__cat.values"),
                    F.least(F.col(f"{c}__at"), F.size(f"{c}__cat.values") - 1),
                ).alias(c)
                for c in spec.categorical
            ],
            spec.target,
        )


def _bytes(marginals: DataFrame, spec: TableSpec) -> int:
    """Measured size of the marginals' numbers and values."""
    numbers = [F.coalesce(F.size(f"{c}__map.v"), F.lit(0)) * 40 for c in spec.numeric]
    texts = [
        F.coalesce(
            F.aggregate(f"{c}__cat.values", F.lit(0), lambda s, v: s + F.octet_length(v) + 32), F.lit(0)
        )
        for c in spec.categorical
    ]
    each = F.aggregate(F.array(*numbers, *texts), F.lit(0).cast("long"), lambda s, x: s + x)
    return marginals.agg(F.sum(each)).first()[0] or 0


def _with_marginals(df: DataFrame, marginals: DataFrame, keys, size: int) -> DataFrame:
    """Attach the marginals of each row's class. Within the measured limit they are broadcast
    and no row moves; beyond, a class's rows are spread over salts."""
    if size <= BROADCAST_BYTES:
        return attach(df, F.broadcast(marginals), keys)
    salted = df.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")
    return attach(salted, marginals.select("*", salts), [*keys, "__salt"]).drop("__salt")


def _row_ids(wanted: DataFrame, by) -> DataFrame:
    """Rows ``0 .. n-1`` of every group, generated in chunks of 20,000 so that
    a large group is produced by many tasks."""
    chunk = 20_000
    chunks = wanted.filter(F.col("n") > 0).select(
        *by,
        "n",
        F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / chunk))).alias("c"),
    )
    # With a number given: the few chunks are so small that they would be put into one task.
    tasks = 4 * wanted.sparkSession.sparkContext.defaultParallelism
    spread = chunks.repartition(tasks, *by, "c")
    low = F.col("c") * chunk
    high = F.least(low + chunk, F.col("n")) - 1
    return spread.select(*by, F.explode(F.sequence(low, high.cast("long"))).alias("synth_id"))


def _dot(rows: str, i: int, vector: str, size: int) -> Column:
    """Row ``i`` of an array of rows times a vector of a known size."""
    row = F.get(F.col(rows), F.lit(i))
    total = F.lit(0.0)
    for j in range(size):
        total = total + F.get(row, F.lit(j)) * F.get(F.col(vector), F.lit(j))
    return total


def _score(p: Column) -> Column:
    return inverse_normal(F.least(F.greatest(p, F.lit(EDGE)), F.lit(1 - EDGE)))


def _number(c: str) -> Column:
    """Value of a numeric marginal at a normal score, by interpolation between
    the distinct quantiles; ``__at`` counts those that end below the score."""
    at, y = F.col(f"{c}__at"), F.col(f"{c}__y")
    v, z_lo, z_hi = (F.col(f"{c}__map.{part}") for part in ("v", "z_lo", "z_hi"))
    left_z, right_z = F.get(z_hi, at - 1), F.get(z_lo, at)
    left, right = F.get(v, at - 1), F.get(v, at)
    return (
        F.when(at >= F.size(v), F.get(v, F.size(v) - 1))
        .when((at == 0) | (y >= right_z), right)
        .otherwise(left + (right - left) * (y - left_z) / (right_z - left_z))
    )


def _category_marginals(df: DataFrame, keys, categorical) -> DataFrame:
    """Sorted values of each categorical column with the normal scores of the
    ends and middles of their probability ranges."""
    counts = value_counts(df, keys, categorical).filter(F.col("value").isNotNull())
    lists = counts.groupBy(*keys, "column").agg(
        F.count(F.lit(1)).alias("size"), F.sum("n").alias("total")
    )
    largest = lists.agg(F.max("size")).first()[0] or 0
    if largest > MAX_CATEGORIES:
        raise ValueError(f"a categorical column has {largest} values; at most {MAX_CATEGORIES}")
    sorted_lists = counts.groupBy(*keys, "column").agg(
        F.array_sort(F.collect_list(F.struct("value", "n"))).alias("s"), F.sum("n").alias("total")
    )
    ends = F.transform(
        F.col("s"),
        lambda _, i: F.aggregate(
            F.slice(F.col("s.n"), F.lit(1), i + 1), F.lit(0).cast("long"), lambda a, x: a + x
        ),
    )
    table = sorted_lists.withColumn("ends", ends)
    middles = F.zip_with("ends", F.col("s.n"), lambda e, n: (e - n / 2) / F.col("total"))
    entry = F.struct(
        F.col("s.value").alias("values"),
        F.transform("ends", lambda e: _score(e / F.col("total"))).alias("z"),
        F.transform(middles, _score).alias("mid"),
    )
    return table.groupBy(*keys).agg(
        *[
            F.first(F.when(F.col("column") == c, entry), True).alias(f"{c}__cat")
            for c in categorical
        ]
    )


def _factors(
    df: DataFrame, marginals: DataFrame, spec: TableSpec, keys, n_quantiles: int, size: int
) -> DataFrame:
    """Cholesky factor of the correlation of normal scores, one per group and class."""
    numeric, categorical = list(spec.numeric), list(spec.categorical)
    features = [*numeric, *categorical]
    wide = with_upper_bound(
        _with_marginals(df.select(*keys, *features), marginals, keys, size),
        {f"{c}__at": (F.col(f"{c}__map.v"), F.col(c).cast("double")) for c in numeric},
        n_quantiles,
    )

    def middle(c: str) -> Column:
        at = F.greatest(F.col(f"{c}__at") - 1, F.lit(0))
        return (F.get(F.col(f"{c}__map.lo"), at) + F.get(F.col(f"{c}__map.hi"), at)) / 2

    # The scores are higher-order functions: no array may be a column of their rows, and the
    # two uses of a middle keep the planner from putting it back into them.
    placed = wide.select(
        *keys,
        *[F.when(F.col(c).isNotNull(), middle(c)).alias(f"{c}__mid") for c in numeric],
        *[
            F.get(
                F.col(f"{c}__cat.mid"),
                F.array_position(F.col(f"{c}__cat.values"), F.col(c).cast("string")).cast("int") - 1,
            ).alias(f"{c}__z")
            for c in categorical
        ],
    )

    scores = placed.select(
        *keys,
        *[F.when(F.col(f"{c}__mid").isNotNull(), _score(F.col(f"{c}__mid"))).alias(f"{c}__z") for c in numeric],
        *[f"{c}__z" for c in categorical],
    )
    pairs = [(i, j) for i in range(len(features)) for j in range(i)]
    rows = (
        scores.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            *[
                F.corr(f"{features[i]}__z", f"{features[j]}__z").alias(f"r_{i}_{j}")
                for i, j in pairs
            ],
        )
        .collect()  # groups x classes rows of features x features numbers
    )
    out = []
    for r in rows:
        corr = np.eye(len(features))
        for i, j in pairs:
            value = r[f"r_{i}_{j}"]
            value = 0.0 if value is None or np.isnan(value) else value
            corr[i, j] = corr[j, i] = value
        smallest = np.linalg.eigvalsh(corr)[0]
        if smallest < 1e-6:  # shrink toward independence until it factorises
            corr = (corr + (1e-6 - smallest) * np.eye(len(features))) / (1 + 1e-6 - smallest)
        out.append((*[r[c] for c in keys], np.linalg.cholesky(corr).tolist()))
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keys)
    return df.sparkSession.createDataFrame(out, f"{schema}, __factor array<array<double>>")
