"""Training statistics of all folds from a table that holds every row once.

Such a table has a column ``fold_roles``: the row's role (train, val or test) in each fold, by
position. Nothing is copied per fold before a row's values differ between folds, which is
where :func:`by_fold` belongs. Every function here takes the fold-long form as well.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.operators.ranking import running_total
from foldsmith.operators.stats import (
    FOLD,
    column_summary,
    moments,
    place_quantiles,
    train_rows,
    unpivot,
    value_counts,
    widen,
)

ROLES = "fold_roles"


def has_roles(df: DataFrame) -> bool:
    return ROLES in df.columns


def by_fold(df: DataFrame) -> DataFrame:
    """One row per row and fold: ``fold_id`` and ``role`` in place of ``fold_roles``."""
    if not has_roles(df):
        return df
    rest = [F.col(f"`{c}`") for c in df.columns if c != ROLES]
    return df.select(*rest, F.posexplode(ROLES).alias("fold_id", "role"))


def fold_count(df: DataFrame) -> int:
    """Folds of the table; 1 if it is empty."""
    first = df.select(F.size(ROLES).alias("k")).first()
    return first.k if first else 1


def in_training() -> Column:
    """Per fold, whether the row is a training row there."""
    return F.transform(ROLES, lambda role: role == "train")


def merged_sums(df: DataFrame, columns, flags: Column | None = None) -> dict[int, dict]:
    """Per fold: ``rows``, and per column the known values' number, mean and sum of squared
    differences from it.

    Rows are summed by their flags over all folds, of which few combinations exist, with
    map-side combine. A fold's numbers are those of the combinations that it takes part in,
    so the table is read once and no row is repeated.
    """
    parts = (
        df.groupBy((in_training() if flags is None else flags).alias("__flags"))
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.count(F.col(f"`{c}`")).alias(f"n{i}") for i, c in enumerate(columns)],
            *[F.avg(F.col(f"`{c}`").cast("double")).alias(f"m{i}") for i, c in enumerate(columns)],
            *[F.var_pop(F.col(f"`{c}`").cast("double")).alias(f"v{i}") for i, c in enumerate(columns)],
        )
        .collect()  # combinations of flags
    )
    out: dict[int, dict] = {}
    for fold in sorted({f for p in parts for f, taken in enumerate(p["__flags"]) if taken}):
        own = [p for p in parts if p["__flags"][fold]]
        sums: dict = {"rows": sum(p["__rows"] for p in own)}
        for i, c in enumerate(columns):
            known = [(p[f"n{i}"], p[f"m{i}"], p[f"v{i}"]) for p in own if p[f"n{i}"]]
            n = sum(k for k, _, _ in known)
            if not all(math.isfinite(m) for _, m, _ in known):
                sums[c] = (n, sum(m for _, m, _ in known), math.nan)
            elif n:
                mean = math.fsum(k * m for k, m, _ in known) / n
                sums[c] = (n, mean, math.fsum(k * v + k * (m - mean) ** 2 for k, m, v in known))
            else:
                sums[c] = (0, None, 0.0)
        out[fold] = sums
    return out


def moments_table(df: DataFrame, columns, sums: dict[int, dict], population: bool = False) -> DataFrame:
    """``(fold_id, <column>__mean, <column>__sd)`` as :func:`stats.moments` gives them."""
    rows = []
    for fold, fitted in sums.items():
        row: list = [fold]
        for c in columns:
            n, mean, squares = fitted[c]
            free = n if population else n - 1
            row += [mean, math.sqrt(squares / free) if free > 0 else None]
        rows.append(tuple(row))
    fields = [T.StructField("fold_id", T.IntegerType())]
    for c in columns:
        fields += [T.StructField(f"{c}__{part}", T.DoubleType()) for part in ("mean", "sd")]
    return df.sparkSession.createDataFrame(rows, T.StructType(fields))


def train_moments(df: DataFrame, columns, population: bool = False) -> DataFrame:
    """Mean and standard deviation of training values, one row per fold."""
    if not has_roles(df):
        return moments(train_rows(df), FOLD, columns, population)
    return moments_table(df, columns, merged_sums(df, columns), population)


def counts_by_fold(
    df: DataFrame, columns, to: str = "string", flags: Column | None = None, k: int | None = None
) -> DataFrame:
    """``(column, value, n)`` with ``n`` the value's training rows in each fold, by position.

    One row per value instead of one per value and fold; NULL has its own row.
    """
    k = fold_count(df) if k is None else k
    marked = df.select(
        (in_training() if flags is None else flags).alias("__flags"),
        *[F.col(f"`{c}`") for c in dict.fromkeys(columns)],
    )
    long = unpivot(marked, ["__flags"], columns, to)
    return long.groupBy("column", "value").agg(
        F.array(*[F.sum(F.col("__flags")[f].cast("long")) for f in range(k)]).alias("n")
    )


def summary_by_fold(counts: DataFrame, k: int) -> DataFrame:
    """:func:`stats.column_summary` per fold from :func:`counts_by_fold`."""
    known = F.col("value").isNotNull()

    def of(fold: int) -> Column:
        n = F.col("n")[fold]
        seen = known & (n > 0)
        return F.struct(
            F.lit(fold).alias("fold_id"),
            F.sum(n).alias("n_rows"),
            F.sum(F.when(known, 0).otherwise(n)).alias("n_null"),
            F.count_if(seen).alias("n_distinct"),
            F.min_by("value", F.when(seen, F.struct(-n, F.col("value")))).alias("mode"),
        )

    folds = counts.groupBy("column").agg(F.array(*[of(f) for f in range(k)]).alias("__folds"))
    return folds.select("column", F.inline("__folds")).filter("n_rows > 0")


def train_summary(df: DataFrame, columns, to: str = "string") -> DataFrame:
    """Rows, NULLs, distinct values and mode of training values, per fold and column."""
    if not has_roles(df):
        return column_summary(value_counts(train_rows(df), FOLD, columns, to), FOLD)
    k = fold_count(df)
    return summary_by_fold(counts_by_fold(df, columns, to, k=k), k)


def train_modes(df: DataFrame, columns, to: str = "string") -> DataFrame:
    """Most frequent training value per column, one row per fold."""
    return widen(train_summary(df, columns, to), FOLD, columns, "mode")


def codes_by_fold(counts: DataFrame, by, k: int, ranges: int | None = None) -> DataFrame:
    """``(fold_id, by, value, code)``: a value's position among the values a fold has seen.

    Values are ordered once for all folds; each fold counts along that order.
    """
    seen = counts.filter(F.col("value").isNotNull()).select(
        *by, "value", *[(F.col("n")[f] > 0).cast("long").alias(f"__s{f}") for f in range(k)]
    )
    ordered = running_total(seen, by, "value", {f"__s{f}": f"__c{f}" for f in range(k)}, ranges=ranges)
    codes = F.array(*[F.when(F.col(f"__s{f}") > 0, F.col(f"__c{f}")) for f in range(k)])
    return (
        ordered.select(*by, "value", F.posexplode(codes).alias("fold_id", "code"))
        .filter(F.col("code").isNotNull())
        .select("fold_id", *by, "value", F.col("code").cast("int").alias("code"))
    )


def quantiles_by_fold(
    counts: DataFrame, k: int, n_quantiles: int, scaling: DataFrame | None = None
) -> DataFrame:
    """:func:`stats.exact_quantiles` per fold and column from :func:`counts_by_fold` of
    doubles, of values scaled by ``scaling`` (``fold_id, column, mean, sd``) if it is given.

    Values are ordered once for all folds and columns, before they are scaled. A value may
    stand in several rows.
    """
    wide = counts.filter(F.col("value").isNotNull()).select(
        "column", "value", *[F.col("n")[f].alias(f"__n{f}") for f in range(k)]
    )
    ordered = running_total(
        wide,
        ["column"],
        "value",
        {f"__n{f}": f"__b{f}" for f in range(k)},
        {f"__n{f}": f"__t{f}" for f in range(k)},
    )
    folds = F.array(
        *[
            F.struct(
                F.lit(f).alias("fold_id"),
                F.col(f"__n{f}").alias("n"),
                F.col(f"__b{f}").alias("start"),
                F.col(f"__t{f}").alias("total"),
            )
            for f in range(k)
        ]
    )
    taken = F.filter(folds, lambda x: x["n"] > 0)
    long = ordered.select("column", "value", F.inline(taken))
    if scaling is not None:
        scaled = F.try_divide(F.col("value") - F.col("mean"), F.col("sd"))
        long = (
            long.join(F.broadcast(scaling), [*FOLD, "column"])
            .withColumn("value", scaled)
            .drop("mean", "sd")
            .filter(F.col("value").isNotNull())
        )
    return place_quantiles(long, [*FOLD, "column"], n_quantiles)
