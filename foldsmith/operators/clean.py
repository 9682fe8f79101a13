"""Column drops, imputation and outlier removal, fitted on training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.operators.foldwise import by_fold, train_moments, train_modes, train_summary
from foldsmith.operators.stats import (
    FOLD,
    column_summary,
    medians,
    modes,
    value_counts,
    with_stats,
)

ALL_ROLES = ("train", "val", "test")
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def column_report(df: DataFrame, categorical, share: float = 0.95) -> DataFrame:
    """Per fold and categorical column: distinct training values, and whether
    the column is constant (all-NULL counts as constant) or nearly unique."""
    return train_summary(df, categorical).select(
        "fold_id",
        "column",
        "n_rows",
        "n_distinct",
        (F.col("n_distinct") <= 1).alias("is_constant"),
        (F.col("n_distinct") >= F.lit(share) * F.col("n_rows")).alias("is_near_unique"),
    )


def _drop(df: DataFrame, report: DataFrame, flag: str) -> DataFrame:
    """Drop the flagged columns; one flagged in some folds only is NULL there."""
    df = by_fold(df)
    rows = report.filter(flag).select("fold_id", "column").collect()  # folds x columns
    folds = {r.fold_id for r in report.select("fold_id").distinct().collect()}
    flagged: dict[str, list[int]] = {}
    for r in rows:
        flagged.setdefault(r.column, []).append(r.fold_id)
    out = []
    for c in df.columns:
        if c not in flagged:
            out.append(F.col(f"`{c}`"))
        elif set(flagged[c]) != folds:
            out.append(F.when(~F.col("fold_id").isin(flagged[c]), F.col(f"`{c}`")).alias(c))
    return df.select(*out)


def drop_constant(df: DataFrame, categorical) -> DataFrame:
    """Drop categorical columns with a single training value."""
    return _drop(df, column_report(df, categorical), "is_constant")


def drop_near_unique(df: DataFrame, categorical, share: float = 0.95) -> DataFrame:
    """Drop categorical columns whose training values are nearly all distinct."""
    return _drop(df, column_report(df, categorical, share), "is_near_unique")


def fill(df: DataFrame, fills: DataFrame, columns, apply_to=ALL_ROLES, by=FOLD) -> DataFrame:
    """Replace NULL by the fitted value of the group, in the given roles."""
    fills = fills.select(*by, *[F.col(c).alias(f"{c}__fill") for c in columns])
    columns = set(columns)
    out = []
    for c in df.columns:
        col = F.col(f"`{c}`")
        if c in columns:
            filled = F.coalesce(col, F.col(f"{c}__fill").cast(df.schema[c].dataType))
            if set(apply_to) != set(ALL_ROLES):
                filled = F.when(F.col("role").isin(*apply_to), filled).otherwise(col)
            col = filled.alias(c)
        out.append(col)
    return with_stats(df, fills, by).select(*out)


def impute_numeric(df: DataFrame, numeric, apply_to=ALL_ROLES) -> DataFrame:
    """Training mean for floating columns, training mode for integer columns."""
    whole = [c for c in numeric if isinstance(df.schema[c].dataType, INTEGRAL)]
    real = [c for c in numeric if c not in whole]
    out = by_fold(df)
    if real:
        out = fill(out, _means(df, real), real, apply_to)
    if whole:
        out = fill(out, train_modes(df, whole, "long"), whole, apply_to)
    return out


def impute_mode(df: DataFrame, categorical, apply_to=ALL_ROLES) -> DataFrame:
    """Training mode, the smallest value on a tie."""
    return fill(by_fold(df), train_modes(df, categorical), categorical, apply_to)


def _means(df: DataFrame, columns) -> DataFrame:
    means = train_moments(df, columns)
    return means.select(*FOLD, *[F.col(f"{c}__mean").alias(c) for c in columns])


def impute_simple(df: DataFrame, numeric, categorical) -> DataFrame:
    """Mean / most frequent before the neighbour search; a column without any
    training value becomes 0 or ``Unknown``."""
    out = by_fold(df)
    if numeric:
        means = _means(df, numeric)
        means = means.select(*FOLD, *[F.coalesce(c, F.lit(0.0)).alias(c) for c in numeric])
        out = fill(
            out.withColumns({c: F.col(c).cast("double") for c in numeric}), means, numeric
        )
    if categorical:
        out = fill(out, train_modes(df, categorical), categorical)
        out = out.fillna("Unknown", subset=list(categorical))
    return out


def impute_synth_prep(
    df: DataFrame, numeric, categorical, by=("fold_id",), few: int = 10
) -> DataFrame:
    """Mode for categories and for columns of fewer than ``few`` distinct values
    (a missing value counts as one), median for the others."""
    by = list(by)
    out = df
    if categorical:
        out = fill(out, modes(df, by, categorical), categorical, by=by)
    if numeric:
        summary = column_summary(value_counts(df, by, numeric, "double"), by)
        distinct = F.col("n_distinct") + F.when(F.col("n_null") > 0, 1).otherwise(0)
        few_modes = summary.groupBy(*by).agg(
            *[
                F.first(
                    F.when((F.col("column") == c) & (distinct < few), F.col("mode")), True
                ).alias(c)
                for c in numeric
            ]
        )
        middle = medians(df, by, numeric).select(
            *by, *[F.col(c).alias(f"{c}__median") for c in numeric]
        )
        fills = few_modes.join(middle, by).select(
            *by, *[F.coalesce(F.col(c), F.col(f"{c}__median")).alias(c) for c in numeric]
        )
        out = fill(out, fills, numeric, by=by)
    return out


def outlier_filter(
    df: DataFrame, numeric, limit: float = 3.0, apply_to=ALL_ROLES
) -> DataFrame:
    """Keep rows within ``limit`` training standard deviations of the training
    mean in every numeric column, in all roles. A missing value keeps its row."""
    stats = train_moments(df, numeric)
    df = by_fold(df)
    inside = F.lit(True)
    for c in numeric:
        far = F.abs(F.col(c) - F.col(f"{c}__mean")) > F.lit(limit) * F.col(f"{c}__sd")
        inside = inside & ~F.coalesce(far, F.lit(False))
    if set(apply_to) != set(ALL_ROLES):
        inside = inside | ~F.col("role").isin(*apply_to)
    return with_stats(df, stats).filter(inside).select(*df.columns)
