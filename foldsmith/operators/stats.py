"""Fitted statistics: value frequencies, moments, exact quantiles.

Everything is fitted per group, usually per fold on its training rows, in one
pass for all folds and all columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.operators.ranking import running_total

FOLD = ("fold_id",)


def train_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("role") == "train")


def unpivot(df: DataFrame, by, columns, to: str) -> DataFrame:
    """``(by, column, value)`` rows of several columns cast to one type."""
    entries = [
        F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast(to).alias("value"))
        for c in columns
    ]
    return df.select(*by, F.inline(F.array(*entries)))


def value_counts(df: DataFrame, by, columns, to: str = "string") -> DataFrame:
    """Frequency of every value of every column: ``(by, column, value, n)``.

    One shuffle serves distinct counts, modes, codes and vocabularies of all
    columns. Counts are combined on the map side, so a value that a third of
    the rows share travels once per task. NULL has its own row.
    """
    return unpivot(df, by, columns, to).groupBy(*by, "column", "value").agg(
        F.count(F.lit(1)).alias("n")
    )


def column_summary(counts: DataFrame, by) -> DataFrame:
    """Per group and column: rows, NULLs, distinct values and mode (the smallest
    value on a tie) from the frequency table."""
    known = F.col("value").isNotNull()
    return counts.groupBy(*by, "column").agg(
        F.sum("n").alias("n_rows"),
        F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("n_null"),
        F.count("value").alias("n_distinct"),
        F.min_by("value", F.when(known, F.struct(-F.col("n"), F.col("value")))).alias("mode"),
    )


def widen(table: DataFrame, by, columns, value: Column | str) -> DataFrame:
    """``(by, column, value)`` to one row per group with one column each."""
    value = F.col(value) if isinstance(value, str) else value
    return table.groupBy(*by).agg(
        *[F.first(F.when(F.col("column") == c, value), True).alias(c) for c in columns]
    )


def modes(df: DataFrame, by, columns, to: str = "string") -> DataFrame:
    """Most frequent value per group and column, one row per group."""
    summary = column_summary(value_counts(df, by, columns, to), by)
    return widen(summary, by, columns, "mode")


def moments(df: DataFrame, by, columns, population: bool = False) -> DataFrame:
    """Mean and standard deviation of all columns in one aggregate."""
    sd = F.stddev_pop if population else F.stddev_samp
    return df.groupBy(*by).agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[sd(c).alias(f"{c}__sd") for c in columns],
    )


def with_stats(df: DataFrame, stats: DataFrame, by=FOLD) -> DataFrame:
    """Attach fitted statistics. They hold one row per fold, hence the broadcast."""
    return df.join(F.broadcast(stats), list(by), "left")


def exact_quantiles(
    long: DataFrame, by, n_quantiles: int = 1000, at_most_rows: bool = True
) -> DataFrame:
    """Quantiles at ``i / (q - 1)`` by linear interpolation, over all rows.

    ``long`` holds ``(by, value)``. With ``at_most_rows`` a group of fewer than
    ``n_quantiles`` rows gets as many quantiles as rows. Returns
    ``(by, i, q, quantile)``.

    Values are counted, ordered by range, and each distinct value finds by
    arithmetic which quantiles fall on it. No task holds a whole column.
    """
    by = list(by)
    counts = (
        long.filter(F.col("value").isNotNull())
        .groupBy(*by, "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ordered = running_total(counts, by, "value", {"n": "start"}, {"n": "total"})
    return place_quantiles(ordered, by, n_quantiles, at_most_rows)


def place_quantiles(
    ordered: DataFrame, by, n_quantiles: int = 1000, at_most_rows: bool = True
) -> DataFrame:
    """Quantiles from counted values ``(by, value, n, start, total)``, where ``start`` rows of
    ``total`` come before the ``n`` rows of the value."""
    by = list(by)
    q = F.lit(n_quantiles).cast("long")
    if at_most_rows:
        q = F.least(q, F.col("total"))
    steps = F.greatest(F.col("q") - 1, F.lit(1))
    gaps = F.greatest(F.col("total") - 1, F.lit(1))
    position = F.col("i") * F.col("total_gaps") / F.col("steps")
    placed = (
        ordered.withColumn("q", q)
        .withColumn("steps", steps)
        .withColumn("total_gaps", F.col("total") - 1)
        .withColumn("end", F.col("start") + F.col("n"))
        # Candidates: one more on both sides than the exact bounds, then tested.
        .withColumn(
            "first",
            F.greatest(F.lit(0), F.floor((F.col("start") - 1) * steps / gaps)).cast("long"),
        )
        .withColumn(
            "last",
            F.least(F.col("q") - 1, F.ceil(F.col("end") * steps / gaps)).cast("long"),
        )
        .filter(F.col("first") <= F.col("last"))
        .withColumn("i", F.explode(F.sequence("first", "last")))
        .withColumn("low", F.floor(position))
        .withColumn("high", F.ceil(position))
        .withColumn("part", position - F.col("low"))
        .withColumn("is_low", (F.col("low") >= F.col("start")) & (F.col("low") < F.col("end")))
        .withColumn(
            "is_high", (F.col("high") >= F.col("start")) & (F.col("high") < F.col("end"))
        )
        .filter(F.col("is_low") | F.col("is_high"))
    )
    return (
        placed.groupBy(*by, "i", "q")
        .agg(
            F.max(F.when(F.col("is_low"), F.col("value"))).alias("a"),
            F.max(F.when(F.col("is_high"), F.col("value"))).alias("b"),
            F.max("part").alias("part"),
        )
        .select(*by, "i", "q", (F.col("a") + (F.col("b") - F.col("a")) * F.col("part")).alias("quantile"))
    )


def medians(df: DataFrame, by, columns) -> DataFrame:
    """Exact median per group and column, one row per group."""
    long = unpivot(df, by, columns, "double")
    middle = exact_quantiles(long, [*by, "column"], 3, at_most_rows=False).filter(
        F.col("i") == 1
    )
    return widen(middle, by, columns, "quantile")
