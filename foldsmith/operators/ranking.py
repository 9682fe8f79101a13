"""Exact ranks and running totals without putting a group into one task.

``row_number()`` over a class or over a whole table sends that class or table
to one task. Here every order is first cut into ranges, whatever its size:
ranges of digests, or Spark's own range partitions of (group, value). Ranges
are summed up, a running sum over the few range sums gives each range its
offset, and only the rows of one range meet in one task.

Groups are told apart by a text of their key columns that is never NULL, so
NULL is a group like any other, and plain equality keeps the partitioning.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.functions.hashing import hash_key
from foldsmith.session import materialize

# Rows of a range that one task should sort. Uniform digests and range partitions
# give ranges of about equal size, whatever the group sizes are.
RANGE_ROWS = 1_000_000


def attach(df: DataFrame, side: DataFrame, columns, how: str = "inner") -> DataFrame:
    """Equi-join on key columns without NULL.

    Plain equality keeps the hash partitioning of the window or aggregate
    before the join, which null-safe equality would not.
    """
    return df.join(side, list(columns), how)


def group_key(by) -> Column:
    """One text per group; NULL and every value differ from each other."""
    parts = []
    for c in by:
        text = F.col(c).cast("string")
        size = F.length(text).cast("string")
        parts.append(F.coalesce(F.concat(size, F.lit(":"), text), F.lit("-")))
    return F.concat_ws("", *parts) if parts else F.lit("")


def range_digits(rows: int) -> int:
    """Leading hex digits of the digest that name a range."""
    digits = 2
    while rows > RANGE_ROWS * 16**digits:
        digits += 1
    return digits


def hash_ranges(df: DataFrame, seed, row_id: str, by, digits: int) -> DataFrame:
    """Row counts and offsets of the digest ranges of every group.

    One row per group and non-empty range: at most ``16**digits`` per group.
    """
    before = (
        Window.partitionBy("__group")
        .orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    named = df.withColumns(
        {"__group": group_key(by), "__range": F.substring(hash_key(seed, row_id), 1, digits)}
    )
    return (
        named.groupBy("__group", "__range")
        .agg(F.count(F.lit(1)).alias("__rows"))
        .withColumn("__offset", F.coalesce(F.sum("__rows").over(before), F.lit(0)))
        .withColumn("__total", F.sum("__rows").over(Window.partitionBy("__group")))
    )


def hash_rank(
    df: DataFrame,
    seed,
    row_id: str,
    by=(),
    rank: str = "rn",
    total: str | None = None,
    extra: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """1-based rank of each row within its group, ordered by digest, then id.

    ``extra`` (one row per group, without NULL keys) is attached together with
    the offsets, so that it costs no additional join on the rows. ``rows`` is
    the size of the table where it is known.
    """
    by = list(by)
    rows = df.select(row_id).count() if rows is None else rows
    digits = range_digits(rows)
    offsets = hash_ranges(df, seed, row_id, by, digits)
    if extra is not None:  # by the groups' text: the counts carry no other column, and hash
        extra = extra.withColumn("__group", group_key(by)).drop(*by)
        offsets = attach(offsets, extra, ["__group"])
    offsets = offsets.drop("__rows")
    if total is None:
        offsets = offsets.drop("__total")
    keyed = df.withColumns(
        {"__key": hash_key(seed, row_id), "__group": group_key(by)}
    ).withColumn("__range", F.substring("__key", 1, digits))
    inside = Window.partitionBy("__group", "__range").orderBy("__key", row_id)
    ranked = keyed.withColumn("__rn", F.row_number().over(inside))
    out = attach(ranked, offsets, ["__group", "__range"]).withColumn(
        rank, (F.col("__offset") + F.col("__rn")).cast("long")
    )
    if total is not None:
        out = out.withColumnRenamed("__total", total)
    return out.drop("__key", "__group", "__range", "__rn", "__offset")


def count_ranges(df: DataFrame) -> int:
    """Ranges for the counted rows, at least one per task that runs at a time."""
    rows = df.count()
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / RANGE_ROWS))


def value_ranges(df: DataFrame, by, order: str, ranges: int | None = None) -> DataFrame:
    """Add ``__group`` and ``__range``, ascending with ``order`` inside a group.

    The ranges are Spark's range partitions of (group, value), so a group with
    most of the rows is cut like any other. The table is written with them:
    what follows sees fixed ranges, however often it is read.
    """
    keyed = df.withColumn("__group", group_key(by))
    if ranges is None:
        keyed = materialize(keyed, "unordered")
        ranges = count_ranges(keyed)
    parted = keyed.repartitionByRange(ranges, "__group", order)
    return materialize(parted.withColumn("__range", F.spark_partition_id()), "ordered")


def range_offsets(ranged: DataFrame, before: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """Per group and range: sums over the ranges before it, and over the group."""
    earlier = (
        Window.partitionBy("__group")
        .orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy("__group")
    sums = ranged.groupBy("__group", "__range").agg(
        *[c.alias(f"__a_{n}") for n, c in before.items()],
        *[c.alias(f"__t_{n}") for n, c in totals.items()],
    )
    return sums.select(
        "__group",
        "__range",
        *[F.coalesce(F.sum(f"__a_{n}").over(earlier), F.lit(0)).alias(n) for n in before],
        *[F.sum(f"__t_{n}").over(whole).alias(n) for n in totals],
    )


def running_total(
    df: DataFrame,
    by,
    order: str,
    amounts: dict[str, str],
    totals: dict[str, str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """Running sum of the rows before each row, ordered by a value.

    ``df`` holds distinct ``(by, order)`` pairs. ``amounts`` maps a column to
    the name of its exclusive running sum; ``totals`` maps a column to the name
    of its group sum.
    """
    totals = totals or {}
    ranged = value_ranges(df, list(by), order, ranges)
    offsets = range_offsets(
        ranged,
        {f"__before_{c}": F.sum(c) for c in amounts},
        {name: F.sum(c) for c, name in totals.items()},
    )
    inside = (
        Window.partitionBy("__group", "__range")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    local = ranged.select(
        "*",
        *[F.coalesce(F.sum(c).over(inside), F.lit(0)).alias(f"__local_{c}") for c in amounts],
    )
    out = attach(local, offsets, ["__group", "__range"])
    return out.select(
        *df.columns,
        *[
            (F.col(f"__before_{c}") + F.col(f"__local_{c}")).alias(name)
            for c, name in amounts.items()
        ],
        *totals.values(),
    )


def value_rank(df: DataFrame, value: str, row_id: str, rank: str, ranges: int | None = None) -> DataFrame:
    """1-based rank of each row of the table by ``value``, then id."""
    keyed = df.withColumn("__pair", F.struct(value, row_id))
    ranged = value_ranges(keyed, [], "__pair", ranges)
    offsets = range_offsets(ranged, {"__offset": F.count(F.lit(1))}, {})
    inside = Window.partitionBy("__group", "__range").orderBy("__pair")
    ranked = ranged.withColumn("__rn", F.row_number().over(inside))
    return (
        attach(ranked, offsets, ["__group", "__range"])
        .withColumn(rank, F.col("__offset") + F.col("__rn"))
        .drop("__pair", "__group", "__range", "__rn", "__offset")
    )
