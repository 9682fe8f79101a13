"""Joins whose plan does not depend on the size of the tables.

``looked_up`` joins wide rows (texts) with a written table. A bitmap of the table's keys, of
at most ``MOST_BITS`` bits, is broadcast; rows whose bit is not set have no match and stay
where they are. Only the others are shuffled, and every row at most once. ``balanced`` joins
narrow rows by sorting. In both, keys that a large part of the rows share (at most ``HEAVY``
by arithmetic, as each has more than 1/``HEAVY`` of all) are broadcast instead, so no task
receives them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.session import materialize

LEAST_BITS = 1 << 20
MOST_BITS = 1 << 28  # 32 MB
BITS_A_ROW = 32
HEAVY = 1000


def heavy_rows(side: DataFrame, weight: str) -> DataFrame | None:
    """Rows with more than 1/HEAVY of the weight, hinted for broadcast; None if there are none."""
    total = side.agg(F.sum(weight)).first()[0] or 0
    heavy = side.where(F.col(weight) * HEAVY > total)
    return F.broadcast(heavy) if heavy.limit(1).count() else None


def sieve(side: DataFrame, keys: list[str], bits: int) -> DataFrame:
    """Bitmaps of the digests of all keys: slot, bits (4 KB each)."""
    rows = side.select((F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1).alias("at"))
    made = rows.groupBy(F.bitmap_bucket_number("at").alias("__slot")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__bits")
    )
    return F.broadcast(materialize(made, "sieve"))


def bit_set(at: Column, bits: Column) -> Column:
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(bits, (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10)
    return F.coalesce(F.getbit(byte.cast("int"), (place % 8).cast("int")) == 1, F.lit(False))


def looked_up(
    rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left", weight: str | None = None
) -> DataFrame:
    """``rows`` with the columns of ``side`` (one row a key, NULL equal to NULL), ``how`` left or inner.

    Both have the key columns, of the same types; other columns must not clash. ``weight`` is a
    column of ``side`` that says how many rows a key has.
    """
    given = [c for c in side.columns if c not in keys]
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (BITS_A_ROW * side.count()).bit_length()))
    heavy = heavy_rows(side, weight) if weight else None
    named = side.withColumnsRenamed({k: f"__k_{k}" for k in keys})
    same = [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]
    flagged = rows.withColumn("__at", F.pmod(F.xxhash64(*keys), F.lit(bits)) + 1)
    flagged = flagged.join(sieve(side, keys, bits), F.bitmap_bucket_number("__at") == F.col("__slot"), "left")
    flagged = flagged.withColumn("__may", bit_set(F.col("__at"), F.col("__bits"))).drop("__at", "__slot", "__bits")
    if heavy is None:
        done = F.lit(False)
        stay = flagged.where(~F.col("__may")).select(
            *rows.columns, *[F.lit(None).cast(side.schema[c].dataType).alias(c) for c in given]
        )
    else:
        done = F.col("__done")
        marked = F.broadcast(heavy.withColumnsRenamed({k: f"__k_{k}" for k in keys}).withColumn("__is", F.lit(True)))
        flagged = flagged.join(marked, same, "left").withColumn("__done", F.coalesce("__is", F.lit(False)))
        stay = flagged.where(done if how == "inner" else done | ~F.col("__may")).select(*rows.columns, *given)
    move = flagged.where(F.col("__may") & ~done).select(*rows.columns)
    moved = move.join(named.hint("merge"), same, how).select(*rows.columns, *given)
    return moved if how == "inner" and heavy is None else moved.unionByName(stay)


def balanced(left: DataFrame, right: DataFrame, keys: list[str], weight: str, how: str = "inner") -> DataFrame:
    """An inner or left_semi join with a written table that has one row a key, without NULL keys."""
    heavy = heavy_rows(right, weight)
    right = right.drop(weight) if how == "left_semi" else right
    if heavy is None:
        return left.join(right.hint("merge"), keys, how)
    rest = left.join(F.broadcast(heavy.select(keys)), keys, "left_anti").join(right.hint("merge"), keys, how)
    return left.join(F.broadcast(heavy), keys, how).unionByName(rest)
