"""Array expressions: fixed width, norms, sorted lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pad(vector: Column, width: int = 100) -> Column:
    """Fixed-width vector: zeros on the right; surplus features are an error."""
    surplus = F.raise_error(F.format_string(f"%d features do not fit into {width}", F.size(vector)))
    filled = F.slice(F.concat(vector, F.array_repeat(F.lit(0.0), width)), 1, width)
    return F.when(F.size(vector) > width, surplus).otherwise(filled)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def argmax(a: Column) -> Column:
    """Zero-based position of the first maximum."""
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def upper_bound(sorted_array: Column, value: Column, steps: int = 10) -> Column:
    """Number of elements ``<= value`` in an ascending array of fewer than
    ``2 ** steps`` elements: a binary search of ``steps`` comparisons."""

    def step(found: Column, width: Column) -> Column:
        probe = found + width
        # Past the end ``get`` is NULL, which is not ``<=``.
        return F.when(F.get(sorted_array, probe - 1) <= value, probe).otherwise(found)

    widths = F.array(*[F.lit(1 << i) for i in reversed(range(steps))])
    return F.aggregate(widths, F.lit(0), step)


def with_upper_bound(
    df: DataFrame, searches: dict[str, tuple[Column, Column]], size: int
) -> DataFrame:
    """Add, per name, the number of elements ``<= value`` of an ascending array
    of at most ``size`` elements.

    A binary search by projections, one comparison each. Unlike a higher-order function they
    stay in generated code, and the arrays are not copied from one operator to the next; unlike
    projections of many comparisons their methods are small enough for the JVM to compile.
    """
    rounds = max(1, size.bit_length())
    for round_ in range(rounds):
        width = 1 << (rounds - 1 - round_)
        columns = []
        for name, (array, value) in searches.items():
            found = F.lit(0) if round_ == 0 else F.col(f"__{round_ - 1}_{name}")
            # Past the end ``get`` is NULL, which is not ``<=``.
            more = F.when(F.get(array, found + (width - 1)) <= value, width).otherwise(0)
            columns.append((found + more).alias(f"__{round_}_{name}"))
        kept = [c for c in df.columns if not (round_ and c in {f"__{round_ - 1}_{n}" for n in searches})]
        df = df.select(*[F.col(f"`{c}`") for c in kept], *columns)
    return df.withColumnsRenamed({f"__{rounds - 1}_{n}": n for n in searches})
