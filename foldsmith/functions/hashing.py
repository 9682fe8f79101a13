"""Random decisions that depend on a seed and a key only.

``rand(seed)`` changes with the partitioning of its input. A digest of
``seed:key`` does not, so every draw survives re-computation of a lost task.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def hash_key(seed, *keys: str | Column) -> Column:
    """Hex digest of ``seed:key1:key2...``."""
    parts = [as_col(k).cast("string") for k in keys]
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *parts))


def hex_uniform(digest: Column, word: int = 0) -> Column:
    """Uniform in (0, 1) from one of the four 8-digit words of a digest."""
    number = F.conv(F.substring(digest, 1 + 8 * word, 8), 16, 10).cast("double")
    return (number + F.lit(0.5)) / F.lit(4294967296.0)


def uniform(seed, *keys: str | Column) -> Column:
    return hex_uniform(hash_key(seed, *keys))
