"""Words of a text as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# White space between words, and what a word is made of.
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def words(text: Column) -> Column:
    """All maximal runs of characters that are no white space; NULL text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")
