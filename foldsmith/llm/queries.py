"""Imports every operator, so that its query is registered."""

from foldsmith.llm import (  # noqa: F401
    chat,
    decontam,
    importance,
    licenses,
    mixture,
    packing,
    pii,
    quality,
    simhash,
    substrings,
    suffix_trees,
    vector_codes,
    warc,
)
from foldsmith.llm.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
