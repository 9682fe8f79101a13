"""Registered queries and their SQL counterparts, one per operator."""

from foldsmith.queries import (  # noqa: F401
    analytics,
    clean,
    encode,
    metrics,
    models,
    neighbours,
    scale,
    schema,
    sources,
    splits,
    streams,
    synth,
)
from foldsmith.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
