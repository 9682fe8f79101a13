"""Tabular machine-learning data work as Spark DataFrame operators."""

from foldsmith.spec import TableSpec

__all__ = ["TableSpec"]
