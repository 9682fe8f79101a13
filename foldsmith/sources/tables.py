"""Labelled tables and supplied splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.operators.schema import classify_columns
from foldsmith.spec import TableSpec, nan_to_null


def read_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header. Types are inferred only when no schema is given,
    because inference reads the whole input once more."""
    reader = spark.read.option("header", True)
    if schema is None:
        return reader.option("inferSchema", True).csv(path)
    return reader.schema(schema).csv(path)


def load_task(
    table: DataFrame,
    target: str,
    row_id: str,
    categorical: dict[str, bool] | None = None,
    name: str = "",
) -> tuple[DataFrame, TableSpec]:
    """A table together with its column roles; NaN is read as NULL.

    Declared and detected categorical columns are marked in the field metadata.
    """
    features = table.drop(row_id)
    cat, num = classify_columns(features, target, categorical)
    spec = TableSpec(target, row_id, tuple(num), tuple(cat), name)
    spec.check(table)
    clean = nan_to_null(table)
    return clean.select(
        *[
            F.col(f"`{c}`").alias(c, metadata={"kind": "categorical"})
            if c in cat
            else F.col(f"`{c}`")
            for c in clean.columns
        ]
    ), spec


def predefined_split(df: DataFrame, splits: DataFrame, row_id: str) -> DataFrame:
    """Rows of ``df`` once per repeat, fold and sample with the given role.

    ``splits`` holds ``(row_id, repeat, fold, sample, role)``.
    """
    return df.join(splits, row_id)
