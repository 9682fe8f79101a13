"""Description of a labelled table: which column plays which role."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableSpec:
    """Column roles of a labelled table."""

    target: str
    row_id: str
    numeric: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    name: str = ""

    @property
    def features(self) -> tuple[str, ...]:
        return self.numeric + self.categorical

    def check(self, df: DataFrame) -> None:
        """Raise if the input is not a table or lacks a declared column."""
        if not isinstance(df, DataFrame):
            raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
        missing = [
            c for c in (self.row_id, self.target, *self.features) if c not in df.columns
        ]
        if missing:
            raise KeyError(f"columns not in the table: {missing}")


def nan_to_null(df: DataFrame) -> DataFrame:
    """Replace NaN by NULL in every floating-point column."""
    return df.select(
        *[
            F.nullif(F.col(f"`{f.name}`"), F.lit(float("nan")).cast(f.dataType)).alias(f.name)
            if isinstance(f.dataType, (T.DoubleType, T.FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
