"""Projections, predicates and schema rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.functions.arrays import pad
from foldsmith.spec import TableSpec, nan_to_null


def drop_missing_target(df: DataFrame, target: str) -> DataFrame:
    """Remove rows whose label is NULL or NaN."""
    return nan_to_null(df).dropna(subset=[target])


def split_features_label(df: DataFrame, target: str) -> tuple[DataFrame, DataFrame]:
    """(all columns but the label, the label)."""
    if not isinstance(df, DataFrame):
        raise TypeError(f"expected a DataFrame, got {type(df).__name__}")
    if target not in df.columns:
        raise KeyError(f"target {target!r} is not a column of the table")
    return df.drop(target), df.select(target)


def profile_dataset(df: DataFrame, target: str, features) -> DataFrame:
    """One row: rows, feature columns, classes.

    The classes are counted from a map-side combined table of class counts.
    """
    return (
        df.groupBy(target)
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum("n").alias("number_rows"),
            F.lit(len(list(features))).cast("long").alias("number_features"),
            F.count(target).alias("num_classes"),
        )
    )


def classify_columns(
    df: DataFrame,
    target: str,
    indicator: dict[str, bool] | None = None,
    rule: str = "non_numeric",
) -> tuple[list[str], list[str]]:
    """(categorical, numeric) feature columns, in table order.

    The type decides over the supplied indicator. ``non_numeric``: every
    non-numeric type is categorical. ``category``: only columns whose field
    metadata says ``kind = categorical`` are; all others count as numeric.
    Columns named in the indicator but absent from the table are ignored.
    """
    if rule not in ("non_numeric", "category"):
        raise ValueError(f"unknown rule {rule!r}")
    kinds = {
        name: "categorical" if flag else "numeric"
        for name, flag in (indicator or {}).items()
        if name != target and name in df.columns
    }
    for field in df.schema.fields:
        if field.name == target:
            continue
        if rule == "category":
            is_categorical = field.metadata.get("kind") == "categorical"
        else:
            is_categorical = not isinstance(field.dataType, T.NumericType)
        kinds[field.name] = "categorical" if is_categorical else "numeric"
    order = [c for c in df.columns if c in kinds]
    return (
        [c for c in order if kinds[c] == "categorical"],
        [c for c in order if kinds[c] == "numeric"],
    )


def coerce_numeric(df: DataFrame, columns) -> DataFrame:
    """Parse columns as doubles; what does not parse becomes NULL."""
    columns = set(columns)
    return df.select(
        *[
            F.nullif(F.col(f"`{c}`").try_cast("double"), F.lit(float("nan"))).alias(c)
            if c in columns
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def align_schema(df: DataFrame, like: T.StructType) -> DataFrame:
    """Columns of ``like`` in its order: extra ones dropped, missing ones NULL."""
    have = set(df.columns)
    return df.select(
        *[
            F.col(f"`{f.name}`").cast(f.dataType).alias(f.name)
            if f.name in have
            else F.lit(None).cast(f.dataType).alias(f.name)
            for f in like.fields
        ]
    )


def fill_unknown(df: DataFrame, columns=None, value: str = "Unknown") -> DataFrame:
    """Constant fill of missing strings."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.fillna(value, subset=[c for c in strings if columns is None or c in columns])


def binarize_target(label: Column, threshold: float = 0.5) -> Column:
    return F.when(label > threshold, 1).otherwise(0)


def label_abs_int(label: Column) -> Column:
    """Truncate toward zero, then drop the sign."""
    return F.abs(label.try_cast("int"))


def pad_features(df: DataFrame, features, width: int = 100, out: str = "features") -> DataFrame:
    """Gather feature columns into a zero-padded vector of fixed width."""
    features = list(features)
    vector = F.array(*[F.col(c).cast("double") for c in features])
    return df.withColumn(out, pad(vector, width)).drop(*features)


def union_rows(first: DataFrame, *rest: DataFrame, origins=None) -> DataFrame:
    """Append tables by column name, duplicates kept; ``origins`` labels them."""
    frames = [first, *rest]
    if origins is not None:
        frames = [
            f.withColumn("origin", F.lit(o)) for f, o in zip(frames, origins, strict=True)
        ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def concat_columns(left: DataFrame, right: DataFrame, row_id: str) -> DataFrame:
    """Put two tables side by side by row id."""
    return left.join(right, row_id)


def fold_dataset(
    long: DataFrame, spec: TableSpec, fold: int, role: str
) -> tuple[DataFrame, DataFrame]:
    """(features, label) of one role of one fold, both with the row id."""
    part = long.filter((F.col("fold_id") == fold) & (F.col("role") == role))
    return (
        part.select(spec.row_id, *spec.features),
        part.select(spec.row_id, spec.target),
    )


def select_results(
    results: DataFrame, metric: str, dataset_id=None, keys=("model_name",)
) -> DataFrame:
    """Keys and one metric of the result rows, missing values dropped."""
    if dataset_id is not None:
        results = results.filter(F.col("dataset_id") == dataset_id)
    return nan_to_null(results.select(*keys, metric)).dropna()


def columns_table(spark: SparkSession, categorical, numeric) -> DataFrame:
    """The column classification as rows."""
    rows = [(c, "categorical") for c in categorical] + [(c, "numeric") for c in numeric]
    return spark.createDataFrame(rows, "column string, kind string")
