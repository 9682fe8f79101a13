"""Enlarge training rows from their neighbours; validation and test rows stay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.hashing import uniform
from foldsmith.operators.clean import impute_simple
from foldsmith.operators.neighbours import knn_join, neighbour_aggregate, vector
from foldsmith.operators.ranking import attach, running_total
from foldsmith.operators.schema import binarize_target, union_rows
from foldsmith.session import materialize
from foldsmith.spec import TableSpec

FOLD = ["fold_id"]


def neighbour_rows(
    queries: DataFrame,
    train: DataFrame,
    spec: TableSpec,
    k: int = 5,
    metric: str = "minkowski",
    aggregation: str = "median",
    include_target: bool = False,
    multi_class: bool = False,
    seed=42,
) -> DataFrame:
    """One row per query, made of its k nearest training rows of the same fold.

    The label takes no part in the distance unless ``include_target`` is set.
    Returns ``(fold_id, q_id, features, target)``.
    """
    features = list(spec.features)
    used = features + ([spec.target] if include_target else [])
    q = queries.select("fold_id", F.col(spec.row_id).alias("q_id"), vector(used).alias("vec"))
    s = train.select("fold_id", F.col(spec.row_id).alias("s_id"), vector(used).alias("vec"))
    found = knn_join(q, s, k, metric, by=FOLD)
    values = train.select(
        "fold_id", F.col(spec.row_id).alias("s_id"), *features, spec.target
    )
    return neighbour_aggregate(
        found,
        values,
        [*features, spec.target],
        aggregation,
        FOLD,
        seed,
        majority=(spec.target,) if multi_class else (),
    )


def augment_knn(
    df: DataFrame,
    spec: TableSpec,
    query_role: str = "test",
    k: int = 5,
    metric: str = "minkowski",
    aggregation: str = "median",
    include_target: bool = False,
    multi_class: bool = False,
    queries: DataFrame | None = None,
) -> DataFrame:
    """Training rows of every fold plus one made-up row per query row.

    Queries are the rows of ``query_role``, or the given table. Numeric columns
    become doubles. ``origin`` tells the two kinds apart.
    """
    columns = ["fold_id", spec.row_id, *spec.features, spec.target]
    train = df.filter(F.col("role") == "train").select(*columns)
    if queries is None:
        queries = df.filter(F.col("role") == query_role)
    made = neighbour_rows(
        queries, train, spec, k, metric, aggregation, include_target, multi_class
    ).withColumnRenamed("q_id", spec.row_id)
    doubles = [F.col(c).cast("double").alias(c) for c in (*spec.features, spec.target)]
    return union_rows(
        train.select("fold_id", spec.row_id, *doubles),
        made.select("fold_id", spec.row_id, *doubles),
        origins=("train", "neighbours"),
    )


def augment_dataset(
    df: DataFrame,
    spec: TableSpec,
    k: int = 5,
    metric: str = "minkowski",
    aggregation: str = "median",
    include_target: bool = False,
    multi_class: bool = False,
    queries: DataFrame | None = None,
    query_role: str = "test",
) -> DataFrame:
    """Impute, add neighbour rows, check for NULL and make the label 0/1 again.

    With more than two classes the label is the majority of the neighbours and
    stays as it is.
    """
    roles = df.filter(F.col("role").isin("train", query_role)) if queries is None else (
        df.filter(F.col("role") == "train")
    )
    frame = roles
    if queries is not None:
        frame = roles.unionByName(
            queries.select(*[c for c in roles.columns if c != "role"], F.lit("query").alias("role"))
        )
    filled = impute_simple(frame, list(spec.features), [])
    out = augment_knn(
        filled,
        spec,
        "query" if queries is not None else query_role,
        k,
        metric,
        aggregation,
        include_target,
        multi_class,
    )
    label = F.col(spec.target)
    if not multi_class:
        label = binarize_target(label)
    checked = [
        F.coalesce(
            F.col(c), F.raise_error(F.lit(f"NULL in {c} after augmentation")).cast("double")
        ).alias(c)
        for c in spec.features
    ]
    return out.select(
        "fold_id", spec.row_id, *checked, label.cast("int").alias(spec.target), "origin"
    )


def retrieval_candidates(
    queries: DataFrame,
    train: DataFrame,
    spec: TableSpec,
    k: int,
    weight: float,
    source: str,
    include_target: bool,
) -> DataFrame:
    """Mean of the k cosine neighbours of each query, with a sampling weight."""
    made = neighbour_rows(
        queries, train, spec, k, "cosine", "mean", include_target=include_target
    )
    return made.select(
        "fold_id",
        F.concat_ws(":", F.lit(source), F.col("q_id").cast("string")).alias("candidate"),
        *spec.features,
        spec.target,
        F.lit(weight).alias("weight"),
    )


def room(train: DataFrame, cap: int | None, share: float | None) -> DataFrame:
    """Rows that each fold may gain, as ``__needed``: up to ``cap``, or a ``share`` more."""
    if (cap is None) == (share is None):
        raise ValueError("give either cap or share")
    n = F.count(F.lit(1))
    if cap is not None:
        needed = F.greatest(F.lit(0), F.lit(cap) - n)
    else:
        needed = F.floor(F.round(F.lit(float(share)) * n, 9))
    return train.groupBy("fold_id").agg(needed.cast("long").alias("__needed"))


def augment_rag(
    df: DataFrame,
    synthetic: DataFrame,
    spec: TableSpec,
    cap: int | None = None,
    share: float | None = None,
    k: int = 10,
    weights: tuple[float, float] = (0.3, 0.7),
    seed=42,
) -> DataFrame:
    """Training rows plus a weighted sample of retrieved neighbour means.

    Candidates are the means around the synthetic rows (label included in the
    distance) and around the validation and test features (label left out).
    Each fold is filled up to ``cap`` rows, or gains ``share`` of its training rows;
    one of the two is given. Folds without room take no part in the joins. The helper
    weight is not kept.
    """
    train = df.filter(F.col("role") == "train")
    needed = materialize(room(train, cap, share), "room")
    open_folds = needed.filter(F.col("__needed") > 0).select("fold_id")
    doubles = [F.col(c).cast("double").alias(c) for c in (*spec.features, spec.target)]
    kept = train.select(
        "fold_id", F.col(spec.row_id).cast("string").alias(spec.row_id), *doubles
    )
    if not open_folds.limit(1).count():
        return kept.withColumn("origin", F.lit("train"))
    pool = train.join(open_folds, "fold_id", "left_semi")
    synthetic = synthetic.join(open_folds, "fold_id", "left_semi")
    unknown = df.filter(F.col("role").isin("val", "test")).join(open_folds, "fold_id", "left_semi")
    around_synthetic = retrieval_candidates(
        synthetic, pool, spec, k, weights[0], "synthetic", True
    )
    around_unknown = retrieval_candidates(
        unknown, pool, spec, k, weights[1], "unknown", False
    )
    candidates = union_rows(around_synthetic, around_unknown)
    sampled = weighted_per_group(candidates, needed, "candidate", "weight", FOLD, seed)
    return union_rows(
        kept,
        sampled.select("fold_id", F.col("candidate").alias(spec.row_id), *doubles),
        origins=("train", "retrieved"),
    )


def weighted_per_group(
    df: DataFrame, needed: DataFrame, row_id: str, weight: str, by, seed=42
) -> DataFrame:
    """Weighted sample without replacement of ``__needed`` rows in every group.

    The rows of a group are ordered by draw within ranges of the draw, so a
    group of any size is never sorted in one task.
    """
    drawn = df.withColumn(
        "__draw", F.struct((-F.ln(uniform(seed, *by, row_id)) / F.col(weight)).alias("d"), F.col(row_id))
    ).withColumn("__one", F.lit(1).cast("long"))
    ranked = running_total(drawn, by, "__draw", {"__one": "__before"})
    limited = attach(ranked, needed, by)
    return limited.filter(F.col("__before") < F.col("__needed")).select(*df.columns)

