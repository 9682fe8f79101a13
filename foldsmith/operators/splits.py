"""Folds, hold-outs, samples and batches with seeded, order-free draws."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.functions.hashing import hash_key, uniform
from foldsmith.operators.foldwise import ROLES, by_fold
from foldsmith.operators.ranking import hash_rank, value_rank

# Classes of a target column; more than this is not a classification target.
MAX_CLASSES = 100_000

# Up to so many folds, roles are written out fold by fold.
CODED_FOLDS = 10

# Sample sizes up to here use a top-n, where every task passes on n rows; larger
# ones use the distributed rank.
TOP_N_ROWS = 1_000


def class_counts(df: DataFrame, *keys) -> list[tuple]:
    """``(class, ..., rows)`` in class order. A column-pruned, map-side combined
    count; its result is refused beyond ``MAX_CLASSES`` rows. A missing class is
    an error: rows without a label are dropped first."""
    rows = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).limit(MAX_CLASSES + 1).collect()
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification target")
    if any(v is None for r in rows for v in r):
        raise ValueError(f"{keys[0]} has missing values; drop those rows before a stratified split")
    return sorted(tuple(r) for r in rows)


def _class_table(df: DataFrame, target: str, rows, fields: list[T.StructField]) -> DataFrame:
    """Per-class numbers as a local table of checked size."""
    return df.sparkSession.createDataFrame(rows, T.StructType([df.schema[target], *fields]))


def _running(counts: list[int]) -> list[int]:
    return [0, *itertools.accumulate(counts)][: len(counts)]


def stratified_kfold(
    df: DataFrame, target: str, row_id: str, k: int = 5, seed=42
) -> DataFrame:
    """Add ``fold_id``: k disjoint test sets, balanced by class and in size."""
    counts = class_counts(df, target)
    offsets = _running([n for _, n in counts])
    extra = _class_table(
        df,
        target,
        [(y, o) for (y, _), o in zip(counts, offsets, strict=True)],
        [T.StructField("class_offset", T.LongType())],
    )
    n_table = sum(n for _, n in counts)
    ranked = hash_rank(df, seed, row_id, [target], rank="__rank", extra=extra, rows=n_table)
    fold = F.pmod(F.col("class_offset") + F.col("__rank") - 1, F.lit(k))
    return ranked.withColumn("fold_id", fold.cast("int")).drop("__rank", "class_offset")


def _in_fold_before(position: Column, offset: Column, fold: Column, k: int) -> Column:
    """How many of the positions ``0 .. position-1`` of a class fall in a fold."""
    first = F.pmod(fold - offset, F.lit(k))
    return F.greatest(F.lit(0), F.floor((position - first + k - 1) / F.lit(k)))


def validation_quota(rest: list[int], n_table: int, val_size: float) -> list[int]:
    """Validation rows per class: the share of the whole table, split over the
    rows outside the test set by largest remainder."""
    total = sum(rest)
    wanted = min(math.ceil(round(val_size * n_table, 9)), total)
    if not total:
        return [0] * len(rest)
    quota = [wanted * n // total for n in rest]
    by_remainder = sorted(range(len(rest)), key=lambda i: (-(wanted * rest[i] % total), i))
    for i in by_remainder[: wanted - sum(quota)]:
        quota[i] += 1
    return quota


def stratified_holdout(
    df: DataFrame,
    target: str,
    row_id: str,
    test: Column,
    val_size: float = 0.2,
    seed=42,
) -> DataFrame:
    """Add ``role``: rows where ``test`` holds are the test set; of the others
    a stratified ``val_size`` share of the whole table becomes validation."""
    marked = df.withColumn("__test", test)
    counts = class_counts(marked, target, "__test")
    rest = [(y, n) for y, is_test, n in counts if not is_test]
    n_table = sum(n for *_, n in counts)
    quota = validation_quota([n for _, n in rest], n_table, val_size)
    rows = [(y, False, q) for (y, _), q in zip(rest, quota, strict=True)]
    rows += [(y, True, 0) for y, is_test, _ in counts if is_test]
    extra = _class_table(
        marked,
        target,
        rows,
        [marked.schema["__test"], T.StructField("quota", T.LongType())],
    )
    ranked = hash_rank(
        marked, seed, row_id, [target, "__test"], rank="__rank", extra=extra, rows=n_table
    )
    role = (
        F.when(F.col("__test"), "test")
        .when(F.col("__rank") <= F.col("quota"), "val")
        .otherwise("train")
    )
    return ranked.withColumn("role", role).drop("__rank", "quota", "__test")


def kfold_roles(
    df: DataFrame,
    target: str,
    row_id: str,
    k: int = 5,
    val_size: float = 0.2,
    seed=42,
) -> DataFrame:
    """Every row once, with ``fold_roles``: train, val or test in each fold, by position.

    The rows are ranked once. Test folds are cyclic in the rank, so a row's
    rank among the rows outside any fold's test set follows by arithmetic and
    no fold needs a shuffle of its own. Validation windows are shifted by one
    quota per fold, so the folds validate on different rows.
    """
    counts = class_counts(df, target)
    sizes = [n for _, n in counts]
    offsets = _running(sizes)
    n_table = sum(sizes)
    folds: list[list] = [[] for _ in counts]
    for fold in range(k):
        rest = [
            n - max(0, (n - (fold - o) % k + k - 1) // k)
            for n, o in zip(sizes, offsets, strict=True)
        ]
        quota = validation_quota(rest, n_table, val_size)
        for c in range(len(counts)):
            folds[c].append((fold, quota[c], rest[c]))
    entry = T.ArrayType(T.StructType.fromDDL("fold_id int, quota bigint, n_rest bigint"))
    quotas = _class_table(
        df,
        target,
        [(y, o, f) for (y, _), o, f in zip(counts, offsets, folds, strict=True)],
        [T.StructField("class_offset", T.LongType()), T.StructField("__folds", entry)],
    )
    ranked = hash_rank(df, seed, row_id, [target], rank="__rank", extra=quotas, rows=n_table)
    position = F.col("__rank") - 1
    test_fold = F.pmod(F.col("class_offset") + position, F.lit(k))

    def role(fold: Column) -> Column:
        among_rest = position - _in_fold_before(
            position, F.col("class_offset"), fold["fold_id"], k
        )
        turn = F.pmod(
            among_rest - fold["fold_id"] * fold["quota"], F.greatest(fold["n_rest"], F.lit(1))
        )
        return (
            F.when(test_fold == fold["fold_id"], "test")
            .when(turn < fold["quota"], "val")
            .otherwise("train")
        )

    # An array of few roles is generated code; a higher-order function runs node by node.
    few = [role(F.get("__folds", F.lit(fold))) for fold in range(k)] if k <= CODED_FOLDS else None
    roles = F.array(*few) if few else F.transform("__folds", role)
    return ranked.withColumn(ROLES, roles).select(*df.columns, ROLES)


def kfold_long(
    df: DataFrame,
    target: str,
    row_id: str,
    k: int = 5,
    val_size: float = 0.2,
    seed=42,
) -> DataFrame:
    """:func:`kfold_roles` with one row per row and fold: ``fold_id``, ``role``.

    Fits take the shorter form as well and repeat no rows for it.
    """
    return by_fold(kfold_roles(df, target, row_id, k, val_size, seed))


def random_holdout(
    df: DataFrame, row_id: str, test_size: float = 0.6, seed=42
) -> DataFrame:
    """Add ``role``: an unstratified split; the test part is rounded up."""
    ranked = hash_rank(df, seed, row_id, rank="__rank", total="__n")
    n_test = F.ceil(F.round(F.lit(test_size) * F.col("__n"), 9))
    role = F.when(F.col("__rank") <= F.col("__n") - n_test, "train").otherwise("test")
    return ranked.withColumn("role", role).drop("__rank", "__n")


def sample_n(df: DataFrame, row_id: str, n: int, seed=42) -> DataFrame:
    """Exactly ``n`` rows, uniformly, without replacement (all if fewer)."""
    if n <= TOP_N_ROWS:
        return df.orderBy(hash_key(seed, row_id), row_id).limit(max(n, 0))
    ranked = hash_rank(df, seed, row_id, rank="__rank")
    return ranked.filter(F.col("__rank") <= n).drop("__rank")


def sample_weighted(
    df: DataFrame, row_id: str, weight: str, n: int, seed=42
) -> DataFrame:
    """``n`` rows with probability by weight, without replacement.

    Each row draws ``-ln(u) / w`` and the smallest ``n`` draws win
    (Efraimidis and Spirakis 2006). Rows without a positive weight never win;
    with too few candidates all of them are returned.
    """
    drawn = df.filter(F.col(weight) > 0).withColumn(
        "__draw", -F.ln(uniform(seed, row_id)) / F.col(weight)
    )
    if n <= TOP_N_ROWS:
        return drawn.orderBy("__draw", row_id).limit(max(n, 0)).drop("__draw")
    ranked = value_rank(drawn, "__draw", row_id, "__rank")
    return ranked.filter(F.col("__rank") <= n).drop("__draw", "__rank")


def size_budget(df: DataFrame, by, cap: int) -> DataFrame:
    """Rows that may still be added per group without passing ``cap``.

    ``n_train + n_test`` count against the cap, as do the training rows alone.
    """
    role = F.col("role")
    n_train = F.sum(F.when(role == "train", 1).otherwise(0))
    n_test = F.sum(F.when(role == "test", 1).otherwise(0))
    return (
        df.groupBy(*by)
        .agg(n_train.alias("n_train"), n_test.alias("n_test"))
        .withColumn(
            "budget", F.greatest(F.lit(0), F.lit(cap) - F.col("n_train") - F.col("n_test"))
        )
        .withColumn("budget_train", F.greatest(F.lit(0), F.lit(cap) - F.col("n_train")))
    )


def mini_batches(
    df: DataFrame, row_id: str, batch_size: int | str = "full", epoch: int = 0, seed=42
) -> DataFrame:
    """Add ``batch_id``, ``batch_pos`` (0-based) and ``batch_rows`` in a shuffled
    order per epoch; the last batch may be short."""
    ranked = hash_rank(df, f"{seed}:{epoch}", row_id, rank="__rank", total="__n")
    position = F.col("__rank") - 1
    size = F.col("__n") if batch_size == "full" else F.lit(int(batch_size))
    batch = F.floor(position / size)
    return (
        ranked.withColumn("batch_id", batch.cast("long"))
        .withColumn("batch_pos", F.pmod(position, size).cast("long"))
        .withColumn(
            "batch_rows",
            F.least(size, F.col("__n") - F.col("batch_id") * size).cast("long"),
        )
        .drop("__rank", "__n")
    )


def context_query_split(batches: DataFrame, share: float = 0.8) -> DataFrame:
    """Add ``part``: the first ``share`` of each batch is context, the rest query.

    Position and size of the batch are known from ``mini_batches``; no window.
    """
    n_context = F.floor(F.round(F.lit(share) * F.col("batch_rows"), 9))
    return batches.withColumn(
        "part", F.when(F.col("batch_pos") < n_context, "context").otherwise("query")
    )

