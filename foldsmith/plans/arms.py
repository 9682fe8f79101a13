"""Augmentation arms: every arm starts from the same untouched fold."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foldsmith.operators.clean import impute_synth_prep
from foldsmith.operators.augment import augment_dataset, augment_rag, room
from foldsmith.operators.gan import GanModel
from foldsmith.operators.ranking import hash_rank
from foldsmith.operators.schema import drop_missing_target, union_rows
from foldsmith.operators.splits import size_budget
from foldsmith.operators.synth import CopulaModel
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.session import materialize
from foldsmith.spec import TableSpec


def augment_none(df: DataFrame, spec: TableSpec, **_) -> DataFrame:
    """Training rows as they are."""
    doubles = [F.col(c).cast("double").alias(c) for c in spec.features]
    return df.filter(F.col("role") == "train").select(
        "fold_id",
        F.col(spec.row_id).cast("string").alias(spec.row_id),
        *doubles,
        F.col(spec.target).cast("int").alias(spec.target),
        F.lit("train").alias("origin"),
    )


def augment_neighbours(df: DataFrame, spec: TableSpec, **options) -> DataFrame:
    """Training rows plus neighbour rows of the test features."""
    out = augment_dataset(df, spec, **options)
    return out.withColumn(spec.row_id, F.col(spec.row_id).cast("string"))


def augment_synthetic(
    df: DataFrame,
    spec: TableSpec,
    cap: int | None = None,
    share: float | None = None,
    seed=42,
) -> DataFrame:
    """Training rows plus synthetic rows, up to ``cap`` rows a fold or ``share`` of its
    training rows more. The fit takes all training rows, missing values filled as
    :func:`impute_synth_prep` does. Folds without room gain none."""
    plain = augment_none(df, spec)
    train = df.filter(F.col("role") == "train")
    wanted = materialize(room(train, cap, share), "room").filter(F.col("__needed") > 0)
    wanted = wanted.withColumnRenamed("__needed", "n")
    if not wanted.limit(1).count():
        return plain
    rows = train.select("fold_id", *spec.features, spec.target)
    rows = rows.join(F.broadcast(wanted.select("fold_id")), "fold_id", "left_semi")
    filled = impute_synth_prep(rows, spec.numeric, spec.categorical)
    made = CopulaModel.fit(materialize(filled, "filled"), spec).sample(wanted, seed)
    made = made.select(
        "fold_id",
        F.concat(F.lit("synthetic:"), F.col("synth_id").cast("string")).alias(spec.row_id),
        *[F.col(c).cast("double").alias(c) for c in spec.features],
        F.col(spec.target).cast("int").alias(spec.target),
        F.lit("synthetic").alias("origin"),
    )
    return union_rows(plain, made)


def augment_retrieval(
    df: DataFrame,
    spec: TableSpec,
    synthetic: DataFrame | None = None,
    cap: int | None = None,
    share: float | None = None,
    **options,
) -> DataFrame:
    """Weighted sample of neighbour means around synthetic and unlabelled rows.

    Each fold is filled up to ``cap`` rows, or gains ``share`` of its training rows.
    """
    if synthetic is None:
        train = df.filter(F.col("role") == "train")
        wanted = materialize(room(train, cap, share), "room").filter(F.col("__needed") > 0)
        wanted = wanted.withColumnRenamed("__needed", "n")
        train = train.join(wanted.select("fold_id"), "fold_id", "left_semi")
        if not wanted.limit(1).count():
            return augment_rag(df, train, spec, cap=cap, share=share, **options)
        model = CopulaModel.fit(train.select("fold_id", *spec.features, spec.target), spec)
        synthetic = model.sample(wanted).withColumnRenamed("synth_id", spec.row_id)
    return augment_rag(df, synthetic, spec, cap=cap, share=share, **options)


def topup(
    raw: DataFrame,
    settings: Preprocessor,
    cap: int,
    k: int = 5,
    seed=42,
    refit: bool = True,
    epochs: int = 100,
    batch_size: int = 128,
) -> DataFrame:
    """Fill every fold's training rows up to ``cap``.

    ``raw`` is the fold-long table before preprocessing. A fold whose training
    and test rows stay below the cap gains, one after the other, neighbour rows
    of its test features, of synthetic rows, and of the test features again,
    each taken from the rows gathered so far. The synthetic rows are those of a
    generative adversarial network (:class:`GanModel`) trained on the fold's raw
    training rows, as many as the fold has room for. They go through a chain
    fitted on themselves, or without ``refit`` through that of the training rows,
    and where they would pass the cap they are sampled down to the room. Folds at
    or over the cap keep their training rows.
    """
    model = settings.fit(raw)
    spec = model.output_spec
    base = materialize(model.transform(raw), "base")
    multi_class = model.labels.select("code").distinct().limit(3).count() > 2
    plain = augment_none(base, spec)
    budget = materialize(size_budget(base, ["fold_id"], cap).drop("budget_train"), "room")
    open_folds = budget.filter(F.col("budget") > 0)
    if not open_folds.limit(1).count():
        return plain

    def of_open(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(open_folds.select("fold_id")), "fold_id", "left_semi")

    # The networks learn the raw training rows, without the columns that the chain drops, and
    # their rows take a chain of the same settings.
    given = replace(settings.spec, categorical=tuple(model.categorical))
    train = drop_missing_target(raw, given.target).filter(F.col("role") == "train")
    train = materialize(of_open(train.select("fold_id", given.row_id, *given.features, given.target)), "gan-train")
    gan = GanModel.fit(train, given, epochs=epochs, batch_size=batch_size, seed=seed)
    made = gan.sample(open_folds.select("fold_id", F.col("budget").alias("n")))
    made = materialize(made.withColumnRenamed("synth_id", given.row_id), "synthetic")
    dropped = {c: F.lit(None).cast(raw.schema[c].dataType) for c in settings.spec.features if c not in made.columns}
    as_rows = made.withColumns({"role": F.lit("train"), **dropped})
    chain = settings.fit(as_rows) if refit else model
    prepared = _sampled(chain.transform(as_rows), budget, spec.row_id, cap, seed)
    # A column that the chain of the synthetic rows drops is missing there.
    for c in spec.features:
        if c not in prepared.columns:
            prepared = prepared.withColumn(c, F.lit(None).cast("double"))
    test = of_open(base).filter(F.col("role") == "test")
    grown = of_open(plain)
    for origin, queries in (("test", test), ("synthetic", prepared), ("test again", test)):
        grown = materialize(_grow(grown, queries, spec, origin, k, multi_class), "grown")
    full = plain.join(F.broadcast(open_folds.select("fold_id")), "fold_id", "left_anti")
    return union_rows(full, grown)


def _sampled(rows: DataFrame, budget: DataFrame, row_id: str, cap: int, seed=42) -> DataFrame:
    """Rows of every fold, or where they would lift its training rows over the cap, as many of
    them as its budget, drawn by digest. ``budget`` is that of :func:`size_budget`."""
    sizes = budget.select("fold_id", F.col("n_train").alias("__train"), F.col("budget").alias("__budget"))
    ranked = hash_rank(rows, seed, row_id, ["fold_id"], rank="__rank", total="__n", extra=sizes)
    over = F.col("__train") + F.col("__n") > F.lit(cap)
    return ranked.filter(~over | (F.col("__rank") <= F.col("__budget"))).select(*rows.columns)


def _grow(
    rows: DataFrame, queries: DataFrame, spec: TableSpec, origin: str, k: int, multi_class: bool
) -> DataFrame:
    """Rows plus one neighbour row per query, its id marked with the origin."""
    marked = queries.select(
        "fold_id",
        F.concat_ws(":", F.lit(origin), F.col(spec.row_id).cast("string")).alias(spec.row_id),
        *[F.col(c).cast("double").alias(c) for c in spec.features],
        F.col(spec.target).cast("int").alias(spec.target),
    )
    train = rows.withColumn("role", F.lit("train"))
    out = augment_dataset(
        train.drop("origin"), spec, k=k, multi_class=multi_class, queries=marked
    )
    made = out.filter(F.col("origin") == "neighbours").withColumn("origin", F.lit(origin))
    return union_rows(rows, made)


ARMS: dict[str, Callable[..., DataFrame]] = {
    "none": augment_none,
    "neighbours": augment_neighbours,
    "synthetic": augment_synthetic,
    "retrieval": augment_retrieval,
}


def augment(arm: str, df: DataFrame, spec: TableSpec, **options) -> DataFrame:
    """Augmented training rows of all folds by the arm's name. An unknown name
    leaves the data unchanged. Validation and test rows are never touched."""
    return ARMS.get(arm, augment_none)(df, spec, **options)
