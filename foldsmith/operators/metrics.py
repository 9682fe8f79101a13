"""Classification metrics over prediction rows.

Input: run keys, a row id, ``y_true`` (int) and ``probs`` (array of class
probabilities). All metrics are aggregates per run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.functions.arrays import argmax
from foldsmith.operators.ranking import attach, value_ranges

# Fixed value: double-precision machine epsilon, the clip of the log loss.
EPS = 2.220446049250313e-16


def predict_label(df: DataFrame) -> DataFrame:
    """Add ``y_pred``: the first class of maximal probability."""
    return df.withColumn("y_pred", argmax(F.col("probs")))


def confusion(df: DataFrame, keys) -> DataFrame:
    """Counts by run, true and predicted class."""
    return (
        predict_label(df).groupBy(*keys, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))
    )


def accuracy(df: DataFrame, keys) -> DataFrame:
    hit = (F.col("y_true") == argmax(F.col("probs"))).cast("double")
    return df.groupBy(*keys).agg(F.avg(hit).alias("accuracy"))


def _auc_hard(y: Column, p: Column, n: Column) -> Column:
    """(TPR + TNR) / 2 over confusion counts; NULL unless the two classes occur."""
    def rate(true: int, predicted: int) -> Column:
        hits = F.sum(F.when((y == true) & (p == predicted), n))
        return F.try_divide(F.coalesce(hits, F.lit(0)), F.sum(F.when(y == true, n)))

    # A prediction other than 0/1 ranks above 1 in the hard scores, so the
    # two-class formula holds for binary predictions only.
    binary = F.max(F.greatest(y, p)) <= 1
    return F.when(binary, (rate(1, 1) + rate(0, 0)) / 2)


def auc_hard(df: DataFrame, keys) -> DataFrame:
    """AUC of the hard labels; NULL for one class or for more than two."""
    table = confusion(df, keys)
    return table.groupBy(*keys).agg(
        _auc_hard(F.col("y_true"), F.col("y_pred"), F.col("n")).alias("auc")
    )


def class_wins(df: DataFrame, keys) -> DataFrame:
    """Per run and class a: how its rows rank among those of every class by the score of a.

    Gives the keys, ``a``, ``n`` (rows of each true class) and ``wins``: pairs of a row of
    class a and one of class c where the first scores higher, ties counted half. Every
    scheme of AUC follows from these. Scores are counted first, per true class; ordered ranges
    of scores then carry one running sum per class, so neither a large run nor a tied score
    meets in one task, and the rows are ranked once for all classes and schemes.
    """
    keys = list(keys)
    y = F.col("y_true").cast("int")
    rows = df.select(*keys, y.alias("y"), "probs")
    top = rows.agg(F.max(F.greatest(F.size("probs") - 1, "y"))).first()[0]
    classes = range((top if top is not None else 0) + 1)
    each = [F.sum(F.when(F.col("y") == c, 1).otherwise(0)).alias(f"n{c}") for c in classes]
    scored = rows.select(*keys, "y", F.posexplode("probs").alias("a", "score"))
    ranged = value_ranges(scored.groupBy(*keys, "a", "score").agg(*each), [*keys, "a"], "score")
    inside = (
        Window.partitionBy("__group", "__range")
        .orderBy("score")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    own = F.get(F.array(*[F.col(f"n{c}") for c in classes]), F.col("a"))
    local = ranged.select(
        *keys, "a", "__group", "__range", own.alias("own"), *[f"n{c}" for c in classes],
        *[(F.coalesce(F.sum(f"n{c}").over(inside), F.lit(0)) + F.col(f"n{c}") / 2).alias(f"b{c}") for c in classes],
    )
    sums = local.groupBy("__group", "__range").agg(
        *[F.first(c).alias(c) for c in (*keys, "a")],
        F.sum("own").alias("own"),
        *[F.sum(F.col("own") * F.col(f"b{c}")).alias(f"w{c}") for c in classes],
        *[F.sum(f"n{c}").alias(f"n{c}") for c in classes],
    )
    before = (
        Window.partitionBy("__group")
        .orderBy("__range")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    below = {c: F.coalesce(F.sum(f"n{c}").over(before), F.lit(0)).cast("double") for c in classes}
    placed = sums.select(
        *keys, "a", *[f"n{c}" for c in classes],
        *[(F.col(f"w{c}") + F.col("own") * below[c]).alias(f"w{c}") for c in classes],
    )
    return placed.groupBy(*keys, "a").agg(
        F.array(*[F.sum(f"n{c}").cast("double") for c in classes]).alias("n"),
        F.array(*[F.sum(f"w{c}") for c in classes]).alias("wins"),
    )


SCHEMES = ("ovo", "ovr")


def auc_schemes(df: DataFrame, keys, schemes=SCHEMES) -> DataFrame:
    """AUC of the probabilities by several schemes, one column each, from one ranking.

    Macro average over classes or class pairs. Two classes use the probability of class 1.
    ``ovr`` compares each class with all others, ``ovo`` each ordered pair of classes by the
    probability of its first. An undefined comparison, as where a class does not occur, makes
    the result NULL.
    """
    keys = list(keys)
    if not set(schemes) <= set(SCHEMES):
        raise ValueError(f"unknown scheme in {schemes!r}")
    classes = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    rows = class_wins(df, keys).withColumn("__size", F.max("a").over(classes) + 1)  # one row a class
    of, n, own = F.col("a"), F.col("n"), F.get("n", F.col("a"))
    others = F.filter(F.sequence(F.lit(0), F.col("__size") - 1), lambda c: c != of)
    total = lambda part: F.aggregate(others, F.lit(0.0), lambda x, c: x + F.get(F.col(part), c))
    pairs = F.transform(others, lambda c: F.try_divide(F.get("wins", c), own * F.get(n, c)))
    rows = rows.select(
        *keys,
        "a",
        (own > 0).alias("__there"),
        F.try_divide(total("wins"), own * total("n")).alias("ovr"),
        pairs.alias("ovo"),
    )
    present = F.count_if("__there")
    first = F.max(F.when(of == 1, F.get("ovo", F.lit(0))))  # class 1 against class 0
    found = {
        "ovr": F.when(present <= 2, F.max(F.when(of == 1, F.col("ovr")))).when(
            F.count("ovr") == F.count(F.lit(1)), F.avg("ovr")
        ),
        "ovo": F.when(present <= 2, first).when(
            ~F.bool_or(F.exists("ovo", lambda x: x.isNull())),
            F.sum(F.aggregate("ovo", F.lit(0.0), lambda x, y: x + y)) / F.sum(F.size("ovo")),
        ),
    }
    return rows.groupBy(*keys).agg(*[found[s].alias(s) for s in schemes])


def auc_prob(df: DataFrame, keys, multi_class: str = "ovo") -> DataFrame:
    """AUC of the probabilities by one scheme; see ``auc_schemes``."""
    return auc_schemes(df, keys, (multi_class,)).withColumnRenamed(multi_class, "auc")


def _f1_weighted(counts: DataFrame, keys) -> DataFrame:
    """Support-weighted F1 from confusion counts; 0 where precision and recall are."""
    # One row per class: hits, support and predictions, without a join.
    per_class = (
        counts.select(
            *keys,
            "n",
            F.inline(
                F.array(
                    F.struct(F.col("y_true").alias("c"), F.lit(True).alias("is_true")),
                    F.struct(F.col("y_pred").alias("c"), F.lit(False).alias("is_true")),
                )
            ),
            (F.col("y_true") == F.col("y_pred")).alias("hit"),
        )
        .groupBy(*keys, "c")
        .agg(
            F.sum(F.when(F.col("is_true"), F.col("n")).otherwise(0)).alias("support"),
            F.sum(F.when(~F.col("is_true"), F.col("n")).otherwise(0)).alias("predicted"),
            F.sum(F.when(F.col("is_true") & F.col("hit"), F.col("n")).otherwise(0)).alias("hits"),
        )
    )
    f1 = 2 * F.col("hits") / (F.col("support") + F.col("predicted"))
    return per_class.groupBy(*keys).agg(
        (F.sum(f1 * F.col("support")) / F.sum("support")).alias("f1")
    )


def f1_weighted(df: DataFrame, keys) -> DataFrame:
    return _f1_weighted(confusion(df, keys), keys)


def _loss() -> Column:
    p = F.get("probs", F.col("y_true"))
    return -F.ln(F.least(F.greatest(p, F.lit(EPS)), F.lit(1.0 - EPS)))


def log_loss(df: DataFrame, keys) -> DataFrame:
    """Mean negative log probability of the true class, clipped at machine epsilon."""
    return df.groupBy(*keys).agg(F.avg(_loss()).alias("log_loss"))


def metrics_all(df: DataFrame, keys) -> DataFrame:
    """Accuracy, hard-label AUC, weighted F1 and log loss, one row per run.

    One pass over the prediction rows: confusion counts carry the loss sums.
    """
    keys = list(keys)
    counts = (
        predict_label(df)
        .groupBy(*keys, "y_true", "y_pred")
        .agg(F.count(F.lit(1)).alias("n"), F.sum(_loss()).alias("loss"))
    )
    y, p, n = F.col("y_true"), F.col("y_pred"), F.col("n")
    summary = counts.groupBy(*keys).agg(
        (F.sum(F.when(y == p, n).otherwise(0)) / F.sum(n)).alias("accuracy"),
        _auc_hard(y, p, n).alias("auc"),
        (F.sum("loss") / F.sum(n)).alias("log_loss"),
    )
    return attach(summary, _f1_weighted(counts, keys), keys)


def epoch_metrics(batches: DataFrame, keys=("run", "epoch", "metric")) -> DataFrame:
    """Mean over batches per metric; missing batch values do not count."""
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    return batches.groupBy(*keys).agg(F.avg(value).alias("value"))


def best_epoch(log: DataFrame, keys=("run",), min_delta: float = 0.0) -> DataFrame:
    """Epoch of the lowest validation loss and the number of strict improvements.

    ``log`` holds ``epoch`` and ``log_loss``; epoch 0 is the value before
    training. The window runs over the epochs of one training run.
    """
    before = (
        Window.partitionBy(*keys)
        .orderBy("epoch")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    lowest = F.min("log_loss").over(before)
    improved = F.coalesce(F.col("log_loss") < lowest - F.lit(min_delta), F.lit(False))
    return (
        log.withColumn("improved", improved.cast("int"))
        .groupBy(*keys)
        .agg(
            F.min_by("epoch", F.when(F.col("log_loss").isNotNull(), F.struct("log_loss", "epoch"))).alias("best_epoch"),
            F.min("log_loss").alias("log_loss"),
            F.sum("improved").alias("improvements"),
        )
    )
