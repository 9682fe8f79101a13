"""Label, ordinal and one-hot codes fitted on training rows."""

from __future__ import annotations

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foldsmith.operators.foldwise import (
    by_fold,
    codes_by_fold,
    counts_by_fold,
    fold_count,
    has_roles,
    in_training,
)
from foldsmith.operators.ranking import count_ranges, running_total
from foldsmith.operators.stats import FOLD, train_rows, value_counts
from foldsmith.session import BROADCAST_BYTES, broadcast_if_small, materialize

# Indicator columns that one-hot encoding may add; beyond, use OneHotIndices.
MAX_ONE_HOT = 1000


def codes(counts: DataFrame, by) -> DataFrame:
    """0-based position of every value in its group's natural order.

    ``counts`` holds distinct ``(by, value)`` rows. The running count works on
    ranges of values, so a vocabulary of any size is never sorted in one task.
    """
    known = counts.filter(F.col("value").isNotNull()).select(
        *by, "value", F.lit(1).cast("long").alias("one")
    )
    return running_total(known, by, "value", {"one": "code"}).select(
        *by, "value", F.col("code").cast("int").alias("code")
    )


def label_codes(df: DataFrame, target: str) -> DataFrame:
    """Codes of the training labels per fold: ``(fold_id, value, code)``, ordered
    as their type orders them (numbers as numbers)."""
    if has_roles(df):
        # The roles were dealt by class, of which there are at most MAX_CLASSES.
        flagged = df.select(F.col(f"`{target}`").alias("value"), in_training().alias("__flags"))
        classes = (
            flagged.filter(F.col("value").isNotNull())
            .distinct()
            .select("value", F.posexplode("__flags").alias("fold_id", "taken"))
            .filter("taken")
            .select(*FOLD, "value")
            .distinct()
        )
        place = F.row_number().over(Window.partitionBy(*FOLD).orderBy("value"))
        return classes.select(*FOLD, "value", (place - 1).cast("int").alias("code"))
    seen = (
        train_rows(df)
        .filter(F.col(target).isNotNull())
        .groupBy(*FOLD, F.col(target).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return codes(seen, list(FOLD))


def label_encode(df: DataFrame, target: str, fitted: DataFrame | None = None) -> DataFrame:
    """Replace the label by its code; a label unseen in training is an error."""
    if fitted is None:
        fitted = materialize(label_codes(df, target), "label-codes")
    df = by_fold(df)
    table = fitted.select(*FOLD, F.col("value").alias(target), F.col("code").alias("__code"))
    unseen = F.raise_error(
        F.concat(F.lit(f"label of {target} not seen in training: "), F.col(target).cast("string"))
    ).cast("int")
    code = F.when(F.col(target).isNull(), F.lit(None).cast("int")).otherwise(
        F.coalesce(F.col("__code"), unseen)
    )
    joined = df.join(table, [*FOLD, target], "left")
    return joined.select(*[code.alias(c) if c == target else F.col(f"`{c}`") for c in df.columns])


class OrdinalEncoder:
    """Ordinal codes of categorical columns per fold; unseen values become -1.

    The fitted codes are written once and measured. Vocabularies are broadcast
    as long as their sum is within the limit, the others are shuffled.
    """

    def __init__(self, codes_table: DataFrame, columns, sizes: dict[str, int]):
        self.codes = codes_table
        self.columns = list(columns)
        self.sizes = sizes

    @classmethod
    def fit(cls, df: DataFrame, columns, counts: DataFrame | None = None) -> OrdinalEncoder:
        """``counts``, if they are there already, are a written table, that of
        :func:`counts_by_fold` if ``df`` has ``fold_roles``."""
        columns = list(columns)
        if has_roles(df):
            k = fold_count(df)
            if counts is None:
                counts = materialize(counts_by_fold(df, columns, k=k), "value-counts")
            fitted = codes_by_fold(counts, ["column"], k, count_ranges(counts))
        else:
            counts = value_counts(train_rows(df), FOLD, columns) if counts is None else counts
            fitted = codes(counts, [*FOLD, "column"])
        table = materialize(fitted, "codes")
        size = F.sum(F.octet_length("value") + 32).alias("size")
        sizes = {r["column"]: r["size"] for r in table.groupBy("column").agg(size).collect()}
        return cls(table, columns, sizes)

    def transform(self, df: DataFrame, limit: int | None = None) -> DataFrame:
        df = out = by_fold(df)
        small = within({c: self.sizes.get(c, 0) for c in self.columns}, limit)
        for c in self.columns:
            side = self.codes.filter(F.col("column") == c).select(
                *FOLD, F.col("value").alias(f"__{c}"), F.col("code").alias(f"__{c}_code")
            )
            side = F.broadcast(side) if c in small else side
            on = (F.col("__fold") == F.col("fold_id")) & (
                F.col(f"`{c}`").cast("string") == F.col(f"__{c}")
            )
            side = side.withColumnRenamed("fold_id", "__fold")
            out = out.join(side, on, "left").drop("__fold", f"__{c}")
        new = {c: F.coalesce(F.col(f"__{c}_code"), F.lit(-1)) for c in self.columns}
        return out.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns])


def within(sizes: dict[str, int], limit: int | None = None) -> set[str]:
    """The columns, smallest first, whose measured bytes together stay within the limit."""
    taken, total = set(), 0
    for c, size in sorted(sizes.items(), key=lambda item: (item[1], item[0])):
        total += size
        if total > (BROADCAST_BYTES if limit is None else limit):
            break
        taken.add(c)
    return taken


def ordinal_encode(df: DataFrame, columns) -> DataFrame:
    return OrdinalEncoder.fit(df, columns).transform(df)


def vocabulary(df: DataFrame, columns, limit: int = MAX_ONE_HOT) -> dict[str, list[str]]:
    """Sorted values of each column, refused beyond ``limit`` indicator columns."""
    counts = value_counts(df, [], columns).filter(F.col("value").isNotNull())
    rows = counts.select("column", "value").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(
            f"one-hot encoding of {list(columns)} needs more than {limit} columns; "
            "use OneHotIndices or ordinal codes"
        )
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in columns}


def one_hot_encode(df: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """Replace each feature by ``feature_value`` indicators; unknown is all zero."""
    kept = [F.col(f"`{c}`") for c in df.columns if c not in vocab]
    flags = [
        F.coalesce(F.col(f"`{c}`").cast("string") == F.lit(v), F.lit(False))
        .cast("double")
        .alias(f"{c}_{v}")
        for c, values in vocab.items()
        for v in values
    ]
    return df.select(*kept, *flags)


def one_hot_decode(df: DataFrame, vocab: dict[str, list[str]]) -> DataFrame:
    """Replace the indicators of each feature by the value of the largest one."""
    flags = {f"{c}_{v}" for c, values in vocab.items() for v in values}
    kept = [F.col(f"`{c}`") for c in df.columns if c not in flags]
    return df.select(*kept, *[_largest(c, values).alias(c) for c, values in vocab.items()])


def _largest(feature: str, values: list[str]) -> Column:
    scores = F.array(*[F.col(f"`{feature}_{v}`") for v in values])
    names = F.array(*[F.lit(v) for v in values])
    return F.get(names, F.array_position(scores, F.array_max(scores)).cast("int") - 1)


# A value in more than this share of a column's rows is joined by broadcast: at most a
# thousand values a column.
HOT_SHARE = 1000


class OneHotIndices:
    """Sparse one-hot codes for vocabularies of any size.

    The places of all columns form one vector: column after column, values in their order as
    text. A row holds the places of its known values; unknown and missing values have none.
    """

    def __init__(self, vocabulary: DataFrame, columns, sizes: dict[str, int], weights: dict[str, int]):
        self.vocabulary = vocabulary
        self.columns = list(columns)
        self.sizes = sizes
        self.weights = weights

    @classmethod
    def fit(cls, df: DataFrame, columns) -> OneHotIndices:
        """Vocabulary ``(column, value, n, hot, index)`` of ``df``, written once."""
        columns = list(columns)
        counts = materialize(value_counts(df, [], columns), "value-counts")
        totals = {r["column"]: r["n"] for r in counts.groupBy("column").agg(F.sum("n").alias("n")).collect()}
        known = counts.filter(F.col("value").isNotNull()).withColumn("one", F.lit(1).cast("long"))
        coded = running_total(known, ["column"], "value", {"one": "code"}, ranges=count_ranges(counts))
        measured = known.groupBy("column").agg(
            F.count(F.lit(1)).alias("values"), F.sum(F.octet_length("value") + 32).alias("bytes")
        )
        found = {r["column"]: r for r in measured.collect()}  # one row per column
        sizes = {c: found[c]["values"] if c in found else 0 for c in columns}
        start, rows = 0, []
        for c in columns:
            rows.append((c, start, totals.get(c, 0)))
            start += sizes[c]
        places = df.sparkSession.createDataFrame(rows, "column string, start long, total long")
        table = coded.join(F.broadcast(places), "column").select(
            "column",
            "value",
            "n",
            (F.col("n") * HOT_SHARE > F.col("total")).alias("hot"),
            (F.col("start") + F.col("code")).cast("int").alias("index"),
        )
        weights = {c: found[c]["bytes"] if c in found else 0 for c in columns}
        return cls(materialize(table, "vocabulary"), columns, sizes, weights)

    @property
    def width(self) -> int:
        return sum(self.sizes.values())

    def _placed(self, df: DataFrame, limit: int | None) -> DataFrame:
        """Add the place of each column's value, ``__i0`` and so on.

        Vocabularies that together stay within the limit are broadcast. Of the others the hot values are, and
        only rows with other values are shuffled by value; the rest keeps a key of its own.
        """
        out, small = df, within(self.weights, limit)
        for i, c in enumerate(self.columns):
            side = self.vocabulary.filter(F.col("column") == c).select("value", "hot", "index")
            text = F.col(f"`{c}`").cast("string")
            if c in small:
                side = side.select(F.col("value").alias("__v"), F.col("index").alias(f"__i{i}"))
                out = out.join(F.broadcast(side), text == F.col("__v"), "left").drop("__v")
                continue
            hot = side.filter("hot").select(F.col("value").alias("__v"), F.col("index").alias("__hot"))
            cold = side.filter("NOT hot").select(
                F.col("value").alias("__v"), F.lit(0).cast("long").alias("__o"), F.col("index").alias("__cold")
            )
            out = out.join(F.broadcast(hot), text == F.col("__v"), "left").drop("__v")
            apart = F.col("__hot").isNotNull() | text.isNull()
            out = out.withColumns(
                {
                    "__key": F.when(~apart, text).otherwise(""),
                    "__own": F.when(apart, F.monotonically_increasing_id() + 1).otherwise(0),
                }
            )
            out = out.join(
                cold, (F.col("__key") == F.col("__v")) & (F.col("__own") == F.col("__o")), "left"
            ).withColumn(f"__i{i}", F.coalesce("__hot", "__cold"))
            out = out.drop("__v", "__o", "__hot", "__cold", "__key", "__own")
        return out

    def transform(self, df: DataFrame, output: str = "indices", limit: int | None = None) -> DataFrame:
        """Replace the columns by one ascending array of places."""
        places = F.array_compact(F.array(*[F.col(f"__i{i}") for i in range(len(self.columns))]))
        kept = [F.col(f"`{c}`") for c in df.columns if c not in self.columns]
        return self._placed(df, limit).select(*kept, places.alias(output))

    def vectors(self, df: DataFrame, output: str = "features", limit: int | None = None) -> DataFrame:
        """Replace the columns by one sparse Spark ML vector, its places those of
        :meth:`transform`. A column without values is left out of it."""
        start, local, sizes = 0, [], []
        for i, c in enumerate(self.columns):
            n = self.sizes[c]
            if n:
                # A code past the last value stands for none and sets no place.
                code = F.coalesce(F.col(f"__i{i}") - start, F.lit(n)).cast("double")
                local.append(code.alias(f"__c{i}"))
                sizes.append(n)
            start += n
        kept = [c for c in df.columns if c not in self.columns]
        coded = self._placed(df, limit).select(*[F.col(f"`{c}`") for c in kept], *local)
        if not local:
            raise ValueError(f"{self.columns} hold no value")
        names = coded.columns[len(kept):]
        last = df.sparkSession.createDataFrame([tuple(float(n - 1) for n in sizes)], names)
        encoder = OneHotEncoder(
            inputCols=names, outputCols=[f"{c}v" for c in names], handleInvalid="keep"
        ).fit(last)
        joined = VectorAssembler(inputCols=[f"{c}v" for c in names], outputCol="__vector")
        out = joined.transform(encoder.transform(coded))
        return out.select(*[F.col(f"`{c}`") for c in kept], F.col("__vector").alias(output))

    def decode(self, df: DataFrame, indices: str = "indices") -> DataFrame:
        """One row per place of a row: ``column``, ``value`` and ``index`` in place of the array."""
        kept = [F.col(f"`{c}`") for c in df.columns if c != indices]
        long = df.select(*kept, F.explode(indices).alias("index"))
        names = broadcast_if_small(
            self.vocabulary.select("index", "column", "value"), sum(self.weights.values())
        )
        return long.join(names, "index")

