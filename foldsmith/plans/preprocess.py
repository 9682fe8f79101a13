"""The preprocessing chain: fit on the training rows of all folds, then one plan."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foldsmith.operators.clean import ALL_ROLES, INTEGRAL
from foldsmith.operators.encode import OrdinalEncoder, label_codes, label_encode
from foldsmith.operators.foldwise import (
    ROLES,
    by_fold,
    counts_by_fold,
    fold_count,
    has_roles,
    merged_sums,
    moments_table,
    quantiles_by_fold,
    summary_by_fold,
)
from foldsmith.operators.scale import (
    fit_quantile_normal,
    fit_yeo_johnson,
    maps_of_quantiles,
    power_yeo_johnson,
    quantile_normal,
)
from foldsmith.operators.schema import drop_missing_target
from foldsmith.operators.stats import (
    FOLD,
    column_summary,
    moments,
    train_rows,
    value_counts,
    with_stats,
)
from foldsmith.session import materialize
from foldsmith.spec import TableSpec

TRANSFORMS = ("quantile", "power", "none")


@dataclass(frozen=True)
class Preprocessor:
    """Settings of the chain.

    drop missing target, label codes, drop constant and near-unique columns,
    impute, ordinal codes, outlier filter, standard scaling, distribution
    transform. Input is the fold-long table (``fold_id``, ``role``) or, better, the table
    with every row once and its ``fold_roles``.
    """

    spec: TableSpec
    transform: str = "quantile"
    near_unique: float = 0.95
    outlier_limit: float = 3.0
    impute_roles: tuple[str, ...] = ALL_ROLES
    outlier_roles: tuple[str, ...] = ALL_ROLES
    n_quantiles: int = 1000

    def fit(self, df: DataFrame) -> PreprocessModel:
        """Fit all folds together.

        Five aggregates whatever the number of folds and columns: value
        frequencies, codes, moments, moments after the outlier filter, and the
        distribution transform. What reaches the driver is folds x columns.

        A table with ``fold_roles`` is fitted without a copy of its rows per fold, but for
        ``transform="power"``, whose exponents need each fold's scaled values.
        """
        if self.transform not in TRANSFORMS:
            raise ValueError(f"invalid transform {self.transform!r}")
        spec = self.spec
        spec.check(df)
        data = drop_missing_target(df, spec.target)
        once = has_roles(data)
        k = fold_count(data) if once else 0
        model = PreprocessModel(self)
        model.labels = materialize(label_codes(data, spec.target), "label-codes")

        if spec.categorical:
            if once:
                counts = counts_by_fold(data, spec.categorical, k=k)
            else:
                counts = value_counts(train_rows(data), FOLD, spec.categorical)
            counts = materialize(counts, "value-counts")
            summary = summary_by_fold(counts, k) if once else column_summary(counts, FOLD)
            self._judge_columns(model, summary)
            kept = [c for c in spec.categorical if c in model.categorical]
            model.encoder = OrdinalEncoder.fit(
                data, kept, counts.filter(F.col("column").isin(kept))
            )
        self._fit_numeric(model, data, k)
        if once:
            self._fit_kept(model, data, k)
            if spec.numeric and self.transform == "power":
                scaled = model.scale(model.clean(data))
                model.shape = _small(fit_yeo_johnson(scaled, spec.numeric), scaled)
            return model

        features = model.features
        cleaned = model.clean(data)
        model.scaling = _small(
            moments(train_rows(cleaned), FOLD, features), cleaned
        )
        if spec.numeric and self.transform != "none":
            scaled = model.scale(cleaned)
            if self.transform == "quantile":
                model.shape = materialize(
                    fit_quantile_normal(scaled, spec.numeric, self.n_quantiles), "quantiles"
                )
            else:
                model.shape = _small(fit_yeo_johnson(scaled, spec.numeric), scaled)
        return model

    def _judge_columns(self, model: PreprocessModel, summary: DataFrame) -> None:
        """Constant and nearly unique columns per fold, and the modes."""
        rows = summary.collect()  # folds x columns
        folds = {r.fold_id for r in rows}
        model.dropped = {}
        for r in rows:
            if r.n_distinct <= 1 or r.n_distinct >= self.near_unique * r.n_rows:
                model.dropped.setdefault(r["column"], set()).add(r.fold_id)
        model.categorical = [
            c for c in self.spec.categorical if model.dropped.get(c, set()) != folds
        ]
        for r in rows:
            if r["column"] in model.categorical:
                model.fills.setdefault(r.fold_id, {})[r["column"]] = r["mode"]

    def _fit_numeric(self, model: PreprocessModel, data: DataFrame, k: int) -> None:
        """Fill values and outlier limits after imputation, from one pass.

        With n known values of mean m and variance v, and r rows filled with f,
        the mean and variance of the filled column follow directly.
        """
        numeric = list(self.spec.numeric)
        if not numeric:
            return
        whole = [c for c in numeric if isinstance(data.schema[c].dataType, INTEGRAL)]
        whole_modes = {}
        if whole and k:
            summary = summary_by_fold(counts_by_fold(data, whole, "long", k=k), k)
        elif whole:
            summary = column_summary(value_counts(train_rows(data), FOLD, whole, "long"), FOLD)
        if whole:
            whole_modes = {(r.fold_id, r["column"]): r["mode"] for r in summary.collect()}
        for fold, own in (merged_sums if k else _sums)(data, numeric).items():
            for c in numeric:
                fill = whole_modes[fold, c] if c in whole else own[c][1]
                model.fills.setdefault(fold, {})[c] = fill
                if fill is None:
                    continue
                total, mean, squares = _filled(own, c, fill)
                if total > 1:
                    model.limits[fold, c] = (mean, math.sqrt(squares / (total - 1)))

    def _fit_kept(self, model: PreprocessModel, data: DataFrame, k: int) -> None:
        """Scaling and quantile maps of the imputed rows that the outlier filter keeps, from
        rows that stand once: filled values enter by their number and their one value."""
        spec, kept = self.spec, list(model.categorical)
        numeric, flags = list(spec.numeric), model.kept_flags(k)
        fills = model.fills if "train" in self.impute_roles else {}
        known = merged_sums(data, numeric, flags)
        sums = {
            fold: {c: _filled(own, c, fills.get(fold, {}).get(c)) for c in numeric}
            for fold, own in known.items()
        }
        if kept:
            for fold, column, moments_ in self._code_sums(model, data, fills, flags, k):
                sums[fold][column] = moments_
        for own in sums.values():
            for c in kept:
                own.setdefault(c, (0, None, 0.0))
        model.scaling = moments_table(data, model.features, sums)
        if not numeric or self.transform != "quantile":
            return
        counts = counts_by_fold(data, numeric, "double", flags, k)
        added = [
            (c, float(fills[fold][c]), [own["rows"] - own[c][0] if f == fold else 0 for f in range(k)])
            for fold, own in known.items()
            for c in numeric
            if own["rows"] > own[c][0] and fills.get(fold, {}).get(c) is not None
        ]
        if added:
            counts = counts.unionByName(
                data.sparkSession.createDataFrame(added, "column string, value double, n array<long>")
            )
        scaling = model.scaling.select(
            "fold_id",
            F.inline(
                F.array(
                    *[
                        F.struct(
                            F.lit(c).alias("column"),
                            F.col(f"{c}__mean").alias("mean"),
                            F.col(f"{c}__sd").alias("sd"),
                        )
                        for c in numeric
                    ]
                )
            ),
        )
        quantiles = quantiles_by_fold(counts, k, self.n_quantiles, scaling)
        model.shape = materialize(maps_of_quantiles(quantiles, numeric), "quantiles")

    def _code_sums(self, model: PreprocessModel, data: DataFrame, fills: dict, flags: Column, k: int):
        """``fold, column, (n, mean, squares)`` of the codes of kept training rows, from
        counted values. The sums are exact whole numbers."""
        kept = list(model.categorical)
        counts = counts_by_fold(data, kept, flags=flags, k=k)
        modes = [(f, c, own.get(c)) for f, own in fills.items() for c in kept]
        fill = data.sparkSession.createDataFrame(modes, "fold_id int, column string, fill string")
        coded = (
            counts.select("column", "value", F.posexplode("n").alias("fold_id", "n"))
            .filter(F.col("n") > 0)
            .join(F.broadcast(fill), ["fold_id", "column"], "left")
            .withColumn("value", F.coalesce("value", "fill"))
            .join(model.encoder.codes, ["fold_id", "column", "value"], "left")
            .select(
                "fold_id",
                "column",
                F.col("n").cast("decimal(18,0)").alias("n"),
                F.coalesce("code", F.lit(-1)).cast("decimal(10,0)").alias("code"),
            )
        )
        sums = coded.groupBy("fold_id", "column").agg(
            F.sum("n").alias("n"),
            F.sum(F.col("n") * F.col("code")).alias("first"),
            F.sum(F.col("n") * F.col("code") * F.col("code")).alias("second"),
        )
        for r in sums.collect():  # folds x columns
            if r.fold_id not in model.dropped.get(r["column"], ()):
                n, first, second = int(r.n), int(r.first), int(r.second)
                yield r.fold_id, r["column"], (n, first / n, (second * n - first * first) / n)


def _sums(data: DataFrame, columns) -> dict[int, dict]:
    """As :func:`merged_sums`, of a fold-long table."""
    rows = (
        train_rows(data)
        .groupBy(*FOLD)
        .agg(
            F.count(F.lit(1)).alias("__rows"),
            *[F.count(c).alias(f"{c}__n") for c in columns],
            *[F.avg(c).alias(f"{c}__mean") for c in columns],
            *[F.var_samp(c).alias(f"{c}__var") for c in columns],
        )
        .collect()  # one row per fold
    )
    out = {}
    for r in rows:
        out[r.fold_id] = {"rows": r["__rows"]}
        for c in columns:
            n, mean = r[f"{c}__n"], r[f"{c}__mean"]
            mean = None if mean is None else float(mean)
            out[r.fold_id][c] = (n, mean, (n - 1) * (r[f"{c}__var"] or 0.0))
    return out


def _filled(own: dict, column: str, fill) -> tuple:
    """Number, mean and squares of a column after its missing values became ``fill``."""
    n, mean, squares = own[column]
    total = own["rows"]
    if fill is None or total == n:
        return n, mean, squares
    fill = float(fill)
    if not n:
        return total, fill, 0.0
    filled = (n * mean + (total - n) * fill) / total
    more = n * (mean - filled) ** 2 + (total - n) * (fill - filled) ** 2
    return total, filled, squares + more


def _small(stats: DataFrame, like: DataFrame) -> DataFrame:
    """Fitted rows (folds x columns of numbers) as a local table."""
    return like.sparkSession.createDataFrame(stats.collect(), stats.schema)


@dataclass
class PreprocessModel:
    """Fitted chain. ``transform`` is lazy: joins with small fitted tables and
    projections, no aggregate and no Python."""

    settings: Preprocessor
    categorical: list[str] = field(default_factory=list)
    dropped: dict[str, set[int]] = field(default_factory=dict)
    fills: dict[int, dict] = field(default_factory=dict)
    limits: dict[tuple[int, str], tuple[float, float]] = field(default_factory=dict)
    labels: DataFrame | None = None
    encoder: OrdinalEncoder | None = None
    scaling: DataFrame | None = None
    shape: DataFrame | None = None

    @property
    def features(self) -> list[str]:
        return [*self.settings.spec.numeric, *self.categorical]

    @property
    def output_spec(self) -> TableSpec:
        """Column roles after the chain: every kept feature is numeric."""
        spec = self.settings.spec
        return TableSpec(spec.target, spec.row_id, tuple(self.features), (), spec.name)

    def kept_flags(self, k: int) -> Column:
        """Per fold of a table with ``fold_roles``: training row that the outlier filter keeps."""
        settings = self.settings

        def per_fold(values) -> Column:
            return F.array(*[F.lit(None if v is None else float(v)).cast("double") for v in values])

        bounds = {}
        if "train" in settings.outlier_roles:
            for c in settings.spec.numeric:
                limits = [self.limits.get((f, c), (None, None)) for f in range(k)]
                bounds[c] = (
                    per_fold(self.fills.get(f, {}).get(c) for f in range(k)),
                    per_fold(mid for mid, _ in limits),
                    per_fold(None if sd is None else settings.outlier_limit * sd for _, sd in limits),
                )

        def kept(role: Column, fold: Column) -> Column:
            keep = role == "train"
            for c, (fill, mid, reach) in bounds.items():
                x = F.col(f"`{c}`").cast("double")
                if "train" in settings.impute_roles:
                    x = F.coalesce(x, F.get(fill, fold))
                far = F.abs(x - F.get(mid, fold)) > F.get(reach, fold)
                keep = keep & ~F.coalesce(far, F.lit(False))
            return keep

        return F.transform(ROLES, kept)

    def _fitted(self, df: DataFrame) -> DataFrame:
        """Fill values and limits, one row per fold."""
        numeric = self.settings.spec.numeric
        fields = [T.StructField("fold_id", df.schema["fold_id"].dataType)]
        for c in self.features:
            kind = T.DoubleType() if c in numeric else T.StringType()
            fields.append(T.StructField(f"{c}__fill", kind))
        for c in numeric:
            fields.append(T.StructField(f"{c}__mid", T.DoubleType()))
            fields.append(T.StructField(f"{c}__far", T.DoubleType()))
        rows = []
        for fold, values in self.fills.items():
            row = [fold]
            for c in self.features:
                value = values.get(c)
                row.append(float(value) if c in numeric and value is not None else value)
            for c in numeric:
                mid, sd = self.limits.get((fold, c), (None, None))
                row += [mid, None if sd is None else self.settings.outlier_limit * sd]
            rows.append(tuple(row))
        return df.sparkSession.createDataFrame(rows, T.StructType(fields))

    def clean(self, df: DataFrame) -> DataFrame:
        """Labels, kept columns, imputation, codes, outliers."""
        settings, spec = self.settings, self.settings.spec
        df = by_fold(df)
        base = ["fold_id", "role", spec.row_id]
        data = label_encode(
            drop_missing_target(df, spec.target).select(
                *base, *spec.numeric, *self.categorical, spec.target
            ),
            spec.target,
            self.labels,
        )
        if not self.features:
            return data
        data = with_stats(data, self._fitted(df))
        fill_here = F.col("role").isin(*settings.impute_roles)
        filled = {}
        for c in self.features:
            kind = "double" if c in spec.numeric else "string"
            x = F.col(f"`{c}`").cast(kind)
            x = F.when(x.isNull() & fill_here, F.col(f"{c}__fill")).otherwise(x)
            if c in self.dropped:  # dropped in some folds only
                x = F.when(~F.col("fold_id").isin(*self.dropped[c]), x)
            filled[c] = x
        keep = [F.col(c) for c in base] + [filled[c].alias(c) for c in self.features]
        limits = [F.col(f"{c}__{part}") for c in spec.numeric for part in ("mid", "far")]
        data = data.select(*keep, spec.target, *limits)
        inside = F.lit(True)
        for c in spec.numeric:
            far = F.abs(F.col(c) - F.col(f"{c}__mid")) > F.col(f"{c}__far")
            inside = inside & ~F.coalesce(far, F.lit(False))
        if set(settings.outlier_roles) != set(ALL_ROLES):
            inside = inside | ~F.col("role").isin(*settings.outlier_roles)
        data = data.filter(inside).select(*base, *self.features, spec.target)
        if self.encoder is not None and self.encoder.columns:
            coded = self.encoder.transform(data)
            data = coded.select(
                *base,
                *spec.numeric,
                *[
                    F.when(~F.col("fold_id").isin(*self.dropped[c]), F.col(c)).alias(c)
                    if c in self.dropped
                    else F.col(c)
                    for c in self.categorical
                ],
                spec.target,
            )
        return data

    def scale(self, cleaned: DataFrame) -> DataFrame:
        scaled = {
            c: F.try_divide(F.col(c) - F.col(f"{c}__mean"), F.col(f"{c}__sd"))
            for c in self.features
        }
        return with_stats(cleaned, self.scaling).select(
            *[scaled[c].alias(c) if c in scaled else F.col(c) for c in cleaned.columns]
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """``(fold_id, role, row_id, features, target)``, ready for a model."""
        out = self.scale(self.clean(df))
        if self.shape is None:
            return out
        numeric = self.settings.spec.numeric
        if self.settings.transform == "quantile":
            return quantile_normal(out, numeric, self.shape, self.settings.n_quantiles)
        return power_yeo_johnson(out, numeric, self.shape)
