"""Normal distribution as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldsmith.functions.arrays import let

# Coefficients of algorithm AS 241 (PPND16), Wichura 1988,
# numerator and denominator polynomials from the highest power down.
CENTRAL_NUM = (
    2509.0809287301226727, 33430.575583588128105, 67265.770927008700853,
    45921.953931549871457, 13731.693765509461125, 1971.5909503065514427,
    133.14166789178437745, 3.387132872796366608,
)
CENTRAL_DEN = (
    5226.495278852545925, 28729.085735721942674, 39307.89580009271061,
    21213.794301586595867, 5394.1960214247511077, 687.1870074920579083,
    42.313330701600911252, 1.0,
)
MIDDLE_NUM = (
    7.7454501427834140764e-4, 0.0227238449892691845833, 0.24178072517745061177,
    1.27045825245236838258, 3.64784832476320460504, 5.7694972214606914055,
    4.6303378461565452959, 1.42343711074968357734,
)
MIDDLE_DEN = (
    1.05075007164441684324e-9, 5.475938084995344946e-4, 0.0151986665636164571966,
    0.14810397642748007459, 0.68976733498510000455, 1.6763848301838038494,
    2.05319162663775882187, 1.0,
)
TAIL_NUM = (
    2.01033439929228813265e-7, 2.71155556874348757815e-5, 0.0012426609473880784386,
    0.026532189526576123093, 0.29656057182850489123, 1.7848265399172913358,
    5.4637849111641143699, 6.6579046435011037772,
)
TAIL_DEN = (
    2.04426310338993978564e-15, 1.4215117583164458887e-7, 1.8463183175100546818e-5,
    7.868691311456132591e-4, 0.0148753612908506148525, 0.13692988092273580531,
    0.59983220655588793769, 1.0,
)


def _poly(coefficients, x: Column) -> Column:
    acc = F.lit(coefficients[0])
    for c in coefficients[1:]:
        acc = acc * x + F.lit(c)
    return acc


def _argument(q: Column, r: Column) -> Column:
    """Variable of the polynomials: central, middle or tail."""
    return (
        F.when(F.abs(q) <= 0.425, F.lit(0.180625) - q * q)
        .when(r <= 5.0, r - F.lit(1.6))
        .otherwise(r - F.lit(5.0))
    )


def _ratio(q: Column, r: Column, t: Column) -> Column:
    sign = F.when(q < 0, -1.0).otherwise(1.0)
    return (
        F.when(F.abs(q) <= 0.425, q * _poly(CENTRAL_NUM, t) / _poly(CENTRAL_DEN, t))
        .when(r <= 5.0, sign * (_poly(MIDDLE_NUM, t) / _poly(MIDDLE_DEN, t)))
        .otherwise(sign * (_poly(TAIL_NUM, t) / _poly(TAIL_DEN, t)))
    )


def _radius(p: Column) -> Column:
    return F.sqrt(-F.ln(F.least(p, F.lit(1.0) - p)))


def inverse_normal(p: Column) -> Column:
    """Quantile of the standard normal distribution for ``0 < p < 1``."""

    def of(x: Column) -> Column:
        q = x - F.lit(0.5)
        return let(_radius(x), lambda r: let(_argument(q, r), lambda t: _ratio(q, r, t)))

    return let(p, of)


# Columns whose quantiles are computed in one generated method. A method of
# more than 8000 bytes of code is never compiled by the JVM.
CODEGEN_COLUMNS = 4


def with_inverse_normal(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add normal quantiles of several probabilities; NULL stays NULL.

    For few columns each step is a projection of its own inside whole-stage
    code generation, on values that cannot be NULL, which keeps the code short.
    For many columns the expression form is used, which generates no code.
    """
    names = list(columns)
    if len(names) > CODEGEN_COLUMNS:
        out = df.select("*", *[columns[n].alias(f"__p_{n}") for n in names])
        return out.select(
            "*", *[inverse_normal(F.col(f"__p_{n}")).alias(n) for n in names]
        ).drop(*[f"__p_{n}" for n in names])
    half = F.lit(0.5)
    out = df.select("*", *[columns[n].alias(f"__p_{n}") for n in names])
    p = {n: F.coalesce(F.col(f"__p_{n}"), half) for n in names}
    out = out.select(
        "*",
        *[(p[n] - half).alias(f"__q_{n}") for n in names],
        *[F.coalesce(_radius(p[n]), half).alias(f"__r_{n}") for n in names],
    )
    out = out.select(
        "*",
        *[_argument(F.col(f"__q_{n}"), F.col(f"__r_{n}")).alias(f"__t_{n}") for n in names],
    )
    scores = {
        n: _ratio(F.col(f"__q_{n}"), F.col(f"__r_{n}"), F.col(f"__t_{n}")) for n in names
    }
    return out.select(
        "*", *[F.when(F.col(f"__p_{n}").isNotNull(), scores[n]).alias(n) for n in names]
    ).drop(*[f"__{part}_{n}" for n in names for part in "pqrt"])


def _poly_sql(coefficients, x: str) -> str:
    acc = repr(float(coefficients[0])) + "::DOUBLE"
    for c in coefficients[1:]:
        acc = f"({acc} * {x} + {float(c)!r}::DOUBLE)"
    return acc


def inverse_normal_sql(p: str) -> str:
    """The same quantile as ANSI SQL text, for checks in another engine."""
    q = f"({p} - 0.5)"
    r_mid = f"(0.180625 - {q} * {q})"
    r = f"sqrt(-ln(least({p}, 1.0 - {p})))"
    near, far = f"({r} - 1.6)", f"({r} - 5.0)"
    sign = f"(CASE WHEN {q} < 0 THEN -1.0 ELSE 1.0 END)"
    return (
        f"(CASE WHEN abs({q}) <= 0.425 THEN {q} * {_poly_sql(CENTRAL_NUM, r_mid)}"
        f" / {_poly_sql(CENTRAL_DEN, r_mid)}"
        f" WHEN {r} <= 5.0 THEN {sign} * {_poly_sql(MIDDLE_NUM, near)}"
        f" / {_poly_sql(MIDDLE_DEN, near)}"
        f" ELSE {sign} * {_poly_sql(TAIL_NUM, far)} / {_poly_sql(TAIL_DEN, far)} END)"
    )
