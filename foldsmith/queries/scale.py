"""Scalers and distribution transforms."""

from pyspark.sql import functions as F

from foldsmith.functions.normal import inverse_normal_sql
from foldsmith.operators import scale as S
from foldsmith.operators.stats import train_rows
from foldsmith.queries.base import EVENTS_FOLDS, events_folds, events_roles, query, rounded, sr6, written

NUMERIC = ["value", "k"]


def folds(spark, sf_dir):
    return written(events_folds(spark, sf_dir), "event-folds")


def roles(spark, sf_dir):
    return written(events_roles(spark, sf_dir), "event-roles")


def picked(df, places=6):
    return rounded(df.select("event_id", "fold_id", "role", *NUMERIC), NUMERIC, places)


@query(
    "standard_scale",
    f"""WITH {EVENTS_FOLDS}, s AS (SELECT fold_id, avg(value) AS m, stddev_samp(value) AS sd,
  avg(k) AS mk, stddev_samp(k) AS sk FROM folds WHERE role = 'train' GROUP BY 1)
SELECT event_id, f.fold_id, role, {sr6('(value - m) / sd')} AS value, {sr6('(k - mk) / sk')} AS k
FROM folds f JOIN s ON f.fold_id = s.fold_id""",
)
def standard_scale(spark, sf_dir):
    return picked(S.standard_scale(roles(spark, sf_dir), NUMERIC))


@query(
    "standard_scale_pop",
    f"""WITH {EVENTS_FOLDS}, s AS (SELECT fold_id, avg(value) AS m, stddev_pop(value) AS sd,
  avg(k) AS mk, stddev_pop(k) AS sk FROM folds WHERE role = 'train' GROUP BY 1)
SELECT event_id, f.fold_id, role, {sr6('(value - m) / sd')} AS value, {sr6('(k - mk) / sk')} AS k,
  {sr6('value')} AS value_back, 0.0::DOUBLE AS flat FROM folds f JOIN s ON f.fold_id = s.fold_id""",
)
def standard_scale_pop(spark, sf_dir):
    columns = [*NUMERIC, "flat"]
    df = folds(spark, sf_dir).withColumn("flat", F.lit(5.0))
    stats = S.population_stats(train_rows(df), columns)
    scaled = S.standard_scale_pop(df, stats, columns)
    copy = scaled.withColumns({"value_scaled": F.col("value"), "k_scaled": F.col("k")})
    back = S.inverse_scale_pop(copy, stats, columns)
    out = back.select(
        "event_id",
        "fold_id",
        "role",
        F.col("value").alias("value_back"),
        F.col("value_scaled").alias("value"),
        F.col("k_scaled").alias("k"),
        (F.col("flat") - 5.0).alias("flat"),
    )
    return rounded(out, [*NUMERIC, "value_back", "flat"])


def _quantile_ctes(c: str) -> str:
    return f"""
o_{c} AS (SELECT fold_id, {c} AS v, row_number() OVER (PARTITION BY fold_id ORDER BY {c}) - 1 AS r
  FROM folds WHERE role = 'train' AND {c} IS NOT NULL),
c_{c} AS (SELECT fold_id, count(*) AS n, least(count(*), 1000) AS q FROM o_{c} GROUP BY 1),
i_{c} AS (SELECT fold_id, i, n, q, i * (n - 1) / (q - 1) AS pos FROM c_{c}, range(1000) g(i) WHERE i < q),
g_{c} AS (SELECT a.fold_id, l.v + (h.v - l.v) * (pos - floor(pos)) AS v, i / (q - 1) AS p FROM i_{c} a
  JOIN o_{c} l ON a.fold_id = l.fold_id AND l.r = CAST(floor(pos) AS BIGINT)
  JOIN o_{c} h ON a.fold_id = h.fold_id AND h.r = CAST(ceil(pos) AS BIGINT)),
d_{c} AS (SELECT fold_id, v, min(p) AS lo, max(p) AS hi FROM g_{c} GROUP BY 1, 2),
n_{c} AS (SELECT *, lead(v) OVER w AS nv, lead(lo) OVER w AS nlo FROM d_{c}
  WINDOW w AS (PARTITION BY fold_id ORDER BY v)),
b_{c} AS (SELECT fold_id, min(v) AS lowest, max(v) AS highest FROM d_{c} GROUP BY 1),
p_{c} AS (SELECT f.event_id, f.fold_id, CASE WHEN f.{c} IS NULL THEN NULL
  WHEN f.{c} - 1e-7 < lowest THEN 0.0::DOUBLE WHEN f.{c} + 1e-7 > highest THEN 1.0::DOUBLE
  WHEN f.{c} = n.v THEN (n.lo + n.hi) / 2
  ELSE n.hi + (f.{c} - n.v) / (n.nv - n.v) * (n.nlo - n.hi) END AS p
  FROM folds f JOIN b_{c} b ON f.fold_id = b.fold_id
  ASOF LEFT JOIN n_{c} n ON f.fold_id = n.fold_id AND f.{c} >= n.v)"""


def _normal(c: str) -> str:
    clipped = f"least(greatest(p_{c}.p, {S.CLIP!r}::DOUBLE), 1.0::DOUBLE - {S.CLIP!r}::DOUBLE)"
    return sr6(inverse_normal_sql(clipped), 5)


@query(
    "quantile_normal",
    f"""WITH {EVENTS_FOLDS}, {_quantile_ctes('value')}, {_quantile_ctes('k')}
SELECT f.event_id, f.fold_id, f.role, CASE WHEN f.value IS NULL THEN NULL ELSE {_normal('value')} END AS value,
  {_normal('k')} AS k FROM folds f
JOIN p_value ON f.event_id = p_value.event_id AND f.fold_id = p_value.fold_id
JOIN p_k ON f.event_id = p_k.event_id AND f.fold_id = p_k.fold_id""",
)
def quantile_normal(spark, sf_dir):
    return picked(S.quantile_normal(roles(spark, sf_dir), NUMERIC), 5)


# The exponent by halving an interval on the sign of the likelihood's slope. Its ends are
# uneven so that no middle is 0 or 2, where the closed forms divide by zero.
YEO_JOHNSON = f"""s AS (SELECT fold_id, avg(value) AS m, stddev_samp(value) AS sd, avg(k) AS mk,
  stddev_samp(k) AS sk FROM folds WHERE role = 'train' GROUP BY 1),
z AS MATERIALIZED (SELECT event_id, f.fold_id, role, unnest(['value', 'k']) AS c,
  unnest([(value - m) / sd, (k - mk) / sk]) AS x FROM folds f JOIN s ON f.fold_id = s.fold_id),
t AS MATERIALIZED (SELECT fold_id, c, x >= 0 AS up, ln(1 + abs(x)) AS u FROM z
  WHERE role = 'train' AND x IS NOT NULL),
b AS (SELECT fold_id, c, -7.9::DOUBLE AS lo, 8.3::DOUBLE AS hi, 0 AS i FROM t GROUP BY 1, 2
  UNION ALL
  SELECT fold_id, c, CASE WHEN slope > 0 THEN mid ELSE lo END, CASE WHEN slope > 0 THEN hi ELSE mid END, i + 1
  FROM (SELECT fold_id, c, any_value(lo) AS lo, any_value(hi) AS hi, any_value(mid) AS mid, any_value(i) AS i,
      sum(CASE WHEN up THEN u ELSE -u END) - count(*) * covar_pop(y, y1) / var_pop(y) AS slope
    FROM (SELECT *, CASE WHEN up THEN 1 ELSE -1 END * (exp(e * u) - 1) / e AS y,
        (exp(e * u) * (e * u - 1) + 1) / (e * e) AS y1
      FROM (SELECT t.fold_id, t.c, lo, hi, i, u, up, (lo + hi) / 2 AS mid,
          CASE WHEN up THEN (lo + hi) / 2 ELSE 2 - (lo + hi) / 2 END AS e
        FROM b JOIN t ON b.fold_id = t.fold_id AND b.c = t.c WHERE i < 52))
    GROUP BY 1, 2)),
lam AS (SELECT fold_id, c, (lo + hi) / 2 AS lam FROM b WHERE i = 52),
y AS (SELECT event_id, z.fold_id, role, z.c, CASE WHEN x >= 0 THEN (pow(x + 1, lam) - 1) / lam
  ELSE (1 - pow(1 - x, 2 - lam)) / (2 - lam) END AS y
  FROM z JOIN lam ON z.fold_id = lam.fold_id AND z.c = lam.c),
n AS (SELECT fold_id, c, avg(y) AS m, stddev_pop(y) AS sd FROM y WHERE role = 'train' GROUP BY 1, 2)"""


@query(
    "power_yeo_johnson",
    f"""WITH RECURSIVE {EVENTS_FOLDS}, {YEO_JOHNSON}
SELECT event_id, y.fold_id, role, max(CASE WHEN y.c = 'value' THEN {sr6('(y - m) / sd')} END) AS value,
  max(CASE WHEN y.c = 'k' THEN {sr6('(y - m) / sd')} END) AS k
FROM y JOIN n ON y.fold_id = n.fold_id AND y.c = n.c GROUP BY 1, 2, 3""",
)
def power_yeo_johnson(spark, sf_dir):
    scaled = written(S.standard_scale(roles(spark, sf_dir), NUMERIC), "scaled")
    return picked(S.power_yeo_johnson(scaled, NUMERIC))


def _yj(x: str, lam: float) -> str:
    return (
        f"CASE WHEN {x} >= 0 THEN (pow({x} + 1, {lam}) - 1) / {lam} "
        f"ELSE (1 - pow(1 - {x}, 2 - {lam})) / (2 - {lam}) END"
    )


@query(
    "power_fixed_lambda",
    f"""WITH {EVENTS_FOLDS}, s AS (SELECT fold_id, avg(value) AS m, stddev_samp(value) AS sd FROM folds
  WHERE role = 'train' GROUP BY 1),
z AS (SELECT event_id, f.fold_id, role, (value - m) / sd AS z FROM folds f JOIN s ON f.fold_id = s.fold_id),
y AS (SELECT *, {_yj('z', 0.25)} AS y FROM z),
t AS (SELECT fold_id, avg(y) AS ym, stddev_pop(y) AS ys FROM y WHERE role = 'train' GROUP BY 1)
SELECT event_id, y.fold_id, role, {sr6('(y - ym) / ys')} AS value FROM y JOIN t ON y.fold_id = t.fold_id""",
)
def power_fixed_lambda(spark, sf_dir):
    df = S.standard_scale(roles(spark, sf_dir), ["value"])
    y = S.yeo_johnson(F.col("value"), F.lit(0.25))
    fitted = (
        train_rows(df)
        .groupBy("fold_id")
        .agg(F.avg(y).alias("mean"), F.stddev_pop(y).alias("sd"))
        .select("fold_id", F.lit("value").alias("column"), F.lit(0.25).alias("lam"), "mean", "sd")
    )
    out = S.power_yeo_johnson(df, ["value"], fitted)
    return rounded(out.select("event_id", "fold_id", "role", "value"), ["value"])
