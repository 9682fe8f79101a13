"""Column drops, imputation, outliers."""

from pyspark.sql import functions as F

from foldsmith.operators import clean as C
from foldsmith.queries.base import (
    CUSTOMER_FOLDS,
    EVENTS_FOLDS,
    customer_folds,
    customer_roles,
    events_roles,
    query,
    rounded,
    sr6,
    written,
)

COLUMNS = ["c_nationkey", "constant", "unique_id"]


def folds(spark, sf_dir):
    return written(customer_roles(spark, sf_dir), "customer-roles")


@query(
    "drop_constant",
    f"""WITH {CUSTOMER_FOLDS}, d AS (SELECT fold_id, count(DISTINCT constant) AS n FROM folds
  WHERE role = 'train' GROUP BY 1)
SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, nation_number, unique_id, folds.fold_id, role
FROM folds JOIN d ON folds.fold_id = d.fold_id WHERE d.n = 1""",
)
def drop_constant(spark, sf_dir):
    return C.drop_constant(folds(spark, sf_dir), COLUMNS)


@query(
    "drop_near_unique",
    f"""WITH {CUSTOMER_FOLDS}, d AS (SELECT fold_id, count(DISTINCT unique_id) AS n, count(*) AS r,
  count(DISTINCT c_nationkey) AS m FROM folds WHERE role = 'train' GROUP BY 1)
SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, nation_number, constant, folds.fold_id, role
FROM folds JOIN d ON folds.fold_id = d.fold_id WHERE d.n >= 0.95 * r AND d.m < 0.95 * r""",
)
def drop_near_unique(spark, sf_dir):
    return C.drop_near_unique(folds(spark, sf_dir), COLUMNS)


@query(
    "impute_numeric",
    f"""WITH {CUSTOMER_FOLDS}, s AS (SELECT fold_id, avg(c_acctbal) AS m, mode(nation_number ORDER BY nation_number)
  AS md FROM folds WHERE role = 'train' GROUP BY 1)
SELECT c_custkey, f.fold_id, role, {sr6('coalesce(c_acctbal, m)')} AS c_acctbal,
  coalesce(nation_number, md) AS nation_number FROM folds f JOIN s ON f.fold_id = s.fold_id""",
)
def impute_numeric(spark, sf_dir):
    out = C.impute_numeric(folds(spark, sf_dir), ["c_acctbal", "nation_number"])
    return rounded(
        out.select("c_custkey", "fold_id", "role", "c_acctbal", "nation_number"), ["c_acctbal"]
    )


@query(
    "impute_mode",
    f"""WITH {CUSTOMER_FOLDS}, s AS (SELECT fold_id, mode(c_nationkey ORDER BY c_nationkey) AS md
  FROM folds WHERE role = 'train' GROUP BY 1)
SELECT c_custkey, f.fold_id, role, coalesce(c_nationkey, md) AS c_nationkey
FROM folds f JOIN s ON f.fold_id = s.fold_id""",
)
def impute_mode(spark, sf_dir):
    out = C.impute_mode(folds(spark, sf_dir), ["c_nationkey"])
    return out.select("c_custkey", "fold_id", "role", "c_nationkey")


@query(
    "impute_simple",
    f"""WITH {CUSTOMER_FOLDS}, s AS (SELECT fold_id, avg(c_acctbal) AS m,
  mode(c_nationkey ORDER BY c_nationkey) AS md FROM folds WHERE role = 'train' GROUP BY 1)
SELECT c_custkey, f.fold_id, role, {sr6('coalesce(c_acctbal, m)')} AS c_acctbal, 0.0::DOUBLE AS empty,
  coalesce(c_nationkey, md) AS c_nationkey FROM folds f JOIN s ON f.fold_id = s.fold_id""",
)
def impute_simple(spark, sf_dir):
    df = folds(spark, sf_dir).withColumn("empty", F.lit(None).cast("double"))
    out = C.impute_simple(df, ["c_acctbal", "empty"], ["c_nationkey"])
    return rounded(
        out.select("c_custkey", "fold_id", "role", "c_acctbal", "empty", "c_nationkey"),
        ["c_acctbal"],
    )


@query(
    "impute_synth_prep",
    f"""WITH {CUSTOMER_FOLDS}, t AS (SELECT *, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_custkey % 5 END AS few
  FROM folds WHERE role = 'train'), s AS (SELECT fold_id, median(c_acctbal) AS m,
  mode(c_nationkey ORDER BY c_nationkey) AS md, mode(few ORDER BY few) AS mf FROM t GROUP BY 1)
SELECT c_custkey, t.fold_id, {sr6('coalesce(c_acctbal, m)')} AS c_acctbal, coalesce(few, mf) AS few,
  coalesce(c_nationkey, md) AS c_nationkey FROM t JOIN s ON t.fold_id = s.fold_id""",
)
def impute_synth_prep(spark, sf_dir):
    df = written(customer_folds(spark, sf_dir), "customer-folds")
    train = df.filter("role = 'train'").withColumn(
        "few", F.when(F.col("c_custkey") % 7 != 0, F.col("c_custkey") % 5)
    )
    out = C.impute_synth_prep(train, ["c_acctbal", "few"], ["c_nationkey"])
    return rounded(
        out.select("c_custkey", "fold_id", "c_acctbal", "few", "c_nationkey"), ["c_acctbal"]
    )


@query(
    "outlier_filter",
    f"""WITH {EVENTS_FOLDS}, s AS (SELECT fold_id, avg(value) AS m, stddev_samp(value) AS sd,
  avg(k) AS mk, stddev_samp(k) AS sk FROM folds WHERE role = 'train' GROUP BY 1)
SELECT event_id, f.fold_id, role, value, k FROM folds f JOIN s ON f.fold_id = s.fold_id
WHERE NOT (coalesce(abs((value - m) / sd) > 3, FALSE) OR coalesce(abs((k - mk) / sk) > 3, FALSE))""",
)
def outlier_filter(spark, sf_dir):
    out = C.outlier_filter(written(events_roles(spark, sf_dir), "event-roles"), ["value", "k"])
    return out.select("event_id", "fold_id", "role", "value", "k")
