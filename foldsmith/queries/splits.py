"""Splits and samples."""

from pyspark.sql import functions as F

from foldsmith.functions.hashing import uniform
from foldsmith.operators import splits as S
from foldsmith.queries.base import (
    CUSTOMER_FOLDS,
    K,
    ORDERS_FOLDS,
    SEED,
    customer_folds,
    orders_folds,
    query,
    table,
    u_sql,
)


@query(
    "stratified_kfold",
    """WITH c AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment
  ORDER BY md5(concat_ws(':', '42', CAST(c_custkey AS VARCHAR))), c_custkey) AS rn FROM customer),
n AS (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1),
o AS (SELECT c_mktsegment, coalesce(sum(n) OVER (ORDER BY c_mktsegment
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM n)
SELECT c_custkey, c.c_mktsegment, CAST((o + rn - 1) % 5 AS INTEGER) AS fold_id
FROM c JOIN o ON c.c_mktsegment = o.c_mktsegment""",
)
def stratified_kfold(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return S.stratified_kfold(df, "c_mktsegment", "c_custkey", K, SEED)


@query(
    "stratified_holdout",
    f"""WITH src AS (SELECT o_orderkey, o_orderstatus, {u_sql('test', 'o_orderkey')} < 0.25 AS t,
  md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR))) AS h FROM orders),
cnt AS (SELECT o_orderstatus, count(*) AS n_rest FROM src WHERE NOT t GROUP BY 1),
tot AS (SELECT *, ceil(round(0.2 * (SELECT count(*) FROM orders), 9)) AS w, sum(n_rest) OVER () AS a FROM cnt),
base AS (SELECT *, CAST(w AS HUGEINT) * n_rest // a AS b, CAST(w AS HUGEINT) * n_rest % a AS r FROM tot),
quota AS (SELECT o_orderstatus, b + CASE WHEN row_number() OVER (ORDER BY r DESC, o_orderstatus)
  <= w - sum(b) OVER () THEN 1 ELSE 0 END AS q FROM base),
rk AS (SELECT *, row_number() OVER (PARTITION BY o_orderstatus, t ORDER BY h, o_orderkey) AS rn FROM src)
SELECT o_orderkey, rk.o_orderstatus, CASE WHEN t THEN 'test' WHEN rn <= q THEN 'val' ELSE 'train' END AS role
FROM rk JOIN quota ON rk.o_orderstatus = quota.o_orderstatus""",
)
def stratified_holdout(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    test = uniform("test", "o_orderkey") < 0.25
    return S.stratified_holdout(df, "o_orderstatus", "o_orderkey", test, 0.2, SEED)


@query("kfold_long", f"WITH {ORDERS_FOLDS} SELECT o_orderkey, o_orderstatus, fold_id, role FROM folds")
def kfold_long(spark, sf_dir):
    return orders_folds(spark, sf_dir).select("o_orderkey", "o_orderstatus", "fold_id", "role")


@query(
    "random_holdout",
    """WITH r AS (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY
  md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey) AS rn FROM orders)
SELECT o_orderkey, CASE WHEN rn <= n - ceil(round(0.6 * n, 9)) THEN 'train' ELSE 'test' END AS role FROM r""",
)
def random_holdout(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.random_holdout(df, "o_orderkey", 0.6, SEED)


@query(
    "sample_n",
    """SELECT o_orderkey, o_orderstatus FROM orders
ORDER BY md5(concat_ws(':', '42', CAST(o_orderkey AS VARCHAR))), o_orderkey LIMIT 1000""",
)
def sample_n(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.sample_n(df, "o_orderkey", 1000, SEED)


@query(
    "sample_weighted",
    f"""SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 0
ORDER BY -ln({u_sql(42, 'o_orderkey')}) / o_totalprice, o_orderkey LIMIT 1000""",
)
def sample_weighted(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return S.sample_weighted(df, "o_orderkey", "o_totalprice", 1000, SEED)


@query(
    "size_budget",
    f"""WITH {CUSTOMER_FOLDS} SELECT fold_id, count(*) FILTER (WHERE role = 'train') AS n_train,
  count(*) FILTER (WHERE role = 'test') AS n_test,
  greatest(0, 1000 - count(*) FILTER (WHERE role = 'train') - count(*) FILTER (WHERE role = 'test')) AS budget,
  greatest(0, 1000 - count(*) FILTER (WHERE role = 'train')) AS budget_train
FROM folds GROUP BY fold_id""",
)
def size_budget(spark, sf_dir):
    return S.size_budget(customer_folds(spark, sf_dir), ["fold_id"], 1000)


BATCH_SQL = """b AS (SELECT o_orderkey, count(*) OVER () AS n, row_number() OVER (ORDER BY
  md5(concat_ws(':', '42:3', CAST(o_orderkey AS VARCHAR))), o_orderkey) - 1 AS p FROM orders),
batches AS (SELECT o_orderkey, p // 128 AS batch_id, p % 128 AS batch_pos,
  count(*) OVER (PARTITION BY p // 128) AS batch_rows FROM b)"""


@query("mini_batches", f"WITH {BATCH_SQL} SELECT * FROM batches")
def mini_batches(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    return S.mini_batches(df, "o_orderkey", 128, epoch=3, seed=SEED)


@query(
    "context_query_split",
    f"""WITH {BATCH_SQL} SELECT o_orderkey, batch_id,
  CASE WHEN batch_pos < floor(round(0.8 * batch_rows, 9)) THEN 'context' ELSE 'query' END AS part
FROM batches""",
)
def context_query_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    batches = S.mini_batches(df, "o_orderkey", 128, epoch=3, seed=SEED)
    return S.context_query_split(batches).select("o_orderkey", "batch_id", "part")


@query(
    "seeded",
    " UNION ALL ".join(
        f"""SELECT CAST({s} AS INTEGER) AS seed, part, count(*) AS n,
  CAST(sum(o_orderkey) AS BIGINT) AS key_sum FROM (SELECT o_orderkey,
  CASE WHEN row_number() OVER (ORDER BY md5(concat_ws(':', '{s}', CAST(o_orderkey AS VARCHAR))), o_orderkey)
  <= (SELECT count(*) FROM orders) - ceil(round(0.6 * (SELECT count(*) FROM orders), 9))
  THEN 'train' ELSE 'test' END AS part FROM orders) GROUP BY part"""
        for s in (1, 2)
    ),
)
def seeded(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    frames = [
        S.random_holdout(df, "o_orderkey", 0.6, s)
        .groupBy(F.lit(s).alias("seed"), F.col("role").alias("part"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("key_sum"))
        for s in (1, 2)
    ]
    return frames[0].unionByName(frames[1])
