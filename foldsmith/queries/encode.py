"""Label, ordinal and one-hot codes."""

from pyspark.sql import functions as F

from foldsmith.operators import encode as E
from foldsmith.operators.foldwise import by_fold
from foldsmith.queries.base import CUSTOMER_FOLDS, customer_roles, query, table, written

BRANDS = [f"Brand#{i}" for i in range(1, 26)]


@query(
    "label_encode",
    f"""WITH {CUSTOMER_FOLDS}, l AS (SELECT fold_id, y, row_number() OVER (PARTITION BY fold_id ORDER BY y) - 1
  AS code FROM (SELECT DISTINCT fold_id, c_mktsegment AS y FROM folds WHERE role = 'train'))
SELECT c_custkey, f.fold_id, role, CAST(code AS INTEGER) AS c_mktsegment
FROM folds f JOIN l ON f.fold_id = l.fold_id AND f.c_mktsegment = l.y""",
)
def label_encode(spark, sf_dir):
    df = customer_roles(spark, sf_dir).select("c_custkey", "fold_roles", "c_mktsegment")
    return E.label_encode(written(df, "customer-roles"), "c_mktsegment")


@query(
    "ordinal_encode",
    f"""WITH {CUSTOMER_FOLDS}, r AS (SELECT *, CASE WHEN role = 'test' AND c_custkey % 5 = 0 THEN 'rare'
  ELSE c_nationkey END AS nk FROM folds),
a AS (SELECT fold_id, v, row_number() OVER (PARTITION BY fold_id ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT fold_id, nk AS v FROM r WHERE role = 'train' AND nk IS NOT NULL)),
b AS (SELECT fold_id, v, row_number() OVER (PARTITION BY fold_id ORDER BY v) - 1 AS code FROM
  (SELECT DISTINCT fold_id, unique_id AS v FROM r WHERE role = 'train'))
SELECT c_custkey, r.fold_id, role, CAST(coalesce(a.code, -1) AS INTEGER) AS c_nationkey,
  CAST(coalesce(b.code, -1) AS INTEGER) AS unique_id FROM r
LEFT JOIN a ON r.fold_id = a.fold_id AND r.nk = a.v
LEFT JOIN b ON r.fold_id = b.fold_id AND r.unique_id = b.v""",
)
def ordinal_encode(spark, sf_dir):
    df = by_fold(written(customer_roles(spark, sf_dir), "customer-roles"))
    rare = (F.col("role") == "test") & (F.col("c_custkey") % 5 == 0)
    df = df.withColumn("c_nationkey", F.when(rare, "rare").otherwise(F.col("c_nationkey")))
    return E.ordinal_encode(
        df.select("c_custkey", "fold_id", "role", "c_nationkey", "unique_id"),
        ["c_nationkey", "unique_id"],
    )


@query(
    "one_hot_encode",
    "SELECT p_partkey, "
    + ", ".join(
        f"CASE WHEN p_brand = '{b}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"p_brand_{b}\"" for b in BRANDS
    )
    + " FROM part",
)
def one_hot_encode(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    return E.one_hot_encode(df, E.vocabulary(df, ["p_brand"]))


@query("one_hot_decode", "SELECT p_partkey, p_brand, p_type FROM part")
def one_hot_decode(spark, sf_dir):
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type")
    vocab = E.vocabulary(df, ["p_brand", "p_type"])
    return E.one_hot_decode(E.one_hot_encode(df, vocab), vocab)


PLACED = ("l_orderkey", "l_partkey", "l_returnflag")


@query(
    "one_hot_sparse",
    "WITH "
    + ", ".join(
        f"v{i} AS (SELECT v, row_number() OVER (ORDER BY v) - 1 AS code FROM (SELECT DISTINCT "
        f"CAST({c} AS VARCHAR) AS v FROM lineitem WHERE {c} IS NOT NULL))"
        for i, c in enumerate(PLACED)
    )
    + " "
    + " UNION ALL ".join(
        f"SELECT l_orderkey AS order_id, l_linenumber, '{c}' AS \"column\", v AS value, CAST(code"
        + "".join(f" + (SELECT count(*) FROM v{j})" for j in range(i))
        + f" AS INTEGER) AS \"index\" FROM lineitem JOIN v{i} ON CAST({c} AS VARCHAR) = v"
        for i, c in enumerate(PLACED)
    ),
)
def one_hot_sparse(spark, sf_dir):
    """Places of every line's values, read back through the vocabulary."""
    df = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("order_id"), "l_linenumber", *PLACED
    )
    encoder = E.OneHotIndices.fit(df, PLACED)
    return encoder.decode(encoder.transform(df))
