"""Projections, predicates and schema rules."""

from pyspark.sql import functions as F

from foldsmith.operators import schema as S
from foldsmith.operators.stats import unpivot
from foldsmith.queries.base import (
    CUSTOMER,
    CUSTOMER_FOLDS,
    CUSTOMER_SRC,
    RESULTS_SRC,
    customer,
    customer_folds,
    query,
    r6,
    results,
    rounded,
    sr6,
    table,
    written,
)

LABELLED = """SELECT o_orderkey, CASE WHEN o_orderkey % 101 = 0 THEN NULL ELSE o_orderstatus END
  AS o_orderstatus, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice FROM orders"""


def labelled(spark, sf_dir):
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        key,
        F.when(key % 101 != 0, F.col("o_orderstatus")).alias("o_orderstatus"),
        F.when(key % 17 == 0, float("nan")).otherwise(F.col("o_totalprice")).alias("o_totalprice"),
    )


@query("drop_missing_target", f"SELECT * FROM ({LABELLED}) WHERE o_orderstatus IS NOT NULL")
def drop_missing_target(spark, sf_dir):
    return S.drop_missing_target(labelled(spark, sf_dir), "o_orderstatus")


@query(
    "split_features_label",
    "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment AS label FROM customer",
)
def split_features_label(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    x, _ = S.split_features_label(df, "c_mktsegment")
    _, y = S.split_features_label(df.select("c_custkey", "c_mktsegment"), "c_mktsegment")
    assert y.columns == ["c_mktsegment"]
    return S.concat_columns(
        x, df.select("c_custkey", F.col("c_mktsegment").alias("label")), "c_custkey"
    )


@query(
    "profile_dataset",
    """SELECT CAST(count(*) AS BIGINT) AS number_rows, CAST(4 AS BIGINT) AS number_features,
  count(DISTINCT c_mktsegment) AS num_classes FROM customer""",
)
def profile_dataset(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return S.profile_dataset(df, "c_mktsegment", [c for c in df.columns if c != "c_mktsegment"])


@query(
    "classify_columns",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", '{kind}' AS kind, count({c}) AS n FROM ({CUSTOMER_SRC})"
        for c, kind in (
            ("c_custkey", "numeric"),
            ("c_acctbal", "numeric"),
            ("nation_number", "numeric"),
            ("c_nationkey", "categorical"),
            ("constant", "categorical"),
            ("unique_id", "categorical"),
        )
    ),
)
def classify_columns(spark, sf_dir):
    df = customer(spark, sf_dir)
    categorical, numeric = S.classify_columns(df, "c_mktsegment", {"unique_id": False})
    kinds = S.columns_table(spark, categorical, numeric)
    filled = (
        unpivot(df, [], [*categorical, *numeric], "string")
        .groupBy("column")
        .agg(F.count("value").alias("n"))
    )
    return kinds.join(filled, "column")


@query(
    "coerce_numeric",
    """SELECT o_orderkey, TRY_CAST(CASE WHEN o_orderkey % 19 = 0 THEN 'n/a'
  ELSE CAST(o_totalprice AS VARCHAR) END AS DOUBLE) AS o_totalprice FROM orders""",
)
def coerce_numeric(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 19 == 0, "n/a")
        .otherwise(F.col("o_totalprice").cast("string"))
        .alias("o_totalprice"),
    )
    return S.coerce_numeric(df, ["o_totalprice"])


@query(
    "align_schema",
    """SELECT s_suppkey AS c_custkey, CAST(NULL AS VARCHAR) AS c_mktsegment,
  s_acctbal AS c_acctbal, s_nationkey AS c_nationkey FROM supplier""",
)
def align_schema(spark, sf_dir):
    like = table(spark, sf_dir, "customer").select(
        "c_custkey", "c_mktsegment", "c_acctbal", "c_nationkey"
    )
    other = table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("c_nationkey"),
        "s_name",
        F.col("s_acctbal").alias("c_acctbal"),
        F.col("s_suppkey").alias("c_custkey"),
    )
    return S.align_schema(other, like.schema)


@query(
    "fill_unknown",
    f"""SELECT c_custkey, c_acctbal, coalesce(c_nationkey, 'Unknown') AS c_nationkey
FROM ({CUSTOMER_SRC})""",
)
def fill_unknown(spark, sf_dir):
    return S.fill_unknown(
        customer(spark, sf_dir).select("c_custkey", "c_acctbal", "c_nationkey")
    )


@query(
    "binarize_target",
    """SELECT l_orderkey, count(*) AS n,
  CASE WHEN round(avg(l_discount * 10), 9) > 0.5 THEN 1 ELSE 0 END AS label
FROM lineitem GROUP BY l_orderkey""",
)
def binarize_target(spark, sf_dir):
    means = (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.col("l_discount") * 10), 9).alias("mean"))
    )
    return means.select("l_orderkey", "n", S.binarize_target(F.col("mean")).alias("label"))


@query(
    "label_abs_int",
    """SELECT c_custkey, CAST(abs(trunc(c_acctbal / 100 - 50)) AS INTEGER) AS label FROM customer""",
)
def label_abs_int(spark, sf_dir):
    value = F.col("c_acctbal") / 100 - 50
    return table(spark, sf_dir, "customer").select(
        "c_custkey", S.label_abs_int(value).alias("label")
    )


@query(
    "pad_features",
    """SELECT md5(concat_ws('|', l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity,
  l_extendedprice, l_shipdate)) AS row_id, 100 AS width, l_quantity AS f1, l_extendedprice AS f2,
  l_discount AS f3, l_tax AS f4, 0.0::DOUBLE AS f5, 0.0::DOUBLE AS f100,
  round(l_quantity + l_extendedprice + l_discount + l_tax, 6) + 0.0 AS total FROM lineitem""",
)
def pad_features(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    parts = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_shipdate")
    df = df.withColumn(
        "row_id", F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in parts]))
    )
    padded = S.pad_features(
        df.select("row_id", "l_quantity", "l_extendedprice", "l_discount", "l_tax"),
        ["l_quantity", "l_extendedprice", "l_discount", "l_tax"],
    )
    f = F.col("features")
    return padded.select(
        "row_id",
        F.size(f).alias("width"),
        *[f[i - 1].alias(f"f{i}") for i in (1, 2, 3, 4, 5, 100)],
        r6(F.aggregate(f, F.lit(0.0), lambda a, x: a + x)).alias("total"),
    )


@query(
    "union_rows",
    """SELECT c_nationkey AS nation, c_acctbal AS balance, 'customer' AS origin FROM customer
UNION ALL SELECT s_nationkey, s_acctbal, 'supplier' FROM supplier""",
)
def union_rows(spark, sf_dir):
    first = table(spark, sf_dir, "customer").select(
        F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance")
    )
    second = table(spark, sf_dir, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation")
    )
    return S.union_rows(first, second, origins=("customer", "supplier"))


@query(
    "concat_columns",
    "SELECT d.doc_id, lang, n_chars, toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def concat_columns(spark, sf_dir):
    x = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    y = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return S.concat_columns(x, y, "doc_id")


@query(
    "fold_dataset",
    f"""WITH {CUSTOMER_FOLDS} SELECT c_custkey, c_acctbal, c_nationkey, constant, unique_id,
  c_mktsegment, role, CAST(fold_id AS INTEGER) AS fold FROM folds""",
)
def fold_dataset(spark, sf_dir):
    long = written(customer_folds(spark, sf_dir), "customer-folds")
    out = None
    for fold in range(5):
        for role in ("train", "val", "test"):
            x, y = S.fold_dataset(long, CUSTOMER, fold, role)
            part = S.concat_columns(x, y, "c_custkey").withColumns(
                {"role": F.lit(role), "fold": F.lit(fold)}
            )
            out = part if out is None else out.unionByName(part)
    return out


@query(
    "select_results",
    f"""SELECT model_name, {sr6('accuracy')} AS accuracy, dataset_id FROM ({RESULTS_SRC})
WHERE accuracy >= 0.4001""",
)
def select_results(spark, sf_dir):
    df = results(spark, sf_dir).withColumn(
        "accuracy", F.when(F.col("accuracy") < 0.4001, float("nan")).otherwise(F.col("accuracy"))
    )
    out = S.select_results(df, "accuracy", keys=("model_name", "dataset_id"))
    return rounded(out, ["accuracy"])

