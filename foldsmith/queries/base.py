"""Registry and shared inputs. Derived inputs are written the same way for
Spark and as SQL text, so that another engine can check the results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.functions.hashing import uniform
from foldsmith.operators.splits import kfold_long, kfold_roles
from foldsmith.session import materialize
from foldsmith.spec import TableSpec

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

K = 5
SEED = 42


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: str | Column, places: int = 6) -> Column:
    """Rounded, with one zero: another engine may add in another order."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), places) + F.lit(0.0)


def rounded(df: DataFrame, columns, places: int = 6) -> DataFrame:
    columns = set(columns)
    return df.select(
        *[r6(F.col(f"`{c}`"), places).alias(c) if c in columns else F.col(f"`{c}`") for c in df.columns]
    )


def sr6(c: str, places: int = 6) -> str:
    return f"(round(CAST({c} AS DOUBLE), {places}) + 0.0)"


def u_sql(seed, *keys: str) -> str:
    """Uniform draw as SQL."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return (
        f"((CAST('0x' || substr(md5(concat_ws(':', '{seed}', {parts})), 1, 8) AS BIGINT)"
        " + 0.5::DOUBLE) / 4294967296.0::DOUBLE)"
    )


def with_nulls(c: str, row_id: str, every: int) -> Column:
    return F.when(F.col(row_id) % every == 0, None).otherwise(F.col(c))


def kfold_sql(source: str, row_id: str, target: str, val: float = 0.2, k: int = K, seed=SEED) -> str:
    """CTEs ending in ``folds``: the source rows per fold with their role."""
    return f"""
src AS ({source}),
keyed AS (SELECT *, md5(concat_ws(':', '{seed}', CAST({row_id} AS VARCHAR))) AS h_ FROM src),
cls AS (SELECT {target} AS y_, count(*) AS n_ FROM src GROUP BY 1),
off AS (SELECT y_, coalesce(sum(n_) OVER (ORDER BY y_ ROWS BETWEEN UNBOUNDED PRECEDING
        AND 1 PRECEDING), 0) AS o_ FROM cls),
ranked AS (SELECT *, row_number() OVER (PARTITION BY {target} ORDER BY h_, {row_id}) AS rn_ FROM keyed),
tested AS (SELECT r.*, CAST((o_ + rn_ - 1) % {k} AS INTEGER) AS tf_
        FROM ranked r JOIN off ON r.{target} = off.y_),
lng AS (SELECT t.*, CAST(f AS INTEGER) AS fold_id FROM tested t, range({k}) g(f)),
rest AS (SELECT fold_id, {target} AS y_, count(*) AS n_rest FROM lng WHERE tf_ <> fold_id GROUP BY 1, 2),
want AS (SELECT *, ceil(round({val} * (SELECT count(*) FROM src), 9)) AS n_val,
        sum(n_rest) OVER (PARTITION BY fold_id) AS all_rest FROM rest),
cut AS (SELECT *, CAST(n_val AS HUGEINT) * n_rest // all_rest AS base_,
        CAST(n_val AS HUGEINT) * n_rest % all_rest AS rem_ FROM want),
quota AS (SELECT fold_id, y_, n_rest, base_ + CASE WHEN row_number() OVER (PARTITION BY fold_id
        ORDER BY rem_ DESC, y_) <= n_val - sum(base_) OVER (PARTITION BY fold_id) THEN 1 ELSE 0 END AS q_
        FROM cut),
placed AS (SELECT *, row_number() OVER (PARTITION BY fold_id, {target}, tf_ <> fold_id
        ORDER BY h_, {row_id}) - 1 AS p_ FROM lng),
folds AS (SELECT p.* EXCLUDE (h_, rn_, tf_, p_), CASE WHEN tf_ = p.fold_id THEN 'test'
        WHEN ((p_ - p.fold_id * q_) % n_rest + n_rest) % n_rest < q_ THEN 'val' ELSE 'train' END AS role
        FROM placed p JOIN quota q ON p.fold_id = q.fold_id AND p.{target} = q.y_)"""


# ----- customer: classes by market segment, with missing values put in by rule
CUSTOMER = TableSpec(
    "c_mktsegment", "c_custkey", ("c_acctbal",), ("c_nationkey", "constant", "unique_id"), "customer"
)
CUSTOMER_SRC = """SELECT c_custkey, c_mktsegment,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal,
  CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(c_nationkey AS VARCHAR) END AS c_nationkey,
  CASE WHEN c_custkey % 11 = 0 THEN NULL ELSE c_nationkey END AS nation_number,
  'const' AS constant, CAST(c_custkey AS VARCHAR) AS unique_id FROM customer"""
CUSTOMER_FOLDS = kfold_sql(CUSTOMER_SRC, "c_custkey", "c_mktsegment")


def customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    nation = df.withColumn("c_nationkey", F.col("c_nationkey").cast("string"))
    return nation.select(
        "c_custkey",
        "c_mktsegment",
        with_nulls("c_acctbal", "c_custkey", 17).alias("c_acctbal"),
        with_nulls("c_nationkey", "c_custkey", 13).alias("c_nationkey"),
        F.when(F.col("c_custkey") % 11 != 0, F.col("c_nationkey").cast("int")).alias(
            "nation_number"
        ),
        F.lit("const").alias("constant"),
        F.col("c_custkey").cast("string").alias("unique_id"),
    )


def customer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold_long(customer(spark, sf_dir), "c_mktsegment", "c_custkey", K, 0.2, SEED)


def customer_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As :func:`customer_folds`, every row once."""
    return kfold_roles(customer(spark, sf_dir), "c_mktsegment", "c_custkey", K, 0.2, SEED)


# ----- orders: the flagship, classes by status
ORDERS = TableSpec("o_orderstatus", "o_orderkey", ("o_totalprice",), ("o_orderpriority",), "orders")
ORDERS_SRC = """SELECT o_orderkey, o_orderstatus,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS o_totalprice,
  CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE o_orderpriority END AS o_orderpriority
  FROM orders"""
ORDERS_FOLDS = kfold_sql(ORDERS_SRC, "o_orderkey", "o_orderstatus")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    return df.select(
        "o_orderkey",
        "o_orderstatus",
        with_nulls("o_totalprice", "o_orderkey", 17).alias("o_totalprice"),
        with_nulls("o_orderpriority", "o_orderkey", 13).alias("o_orderpriority"),
    )


def orders_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold_long(orders(spark, sf_dir), "o_orderstatus", "o_orderkey", K, 0.2, SEED)


def orders_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold_roles(orders(spark, sf_dir), "o_orderstatus", "o_orderkey", K, 0.2, SEED)


# ----- events: skewed numbers with outliers, classes by event type
EVENTS = TableSpec("event_type", "event_id", ("value", "k"), (), "events")
EVENTS_SRC = """SELECT event_id, event_type,
  CASE WHEN event_id % 17 = 0 THEN NULL ELSE value END AS value,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events"""
EVENTS_FOLDS = kfold_sql(EVENTS_SRC, "event_id", "event_type")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(
        "event_id",
        "event_type",
        with_nulls("value", "event_id", 17).alias("value"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


def events_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold_long(events(spark, sf_dir), "event_type", "event_id", K, 0.2, SEED)


def events_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kfold_roles(events(spark, sf_dir), "event_type", "event_id", K, 0.2, SEED)


def written(df: DataFrame, name: str) -> DataFrame:
    """Fold assignment used by several fits: written once."""
    return materialize(df, name)


# ----- result rows: one per supplier x line number x flags, metrics from the lines
RESULT_KEYS = ("random_state", "dataset_id", "fold", "model_name", "augmentation")
RESULTS_SRC = """SELECT CAST(year(l_shipdate) AS INTEGER) AS random_state,
  CAST(l_suppkey AS INTEGER) AS dataset_id, CAST(l_linenumber AS INTEGER) AS fold,
  l_returnflag AS model_name, l_linestatus AS augmentation,
  sqrt(avg(l_discount) * 10) AS accuracy, sqrt(avg(l_tax) * 10) AS f1,
  sqrt(avg(l_quantity)) AS time_predict, count(*) AS n_lines
  FROM lineitem GROUP BY 1, 2, 3, 4, 5"""


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return df.groupBy(
        F.year("l_shipdate").alias("random_state"),
        F.col("l_suppkey").cast("int").alias("dataset_id"),
        F.col("l_linenumber").cast("int").alias("fold"),
        F.col("l_returnflag").alias("model_name"),
        F.col("l_linestatus").alias("augmentation"),
    ).agg(
        F.sqrt(F.avg("l_discount") * 10).alias("accuracy"),
        F.sqrt(F.avg("l_tax") * 10).alias("f1"),
        F.sqrt(F.avg("l_quantity")).alias("time_predict"),
        F.count(F.lit(1)).alias("n_lines"),
    )


# ----- training log: events as scalars; one writer per user, several writes per pair
TAGS = ("click", "error", "purchase", "signup", "view")
LOG_SRC = """SELECT 'user_' || CAST(user_id AS VARCHAR) AS writer, event_type AS tag,
  CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS step, value, event_id AS seq
  FROM events"""


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    return df.select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("writer"),
        F.col("event_type").alias("tag"),
        F.get_json_object("props", "$.k").cast("int").alias("step"),
        "value",
        F.col("event_id").alias("seq"),
    )


# ----- predictions: one run per priority; probabilities rounded, so that ties occur
PRED_KEYS = ["run"]


def pred_sql(classes: int, y: str, places: int) -> str:
    draws = ", ".join(
        f"round({u_sql('p' + str(c), 'o_orderkey')}, {places}) AS d{c}" for c in range(classes)
    )
    total = " + ".join(f"d{c}" for c in range(classes))
    probs = ", ".join(f"d{c} / greatest({total}, 0.0001)" for c in range(classes))
    return f"""draws AS (SELECT o_orderkey, o_orderpriority AS run, {y} AS y_true, {draws} FROM orders),
preds AS (SELECT o_orderkey, run, y_true, [{probs}] AS probs FROM draws)"""


Y3_SQL = "CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END"
Y2_SQL = "CASE o_orderstatus WHEN 'F' THEN 0 ELSE 1 END"
PRED3 = pred_sql(3, Y3_SQL, 2)
PRED2 = pred_sql(2, Y2_SQL, 2)


def predictions(spark: SparkSession, sf_dir: str, classes: int, places: int = 2) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    status = F.col("o_orderstatus")
    y = F.when(status == "F", 0).otherwise(1)
    if classes == 3:
        y = F.when(status == "F", 0).when(status == "O", 1).otherwise(2)
    draws = [F.round(uniform(f"p{c}", "o_orderkey"), places).alias(f"d{c}") for c in range(classes)]
    total = sum((F.col(f"d{c}") for c in range(1, classes)), F.col("d0"))
    return df.select(
        "o_orderkey", F.col("o_orderpriority").alias("run"), y.alias("y_true"), *draws
    ).select(
        "o_orderkey",
        "run",
        "y_true",
        F.array(*[F.col(f"d{c}") / F.greatest(total, F.lit(0.0001)) for c in range(classes)]).alias(
            "probs"
        ),
    )


# ----- embeddings: folds over the vectors
EMB_SRC = "SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings"
EMB_FOLDS = kfold_sql(EMB_SRC, "vec_id", "label")


def embedding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("vec")
    )
    return kfold_long(df, "label", "vec_id", K, 0.2, SEED)
