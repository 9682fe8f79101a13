"""Sources and sinks."""

from pyspark.sql import functions as F

from foldsmith.functions.hashing import uniform
from foldsmith.queries.base import (
    CUSTOMER,
    CUSTOMER_SRC,
    LOG_SRC,
    RESULT_KEYS,
    RESULTS_SRC,
    TAGS,
    customer,
    log,
    query,
    results,
    rounded,
    sr6,
    table,
    u_sql,
)
from foldsmith.session import new_path
from foldsmith.sources import logs, tables
from foldsmith.sources import results as R


@query("src_csv", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def src_csv(spark, sf_dir):
    path = new_path(spark, "orders-csv")
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"]
    df = table(spark, sf_dir, "orders").select(*columns)
    df.write.option("header", True).csv(path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema.fields)
    return tables.read_csv(spark, path, schema)


@query(
    "src_task",
    f"""SELECT c_custkey, c_mktsegment, c_acctbal, c_nationkey, nation_number, constant, unique_id,
  'c_mktsegment' AS target, 'c_acctbal,nation_number' AS numeric_columns,
  'c_nationkey,constant,unique_id' AS categorical_columns FROM ({CUSTOMER_SRC})""",
)
def src_task(spark, sf_dir):
    indicator = {"c_acctbal": False, "c_nationkey": True, "constant": True, "unique_id": False}
    df, spec = tables.load_task(
        customer(spark, sf_dir), CUSTOMER.target, CUSTOMER.row_id, indicator, "customer"
    )
    return df.select(
        *df.columns,
        F.lit(spec.target).alias("target"),
        F.lit(",".join(spec.numeric)).alias("numeric_columns"),
        F.lit(",".join(spec.categorical)).alias("categorical_columns"),
    )


@query(
    "src_predefined_split",
    f"""SELECT o_orderkey, o_orderstatus, CAST(r AS INTEGER) AS repeat, CAST(f AS INTEGER) AS fold,
  0 AS sample, CASE WHEN floor({u_sql('split', 'r', 'o_orderkey')} * 3) = f THEN 'test' ELSE 'train' END AS role
FROM orders, range(2) a(r), range(3) b(f)""",
)
def src_predefined_split(spark, sf_dir):
    df = table(spark, sf_dir, "orders")
    given = (
        df.select("o_orderkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("repeat"))
        .withColumn("part", F.floor(uniform("split", "repeat", "o_orderkey") * 3))
        .select("*", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("fold"))
        .select(
            "o_orderkey",
            "repeat",
            "fold",
            F.lit(0).alias("sample"),
            F.when(F.col("part") == F.col("fold"), "test").otherwise("train").alias("role"),
        )
    )
    return tables.predefined_split(
        df.select("o_orderkey", "o_orderstatus"), given, "o_orderkey"
    )


COLUMNS = [*RESULT_KEYS, "accuracy", "f1", "time_predict", "n_lines"]


def _stored(spark, sf_dir, name):
    path = new_path(spark, name)
    R.store_results(results(spark, sf_dir), path)
    return path


@query("sink_results", f"SELECT dataset_id, count(*) AS runs FROM ({RESULTS_SRC}) GROUP BY 1")
def sink_results(spark, sf_dir):
    stored = R.load_results(spark, _stored(spark, sf_dir, "results"))
    return stored.groupBy("dataset_id").agg(F.count(F.lit(1)).alias("runs"))


@query(
    "src_results",
    f"""SELECT random_state, dataset_id, fold, model_name, augmentation, {sr6('accuracy')} AS accuracy,
  {sr6('f1')} AS f1, {sr6('time_predict')} AS time_predict, n_lines FROM ({RESULTS_SRC})""",
)
def src_results(spark, sf_dir):
    stored = R.load_results(spark, _stored(spark, sf_dir, "results")).select(*COLUMNS)
    return rounded(stored, ["accuracy", "f1", "time_predict"])


@query(
    "run_resume",
    f"""WITH r AS ({RESULTS_SRC}), stored AS (SELECT * FROM r WHERE accuracy >= 0.6001)
SELECT random_state, dataset_id, fold, model_name, augmentation FROM r
WHERE NOT EXISTS (SELECT 1 FROM stored s WHERE s.random_state = r.random_state
  AND s.dataset_id = r.dataset_id AND s.fold = r.fold AND s.model_name = r.model_name
  AND s.augmentation = r.augmentation)""",
)
def run_resume(spark, sf_dir):
    path = new_path(spark, "partial-results")
    everything = results(spark, sf_dir)
    R.store_results(everything.filter("accuracy >= 0.6001"), path)
    return R.pending_runs(everything.select(*RESULT_KEYS), R.load_results(spark, path))


@query(
    "sink_log",
    f"""SELECT writer, tag, step, value, seq,
  '{{"name":"' || writer || '","rows":' || count(*) OVER (PARTITION BY writer) || '}}' AS config
FROM ({LOG_SRC})""",
)
def sink_log(spark, sf_dir):
    path = new_path(spark, "log")
    scalars = log(spark, sf_dir)
    configs = (
        scalars.groupBy("writer")
        .agg(F.count(F.lit(1)).alias("rows"))
        .select("writer", F.struct(F.col("writer").alias("name"), "rows").alias("config"))
    )
    logs.register_writers(configs, path)
    logs.append_scalars(scalars, path)
    return logs.read_log(spark, path).join(spark.read.parquet(f"{path}/writers"), "writer")


WIDE = ", ".join(f"arg_max(value, seq) FILTER (WHERE tag = '{t}') AS {t}" for t in TAGS)
PIVOT_SQL = f"SELECT writer, step, {WIDE} FROM ({LOG_SRC}) GROUP BY writer, step"


@query("sink_log_csv", PIVOT_SQL)
def sink_log_csv(spark, sf_dir):
    path = new_path(spark, "log-csv")
    logs.save_log_csv(log(spark, sf_dir), TAGS, path, ("writer", "step"))
    schema = "writer string, step int, " + ", ".join(f"{t} double" for t in TAGS)
    return tables.read_csv(spark, path, schema)


@query("log_pivot", PIVOT_SQL)
def log_pivot(spark, sf_dir):
    return logs.log_pivot(log(spark, sf_dir), TAGS, ("writer", "step"))


@query(
    "sink_eval_json",
    f"""WITH leaf AS (SELECT random_state, dataset_id, fold, model_name AS model,
  '[' || string_agg('{{"accuracy":' || CAST(round(accuracy, 4) AS VARCHAR) || ',"f1":' || CAST(round(f1, 4) AS VARCHAR) || '}}',
  ',' ORDER BY augmentation) || ']' AS body FROM ({RESULTS_SRC}) GROUP BY 1, 2, 3, 4),
fld AS (SELECT random_state, dataset_id, fold, '{{' || string_agg('"' || model || '":' || body, ','
  ORDER BY '"' || model || '":' || body) || '}}' AS body FROM leaf GROUP BY 1, 2, 3)
SELECT 'random_state_' || random_state AS random_state, 'dataset_' || dataset_id AS dataset,
  '{{' || string_agg('"fold_' || fold || '":' || body, ',' ORDER BY '"fold_' || fold || '":' || body) || '}}'
  AS evaluation FROM fld GROUP BY random_state, dataset_id""",
)
def sink_eval_json(spark, sf_dir):
    steps = results(spark, sf_dir).select(
        "random_state",
        "dataset_id",
        "fold",
        F.col("model_name").alias("model"),
        F.col("augmentation").alias("step"),
        F.round("accuracy", 4).alias("accuracy"),
        F.round("f1", 4).alias("f1"),
    )
    return R.results_json(steps, ["accuracy", "f1"])
