"""Result analytics."""

from pyspark.sql import functions as F

from foldsmith.operators import analytics as A
from foldsmith.queries.base import (
    CUSTOMER_SRC,
    RESULT_KEYS,
    RESULTS_SRC,
    customer,
    query,
    results,
    rounded,
    sr6,
    table,
)

METRICS = ["accuracy", "f1"]
DRAWS = 1000
RUN_ID = "concat_ws('/', random_state, dataset_id, fold, model_name, augmentation)"
LONG = f"""long AS (SELECT r.*, {RUN_ID} AS run_id, m AS metric,
  CASE WHEN m = 'f1' THEN f1 ELSE accuracy END AS value
  FROM ({RESULTS_SRC}) r, (VALUES ('accuracy'), ('f1')) t(m))"""


def runs(spark, sf_dir):
    parts = [F.col(c).cast("string") for c in RESULT_KEYS]
    return results(spark, sf_dir).withColumn("run_id", F.concat_ws("/", *parts))


def ci_sql(source: str, by: str, draws: int = DRAWS) -> str:
    """Poisson bootstrap with the digest draws, written with a table of weights."""
    steps = " + ".join(f"(u > {p!r}::DOUBLE)::INTEGER" for p in A.POISSON_CDF)
    return f"""draw AS (SELECT {by}, value, k, md5(concat_ws(':', '42', CAST(k AS VARCHAR), run_id)) AS d
  FROM {source}, range({-(-draws // A.WORDS)}) g(k)),
wt AS (SELECT {by}, value, b, {steps} AS w FROM (SELECT {by}, value, {A.WORDS} * k + j AS b,
  (CAST('0x' || substr(d, CAST(1 + {A.DIGITS} * j AS BIGINT), {A.DIGITS}) AS BIGINT) + 0.5::DOUBLE) / {16**A.DIGITS}.0::DOUBLE AS u
  FROM draw, range({A.WORDS}) t(j)) WHERE b < {draws}),
res AS (SELECT {by}, b, sum(value * w) / nullif(sum(w), 0) AS m FROM wt GROUP BY {by}, b),
ci AS (SELECT {by}, quantile_cont(m, 0.025) AS ci_low, quantile_cont(m, 0.975) AS ci_high FROM res GROUP BY {by}),
mean AS (SELECT {by}, avg(value) AS mean FROM {source} GROUP BY {by})
SELECT {', '.join('mean.' + c.strip() for c in by.split(','))}, {sr6('mean')} AS mean, {sr6('ci_low')} AS ci_low,
  {sr6('ci_high')} AS ci_high FROM mean JOIN ci USING ({by})"""


@query("agg_model_by_dataset", f"WITH {LONG}, {ci_sql('long', 'dataset_id, model_name, metric')}")
def agg_model_by_dataset(spark, sf_dir):
    out = A.model_means(runs(spark, sf_dir), METRICS, ["dataset_id", "model_name"], "run_id", DRAWS)
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query("agg_model_across_datasets", f"WITH {LONG}, {ci_sql('long', 'model_name, metric')}")
def agg_model_across_datasets(spark, sf_dir):
    out = A.model_means(runs(spark, sf_dir), METRICS, ["model_name"], "run_id", DRAWS)
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query(
    "agg_model_sets",
    f"""SELECT dataset_id, model_name, metric, mean, ci_low, ci_high, 0 AS grouping FROM (
  WITH {LONG}, {ci_sql('long', 'dataset_id, model_name, metric')})
UNION ALL SELECT NULL, model_name, metric, mean, ci_low, ci_high, 1 FROM (
  WITH {LONG}, {ci_sql('long', 'model_name, metric')})""",
)
def agg_model_sets(spark, sf_dir):
    sets = [["dataset_id", "model_name"], ["model_name"]]
    out = A.model_means_sets(runs(spark, sf_dir), METRICS, sets, "run_id", DRAWS)
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query(
    "agg_model_sd",
    f"""WITH {LONG} SELECT dataset_id, model_name, metric, {sr6('avg(value)')} AS mean,
  {sr6('stddev_samp(value)')} AS sd FROM long GROUP BY 1, 2, 3""",
)
def agg_model_sd(spark, sf_dir):
    out = A.model_sd(results(spark, sf_dir), METRICS, ["dataset_id", "model_name"])
    return rounded(out, ["mean", "sd"])


@query(
    "agg_dataset_line",
    f"""WITH acc AS (SELECT *, {RUN_ID} AS run_id, accuracy AS value FROM ({RESULTS_SRC})),
{ci_sql('acc', 'model_name, dataset_id')}""",
)
def agg_dataset_line(spark, sf_dir):
    out = A.bootstrap_ci(
        runs(spark, sf_dir), ["model_name", "dataset_id"], "accuracy", "run_id", DRAWS
    )
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query(
    "bootstrap_ci",
    f"""WITH src AS (SELECT l_returnflag, l_linestatus, l_quantity AS value, concat_ws('|', l_orderkey, l_partkey,
  l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS run_id FROM lineitem),
{ci_sql('src', 'l_returnflag, l_linestatus')}""",
)
def bootstrap_ci(spark, sf_dir):
    parts = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")
    df = table(spark, sf_dir, "lineitem").withColumn(
        "run_id", F.concat_ws("|", *[F.col(c).cast("string") for c in parts])
    )
    out = A.bootstrap_ci(df, ["l_returnflag", "l_linestatus"], "l_quantity", "run_id", DRAWS)
    return rounded(out, ["mean", "ci_low", "ci_high"])


@query(
    "time_vs_accuracy",
    f"""SELECT dataset_id, model_name, round(accuracy, 4) AS accuracy, {sr6('avg(time_predict)')} AS time_predict
FROM ({RESULTS_SRC}) WHERE fold <> 7 GROUP BY 1, 2, 3""",
)
def time_vs_accuracy(spark, sf_dir):
    text = F.when(F.col("fold") == 7, "failed").otherwise(F.col("time_predict").cast("string"))
    df = results(spark, sf_dir).withColumns(
        {"time_predict": text, "accuracy": F.round("accuracy", 4)}
    )
    return rounded(A.time_vs_accuracy(df), ["time_predict"])


PRE_POST = f"""WITH r AS (SELECT fold, accuracy AS pre_eval, f1 AS post_eval FROM ({RESULTS_SRC})),
s AS (SELECT stddev_samp(pre_eval) / sqrt(count(*)) * 1.959963984540054 AS a,
  stddev_samp(post_eval) / sqrt(count(*)) * 1.959963984540054 AS b FROM r)
SELECT fold, {sr6('avg(pre_eval)')} AS pre_eval, {sr6('avg(pre_eval) - any_value(a)')} AS pre_eval_low,
  {sr6('avg(pre_eval) + any_value(a)')} AS pre_eval_high, {sr6('avg(post_eval)')} AS post_eval,
  {sr6('avg(post_eval) - any_value(b)')} AS post_eval_low, {sr6('avg(post_eval) + any_value(b)')} AS post_eval_high
FROM r, s GROUP BY fold"""


@query("fold_pre_post", PRE_POST)
def fold_pre_post(spark, sf_dir):
    df = results(spark, sf_dir).select(
        "fold", F.col("accuracy").alias("pre_eval"), F.col("f1").alias("post_eval")
    )
    out = A.fold_pre_post(df)
    return rounded(out, [c for c in out.columns if c != "fold"])


COMPARE = f"""o AS (SELECT 'old' AS origin, c_acctbal FROM ({CUSTOMER_SRC}) UNION ALL
  SELECT 'new', s_acctbal FROM supplier),
v AS (SELECT origin, c_acctbal AS x FROM o WHERE c_acctbal IS NOT NULL),
s AS (SELECT origin, count(*) AS n, min(x) AS lo, (max(x) - min(x)) / 30 AS w, stddev_samp(x) AS sd FROM v GROUP BY 1),
h AS (SELECT v.origin, least(CAST(floor((x - lo) / w) AS INTEGER), 29) AS bin, count(*) AS c
  FROM v JOIN s ON v.origin = s.origin GROUP BY 1, 2)"""


def compared(spark, sf_dir):
    old = customer(spark, sf_dir).select(F.lit("old").alias("origin"), "c_acctbal")
    new = table(spark, sf_dir, "supplier").select(
        F.lit("new").alias("origin"), F.col("s_acctbal").alias("c_acctbal")
    )
    return old.unionByName(new)


@query(
    "distribution_compare",
    f"""WITH {COMPARE} SELECT h.origin, 'c_acctbal' AS "column", bin, {sr6('lo + bin * w')} AS "left",
  {sr6('lo + bin * w + w')} AS "right", {sr6('c / (n * w)', 9)} AS density FROM h JOIN s ON h.origin = s.origin""",
)
def distribution_compare(spark, sf_dir):
    out = A.histograms(compared(spark, sf_dir), ["c_acctbal"])
    return rounded(rounded(out, ["left", "right"]), ["density"], 9)


@query(
    "distribution_curve",
    f"""WITH {COMPARE}, g AS (SELECT s.*, p, lo + p * w * 30 / 49.0::DOUBLE AS x, sd * pow(n, -0.2) AS bw
  FROM s, range(50) t(p))
SELECT g.origin, 'c_acctbal' AS "column", CAST(p AS INTEGER) AS point, {sr6('x')} AS x,
  {sr6('sum(c * exp(-0.5 * pow((x - (lo + bin * w + w / 2)) / bw, 2))) / (n * bw * sqrt(2 * pi()))', 9)} AS density
FROM g JOIN h ON g.origin = h.origin GROUP BY g.origin, p, x, n, bw""",
)
def distribution_curve(spark, sf_dir):
    out = A.density_curves(compared(spark, sf_dir), ["c_acctbal"])
    return rounded(rounded(out, ["x"]), ["density"], 9)


@query(
    "mean_over_runs",
    f"""SELECT model_name, {sr6('avg(accuracy)')} AS accuracy, {sr6('avg(time_predict)')} AS time_predict
FROM ({RESULTS_SRC}) GROUP BY 1""",
)
def mean_over_runs(spark, sf_dir):
    out = A.mean_over_runs(results(spark, sf_dir), ["model_name"], ["accuracy", "time_predict"])
    return rounded(out, ["accuracy", "time_predict"])
