"""Classification metrics."""

from pyspark.sql import functions as F

from foldsmith.operators import metrics as M
from foldsmith.queries.base import (
    PRED2,
    PRED3,
    PRED_KEYS,
    RESULTS_SRC,
    predictions,
    query,
    results,
    rounded,
    sr6,
)

ARGMAX = "list_position(probs, list_max(probs)) - 1"
LABELS3 = f"{PRED3}, l AS (SELECT *, {ARGMAX} AS y_pred FROM preds)"
LABELS2 = f"{PRED2}, l AS (SELECT *, {ARGMAX} AS y_pred FROM preds)"
LOSS = "-ln(greatest(least(probs[y_true + 1], 1 - 2.220446049250313e-16), 2.220446049250313e-16))"
F1 = """f1t AS (SELECT t.run, t.c, t.support, coalesce(p.predicted, 0) AS predicted, coalesce(h.hits, 0) AS hits
  FROM (SELECT run, y_true AS c, count(*) AS support FROM l GROUP BY 1, 2) t
  LEFT JOIN (SELECT run, y_pred AS c, count(*) AS predicted FROM l GROUP BY 1, 2) p
    ON t.run = p.run AND t.c = p.c
  LEFT JOIN (SELECT run, y_true AS c, count(*) AS hits FROM l WHERE y_true = y_pred GROUP BY 1, 2) h
    ON t.run = h.run AND t.c = h.c),
f1 AS (SELECT run, sum(support * CASE WHEN hits = 0 THEN 0 ELSE 2.0 * (hits / predicted) * (hits / support)
  / (hits / predicted + hits / support) END) / sum(support) AS f1 FROM f1t GROUP BY run)"""


@query("predict_label", f"WITH {LABELS3} SELECT o_orderkey, CAST(y_pred AS INTEGER) AS y_pred FROM l")
def predict_label(spark, sf_dir):
    return M.predict_label(predictions(spark, sf_dir, 3)).select("o_orderkey", "y_pred")


@query(
    "confusion",
    f"""WITH {LABELS3} SELECT run, y_true, CAST(y_pred AS INTEGER) AS y_pred, count(*) AS n
FROM l GROUP BY 1, 2, 3""",
)
def confusion(spark, sf_dir):
    return M.confusion(predictions(spark, sf_dir, 3), PRED_KEYS)


@query(
    "metric_accuracy",
    f"""WITH {LABELS3} SELECT run, {sr6('avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)')} AS accuracy
FROM l GROUP BY run""",
)
def metric_accuracy(spark, sf_dir):
    return rounded(M.accuracy(predictions(spark, sf_dir, 3), PRED_KEYS), ["accuracy"])


HARD = """(sum(CASE WHEN y_true = 1 AND y_pred = 1 THEN 1.0 ELSE 0.0 END) / count(*) FILTER (WHERE y_true = 1)
 + sum(CASE WHEN y_true = 0 AND y_pred = 0 THEN 1.0 ELSE 0.0 END) / count(*) FILTER (WHERE y_true = 0)) / 2"""


@query("metric_auc_hard", f"WITH {LABELS2} SELECT run, {sr6(HARD)} AS auc FROM l GROUP BY run")
def metric_auc_hard(spark, sf_dir):
    return rounded(M.auc_hard(predictions(spark, sf_dir, 2), PRED_KEYS), ["auc"])


def _midrank_auc(keys: str, source: str) -> str:
    """Mann-Whitney from average ranks: another formula than the operator's."""
    return f"""SELECT {keys}, (sum(mid) FILTER (WHERE pos) - count(*) FILTER (WHERE pos)
  * (count(*) FILTER (WHERE pos) + 1) / 2.0) / (count(*) FILTER (WHERE pos) * count(*) FILTER (WHERE NOT pos)) AS auc
FROM (SELECT *, rank() OVER (PARTITION BY {keys} ORDER BY score)
  + (count(*) OVER (PARTITION BY {keys}, score) - 1) / 2.0 AS mid FROM ({source})) GROUP BY {keys}"""


AUC2 = _midrank_auc("run", "SELECT run, probs[2] AS score, y_true = 1 AS pos FROM preds")
OVR = _midrank_auc(
    "run, c", "SELECT run, c, probs[c + 1] AS score, y_true = c AS pos FROM preds, range(3) g(c)"
)
OVO = _midrank_auc(
    "run, a, b",
    """SELECT run, a, b, probs[a + 1] AS score, y_true = a AS pos FROM preds, range(3) g(a), range(3) h(b)
    WHERE a <> b AND (y_true = a OR y_true = b)""",
)


@query(
    "metric_auc_prob",
    f"""WITH {PRED2.replace('draws', 'draws2').replace('preds', 'preds2')}, {PRED3}
SELECT run, 'ovo' AS scheme, {sr6('avg(auc)')} AS auc FROM ({OVO}) GROUP BY run
UNION ALL SELECT run, 'ovr', {sr6('avg(auc)')} FROM ({OVR}) GROUP BY run
UNION ALL SELECT run, 'binary', {sr6('auc')} FROM ({AUC2.replace('FROM preds', 'FROM preds2')})""",
)
def metric_auc_prob(spark, sf_dir):
    three, two = predictions(spark, sf_dir, 3), predictions(spark, sf_dir, 2)
    both = M.auc_schemes(three, PRED_KEYS)
    parts = [both.select(*PRED_KEYS, F.col(x).alias("auc"), F.lit(x).alias("scheme")) for x in M.SCHEMES]
    parts.append(M.auc_prob(two, PRED_KEYS).withColumn("scheme", F.lit("binary")))
    return rounded(parts[0].unionByName(parts[1]).unionByName(parts[2]), ["auc"])


@query("metric_f1_weighted", f"WITH {LABELS3}, {F1} SELECT run, {sr6('f1')} AS f1 FROM f1")
def metric_f1_weighted(spark, sf_dir):
    return rounded(M.f1_weighted(predictions(spark, sf_dir, 3), PRED_KEYS), ["f1"])


@query(
    "metric_log_loss",
    f"WITH {PRED3} SELECT run, {sr6(f'avg({LOSS})')} AS log_loss FROM preds GROUP BY run",
)
def metric_log_loss(spark, sf_dir):
    return rounded(M.log_loss(predictions(spark, sf_dir, 3), PRED_KEYS), ["log_loss"])


@query(
    "metrics_all",
    f"""WITH {LABELS2}, {F1} SELECT l.run, {sr6('avg(CASE WHEN y_true = y_pred THEN 1.0 ELSE 0.0 END)')} AS accuracy,
  {sr6(HARD)} AS auc, {sr6('any_value(f1)')} AS f1, {sr6(f'avg({LOSS})')} AS log_loss
FROM l JOIN f1 ON l.run = f1.run GROUP BY l.run""",
)
def metrics_all(spark, sf_dir):
    out = M.metrics_all(predictions(spark, sf_dir, 2), PRED_KEYS)
    return rounded(out, ["accuracy", "auc", "f1", "log_loss"])


BATCHES_SRC = f"""SELECT dataset_id AS run, fold AS epoch, m AS metric,
  CASE WHEN m = 'f1' AND (f1 < 0.4001 OR model_name = 'A') THEN 'nan'::DOUBLE
  WHEN m = 'f1' THEN f1 ELSE accuracy END AS value FROM ({RESULTS_SRC}), (VALUES ('accuracy'), ('f1')) t(m)"""


def batch_values(spark, sf_dir):
    df = results(spark, sf_dir)
    missing = (F.col("f1") < 0.4001) | (F.col("model_name") == "A")
    f1 = F.when(missing, float("nan")).otherwise(F.col("f1"))
    entries = F.array(
        F.struct(F.lit("accuracy").alias("metric"), F.col("accuracy").alias("value")),
        F.struct(F.lit("f1").alias("metric"), f1.alias("value")),
    )
    return df.select(
        F.col("dataset_id").alias("run"), F.col("fold").alias("epoch"), F.inline(entries)
    )


@query(
    "epoch_metrics",
    f"""SELECT run, epoch, metric, {sr6('avg(value) FILTER (WHERE NOT isnan(value))')} AS value
FROM ({BATCHES_SRC}) GROUP BY 1, 2, 3""",
)
def epoch_metrics(spark, sf_dir):
    return rounded(M.epoch_metrics(batch_values(spark, sf_dir)), ["value"])


@query(
    "best_epoch",
    f"""WITH e AS (SELECT dataset_id AS run, fold AS epoch, round(avg(accuracy), 9) AS log_loss
  FROM ({RESULTS_SRC}) GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN log_loss < min(log_loss) OVER (PARTITION BY run ORDER BY epoch
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS better FROM e)
SELECT run, (SELECT min(epoch) FROM e WHERE e.run = i.run AND e.log_loss = min(i.log_loss)) AS best_epoch,
  {sr6('min(log_loss)')} AS log_loss, CAST(sum(better) AS BIGINT) AS improvements FROM i GROUP BY run""",
)
def best_epoch(spark, sf_dir):
    log = (
        results(spark, sf_dir)
        .groupBy(F.col("dataset_id").alias("run"), F.col("fold").alias("epoch"))
        .agg(F.round(F.avg("accuracy"), 9).alias("log_loss"))
    )
    return rounded(M.best_epoch(log), ["log_loss"])
