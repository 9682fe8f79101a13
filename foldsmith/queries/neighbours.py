"""Neighbour joins and augmentation."""

import math

from pyspark.sql import functions as F

from foldsmith.operators import augment as A
from foldsmith.operators import neighbour_graph as G
from foldsmith.operators import neighbours as N
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.queries.base import (
    CUSTOMER_SRC,
    EMB_FOLDS,
    EMB_SRC,
    ORDERS,
    customer,
    embedding_folds,
    kfold_sql,
    orders_roles,
    query,
    rounded,
    sr6,
    table,
    written,
)
from foldsmith.operators.splits import kfold_long
from foldsmith.spec import TableSpec


def _sides(df, row_id, vec="vec"):
    q = df.filter("role = 'test'").select(
        "fold_id", F.col(row_id).alias("q_id"), F.col(vec).alias("vec")
    )
    s = df.filter("role = 'train'").select(
        "fold_id", F.col(row_id).alias("s_id"), F.col(vec).alias("vec")
    )
    return q, s


def _embedding_sides(spark, sf_dir):
    return _sides(written(embedding_folds(spark, sf_dir), "embedding-folds"), "vec_id")


def _knn_sql(distance: str, k: int) -> str:
    return f"""pairs AS (SELECT q.fold_id, q.vec_id AS q_id, s.vec_id AS s_id, {distance} AS distance
  FROM folds q JOIN folds s ON q.fold_id = s.fold_id AND q.role = 'test' AND s.role = 'train'),
near AS (SELECT *, row_number() OVER (PARTITION BY fold_id, q_id ORDER BY distance, s_id) AS rank
  FROM pairs QUALIFY rank <= {k})"""


OUT = f"SELECT fold_id, q_id, s_id, {sr6('distance')} AS distance, CAST(rank AS INTEGER) AS rank FROM near"


@query("knn_join", f"WITH {EMB_FOLDS}, {_knn_sql('list_distance(q.vec, s.vec)', 5)} {OUT}")
def knn_join(spark, sf_dir):
    q, s = _embedding_sides(spark, sf_dir)
    return rounded(N.knn_join(q, s, 5, by=["fold_id"]), ["distance"])


@query("knn_join_approx")
def knn_join_approx(spark, sf_dir):
    """Every 50th vector against all, with the recall against the exact join."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding IS NOT NULL")
    s = vectors.select(F.col("vec_id").alias("s_id"), F.col("embedding").alias("vec"))
    q = s.where("s_id % 50 = 0").withColumnRenamed("s_id", "q_id")
    found = written(G.knn_join_approx(q, s, 10), "approx")
    reached = G.recall(found, q, s, 10).select("recall").first()[0]
    return rounded(found, ["distance"]).withColumn("recall", F.lit(reached))


GAPS = "list_transform(range(1, len(q.vec) + 1), lambda i: abs(q.vec[i] - s.vec[i]))"


@query(
    "knn_join_metric",
    " UNION ALL ".join(
        f"SELECT *, '{name}' AS metric FROM (WITH {EMB_FOLDS}, {_knn_sql(d, 5)} {OUT})"
        for name, d in (
            ("p1", f"list_sum({GAPS})"),
            ("p2", "list_distance(q.vec, s.vec)"),
            ("inf", f"list_max({GAPS})"),
            ("cosine", "list_cosine_distance(q.vec, s.vec)"),
        )
    ),
)
def knn_join_metric(spark, sf_dir):
    q, s = _embedding_sides(spark, sf_dir)
    out = None
    for name, options in (
        ("p1", {"p": 1}),
        ("p2", {"p": 2}),
        ("inf", {"p": math.inf}),
        ("cosine", {"metric": "cosine"}),
    ):
        part = N.knn_join(q, s, 5, by=["fold_id"], **options).withColumn("metric", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["distance"])


@query(
    "knn_cosine_join",
    f"WITH {EMB_FOLDS}, {_knn_sql('list_cosine_distance(q.vec, s.vec)', 10)} {OUT}",
)
def knn_cosine_join(spark, sf_dir):
    q, s = _embedding_sides(spark, sf_dir)
    return rounded(N.knn_join(q, s, 10, "cosine", by=["fold_id"]), ["distance"])


@query(
    "cosine_similarity",
    f"""WITH {EMB_FOLDS} SELECT q.fold_id, q.vec_id AS q_id, s.vec_id AS s_id,
  {sr6('list_cosine_similarity(q.vec, s.vec)')} AS similarity FROM folds q JOIN folds s
  ON q.fold_id = s.fold_id AND q.role = 'test' AND s.role = 'train'
WHERE list_cosine_similarity(q.vec, s.vec) >= 0.3""",
)
def cosine_similarity(spark, sf_dir):
    q, s = _embedding_sides(spark, sf_dir)
    return rounded(N.cosine_similarity(q, s, 0.3, by=["fold_id"]), ["similarity"])


# Customers with two plain features, so that the values of neighbours can be collapsed.
POINTS_SRC = """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label,
  c_acctbal / 1000 AS balance, CAST(c_nationkey AS DOUBLE) AS nation FROM customer"""
POINTS_FOLDS = kfold_sql(POINTS_SRC, "c_custkey", "label")
POINTS = TableSpec("label", "c_custkey", ("balance", "nation"), (), "customer")


def points(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("label"),
        (F.col("c_acctbal") / 1000).alias("balance"),
        F.col("c_nationkey").cast("double").alias("nation"),
    )


def point_folds(spark, sf_dir):
    return written(kfold_long(points(spark, sf_dir), "label", "c_custkey"), "point-folds")


POINT_NEAR = """near AS (SELECT q.fold_id, q.c_custkey AS q_id, s.c_custkey AS s_id, s.balance, s.nation, s.label,
  sqrt(pow(q.balance - s.balance, 2) + pow(q.nation - s.nation, 2)) AS distance,
  row_number() OVER (PARTITION BY q.fold_id, q.c_custkey ORDER BY
  sqrt(pow(q.balance - s.balance, 2) + pow(q.nation - s.nation, 2)), s.c_custkey) AS rank
  FROM folds q JOIN folds s ON q.fold_id = s.fold_id AND q.role = 'test' AND s.role = 'train' QUALIFY rank <= 5)"""
W = "1 / (distance + 1e-6)"
HOW = {
    "median": "median({c})",
    "mean": "avg({c})",
    "weighted_average": f"sum({W} * {{c}}) / sum({W})",
    "max": "max({c})",
    "min": "min({c})",
    "random": "arg_min({c}, md5(concat_ws(':', '42', CAST(q_id AS VARCHAR), CAST(s_id AS VARCHAR))))",
    "first": "arg_min({c}, rank)",
}


@query(
    "neighbour_aggregate",
    f"WITH {POINTS_FOLDS}, {POINT_NEAR} "
    + " UNION ALL ".join(
        f"""SELECT fold_id, q_id, '{name}' AS aggregation, {sr6(sql.format(c='balance'))} AS balance,
  {sr6(sql.format(c='nation'))} AS nation FROM near GROUP BY fold_id, q_id"""
        for name, sql in HOW.items()
    ),
)
def neighbour_aggregate(spark, sf_dir):
    df = point_folds(spark, sf_dir).withColumn("vec", N.vector(POINTS.features))
    q, s = _sides(df, "c_custkey")
    near = written(N.knn_join(q, s, 5, by=["fold_id"]), "near")
    train = df.filter("role = 'train'").select(
        "fold_id", F.col("c_custkey").alias("s_id"), "balance", "nation"
    )
    out = None
    for how in N.AGGREGATIONS:
        part = N.neighbour_aggregate(near, train, ["balance", "nation"], how, ["fold_id"])
        part = part.withColumn("aggregation", F.lit(how))
        out = part if out is None else out.unionByName(part)
    return rounded(out, ["balance", "nation"])


# The flagship: orders through the whole chain, then neighbour rows of the test features.
@query("flagship_orders")
def flagship_orders(spark, sf_dir):
    raw = written(orders_roles(spark, sf_dir), "order-roles")
    model = Preprocessor(ORDERS).fit(raw)
    ready = written(model.transform(raw), "prepared")
    out = A.augment_knn(ready, model.output_spec, multi_class=True)
    return rounded(out, [*model.features], 5)


@query(
    "augment_knn",
    f"""WITH {POINTS_FOLDS}, {POINT_NEAR} SELECT fold_id, c_custkey, {sr6('balance')} AS balance, {sr6('nation')} AS nation,
  CAST(label AS DOUBLE) AS label, 'train' AS origin FROM folds WHERE role = 'train' UNION ALL
SELECT fold_id, q_id, {sr6('median(balance)')}, {sr6('median(nation)')}, median(label), 'neighbours'
FROM near GROUP BY fold_id, q_id""",
)
def augment_knn(spark, sf_dir):
    out = A.augment_knn(point_folds(spark, sf_dir), POINTS)
    return rounded(out, ["balance", "nation"])


AUG_SRC = """SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN 1 ELSE 0 END AS label,
  CASE WHEN c_custkey % 17 = 0 THEN NULL ELSE c_acctbal / 1000 END AS balance,
  CAST(c_nationkey AS DOUBLE) AS nation FROM customer"""


@query(
    "augment_dataset",
    f"""WITH raw AS (WITH {kfold_sql(AUG_SRC, 'c_custkey', 'label')} SELECT * FROM folds),
m AS (SELECT fold_id, avg(balance) AS mb FROM raw WHERE role = 'train' GROUP BY 1),
folds AS (SELECT raw.* EXCLUDE (balance), round(coalesce(balance, mb), 9) AS balance
  FROM raw JOIN m ON raw.fold_id = m.fold_id), {POINT_NEAR}
SELECT fold_id, c_custkey, {sr6('balance')} AS balance, {sr6('nation')} AS nation,
  label, 'train' AS origin FROM folds WHERE role = 'train' UNION ALL
SELECT fold_id, q_id, {sr6('avg(balance)')}, {sr6('avg(nation)')}, CASE WHEN avg(label) > 0.5 THEN 1 ELSE 0 END,
  'neighbours' FROM near GROUP BY fold_id, q_id""",
)
def augment_dataset(spark, sf_dir):
    df = points(spark, sf_dir).withColumn(
        "balance", F.when(F.col("c_custkey") % 17 != 0, F.col("balance"))
    )
    folds = written(kfold_long(df, "label", "c_custkey"), "point-folds")
    out = A.augment_dataset(folds, POINTS, aggregation="mean")
    return rounded(out, ["balance", "nation"])


def _retrieved(alias: str, rows: str, row_id: str, target: bool) -> str:
    """Mean of the ten cosine neighbours of each row."""
    def vec(t):
        return f"[{t}.balance, {t}.nation, CAST({t}.label AS DOUBLE)]" if target else f"[{t}.balance, {t}.nation]"

    return f"""{alias} AS (SELECT fold_id, '{alias}:' || CAST(q_id AS VARCHAR) AS cand, avg(balance) AS balance,
  avg(nation) AS nation, avg(label) AS label FROM (SELECT q.fold_id, q.{row_id} AS q_id, s.balance, s.nation,
  s.label, row_number() OVER (PARTITION BY q.fold_id, q.{row_id} ORDER BY
  list_cosine_distance({vec('q')}, {vec('s')}), s.c_custkey) AS r
  FROM {rows} q JOIN folds s ON q.fold_id = s.fold_id AND s.role = 'train') WHERE r <= 10 GROUP BY 1, q_id)"""


RAG_POINTS = POINTS_SRC.replace("c_acctbal / 1000 AS balance", "c_acctbal / 1000 + c_custkey / 100000.0::DOUBLE AS balance").replace(
    "CAST(c_nationkey AS DOUBLE) AS nation", "CAST(c_nationkey AS DOUBLE) + 0.5 + c_custkey / 70000.0::DOUBLE AS nation"
)


@query(
    "augment_rag",
    f"""WITH {kfold_sql(RAG_POINTS, 'c_custkey', 'label')},
syn AS (SELECT f AS fold_id, s_suppkey, s_acctbal / 1000 AS balance, CAST(s_nationkey AS DOUBLE) + 0.5 AS nation,
  CAST(s_suppkey % 2 AS INTEGER) AS label FROM supplier, range(5) g(f)),
{_retrieved('synthetic', 'syn', 's_suppkey', True)},
unk AS (SELECT * FROM folds WHERE role <> 'train'),
{_retrieved('unknown', 'unk', 'c_custkey', False)},
cand AS (SELECT *, 0.3 AS w FROM synthetic UNION ALL SELECT *, 0.7 FROM unknown),
pick AS (SELECT *, row_number() OVER (PARTITION BY fold_id ORDER BY -ln((CAST('0x' || substr(md5(concat_ws(':', '42',
  CAST(fold_id AS VARCHAR), cand)), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / w, cand) AS r FROM cand),
need AS (SELECT fold_id, CAST(floor(0.25 * count(*)) AS BIGINT) AS n FROM folds WHERE role = 'train' GROUP BY 1)
SELECT fold_id, CAST(c_custkey AS VARCHAR) AS c_custkey, {sr6('balance')} AS balance, {sr6('nation')} AS nation,
  {sr6('label')} AS label, 'train' AS origin FROM folds WHERE role = 'train' UNION ALL
SELECT p.fold_id, cand, {sr6('balance')}, {sr6('nation')}, {sr6('label')}, 'retrieved'
FROM pick p JOIN need ON p.fold_id = need.fold_id WHERE r <= n""",
)
def augment_rag(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(F.col("c_mktsegment") == "BUILDING", 1).otherwise(0).alias("label"),
        (F.col("c_acctbal") / 1000 + F.col("c_custkey") / F.lit(100000.0)).alias("balance"),
        (F.col("c_nationkey").cast("double") + 0.5 + F.col("c_custkey") / F.lit(70000.0)).alias(
            "nation"
        ),
    )
    folds = written(kfold_long(df, "label", "c_custkey"), "point-folds")
    synthetic = table(spark, sf_dir, "supplier").select(
        F.explode(F.sequence(F.lit(0), F.lit(4))).alias("fold_id"),
        F.col("s_suppkey").alias("c_custkey"),
        (F.col("s_acctbal") / 1000).alias("balance"),
        (F.col("s_nationkey").cast("double") + 0.5).alias("nation"),
        (F.col("s_suppkey") % 2).cast("int").alias("label"),
    )
    out = A.augment_rag(folds, synthetic, POINTS, share=0.25)
    return rounded(out, ["balance", "nation", "label"])
