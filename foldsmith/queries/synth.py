"""The fitted chain, synthetic rows and augmentation arms."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from foldsmith.operators.clean import impute_synth_prep
from foldsmith.operators.encode import vocabulary
from foldsmith.operators.foldwise import by_fold
from foldsmith.operators.stats import train_rows
from foldsmith.operators.synth import CopulaModel, synth_decode, synth_prepare
from foldsmith.plans.arms import augment, topup
from foldsmith.plans.preprocess import Preprocessor
from foldsmith.queries.base import (
    CUSTOMER,
    CUSTOMER_FOLDS,
    EVENTS,
    customer_folds,
    customer_roles,
    events_roles,
    query,
    rounded,
    sr6,
    written,
)
from foldsmith.queries.neighbours import POINTS, POINTS_FOLDS, point_folds
from foldsmith.spec import TableSpec

# Customers with labels missing by rule, a constant and a unique column, NULL numbers.
CHAIN_SQL = f"""WITH {CUSTOMER_FOLDS},
lab AS (SELECT fold_id, y, row_number() OVER (PARTITION BY fold_id ORDER BY y) - 1 AS code
  FROM (SELECT DISTINCT fold_id, c_mktsegment AS y FROM folds WHERE role = 'train')),
st AS (SELECT fold_id, avg(c_acctbal) AS m, mode(c_nationkey ORDER BY c_nationkey) AS md FROM folds
  WHERE role = 'train' GROUP BY 1),
im AS (SELECT c_custkey, f.fold_id, role, coalesce(c_acctbal, m) AS x, coalesce(c_nationkey, md) AS g,
  c_mktsegment FROM folds f JOIN st ON f.fold_id = st.fold_id),
cat AS (SELECT fold_id, g, row_number() OVER (PARTITION BY fold_id ORDER BY g) - 1 AS code
  FROM (SELECT DISTINCT fold_id, g FROM im WHERE role = 'train')),
en AS (SELECT c_custkey, im.fold_id, role, x, CAST(coalesce(cat.code, -1) AS DOUBLE) AS g, lab.code AS y
  FROM im JOIN lab ON im.fold_id = lab.fold_id AND im.c_mktsegment = lab.y
  LEFT JOIN cat ON im.fold_id = cat.fold_id AND im.g = cat.g),
lim AS (SELECT fold_id, avg(x) AS m, stddev_samp(x) AS s FROM en WHERE role = 'train' GROUP BY 1),
ok AS (SELECT en.* FROM en JOIN lim ON en.fold_id = lim.fold_id WHERE abs((x - m) / s) <= 1.5),
sc AS (SELECT fold_id, avg(x) AS mx, stddev_samp(x) AS sx, avg(g) AS mg, stddev_samp(g) AS sg
  FROM ok WHERE role = 'train' GROUP BY 1)
SELECT c_custkey, ok.fold_id, role, {sr6('(x - mx) / sx')} AS c_acctbal, {sr6('(g - mg) / sg')} AS c_nationkey,
  CAST(y AS INTEGER) AS c_mktsegment FROM ok JOIN sc ON ok.fold_id = sc.fold_id"""


@query("preprocess", CHAIN_SQL)
def preprocess(spark, sf_dir):
    raw = written(customer_roles(spark, sf_dir), "customer-roles")
    model = Preprocessor(CUSTOMER, transform="none", outlier_limit=1.5).fit(raw)
    return rounded(model.transform(raw), model.features)


@query("preprocess_quantile")
def preprocess_quantile(spark, sf_dir):
    raw = written(customer_roles(spark, sf_dir), "customer-roles")
    model = Preprocessor(CUSTOMER).fit(raw)
    return rounded(model.transform(raw), model.features, 5)


@query("preprocess_power")
def preprocess_power(spark, sf_dir):
    raw = written(events_roles(spark, sf_dir), "event-roles")
    model = Preprocessor(EVENTS, transform="power").fit(raw)
    return rounded(model.transform(raw), model.features, 4)


KEYS = [str(i) for i in range(25)]


@query(
    "synth_prepare",
    f"""WITH {CUSTOMER_FOLDS}, tr AS (SELECT * FROM folds WHERE role = 'train'),
st AS (SELECT fold_id, median(c_acctbal) AS md, mode(c_nationkey ORDER BY c_nationkey) AS mo FROM tr GROUP BY 1),
fi AS (SELECT c_custkey, tr.fold_id, coalesce(c_acctbal, md) AS x, coalesce(c_nationkey, mo) AS g
  FROM tr JOIN st ON tr.fold_id = st.fold_id),
sc AS (SELECT fold_id, avg(x) AS m, stddev_pop(x) AS s FROM fi GROUP BY 1)
SELECT c_custkey, fi.fold_id, {sr6('(x - m) / s')} AS c_acctbal, """
    + ", ".join(
        f"CASE WHEN g = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS \"c_nationkey_{v}\"" for v in KEYS
    )
    + " FROM fi JOIN sc ON fi.fold_id = sc.fold_id",
)
def synth_prepare_query(spark, sf_dir):
    train = train_rows(written(customer_folds(spark, sf_dir), "customer-folds")).select(
        "c_custkey", "fold_id", "c_acctbal", "c_nationkey"
    )
    vocab = vocabulary(train, ["c_nationkey"])
    rows, _ = synth_prepare(train, ["c_acctbal"], ["c_nationkey"], vocab)
    return rounded(rows, ["c_acctbal"])


@query(
    "synth_decode",
    f"""WITH {CUSTOMER_FOLDS}, tr AS (SELECT * FROM folds WHERE role = 'train'),
st AS (SELECT fold_id, median(c_acctbal) AS md, mode(c_nationkey ORDER BY c_nationkey) AS mo FROM tr GROUP BY 1)
SELECT c_custkey, tr.fold_id, round_even(round(coalesce(c_acctbal, md), 6), 0) + 0.0 AS c_acctbal,
  coalesce(c_nationkey, mo) AS c_nationkey FROM tr JOIN st ON tr.fold_id = st.fold_id""",
)
def synth_decode_query(spark, sf_dir):
    train = train_rows(written(customer_folds(spark, sf_dir), "customer-folds")).select(
        "c_custkey", "fold_id", "c_acctbal", "c_nationkey"
    )
    vocab = vocabulary(train, ["c_nationkey"])
    rows, stats = synth_prepare(train, ["c_acctbal"], ["c_nationkey"], vocab)
    out = synth_decode(rows, stats, ["c_acctbal"], vocab, train.columns)
    return rounded(out, ["c_acctbal"], 0)


SYNTH = TableSpec("c_mktsegment", "c_custkey", ("c_acctbal", "nation_number"), ("c_nationkey",))


def imputed(spark, sf_dir):
    """All training rows of every fold, missing values filled."""
    train = train_rows(by_fold(written(customer_roles(spark, sf_dir), "customer-roles"))).select(
        "fold_id", *SYNTH.features, SYNTH.target
    )
    filled = impute_synth_prep(train, SYNTH.numeric, SYNTH.categorical)
    return written(filled.withColumn("nation_number", F.col("nation_number").cast("double")), "filled")


def made_rows(train):
    wanted = train.groupBy("fold_id").agg(F.count(F.lit(1)).alias("n"))
    return CopulaModel.fit(train, SYNTH).sample(wanted)


@query("synth_rows")
def synth_rows(spark, sf_dir):
    return made_rows(imputed(spark, sf_dir))


@query(
    "synth_rows_shape",
    f"""WITH {CUSTOMER_FOLDS} SELECT fold_id, c_mktsegment, count(*) AS n_real,
  sum(count(*)) OVER (PARTITION BY fold_id)::BIGINT AS n_made_in_fold, TRUE AS share_kept,
  TRUE AS balance_in_range, TRUE AS nation_in_range, TRUE AS values_known, 0::BIGINT AS n_missing
  FROM folds WHERE role = 'train' GROUP BY 1, 2""",
)
def synth_rows_shape(spark, sf_dir):
    """Made rows against the rows they were fitted on, per fold and class: number, share of the
    class (within five standard errors of its draw), ranges and values."""
    keys = ["fold_id", "c_mktsegment"]

    def shape(df, name):
        ends = [
            end(c).alias(f"{name}_{label}_{c}")
            for c in SYNTH.numeric
            for label, end in (("low", F.min), ("high", F.max))
        ]
        missing = F.count_if(F.greatest(*[F.col(c).isNull() for c in SYNTH.features]))
        return df.groupBy(*keys).agg(
            F.count(F.lit(1)).alias(f"{name}_n"),
            F.collect_set("c_nationkey").alias(f"{name}_values"),
            missing.alias(f"{name}_missing"),
            *ends,
        )

    train = imputed(spark, sf_dir)
    both = shape(train, "real").join(shape(made_rows(train), "made"), keys)
    fold = Window.partitionBy("fold_id")
    share = F.col("real_n") / F.sum("real_n").over(fold)
    made = F.sum("made_n").over(fold)
    error = F.sqrt(share * (1 - share) / made)
    within = {
        c: (F.col(f"made_low_{c}") >= F.col(f"real_low_{c}") - 1e-9)
        & (F.col(f"made_high_{c}") <= F.col(f"real_high_{c}") + 1e-9)
        for c in SYNTH.numeric
    }
    return both.select(
        *keys,
        F.col("real_n").alias("n_real"),
        made.alias("n_made_in_fold"),
        (F.abs(F.col("made_n") / made - share) <= 5 * error).alias("share_kept"),
        within["c_acctbal"].alias("balance_in_range"),
        within["nation_number"].alias("nation_in_range"),
        (F.size(F.array_except("made_values", "real_values")) == 0).alias("values_known"),
        F.col("made_missing").alias("n_missing"),
    )


@query("topup_gan")
def topup_gan(spark, sf_dir):
    raw = written(point_folds(spark, sf_dir), "point-folds")
    rows = raw.filter("fold_id = 0").count()
    return topup(raw, Preprocessor(POINTS), cap=rows)


@query(
    "augment_none",
    f"""WITH {POINTS_FOLDS} SELECT fold_id, CAST(c_custkey AS VARCHAR) AS c_custkey, {sr6('balance')} AS balance,
  {sr6('nation')} AS nation, label, 'train' AS origin FROM folds WHERE role = 'train'""",
)
def augment_none(spark, sf_dir):
    out = augment("no such arm", point_folds(spark, sf_dir), POINTS)
    return rounded(out, ["balance", "nation"])


@query("augment_retrieval")
def augment_retrieval(spark, sf_dir):
    return augment("retrieval", point_folds(spark, sf_dir), POINTS, share=0.25)
