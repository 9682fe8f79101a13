"""Quality rules judged by host.

Each document is measured and held against rules; the failures are summed by host, each
host's failure rate is shrunk towards the rate of all hosts with a beta prior fitted to
the hosts (method of moments), and hosts above the threshold take their documents along.

Defined results: a NULL text has no words; a NULL host is a host of its own; repeated rows
are judged one by one; an empty table gives an empty result. Columns made here are named
by ``MEASURES`` and ``VERDICTS``; input columns of these names are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foldsmith.llm.registry import query, table
from foldsmith.llm.text import NOT_SPACE, SPACE_CHARS, words
from foldsmith.session import broadcast_if_small, materialize

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICTS = ("base_failed", "host_failed", "kept")

# Fixed values of the base rule.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

# A host goes when more of its documents than this are expected to fail one rule.
MAX_HOST_RATE = 0.5
HOST_ROW_BYTES = 200


def with_measures(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add word, symbol, line and repetition counts of the whole text of each row.

    Windows of three words are compared by 64-bit hashes inside their own text: sorted,
    equal neighbours are repeats, and the words they cover are counted from the distances
    of their positions.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    df = docs.drop(*MEASURES, *VERDICTS, "_w", "_h", "_s", "_p", "_l")
    df = df.withColumn("_w", words(F.col(text)))
    df = df.withColumns(
        {
            "n_words": F.size("_w").cast("long"),
            "word_chars": F.length(F.translate(whole, SPACE_CHARS, "")).cast("long"),
            "n_symbols": (F.length(whole) - F.length(F.translate(whole, SYMBOLS, ""))).cast("long"),
            "_l": F.filter(F.split(whole, "\n"), lambda line: line.rlike(NOT_SPACE)),
            "_h": F.when(
                F.size("_w") > 3,
                F.transform(
                    F.sequence(F.lit(0), F.size("_w") - 3),
                    lambda i: F.xxhash64(
                        F.get("_w", i), F.get("_w", i + 1), F.get("_w", i + 2)
                    ),
                ),
            ),
        }
    ).drop("_w")
    df = df.withColumns(
        {
            "n_dup_lines": (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"),
            "_s": F.when(
                F.size(F.array_distinct("_h")) < F.size("_h"),
                F.sort_array(
                    F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i")))
                ),
            ),
        }
    ).drop("_l", "_h")
    same = lambda x, at: F.coalesce(x["h"] == F.get("_s", at)["h"], F.lit(False))
    repeated = F.filter(
        "_s", lambda x, k: F.when(k > 0, same(x, k - 1)).otherwise(False) | same(x, k + 1)
    )
    df = df.withColumn("_p", F.sort_array(F.transform(repeated, lambda x: x["i"]))).drop("_s")
    covered = F.aggregate(
        F.transform("_p", lambda p, k: F.least(F.lit(3), F.get("_p", k + 1) - p)),
        F.lit(0),
        lambda total, step: total + F.coalesce(step, F.lit(3)),
    )
    return df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("long")).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (
        100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")
    )


def rules() -> dict[str, Column]:
    """Rules on the measures; true where a document fails."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "base": base_failed(),
        "symbols": 10 * F.col("n_symbols") > n,
        "lines": 10 * F.col("n_dup_lines") > n,
        "word_length": (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    }


def beta_prior(hosts: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """Prior of each rule: (mean, weight) by the moments of the hosts' failure rates.

    One row of sums reaches the driver. Without spread between hosts the weight is
    infinite: every host then has the mean.
    """
    sums = []
    for name in names:
        k = F.col(f"k_{name}")
        sums += [
            F.sum(k).alias(f"k_{name}"),
            F.sum(k * k / F.col("n")).alias(f"q_{name}"),
        ]
    row = hosts.agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"), F.sum(F.col("n") * F.col("n")).alias("nn"), *sums
    ).first()
    priors = {}
    for name in names:
        n, count = row["n"] or 0, row["hosts"]
        mean = (row[f"k_{name}"] or 0) / n if n else 0.0
        spread = 0.0
        if count > 1 and 0 < mean < 1:
            # Between-host variance of the rates, less what chance alone gives them.
            within = mean * (1 - mean)
            observed = row[f"q_{name}"] - n * mean * mean
            spread = (observed - (count - 1) * within) / (n - row["nn"] / n - (count - 1))\
                if n - row["nn"] / n > count - 1 else 0.0
        weight = mean * (1 - mean) / spread - 1 if spread > 0 else math.inf
        priors[name] = (mean, max(weight, 0.0))
    return priors


def host_verdicts(judged: DataFrame, host: str, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per host: documents, failures and shrunk failure rate of each rule, verdict."""
    tests = rules()
    hosts = judged.groupBy(F.col(host).alias("_host")).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(test.cast("long")).alias(f"k_{name}") for name, test in tests.items()],
    )
    hosts = materialize(hosts, "hosts")
    rates = {}
    for name, (mean, weight) in beta_prior(hosts, list(tests)).items():
        rate = F.lit(mean)
        if math.isfinite(weight):
            rate = (F.col(f"k_{name}") + F.lit(mean * weight)) / (F.col("n") + F.lit(weight))
        rates[f"rate_{name}"] = rate
    return hosts.withColumns(rates).withColumn(
        "host_failed", F.greatest(*[F.col(c) for c in rates], F.lit(0.0)) > max_rate
    )


def judge(
    docs: DataFrame, host: str = "source", text: str = "text", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """All rows with measures, ``base_failed``, ``host_failed`` and ``kept``.

    The measured rows are written once. Host verdicts are joined by broadcast where the
    counted hosts are few, else by a shuffle whose skewed hosts AQE splits.
    """
    measured = materialize(with_measures(docs, text).withColumn("base_failed", base_failed()), "quality")
    verdicts = host_verdicts(measured, host, max_rate).select("_host", "host_failed")
    verdicts = broadcast_if_small(verdicts, verdicts.count() * HOST_ROW_BYTES)
    joined = measured.join(verdicts, F.col(host).eqNullSafe(F.col("_host")), "left").drop("_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_failed"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep, with the columns of ``docs``, carried in one struct."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"))
    kept = judge(rows, "_row.source", "_row.text").where("kept")
    return kept.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
win AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM w, LATERAL (SELECT unnest(range(1, len(w) - 1)) AS i)),
rep AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
cov AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words FROM rep, range(3) r(j) GROUP BY 1),
m AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  10 * n_symbols > greatest(n_words, 1) AS f_symbols, 10 * n_dup_lines > greatest(n_words, 1) AS f_lines,
  word_chars < 2 * greatest(n_words, 1) OR word_chars > 15 * greatest(n_words, 1) AS f_length FROM m),
r AS (SELECT source, rule, count(*)::DOUBLE AS n, sum(failed::INT)::DOUBLE AS k FROM (
  SELECT source, 'base' AS rule, base_failed AS failed FROM f UNION ALL SELECT source, 'symbols', f_symbols FROM f
  UNION ALL SELECT source, 'lines', f_lines FROM f UNION ALL SELECT source, 'length', f_length FROM f) GROUP BY 1, 2),
s AS (SELECT rule, sum(k) / sum(n) AS p, sum(n) AS n, count(*) AS h, sum(n * n) AS nn, sum(k * k / n) AS q
  FROM r GROUP BY 1),
v AS (SELECT rule, p, CASE WHEN h > 1 AND p > 0 AND p < 1 AND n - nn / n > h - 1
  THEN (q - n * p * p - (h - 1) * p * (1 - p)) / (n - nn / n - (h - 1)) ELSE 0 END AS spread FROM s),
pr AS (SELECT rule, p, CASE WHEN spread > 0 THEN greatest(p * (1 - p) / spread - 1, 0) END AS weight FROM v),
b AS (SELECT source, bool_or(CASE WHEN weight IS NULL THEN p ELSE (k + p * weight) / (n + weight) END > 0.5) AS bad
  FROM r JOIN pr USING (rule) GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT bad AS kept
FROM f JOIN b ON f.source IS NOT DISTINCT FROM b.source"""


@query("op9_quality_rules", SQL)
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdict of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return judge(docs).select("doc_id", *MEASURES, "base_failed", "kept")
