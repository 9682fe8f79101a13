"""Mixing sources to target weights by capped water-filling.

All sources share a budget of words in proportion to their weights. A source is not repeated
more than ``EPOCHS`` times: where its share is above that, it is clamped there, and what is
left is shared anew among the others until none is above (at most one round per clamped
source, in practice a few; a round is one aggregate over the sources).

A source with target t and size s takes every document ``t // s`` times, and the rest by
documents in order of a seeded digest: those whose middle, in running words, lies within the
rest. So its words miss the target by half a document at most. The order is never sorted as a
whole: words are summed by ranges of the digest, which says in which range a source's rest
ends, and only that range is looked at closely. What follows is one row per source (whole
repetitions and the last digest taken), so texts are never shuffled: a document needs its
source's row only.

Native: column functions, aggregates and joins. Defined results: NULL text has size zero; the
NULL source is a source, the last in order; rows of one id are taken together, and so are the
rows without an id; a source or a table without words has target zero; an empty table gives
an empty result. Columns besides id, text and source are not read, ``repeated`` keeps all.
"""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foldsmith.functions.hashing import hash_key
from foldsmith.llm.registry import query, table
from foldsmith.llm.text import NOT_SPACE
from foldsmith.operators.ranking import RANGE_ROWS, group_key, range_digits, value_rank
from foldsmith.session import broadcast_if_small, materialize

CYCLE = (1, 2, 3)  # weights of the sources in order, repeating
PERCENT = 100
EPOCHS = 3
SEED = 13
SOURCE_BYTES = 300


def sized(docs: DataFrame, doc_id: str, source: str, text: str) -> DataFrame:
    """doc_id, source and size in words of each row, written."""
    count = F.regexp_count(F.coalesce(F.col(f"`{text}`"), F.lit("")), F.lit(NOT_SPACE + "+"))
    return materialize(
        docs.select(
            F.col(f"`{doc_id}`").alias("doc_id"),
            F.col(f"`{source}`").alias("source"),
            count.cast("long").alias("size"),
        ),
        "sizes",
    )


def in_order(sources: DataFrame, cycle: tuple[int, ...] = CYCLE) -> DataFrame:
    """Sources by code point, NULL last, with the weights of ``cycle`` repeating."""
    order = F.struct(F.col("source").isNull(), "source")
    ranges = max(1, math.ceil(sources.count() / RANGE_ROWS))
    placed = value_rank(sources.withColumn("order", order), "order", "source_size", "place", ranges).drop("order")
    turn = ((F.col("place") - 1) % len(cycle)).cast("int")
    return placed.withColumn("weight", F.get(F.array(*[F.lit(int(c)) for c in cycle]), turn)).drop("place")


def water_filled(sources: DataFrame, percent: int = PERCENT, epochs: int = EPOCHS) -> DataFrame:
    """Sources (source_size, weight) with their ``target``.

    Whether a share is above its cap is compared in whole numbers.
    """

    def number(value) -> Column:
        return (value if isinstance(value, Column) else F.lit(Decimal(int(value)))).cast("decimal(19,0)")

    cap = number(F.col("source_size") * epochs)
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = (total or 0) * percent // 100
    rest, weight, clamped = budget, weight or 0, 0
    while True:
        above = cap * number(weight) < number(rest) * number(F.col("weight"))
        n, caps, others = sources.agg(
            F.count_if(above), F.sum(F.when(above, cap)), F.sum(F.when(~above, F.col("weight")))
        ).first()
        if n == clamped or not others:
            break
        rest, weight, clamped = budget - int(caps), others, n
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(weight or 1))
    return sources.withColumn("target", F.when(above, cap.cast("double")).otherwise(share))


def decisions(
    sizes: DataFrame,
    cycle: tuple[int, ...] = CYCLE,
    percent: int = PERCENT,
    epochs: int = EPOCHS,
    seed: int = SEED,
) -> DataFrame:
    """One row per source: group, source_size, weight, target, whole repetitions, ``cut``.

    A document is taken once more when its digest is not above ``cut``.
    """
    sources = materialize(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    targets = water_filled(materialize(in_order(sources, cycle), "weights"), percent, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    targets = targets.withColumn("whole", whole.cast("long")).withColumn(
        "rest", F.col("target") - F.col("whole") * F.col("source_size")
    )
    targets = materialize(targets.withColumn("group", group_key(["source"])), "targets")
    n_bytes = targets.count() * SOURCE_BYTES

    digits = range_digits(sizes.count())
    keyed = sizes.where("size > 0").select(
        group_key(["source"]).alias("group"), hash_key(seed, "doc_id").alias("key"), "size"
    )
    keyed = keyed.withColumn("range", F.substring("key", 1, digits))
    before = Window.partitionBy("group").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = keyed.groupBy("group", "range").agg(F.sum("size").alias("words"))
    ranges = ranges.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))
    last = ranges.join(broadcast_if_small(targets.select("group", "rest"), n_bytes), "group").where(
        "rest > 0 AND before <= rest AND rest < before + words"
    )
    last = materialize(last.select("group", "range", "before", "rest"), "last")
    close = keyed.join(broadcast_if_small(last, n_bytes), ["group", "range"])
    close = close.groupBy("group", "range", "before", "rest", "key").agg(F.sum("size").alias("size"))
    # One range of each source.
    inside = Window.partitionBy("group").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2
    close = close.withColumn("within", middle <= F.col("rest"))
    cuts = close.groupBy("group").agg(
        # Nothing of the range: its own name is below all of its digests.
        F.coalesce(F.max(F.when(F.col("within"), F.col("key"))), F.first("range")).alias("cut")
    )
    return materialize(targets.join(cuts, "group", "left").drop("source", "rest"), "decisions")


def repetitions(doc_id: str, seed: int = SEED) -> Column:
    """How often a row joined with its source's decision is taken."""
    again = F.coalesce(hash_key(seed, F.col(f"`{doc_id}`")) <= F.col("cut"), F.lit(False))
    return F.col("whole") + again.cast("long")


def decided(rows: DataFrame, found: DataFrame, source: str) -> DataFrame:
    """Rows with their source's decision; a hot source is split by AQE where it is shuffled."""
    small = broadcast_if_small(found, found.count() * SOURCE_BYTES)
    return rows.withColumn("group", group_key([source])).join(small, "group").drop("group")


def repeated(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", seed: int = SEED, **options
) -> DataFrame:
    """The mixture itself: the rows of ``docs``, all their columns, as often as they are taken."""
    found = decisions(sized(docs, doc_id, source, text), seed=seed, **options)
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.struct("*").alias("row")
    )
    times = decided(rows, found, "source").select("row", repetitions("doc_id", seed).alias("times"))
    copies = F.explode(F.sequence(F.lit(1), F.col("times").cast("int")))
    return times.where("times > 0").select("row", copies.alias("k")).select("row.*")


SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'),
  lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, sum(size) AS source_size, {EPOCHS} * sum(size) AS cap,
  (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, sum(source_size) OVER () * {PERCENT} // 100 - coalesce(sum(cap) OVER b, 0) AS rest,
  sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS weight FROM s
  WINDOW b AS (ORDER BY cap / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT cap / w AS least, rest, weight FROM o WHERE cap * weight >= rest * w ORDER BY cap / w, source LIMIT 1),
t AS (SELECT source, CAST(source_size AS BIGINT) AS source_size,
  CASE WHEN cap / w < least THEN cap::DOUBLE ELSE level.rest::DOUBLE * w / level.weight::DOUBLE END AS target FROM o, level),
u AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT doc_id, size, source_size, target, whole, coalesce(sum(size) OVER (PARTITION BY d.source
  ORDER BY md5('{SEED}:' || doc_id) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + size / 2 AS middle
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN middle <= target - whole * source_size
  THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r"""


@query("op13_mixture", SQL)
def op13_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size of every document, its source's size and target, and the words that are taken of it."""
    sizes = sized(table(spark, sf_dir, "documents"), "doc_id", "source", "text")
    rows = decided(sizes, decisions(sizes), "source")
    return rows.select(
        "doc_id", "size", "source_size", "target", (F.col("size") * repetitions("doc_id")).alias("taken")
    )
