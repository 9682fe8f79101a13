"""The training-data pipeline over ``documents``.

Stages run in order; each result is written as Parquet to the shared checkpoint folder and
read again as the next stage's input, so a lost executor never repeats more than one stage.
Each stage handles NULLs, empty texts, repeated rows, empty tables and extra columns as its
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foldsmith.llm import decontam, packing, pii, quality, simhash
from foldsmith.session import WRITTEN, discard, materialize

# (name, function of (spark, docs, sf_dir)); all but the last keep the columns of documents.
STAGES = [
    ("quality_rules", quality.stage),
    ("simhash_near_dedup", simhash.stage),
    ("benchmark_decontamination", decontam.stage),
    ("pii", pii.stage),
    ("packing", packing.stage),
]

# Near-duplicate groups, tilings and token ids are not within SQL's reach; tests/llm holds the
# pipeline against the operators' brute-force versions in a chain.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the last stage, from the whole documents table.

    What a stage wrote on its way, and its input, go once its result is written.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = len(WRITTEN)
    for name, apply in STAGES:
        docs = materialize(apply(spark, docs, sf_dir), name)
        discard(spark, WRITTEN[before:-1])
    return docs
