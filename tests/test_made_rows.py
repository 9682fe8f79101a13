"""Synthetic rows at size: drawn by many tasks, whatever the planner takes them for."""

from pyspark.sql import functions as F

from foldsmith.operators.synth import CopulaModel
from foldsmith.spec import TableSpec


def test_rows_of_a_group_are_drawn_by_several_tasks(spark):
    rows = spark.range(400).select(
        F.lit(0).alias("fold_id"),
        F.col("id").cast("double").alias("x"),
        (F.col("id") % 7).cast("string").alias("c"),
        (F.col("id") % 2).cast("int").alias("y"),
    )
    model = CopulaModel.fit(rows, TableSpec("y", "id", ("x",), ("c",)))
    wanted = spark.createDataFrame([(0, 100_000)], "fold_id int, n long")
    made = model.sample(wanted).groupBy(F.spark_partition_id().alias("task")).count()
    sizes = [r["count"] for r in made.collect()]
    assert sum(sizes) == 100_000
    assert len(sizes) > 1 and max(sizes) < 100_000
