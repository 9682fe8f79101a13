"""Array expressions."""

import pytest
from pyspark.sql import functions as F

from foldsmith.functions import arrays as A
from foldsmith.functions.arrays import pad


def test_surplus_features_are_an_error(spark):
    df = spark.range(1).select(F.array(*[F.lit(float(k)) for k in range(3)]).alias("v"))
    assert df.select(pad(F.col("v"), 4)).first()[0] == [0.0, 1.0, 2.0, 0.0]
    assert df.select(pad(F.col("v"), 3)).first()[0] == [0.0, 1.0, 2.0]
    with pytest.raises(Exception, match="3 features do not fit into 2"):
        df.select(pad(F.col("v"), 2)).collect()


def test_lookups_are_many_small_projections(spark):
    """Equal elements, values outside, NULL and an empty array; one comparison a projection."""
    rows = [([1.0, 2.0, 2.0, 5.0, 9.0], v) for v in (0.0, 1.0, 2.0, 3.0, 9.0, 10.0, None)] + [([], 1.0)]
    df = spark.createDataFrame(rows, "a array<double>, v double")
    for size in (5, 7, 8, 1000):
        out = A.with_upper_bound(df, {"at": (F.col("a"), F.col("v"))}, size)
        assert out.columns == ["a", "v", "at"]
        wanted = [sum(x <= v for x in a) if v is not None else 0 for a, v in rows]
        assert [r["at"] for r in out.collect()] == wanted
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(line.count("CASE WHEN") for line in plan.split("\n")) <= 1
