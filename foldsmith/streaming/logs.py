"""Running means of logged metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_log_mean(
    log: DataFrame, window: str = "1 hour", lateness: str = "10 minutes"
) -> DataFrame:
    """Mean of each tag per event-time window; rows later than the watermark
    are dropped and closed windows leave the state."""
    value = F.nanvl(F.col("value").cast("double"), F.lit(None).cast("double"))
    return (
        log.withWatermark("ts", lateness)
        .groupBy(F.window("ts", window).alias("w"), "tag")
        .agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
        .select(F.col("w.start").alias("window_start"), "tag", "n", "mean")
    )
