"""Streaming queries: file source, everything available, then stop."""

from pyspark.sql import functions as F

from foldsmith.plans.preprocess import Preprocessor
from foldsmith.queries.base import CUSTOMER, customer_folds, query, rounded, sr6, table
from foldsmith.queries.synth import CHAIN_SQL
from foldsmith.session import new_path
from foldsmith.streaming.logs import stream_log_mean
from foldsmith.streaming.transform import stream_transform


@query("stream_transform", CHAIN_SQL)
def stream_transform_query(spark, sf_dir):
    path = new_path(spark, "arriving")
    customer_folds(spark, sf_dir).write.parquet(path)
    raw = spark.read.parquet(path)
    model = Preprocessor(CUSTOMER, transform="none", outlier_limit=1.5).fit(raw)
    rows = spark.readStream.schema(raw.schema).parquet(path)
    out = new_path(spark, "transformed")
    stream_transform(rows, model, out, new_path(spark, "stream-state")).awaitTermination()
    return rounded(spark.read.parquet(out), model.features)


@query(
    "stream_log_mean",
    f"""WITH w AS (SELECT date_trunc('hour', ts) AS h, event_type AS tag, value FROM events)
SELECT strftime(h, '%Y-%m-%d %H:%M:%S') AS window_start, tag, count(*) AS n, {sr6('avg(value)')} AS mean FROM w
WHERE h + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY h, tag""",
)
def stream_log_mean_query(spark, sf_dir):
    path = new_path(spark, "log-stream")
    table(spark, sf_dir, "events").select(
        F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("tag"), "value"
    ).write.parquet(path)
    schema = spark.read.parquet(path).schema
    means = stream_log_mean(spark.readStream.schema(schema).parquet(path))
    out = new_path(spark, "log-means")
    (
        means.writeStream.outputMode("append")
        .format("parquet")
        .option("path", out)
        .option("checkpointLocation", new_path(spark, "stream-state"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    found = spark.read.parquet(out)
    stamp = F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")
    return rounded(found.select(stamp, "tag", "n", "mean"), ["mean"])
