"""Apply a fitted preprocessing chain to arriving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from foldsmith.plans.preprocess import PreprocessModel


def stream_transform(
    rows: DataFrame, model: PreprocessModel, path: str, checkpoint: str, **trigger
) -> StreamingQuery:
    """Stateless: the fitted tables are static sides of the joins.

    ``rows`` is a stream with the columns of the training table, ``fold_id``
    and ``role``. Output is appended to ``path``; ``checkpoint`` makes it exact
    across restarts.
    """
    writer = (
        model.transform(rows)
        .writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
    )
    return writer.trigger(**(trigger or {"availableNow": True})).start()
