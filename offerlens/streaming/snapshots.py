"""Snapshot feed as micro-batches: append by batch, then trends from the table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def snapshot_feed(stream: DataFrame, path: str, checkpoint: str, *, captured: str = "captured_at", trigger: dict | None = None) -> StreamingQuery:
    """Append each micro-batch under its own batch folder; a replayed batch replaces itself."""

    def append(batch: DataFrame, batch_id: int) -> None:
        (
            batch.withColumns({"captured_date": F.to_date(captured), "batch_id": F.lit(batch_id)})
            .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
            .partitionBy("captured_date", "batch_id").parquet(path)
        )

    writer = stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint)
    return writer.trigger(**(trigger or {"availableNow": True})).start()
