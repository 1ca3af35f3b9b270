"""Checkpointed streams: change logs applied batch by batch, and windowed extensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewater.operators import snapshots


def apply_log(spark: SparkSession, log_path: str, schema: str, snapshot_path: str, checkpoint: str, key: str) -> StreamingQuery:
    """Merge a growing folder of change files into a snapshot, once per file.

    Each batch writes the snapshot's next version under its own batch id, so a replayed batch
    overwrites what it wrote and the result equals one merge of the whole log.
    """
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(log_path)

    def merge(batch: DataFrame, batch_id: int) -> None:
        before = spark.read.parquet(f"{snapshot_path}/v{batch_id}")
        snapshots.merge(before, batch, key).write.mode("overwrite").parquet(f"{snapshot_path}/v{batch_id + 1}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, ts: str, key: str, window: str = "1 hour", late: str = "2 hours", slide: str | None = None) -> DataFrame:
    """Extension: counts by key and window, tumbling or, with ``slide``, sliding; a stream drops rows later than the watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, window, slide), key).agg(F.count("*").alias("n"))
