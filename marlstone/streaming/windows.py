"""Windowed counts of an event stream, and the hand-over of an outbox."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def event_counts(events: DataFrame, ts: str, by: list[str], width: str, lateness: str) -> DataFrame:
    """Counts per tumbling window; works on streams and tables. Events later than lateness are dropped from streams."""
    rows = events.withColumn("__at", F.col(ts).cast("timestamp"))
    if events.isStreaming:
        rows = rows.withWatermark("__at", lateness)
    counts = rows.groupBy(F.window("__at", width).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def drain(stream: DataFrame, send: Callable[[DataFrame], None], checkpoint: str):
    """Hand every batch of pending events to send once; send must be idempotent by event_key."""
    return stream.writeStream.foreachBatch(lambda batch, _: send(batch.dropDuplicates(["event_key"]))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
