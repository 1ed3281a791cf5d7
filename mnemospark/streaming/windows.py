"""Event-time windows and stateful sinks, the same over batches and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def panes(events: DataFrame, length: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(pane, event_type, n, v): counts and sums; a stream drops what is later than its watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    out = e.groupBy(F.window("ts", length, slide or length), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("v"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("pane"), "event_type", "n", "v")


def sessions(events: DataFrame, gap: str, late: str = "10 minutes") -> DataFrame:
    """(user_id, started, n): runs of a user's events with less than the gap between them."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark("ts", late)
    out = e.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("started"), "n")


def confirming_sink(path: str):
    """A foreachBatch function that keeps (user_id, event_type, first, confirmations), one folder for each batch.

    A batch that runs again overwrites its own folder, so its counts aren't added twice; readers sum over folders.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy("user_id", "event_type").agg(F.min("event_id").alias("first"), F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return write


def confirmed(df: DataFrame) -> DataFrame:
    """What the sink's folders say together."""
    return df.groupBy("user_id", "event_type").agg(F.min("first").alias("first"), (F.sum("n") - 1).alias("confirmations"))
