"""Streams: windows over outcomes, sessions, and ingest with dedup. The same plans work on batches and on streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def outcome_windows(outcomes: DataFrame, length: str = "6 hours", step: str = "5 minutes", late: str | None = None) -> DataFrame:
    """Outcomes by kind in sliding windows (start, end, outcome_type, n); on streams `late` sets the watermark."""
    rows = outcomes if late is None else outcomes.withWatermark("observed_at", late)
    out = rows.groupBy(F.window("observed_at", length, step).alias("w"), "outcome_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "outcome_type", "n")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """Activity per user in sessions that end after a gap: (user_id, start, end, n)."""
    rows = events if late is None else events.withWatermark("ts", late)
    out = rows.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.unix_seconds(F.col("w.start").cast("timestamp")).alias("start"), F.unix_seconds(F.col("w.end").cast("timestamp")).alias("end"), "n")


def deduplicated(episodes: DataFrame, late: str = "1 day") -> DataFrame:
    """Each content once per scope while the watermark remembers it."""
    rows = episodes.withColumn("content_hash", F.sha2(F.coalesce("content", F.lit("")), 256))
    return rows.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["project_slug", "content_hash"])


def ingest(episodes: DataFrame, store: Callable[[DataFrame], object], checkpoint: str, once: bool = True):
    """Runs a stream of episodes into a store, batch by batch; a repeated batch id is skipped after a restart by the checkpoint."""
    writer = episodes.writeStream.foreachBatch(lambda batch, _: store(batch) and None).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="60 seconds")).start()
