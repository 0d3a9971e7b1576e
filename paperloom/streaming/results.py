"""Streams: result files as they arrive, and windowed counts of events. An extension; batch ingestion is in operators.screening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def result_lines(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """New result files of a folder as a stream of (file, value). A file that changes later is not read again."""
    stream = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).option("pathGlobFilter", "*.result.jsonl").text(folder)
    return stream.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "value")


def ingest(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """Runs apply(batch, id) on all that has arrived, then stops; the checkpoint makes each file count once."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, *, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events and their values by window and type; rows later than the watermark are left out of a stream."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """Sessions of users: runs of events less than a gap apart."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    return events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
