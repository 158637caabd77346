"""The event log as a stream: append, watermarked windows, and streak state for each reader."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

EVENT_SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def read(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream, with the time of arrival."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return rows.withColumn("ts", F.col("ts").cast("timestamp")).withColumn("arrived_at", F.current_timestamp())


def append(events: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Append every event to Parquet, once each."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")


def tumbling(events: DataFrame, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums in fixed windows; rows later than the watermark are dropped."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "event_type", "n", "total")


def sliding(events: DataFrame, size: str = "1 hour", slide: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    w = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide))
    return w.agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(events: DataFrame, gap: str = "25 seconds", late: str = "10 minutes") -> DataFrame:
    """A reader's sessions: they end after ``gap`` without an event."""
    w = events.withWatermark("ts", late).groupBy("user_id", F.session_window("ts", gap))
    return w.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def once(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The first of events with the same id, as far as the watermark remembers."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def streaks(events: DataFrame) -> DataFrame:
    """(user_id, current, longest, last_day) after each batch that has days of the reader: the same day keeps a streak, the next one adds to it."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        current, longest, last = state.get if state.exists else (0, 0, None)
        days = sorted({d for b in batches for d in b["day"]})
        for d in days:
            gap = None if last is None else (d - last).days
            if gap is not None and gap < 0:
                continue  # a late day changes nothing
            current = max(current, 1) if gap == 0 else current + 1 if gap == 1 else 1
            longest, last = max(longest, current), d
        state.update((current, longest, last))
        yield pd.DataFrame({"user_id": [key[0]], "current": [current], "longest": [longest], "last_day": [last]})

    days = events.select("user_id", F.to_date("ts").alias("day"))
    return days.groupBy("user_id").applyInPandasWithState(update, "user_id long, current int, longest int, last_day date", "current int, longest int, last_day date", "update", "NoTimeout")
