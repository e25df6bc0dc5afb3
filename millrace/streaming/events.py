"""Views over a stream of events (event_id, ts, user_id, event_type, value); they serve a batch DataFrame as well."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """Parquet files of a folder as they come; ts in the session's time zone."""
    return stamped(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files).parquet(folder))


def stamped(events: DataFrame) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def once(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without repeats of an id within the time that late ones may take."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])


def windowed(events: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) in tumbling or sliding windows."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy(F.window("ts", size, slide), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, session_end, n) of runs of a user's events."""
    marked = events.withWatermark("ts", late) if events.isStreaming else events
    out = marked.groupBy("user_id", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n")


def into(df: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A query that hands every micro-batch to ``apply`` and ends when what is there has been read."""
    return df.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
