"""Event-log stream: stage activity per time window with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from graphloom.sources.readers import EVENT_SCHEMA


def read_event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Append-only JSON event files as a stream with an event-time column ``ts``."""
    return spark.readStream.schema(EVENT_SCHEMA).json(path).withColumn("ts", F.timestamp_seconds("timestamp"))


def stage_activity(events: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Events and errors per window and stage; state is bounded by the watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "stage").agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("type") == "error", 1)).alias("errors"))
