"""Event streams: an extension that the batch tables check, with watermarks for late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events and users by tumbling window and type; the same plan over a stream or a table."""
    source = events.withWatermark("ts", late) if events.isStreaming else events
    g = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 6).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def stream_of(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)
