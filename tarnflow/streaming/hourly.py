"""Hourly counts of a stream of events, with late rows up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def hourly_counts(events: DataFrame, key: str = "event_type", time: str = "ts", late: str = "2 hours") -> DataFrame:
    """(series_id, t, y) for batch and streaming frames alike; streams drop rows later than `late`."""
    rows = events.withColumn("at", F.col(time).cast("timestamp"))
    rows = rows.withWatermark("at", late) if events.isStreaming else rows
    out = rows.groupBy(F.window("at", "1 hour"), F.col(key).alias("series_id")).agg(F.count("*").alias("y"))
    return out.select("series_id", F.col("window.start").alias("t"), "y")
