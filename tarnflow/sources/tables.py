"""Canonical frames over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.operators import series


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def hourly_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series_id, t, idx, y): events of each type in each hour of the whole range; 0 where there are none."""
    events = read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id"), F.date_trunc("hour", "ts").alias("t"))
    counts = events.groupBy("series_id", "t").agg(F.count("*").cast("double").alias("y"))
    return series.indexed(series.calendar_fill(counts, ["series_id"], "t", ["y"], "1 hour", per_group=False))


def hourly_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each series' percentage of the hour's events."""
    counts = hourly_count(spark, sf_dir)
    total = counts.groupBy("t").agg(F.sum("y").alias("total"))
    return counts.join(total, "t").select("series_id", "t", "idx", F.coalesce(F.expr("try_divide(100 * y, total)"), F.lit(0.0)).alias("y"))


def daily_sales(spark: SparkSession, sf_dir: str, per_group: bool = False) -> DataFrame:
    """(category, d, sales, quantity, discount): sums by part type and shipping day, calendar filled."""
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    lines = read(spark, sf_dir, "lineitem").join(part, "l_partkey")
    sums = lines.groupBy("category", F.col("l_shipdate").cast("date").alias("d")).agg(F.sum("l_extendedprice").alias("sales"), F.sum("l_quantity").alias("quantity"), F.sum("l_discount").alias("discount"))
    return series.calendar_fill(sums, ["category"], "d", ["sales", "quantity", "discount"], "1 day", per_group=per_group)


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, zsid, e, n, cnt): ten snapshots of stations in the plane; every eleventh count is missing."""
    at = lambda i: F.col("embedding")[i].cast("double")
    return read(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("t"), F.col("vec_id").alias("zsid"), at(0).alias("e"), at(1).alias("n"), F.when(F.col("vec_id") % 11 != 0, F.abs(at(2)) * 1000).alias("cnt"))
