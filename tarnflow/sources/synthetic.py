"""Generated series: trend, seasons and noise by formulas, so that every engine and every run gives the same values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Products of the generator: (name, slope, days of a slope, amplitude, days of a period); base, noise deviation and its correlation. Fixed values.
PRODUCTS = (("a", 2.0, 4, 5.0, 7), ("b", -1.0, 4, 10.0, 28), ("c", -1.0, 10, 15.0, 91))
BASE, NOISE, CORRELATION = 100.0, 10.0, 0.5
START, STOP = "2021-05-31 00:00:00", "2021-12-30 00:00:00"


def uniform(*key: Column) -> Column:
    """A draw from (0, 1) by a checksum of the key."""
    return (F.conv(F.substring(F.md5(F.concat_ws("|", *(k.cast("string") for k in key))), 1, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)


def normal(*key: Column) -> Column:
    """A draw from the standard normal distribution by Box and Muller's formula."""
    return F.sqrt(-2 * F.log(uniform(F.lit("u"), *key))) * F.cos(2 * F.pi() * uniform(F.lit("v"), *key))


def red_noise(df: DataFrame, correlation: float = CORRELATION, sd: float = NOISE) -> DataFrame:
    """Adds noise n_t = correlation * n_{t-1} + sqrt(1 - correlation^2) * sd * draw_t, from (series_id, idx, draw), a task for each series."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        out, last = np.empty(len(pdf)), 0.0
        for i, v in enumerate(pdf["draw"].to_numpy() * sd):
            last = v if i == 0 else correlation * last + np.sqrt(1 - correlation**2) * v
            out[i] = last
        return pdf.assign(noise=out)

    return df.groupBy("series_id").applyInPandas(run, StructType([*df.schema.fields, StructField("noise", DoubleType())]))


def products(spark: SparkSession, start: str = START, stop: str = STOP, seed: int = 42, rounded: bool = False) -> DataFrame:
    """(series_id, t, idx, clean, y): three products and their sum on an hourly index without its end; `rounded`: absolute values without decimals."""
    hours = spark.range(1).select(F.explode(F.sequence(F.lit(start).cast("timestamp_ntz"), F.lit(stop).cast("timestamp_ntz"), F.expr("interval 1 hour"))).alias("t")).where(F.col("t") < F.lit(stop).cast("timestamp_ntz"))
    days = F.timestamp_diff("SECOND", F.lit(start).cast("timestamp_ntz"), F.col("t")) / 86_400.0
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("series_id"), F.lit(s).alias("slope"), F.lit(u).alias("unit"), F.lit(a).alias("amplitude"), F.lit(p).alias("period")) for n, s, u, a, p in PRODUCTS))).alias("of")
    rows = hours.withColumn("idx", F.round(days * 24).cast("long")).select("t", "idx", days.alias("days"), each).select("t", "idx", "days", "of.*")
    clean = BASE + F.col("slope") * F.col("days") / F.col("unit") + F.col("amplitude") * F.sin(2 * F.pi() * F.col("days") / F.col("period"))
    rows = rows.select("series_id", "t", "idx", clean.alias("clean"), normal(F.lit(seed), F.col("series_id"), F.col("idx")).alias("draw"))
    rows = red_noise(rows).select("series_id", "t", "idx", "clean", (F.col("clean") + F.col("noise")).alias("y"))
    if rounded:
        rows = rows.withColumns({c: F.bround(F.abs(c), 0) for c in ("clean", "y")})
    return rows.unionByName(rows.groupBy("t", "idx").agg(F.sum("clean").alias("clean"), F.sum("y").alias("y")).withColumn("series_id", F.lit("all")))


def sine(spark: SparkSession, n: int, period: int, amplitude: float, slope: float, noise: float, step: str, start: str, seed: int = 42) -> DataFrame:
    """(series_id, t, idx, y): amplitude * sin + slope * idx + normal noise, at so many steps of a calendar."""
    idx = F.col("id")
    t = F.lit(start).cast("timestamp_ntz") + (F.make_interval(months=F.col("id").cast("int")) if step == "month" else F.make_interval(hours=F.col("id").cast("int")))
    y = amplitude * F.sin(2 * F.pi() * idx / period) + slope * idx + noise * normal(F.lit(seed), F.lit(step), idx)
    return spark.range(n).select(F.lit(f"demo_{step}").alias("series_id"), t.alias("t"), idx.alias("idx"), y.alias("y"))


def demo_monthly(spark: SparkSession) -> DataFrame:
    return sine(spark, 300, 12, 10.0, 0.05, 1.5, "month", "2000-01-01 00:00:00")


def demo_hourly(spark: SparkSession) -> DataFrame:
    return sine(spark, 720, 24, 10.0, 0.01, 1.5, "hour", "2024-01-01 00:00:00")


def month_ends(spark: SparkSession, n: int = 36, seed: int = 42) -> DataFrame:
    """A sine of a year at month ends from January 2020, with a little noise."""
    out = sine(spark, n, 12, 1.0, 0.0, 0.2, "month", "2020-01-01 00:00:00", seed)
    return out.select(F.lit("month_ends").alias("series_id"), F.last_day("t").alias("t"), "idx", "y")
