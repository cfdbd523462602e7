"""Flat and seasonal baselines for every series at once; nothing but windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.series import by, full_mean

#: Width of bands, windows and seasons that are tried; fixed values.
Z = 1.96
WINDOWS, SEASONS = (3, 6, 12, 24, 48, 168), (24, 168)


def _banded(test: DataFrame, fit: DataFrame, on: list[str]) -> DataFrame:
    out = test.join(fit, on)
    return out.withColumns({"lower": F.col("y_hat") - Z * F.col("sd"), "upper": F.col("y_hat") + Z * F.col("sd")}).drop("sd")


def _test(df: DataFrame) -> DataFrame:
    return df.where(~F.col("train")).select("series_id", "idx", "y")


def mean(df: DataFrame) -> DataFrame:
    """Expects series.split(); the same holds below. Band: sample deviation of the train rows."""
    fit = df.where("train").groupBy("series_id").agg(F.avg("y").alias("y_hat"), F.stddev_samp("y").alias("sd"))
    return _banded(_test(df), fit, ["series_id"])


def naive(df: DataFrame) -> DataFrame:
    rows = df.where("train").withColumn("dy", F.col("y") - F.lag("y").over(by()))
    return _banded(_test(df), rows.groupBy("series_id").agg(F.max_by("y", "idx").alias("y_hat"), F.stddev_samp("dy").alias("sd")), ["series_id"])


def window_search(df: DataFrame, windows=WINDOWS) -> DataFrame:
    """In-sample error of each rolling mean: (series_id, w, mae)."""
    rows = df.where("train")
    errors = rows.select("series_id", *(F.abs(F.col("y") - full_mean(w)).alias(str(w)) for w in windows))
    wide = errors.groupBy("series_id").agg(*(F.avg(str(w)).alias(str(w)) for w in windows))
    return wide.unpivot("series_id", [str(w) for w in windows], "w", "mae").select("series_id", F.col("w").cast("long").alias("w"), "mae").where("mae is not null")


def season_search(df: DataFrame, seasons=SEASONS) -> DataFrame:
    """In-sample error of each seasonal repeat: (series_id, s, mae)."""
    rows = df.where("train")
    errors = rows.select("series_id", *(F.abs(F.col("y") - F.lag("y", s).over(by())).alias(str(s)) for s in seasons))
    wide = errors.groupBy("series_id").agg(*(F.avg(str(s)).alias(str(s)) for s in seasons))
    return wide.unpivot("series_id", [str(s) for s in seasons], "s", "mae").select("series_id", F.col("s").cast("long").alias("s"), "mae").where("mae is not null")


def best(search: DataFrame, name: str) -> DataFrame:
    return search.groupBy("series_id").agg(F.min_by(name, F.struct("mae", name)).alias(name))


def moving_average(df: DataFrame, windows=WINDOWS) -> DataFrame:
    chosen = best(window_search(df, windows), "w")
    rows = df.where("train").withColumns({f"m{w}": full_mean(w) for w in windows}).join(chosen, "series_id")
    past: Column = F.coalesce(*(F.when(F.col("w") == w, F.col(f"m{w}")) for w in windows))
    tail = F.when(F.col("idx") >= F.col("n_train") - F.col("w"), F.col("y"))
    fit = rows.withColumns({"res": F.col("y") - past, "tail": tail}).groupBy("series_id").agg(F.avg("tail").alias("y_hat"), F.stddev_samp("res").alias("sd"))
    return _banded(_test(df), fit, ["series_id"])


def seasonal_naive(df: DataFrame, seasons=SEASONS) -> DataFrame:
    """The last season of the best length, repeated; band: population deviation of the in-sample residuals."""
    chosen = best(season_search(df, seasons), "s")
    rows = df.join(chosen, "series_id")
    lagged = F.coalesce(*(F.when(F.col("s") == s, F.lag("y", s).over(by())) for s in seasons))
    sd = rows.where("train").withColumn("res", F.col("y") - lagged).groupBy("series_id").agg(F.stddev_pop("res").alias("sd"))
    last = rows.where(F.col("train") & (F.col("idx") >= F.col("n_train") - F.col("s"))).select("series_id", (F.col("idx") - F.col("n_train") + F.col("s")).alias("place"), F.col("y").alias("y_hat"))
    test = rows.where(~F.col("train")).select("series_id", "idx", "y", ((F.col("idx") - F.col("n_train")) % F.col("s")).alias("place"))
    return _banded(test.join(last, ["series_id", "place"]), sd, ["series_id"]).drop("place")
