"""Calendars, positions, differences, rolling features and gaps of time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

#: Lags of the features; fixed values.
LAGS = (1, 2, 3, 24, 25, 48, 168, 169)


def by(series: str = "series_id", order: str = "idx") -> WindowSpec:
    return Window.partitionBy(series).orderBy(order)


def calendar_fill(df: DataFrame, keys: list[str], time: str, values: list[str], step: str, per_group: bool) -> DataFrame:
    """Every key at every step from the first to the last time (of all, or of its own); missing values are 0."""
    ends = [F.min(time).alias("lo"), F.max(time).alias("hi")]
    bounds = df.groupBy(*keys).agg(*ends) if per_group else df.select(*keys).distinct().join(F.broadcast(df.agg(*ends)))
    days = bounds.select(*keys, F.explode(F.sequence("lo", "hi", F.expr(f"interval {step}"))).alias(time))
    return days.join(df, [*keys, time], "left").select(*keys, time, *(F.coalesce(v, F.lit(0.0)).alias(v) for v in values))


def indexed(df: DataFrame, series: str = "series_id", time: str = "t") -> DataFrame:
    return df.withColumn("idx", (F.row_number().over(by(series, time)) - 1).cast("long"))


def split(df: DataFrame, ratio: float = 0.8, series: str = "series_id") -> DataFrame:
    """Adds n_train, rounded half to even, and train."""
    n = F.count("*").over(Window.partitionBy(series))
    out = df.withColumn("n_train", F.bround(F.lit(ratio) * n, 0).cast("long"))
    return out.withColumn("train", F.col("idx") < F.col("n_train"))


def split_last(df: DataFrame, last: int, series: str = "series_id") -> DataFrame:
    """Adds n_train and train: all but the last rows of each series."""
    n = F.count("*").over(Window.partitionBy(series)) - last
    return df.withColumn("n_train", F.greatest(n, F.lit(0))).withColumn("train", F.col("idx") < F.col("n_train"))


def difference(df: DataFrame, lag: int = 1, series: str = "series_id") -> DataFrame:
    """y less the value `lag` rows before; the first rows are dropped."""
    return df.withColumn("dy", F.col("y") - F.lag("y", lag).over(by(series))).where("dy is not null")


def undifference(df: DataFrame, series: str = "series_id") -> DataFrame:
    """One-step prediction from the previous value and a predicted difference, not below 0."""
    back = F.lag(F.col("y") + F.col("d_hat")).over(by(series))
    return df.withColumn("y_hat", F.when(back.isNotNull(), F.greatest(back, F.lit(0.0))))


def full_mean(w: int, series: str = "series_id") -> Column:
    """Mean of the w rows before; null until there are that many."""
    frame = by(series).rowsBetween(-w, -1)
    return F.when(F.count("y").over(frame) == w, F.avg("y").over(frame))


def lag_features(df: DataFrame, series: str = "series_id") -> DataFrame:
    lags = {f"lag_{k}": F.lag("y", k).over(by(series)) for k in LAGS}
    return df.withColumns(lags | {f"mean_{w}": full_mean(w, series) for w in (24, 168)})


def calendar_features(df: DataFrame, time: str = "t") -> DataFrame:
    """Hour, weekday from Monday = 0, weekend flag, and both cycles as sine and cosine."""
    hour, day = F.hour(time), F.weekday(time)
    wave = lambda f, x, n: f(2 * F.pi() * x / n)
    return df.withColumns({"hour": hour.cast("long"), "weekday": day.cast("long"), "weekend": (day >= 5).cast("long"), "hour_sin": wave(F.sin, hour, 24), "hour_cos": wave(F.cos, hour, 24), "day_sin": wave(F.sin, day, 7), "day_cos": wave(F.cos, day, 7)})


def expanding_mean(df: DataFrame, series: str = "series_id") -> DataFrame:
    return df.withColumn("mean_before", F.avg("y").over(by(series).rowsBetween(Window.unboundedPreceding, -1)))


def interpolate_linear(df: DataFrame, series: str = "series_id") -> DataFrame:
    """Fills null y on the line between the known neighbours; ends without one stay null."""
    point = F.when(F.col("y").isNotNull(), F.struct("idx", "y"))
    w = by(series)
    a = F.last(point, True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    b = F.first(point, True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = df.withColumns({"a": a, "b": b})
    line = F.col("a.y") + (F.col("b.y") - F.col("a.y")) * (F.col("idx") - F.col("a.idx")) / (F.col("b.idx") - F.col("a.idx"))
    return out.withColumn("y", F.coalesce("y", F.when(F.col("b.idx") > F.col("a.idx"), line))).drop("a", "b")


def sparsify(df: DataFrame, percent: int, seed: int = 42, series: str = "series_id") -> DataFrame:
    """Nulls `percent` of the inner rows of each series, the first by a checksum; both ends stay."""
    n = F.count("*").over(Window.partitionBy(series))
    inner = (F.col("idx") > 0) & (F.col("idx") < n - 1)
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(series).cast("string"), F.lit(str(percent)), F.col("idx").cast("string")))
    rank = F.row_number().over(Window.partitionBy(series, inner).orderBy(key))
    drop = inner & (rank <= F.bround(F.lit(percent / 100) * (n - 2), 0))
    return df.withColumn("y", F.when(~drop, F.col("y")))
