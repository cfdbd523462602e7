"""Forecast accuracy as single-pass aggregates, and skill against the flat mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def _div(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.nullif(b, F.lit(0.0)))


def aligned(truth: DataFrame, forecast: DataFrame, keys: list[str]) -> DataFrame:
    """Only rows with both a truth and a forecast are scored."""
    return truth.join(forecast, keys)


def all_metrics(df: DataFrame, by: list[str], season: int = 24, q: float = 0.5) -> DataFrame:
    """Eleven metrics of (idx, y, y_hat) for each group, in one aggregation."""
    w = Window.partitionBy(*by).orderBy("idx")
    e = F.col("y") - F.col("y_hat")
    rows = df.withColumns({"e": e, "s": F.col("y") - F.lag("y", season).over(w), "dy": F.col("y") - F.lag("y").over(w), "df": F.col("y_hat") - F.lag("y_hat").over(w)})
    e, y, f = F.col("e"), F.col("y"), F.col("y_hat")
    return rows.groupBy(*by).agg(
        F.avg(F.abs(e)).alias("mae"), F.median(F.abs(e)).alias("medae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (100 * F.avg(F.abs(_div(e, y)))).alias("mape"), (100 * F.avg(_div(2 * F.abs(e), F.abs(y) + F.abs(f)))).alias("smape"),
        _div(F.avg(F.abs(e)), F.avg(F.abs("s"))).alias("mase"), F.sqrt(_div(F.avg(e * e), F.avg(F.col("s") * F.col("s")))).alias("rmsse"),
        (1 - _div(F.sum(e * e), F.var_pop("y") * F.count("y"))).alias("r2"),
        (100 * F.avg((F.signum("dy") == F.signum("df")).cast("double"))).alias("direction"),
        F.avg(F.greatest(q * e, (q - 1) * e)).alias("pinball"),
    )


def pipeline_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    e = F.col("y") - F.col("y_hat")
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(F.abs(_div(e, F.col("y"))))).alias("mape"))


def error(df: DataFrame, by: list[str]) -> DataFrame:
    """MAE, RMSE and sMAPE, where rows of two zeros count as 0."""
    e = F.col("y") - F.col("y_hat")
    half = F.coalesce(_div(2 * F.abs(e), F.abs("y") + F.abs("y_hat")), F.lit(0.0))
    return df.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (100 * F.avg(half)).alias("smape"))


def sales_metrics(df: DataFrame, by: list[str]) -> DataFrame:
    """With mase_inverse: the naive error over the model's; more is better."""
    e = F.col("y") - F.col("y_hat")
    rows = df.withColumn("naive", F.abs(F.col("y") - F.lag("y").over(Window.partitionBy(*by).orderBy("idx"))))
    return rows.groupBy(*by).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.avg(F.abs(_div(e, F.col("y")))).alias("mape"), _div(F.avg("naive"), F.avg(F.abs(e))).alias("mase_inverse"))


def skill(df: DataFrame, by: list[str], base: str = "mean") -> DataFrame:
    """skill in percent of the base model's rmse in the group, or of the largest; 0 if that isn't positive."""
    w = Window.partitionBy(*by)
    ref = F.coalesce(F.max(F.when(F.col("model") == base, F.col("rmse"))).over(w), F.max("rmse").over(w))
    return df.withColumn("skill", F.coalesce(100 * (1 - _div(F.col("rmse"), F.when(ref > 0, ref))), F.lit(0.0)))
