"""Queries of fitted models, their grids, walk-forward evaluation and tests of series. Fits are beyond SQL; tests hold them to plain NumPy."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnflow.operators import baselines, boosting, evaluation, metrics, models, series, stationarity
from tarnflow.plans.catalog import _SKILL, _W, HOURLY, _split, query
from tarnflow.session import checkpoints, saved, shared_folder
from tarnflow.sources import tables
from tarnflow.streaming import rolling


@query()
def detect_periodicity(spark, sf_dir):
    return stationarity.detect_periodicity(tables.hourly_count(spark, sf_dir))


@query()
def pacf(spark, sf_dir):
    return stationarity.pacf(tables.hourly_count(spark, sf_dir))


@query()
def adf_test(spark, sf_dir):
    return stationarity.adf(tables.hourly_count(spark, sf_dir))


@query()
def ar_one_step(spark, sf_dir):
    return models.ar_one_step(_split(spark, sf_dir))


def _model(name: str) -> None:
    def run(spark, sf_dir):
        return models.forecast(_split(spark, sf_dir), name)

    run.__name__ = f"forecast_{name}"
    query()(run)


for _name in models.MODELS:
    _model(_name)


def _grid(name: str) -> None:
    def run(spark, sf_dir):
        found = models.grid_search(_split(spark, sf_dir), name)
        place = F.row_number().over(evaluation.Window.partitionBy("series_id").orderBy(F.asc_nulls_last("score"), "ordinal"))
        return found.drop("model").withColumn("place", place).where("place <= 5")

    run.__name__ = f"grid_{name}"
    query()(run)


for _name in ("sarima", "ets", "prophet_like", "dlinear"):
    _grid(_name)


def _boosted(config: str, name: str) -> None:
    def run(spark, sf_dir):
        checkpoints(spark)
        return models.gbt_recursive(series.split(tables.hourly_share(spark, sf_dir)), config)

    run.__name__ = name
    query()(run)


_boosted("deep", "gbt_recursive")
_boosted("leaves31", "gbt_recursive_leaves31")


@query()
def forecast_boosted(spark, sf_dir):
    """A model of 600 trees of depth 6 for each series, over all its test hours."""
    return boosting.forecast(series.split(tables.hourly_share(spark, sf_dir)), "deep")


@query()
def forecast_boosted_leaves31(spark, sf_dir):
    """A model of 600 trees of 31 leaves for each series, over all its test hours."""
    return boosting.forecast(series.split(tables.hourly_share(spark, sf_dir)), "leaves31")


FITTED = ("ar", "ets", "sarima", "prophet_like", "dlinear", "detected_naive")


def _walked(spark, sf_dir):
    df = tables.hourly_count(spark, sf_dir)
    return df, models.walk_forward(df, evaluation.rolling_origins(df), FITTED)


@query()
def walk_forward_models(spark, sf_dir):
    """Errors of fitted models at each origin, and how many fits failed."""
    return evaluation.scored(_walked(spark, sf_dir)[1], ["series_id", "cutoff", "model"])


def _all_scores(spark, sf_dir):
    df, fitted = _walked(spark, sf_dir)
    plain = evaluation.walk_forward(df, evaluation.rolling_origins(df))
    return plain.unionByName(evaluation.scored(fitted, ["series_id", "cutoff", "model"]).where("n > 0").drop("n", "failed"))


@query()
def models_ranking(spark, sf_dir):
    """The leaderboard over plain and fitted models, with the skill of each."""
    summary = evaluation.summary(_all_scores(spark, sf_dir), ["series_id"])
    return evaluation.pair_ranking(summary, ["naive", "seasonal_naive", *FITTED])


@query()
def sparsity_models(spark, sf_dir):
    """Fitted models on series with dropped and interpolated rows, scored on the true ones; skill against the mean at the same rate."""
    df = tables.hourly_count(spark, sf_dir)
    return evaluation.summary(evaluation.sparsity_models(df, ("ar", "ets", "prophet_like", "detected_naive")), ["drop_rate"])


@query()
def one_step_skill_fitted(spark, sf_dir):
    """One-step predictors on the test rows, an autoregression among them."""
    return evaluation.one_step_skill_test(_split(spark, sf_dir))


_PLAIN = HOURLY + f", x AS (SELECT sp.series_id, sp.idx, sp.n_train, sp.y, avg(y) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, lag(y) {_W}) AS p, lag(y, 24) {_W}) AS s FROM sp), l AS (SELECT series_id, y, unnest(['mean', 'persistence', 'seasonal24']) AS model, unnest([m, p, coalesce(s, m)]) AS f FROM x WHERE idx >= n_train), u AS (SELECT series_id, model, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse, 100 * avg(coalesce(2 * abs(y - f) / nullif(abs(y) + abs(f), 0), 0)) AS smape FROM l GROUP BY ALL), v AS (SELECT *, " + _SKILL.format(b="coalesce(max(CASE WHEN model = 'mean' THEN rmse END) OVER (PARTITION BY series_id), max(rmse) OVER (PARTITION BY series_id))") + " AS skill FROM u)"


@query(_PLAIN + " SELECT series_id, model, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(smape, 6) AS smape, round(skill, 6) AS skill FROM v")
def one_step_skill_plain(spark, sf_dir):
    """One-step predictors on the test rows that need no fit."""
    return evaluation.one_step_skill_test(_split(spark, sf_dir), fitted=False)


@query()
def rolling_ma1(spark, sf_dir):
    """Rolling one-step forecasts of daily sales by an MA(1) of their differences, undone and not below 0."""
    rows = tables.daily_sales(spark, sf_dir).select(F.col("category").alias("series_id"), "d", F.col("sales").alias("y"))
    fit = models.rolling_ma1(series.indexed(rows, time="d"))
    return series.undifference(fit).select("series_id", "idx", "y", "y_hat", "train")


@query()
def rolling_ma1_metrics(spark, sf_dir):
    rows = tables.daily_sales(spark, sf_dir).select(F.col("category").alias("series_id"), "d", F.col("sales").alias("y"))
    fit = series.undifference(models.rolling_ma1(series.indexed(rows, time="d")))
    return metrics.sales_metrics(fit.where(~F.col("train") & F.col("y_hat").isNotNull()), ["series_id"])


@query()
def streamed_ma1(spark, sf_dir):
    """The same predictions by a stateful stream that reads the days' sales from files and appends to files; the last day waits for the watermark. (series_id, idx, y, d, d_hat, y_hat)"""
    rows = tables.daily_sales(spark, sf_dir).select(F.col("category").alias("series_id"), "d", F.col("sales").cast("double").alias("y"))
    rows = saved(series.indexed(rows, time="d"), "sales")
    coefficients = saved(models.ma1_coefficients(rows), "coefficients")
    source, out, kept = (shared_folder(spark, name) for name in ("source", "predictions", "state"))
    feed = rows.select("series_id", F.timestamp_seconds((F.col("idx") + 1) * 86_400).alias("at"), "y")
    feed.write.parquet(source)
    stream = spark.readStream.schema(feed.schema).parquet(source)
    with rolling.state_store(spark):
        run = rolling.rolling_predictions(stream, coefficients).writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(rolling.OUT).parquet(out).select("series_id", (F.floor(F.unix_seconds("at") / 86_400) - 1).alias("idx"), "y", "d", "d_hat", "y_hat")


def _errors(df, name: str):
    return metrics.error(models.forecast(df, name).where("y_hat is not null"), ["series_id"]).withColumn("model", F.lit(name))


@query()
def comparison_all_models(spark, sf_dir):
    """Errors and skill of every model on the test rows of each series, from the smallest error on; models that fit nothing have no errors."""
    df = _split(spark, sf_dir)
    parts = [_errors(df, name) for name in (*FITTED, "sarimax_fixed", "auto_weekly")]
    for name, model in (("mean", baselines.mean), ("naive", baselines.naive), ("seasonal_naive", baselines.seasonal_naive), ("moving_average", baselines.moving_average)):
        parts.append(metrics.error(model(df), ["series_id"]).withColumn("model", F.lit(name)))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    place = F.row_number().over(evaluation.Window.partitionBy("series_id").orderBy(F.asc_nulls_last("rmse"), "model"))
    return metrics.skill(both, ["series_id"]).withColumn("place", place)
