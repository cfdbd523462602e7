"""Filters, scans, sinks, generated series, and the data behind plots, as queries with their twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.scalars import clip, near
from tarnflow.operators import baselines, evaluation, metrics, series, spatial, stationarity
from tarnflow.plans.catalog import _W, BOARD, HOURLY, MEAN_F, MEDIAN, NAIVE_F, SALES_ALL, SUMMARY, WALK, _r, _split, _summary, _walk, query
from tarnflow.session import shared_folder
from tarnflow.sources import files, synthetic, tables
from tarnflow.streaming import hourly

# filters


@query(HOURLY + " SELECT series_id, idx, y FROM h WHERE t = TIMESTAMP '2024-01-05 12:00:00'")
def snapshot_at(spark, sf_dir):
    return tables.hourly_count(spark, sf_dir).where(F.col("t") == F.lit("2024-01-05 12:00:00").cast("timestamp_ntz")).select("series_id", "idx", "y")


@query("SELECT DISTINCT strftime(date_trunc('hour', ts), '%Y-%m-%dT%H:%M:%S') AS t FROM events WHERE strftime(ts, '%Y-%m-%dT%H:%M:%S') LIKE '2024-01-07%'")
def times_of_a_day(spark, sf_dir):
    """Distinct hours whose text starts with a day."""
    t = F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd'T'HH:mm:ss")
    return tables.read(spark, sf_dir, "events").select(t.alias("t")).where(F.col("t").startswith("2024-01-07")).distinct()


@query(HOURLY + ", x AS (SELECT series_id, idx, " + ", ".join(f"lag(y, {k}) {_W}) AS lag_{k}" for k in (1, 24, 169)) + " FROM h) SELECT * FROM x WHERE lag_169 IS NOT NULL")
def complete_rows(spark, sf_dir):
    """Rows without a null in any column."""
    lags = {f"lag_{k}": F.lag("y", k).over(series.by()) for k in (1, 24, 169)}
    return tables.hourly_count(spark, sf_dir).withColumns(lags).drop("t", "y").na.drop("any")


@query(SALES_ALL + " SELECT strftime(d, '%Y-%m-%d') AS d, round(sales, 2) AS sales FROM s WHERE category = (SELECT min(p_type) FROM part)")
def category_slice(spark, sf_dir):
    first = tables.read(spark, sf_dir, "part").agg(F.min("p_type")).first()[0]
    return tables.daily_sales(spark, sf_dir).where(F.col("category") == first).select(F.date_format("d", "yyyy-MM-dd").alias("d"), F.round("sales", 2).alias("sales"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 12 AND p_retailprice > 1000")
def text_predicate(spark, sf_dir):
    return tables.read(spark, sf_dir, "part").where("p_size = 12 and p_retailprice > 1000").select("p_partkey", "p_brand", "p_size")


@query(WALK + ", x AS (SELECT series_id, cutoff, model, rmse / nullif(CASE WHEN model = 'naive' THEN 0 ELSE 1 END, 0) AS rmse FROM w) SELECT series_id, cutoff, model, round(rmse, 6) AS rmse FROM x WHERE rmse IS NOT NULL AND isfinite(rmse)")
def finite_scores(spark, sf_dir):
    """Scores that are numbers: one model's are made infinite first."""
    scores = _walk(spark, sf_dir).select("series_id", "cutoff", "model", F.when(F.col("model") == "naive", F.lit(float("inf"))).otherwise(F.col("rmse")).alias("rmse"))
    return scores.where(F.col("rmse").isNotNull() & ~F.isnan("rmse") & (F.abs("rmse") < float("inf")))


SIGNIFICANT = [17 * k + 3 for k in range(15)]


@query(MEDIAN + f" SELECT t, zsid, zsid IN ({', '.join(map(str, SIGNIFICANT))}) AS hub FROM full_")
def station_flags(spark, sf_dir):
    return spatial.flagged(spatial.knn_impute(tables.stations(spark, sf_dir)), SIGNIFICANT).select("t", "zsid", "hub")


@query(MEDIAN + f" SELECT t, count(*) AS n FROM full_ WHERE zsid IN ({', '.join(map(str, SIGNIFICANT))}) GROUP BY t")
def chosen_stations(spark, sf_dir):
    return spatial.knn_impute(tables.stations(spark, sf_dir)).where(F.col("zsid").isin(SIGNIFICANT)).groupBy("t").agg(F.count("*").alias("n"))


@query("WITH s AS (SELECT user_id, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 1) SELECT * FROM s WHERE n >= 12")
def long_enough(spark, sf_dir):
    """Series of at least so many rows."""
    return tables.read(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).where("n >= 12")


@query(HOURLY + ", sh AS (SELECT series_id, idx, coalesce(300 * y / nullif(sum(y) OVER (PARTITION BY t), 0), 0) - 30 AS y FROM h) SELECT series_id, idx, round(least(100, greatest(0, y)), 6) AS y FROM sh")
def clip_share(spark, sf_dir):
    return tables.hourly_share(spark, sf_dir).select("series_id", "idx", clip(3 * F.col("y") - 30).alias("y"))


@query(HOURLY + ", l AS (SELECT *, max(idx) OVER (PARTITION BY series_id) + 1 AS n FROM h) SELECT series_id, idx, y, idx < n - 10 AS train FROM l")
def label_split(spark, sf_dir):
    """The last ten rows of each series are the test, disjoint from the train rows."""
    return series.split_last(tables.hourly_count(spark, sf_dir), 10).select("series_id", "idx", "y", "train")


@query(HOURLY + " SELECT series_id, idx, y FROM h WHERE y >= 1 AND series_id LIKE '%c%' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY idx) <= 5")
def head_rows(spark, sf_dir):
    """The first five rows of each series whose name holds a text."""
    rows = tables.hourly_count(spark, sf_dir).where(F.col("series_id").contains("c") & (F.col("y") >= 1))
    return rows.withColumn("rn", F.row_number().over(series.by())).where("rn <= 5").select("series_id", "idx", "y")


@query("SELECT o_orderkey, CAST(epoch(o_orderdate) / 10 AS BIGINT) AS tens, strftime(o_orderdate, '%Y') || '_' || o_orderpriority AS label, split_part(o_orderpriority, '-', 2) AS word, replace(CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || 'T00', 'T', ' ') AS day, regexp_extract('forecast_' || o_orderstatus || '.csv', 'forecast_(.*?)\\.csv', 1) AS status, starts_with(o_orderpriority, '1') AS urgent FROM orders")
def text_and_epoch(spark, sf_dir):
    """Epoch seconds in tens, and text functions: labels, parts, replacement, lazy patterns, prefixes."""
    o = tables.read(spark, sf_dir, "orders")
    seconds = F.timestamp_diff("SECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col("o_orderdate").cast("timestamp_ntz"))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select("o_orderkey", F.round(seconds / 10).cast("long").alias("tens"), F.concat(F.date_format("o_orderdate", "yyyy"), F.lit("_"), "o_orderpriority").alias("label"), F.split_part("o_orderpriority", F.lit("-"), F.lit(2)).alias("word"), F.replace(F.concat(day, F.lit("T00")), F.lit("T"), F.lit(" ")).alias("day"), F.regexp_extract(F.concat(F.lit("forecast_"), "o_orderstatus", F.lit(".csv")), r"forecast_(.*?)\.csv", 1).alias("status"), F.startswith("o_orderpriority", F.lit("1")).alias("urgent"))


@query("SELECT event_id, coalesce(json_extract_string(CASE WHEN json_valid(props) THEN props END, '$.k'), '') AS k, CAST(len(json_keys(CASE WHEN json_valid(props) THEN props ELSE '{}' END)) AS INT) AS n FROM events")
def event_props(spark, sf_dir):
    """A key of the JSON text of each event, and how many keys it has."""
    of = F.from_json("props", "map<string,string>")
    return tables.read(spark, sf_dir, "events").select("event_id", F.coalesce(F.get_json_object("props", "$.k"), F.lit("")).alias("k"), F.coalesce(F.size(of), F.lit(0)).alias("n"))


# scans and sinks: written and read again


def _again(spark: SparkSession, name: str) -> str:
    return shared_folder(spark, name)


@query(MEDIAN.split(",\nnear AS")[0] + " SELECT CAST(zsid AS VARCHAR) AS zsid, t AS snap, round(e, 4) AS e, round(n, 4) AS n, round(cnt, 4) AS cnt FROM st")
def source_counts(spark, sf_dir):
    """Yearly CSV of counts, missing ones as NaN: written, scanned, and the time taken apart again."""
    path = _again(spark, "counts")
    st = tables.stations(spark, sf_dir)
    time = F.date_format(F.lit("2026-02-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("t").cast("int")), "yyyy-MM-dd'T'HH:mm:ss")
    cnt = F.coalesce(F.round("cnt", 4).cast("string"), F.lit("NaN"))
    st.select(F.col("zsid").cast("string").alias("ZSID"), F.lit("x").alias("ZSName"), F.lit(1.0).alias("Hoehe"), F.round("e", 4).alias("EKoord"), F.round("n", 4).alias("NKoord"), time.alias("MessungDatZeit"), cnt.alias("AnzFahrzeuge")).write.option("header", True).csv(f"{path}/2026.csv")
    df = files.scan_counts(spark, path + "/{year}.csv")
    return df.select(F.col("ZSID").alias("zsid"), F.hour("t").cast("long").alias("snap"), F.col("EKoord").alias("e"), F.col("NKoord").alias("n"), F.col("AnzFahrzeuge").alias("cnt"))


@query(HOURLY + " SELECT series_id, idx, y FROM h")
def source_wide(spark, sf_dir):
    """Hub distribution: wide CSV with a column for each hub, zeros left empty; written, and scanned as long rows."""
    path = _again(spark, "wide")
    h = tables.hourly_count(spark, sf_dir)
    hubs = sorted(r[0] for r in h.select("series_id").distinct().collect())
    counts = h.select(F.col("idx").alias("t"), F.col("series_id").alias("hub"), F.when(F.col("y") > 0, F.col("y")).alias("n"))
    files.write_hub_distribution(counts, hubs, path)
    wide = spark.read.option("header", True).csv(path)
    times = wide.withColumn("t", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_interval(hours=F.col("t").cast("int")))
    times.write.option("header", True).csv(f"{path}-timed")
    long = files.scan_wide(spark, f"{path}-timed")
    return long.select("series_id", F.timestamp_diff("HOUR", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"), "t").alias("idx"), "y")


@query(HOURLY + MEAN_F + NAIVE_F.replace(", f AS", ", g AS") + " SELECT 'mean' AS model, series_id, idx, y, round(y_hat, 6) AS y_hat FROM sp JOIN f USING (series_id) WHERE idx >= n_train UNION ALL SELECT 'naive', series_id, idx, y, round(y_hat, 6) FROM sp JOIN g USING (series_id) WHERE idx >= n_train")
def source_forecasts(spark, sf_dir):
    """Forecast files, a model's name in each file's: written, with rows that lack a value, and scanned without those."""
    path, df = _again(spark, "forecasts"), _split(spark, sf_dir)
    for name, model in (("mean", baselines.mean), ("naive", baselines.naive)):
        out = model(df).select("series_id", "idx", "y", "y_hat")
        out.unionByName(out.limit(3).withColumn("y_hat", F.lit(None).cast("double"))).write.option("header", True).csv(f"{path}/forecast_{name}.csv")
    return files.scan_forecasts(spark, f"{path}/*").select("model", "series_id", "idx", "y", "y_hat")


@query(HOURLY + " SELECT upper(left(series_id, 3)) || '1' AS pair, 'Z' || length(series_id) AS hub, CAST(sum(y) AS VARCHAR) AS value FROM h GROUP BY series_id")
def source_folders(spark, sf_dir):
    """Folders named by pair, hub and month: written, and their names taken apart."""
    path = _again(spark, "folders")
    h = tables.hourly_count(spark, sf_dir).groupBy("series_id").agg(F.sum("y").cast("string").alias("value"))
    for r in h.collect():  # one row for each series
        spark.createDataFrame([(r.value,)], "value string").write.text(f"{path}/{r.series_id[:3].upper()}1_Z{len(r.series_id)}_2026-02")
    return files.scan_folders(spark, f"{path}/*_2026-02")


@query(SUMMARY + ", l AS (SELECT series_id AS series, model, unnest(['mae', 'rmse', 'smape']) AS metric, unnest([mae, rmse, smape]) AS value FROM v) SELECT series, model, metric, round(value, 6) AS value FROM l")
def source_metric_store(spark, sf_dir):
    """Nested JSON of metrics: written, and scanned as long rows."""
    path = _again(spark, "metrics")
    long = _summary(spark, sf_dir).unpivot(["series_id", "model"], ["mae", "rmse", "smape"], "metric", "value")
    files.write_metric_store(long.withColumnRenamed("series_id", "series"), path)
    return files.scan_metric_store(spark, path, lines=True)


@query("SELECT c_custkey, 'Zürich é ' || c_mktsegment AS name, DATE '2020-01-01' + CAST(c_custkey % 700 AS INT) AS day FROM customer")
def source_latin1(spark, sf_dir):
    """CSV in ISO 8859-1 with dates: written and scanned."""
    path = _again(spark, "latin1")
    rows = tables.read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("Zürich é "), "c_mktsegment").alias("name"), F.date_add(F.lit("2020-01-01").cast("date"), (F.col("c_custkey") % 700).cast("int")).alias("day"))
    rows.write.option("header", True).option("encoding", "ISO-8859-1").csv(path)
    return files.scan_latin1(spark, path, "c_custkey bigint, name string, day string", ("day",))


@query(HOURLY + " SELECT series_id, strftime(t, '%Y-%m-%dT%H:%M:%S') AS t, y FROM h WHERE t >= TIMESTAMP '2024-01-10 00:00:00' QUALIFY row_number() OVER (PARTITION BY series_id ORDER BY t) <= 48")
def source_window(spark, sf_dir):
    return files.window_slice(tables.hourly_count(spark, sf_dir).select("series_id", "t", "y"), "2024-01-10 00:00:00", 48)


@query(SUMMARY + f" SELECT series_id, model, {_r('mae', 'rmse', 'smape', 'rmse_sd', 'skill')}, 'b' AS label FROM v UNION ALL SELECT series_id, model, {_r('mae', 'rmse', 'smape', 'rmse_sd', 'skill')}, 'a' FROM v")
def sink_scores(spark, sf_dir):
    """Per-origin scores and their summary, in a folder for each label; a label written twice is there once."""
    path, walk, summary = _again(spark, "scores"), _walk(spark, sf_dir), _summary(spark, sf_dir)
    for label in ("a", "b", "a"):
        files.write_scores(walk, summary, path, label)
    return spark.read.parquet(f"{path}/summary")


@query(BOARD + f" SELECT series_id, best_model, {_r('best_skill', 'best_rmse', 'mean_rmse')}, best_skill > 1 AS real_skill FROM lb")
def sink_ranking(spark, sf_dir):
    """A leaderboard written in two parts, of which the second repeats a pair."""
    path = _again(spark, "ranking")
    board = evaluation.leaderboard(_summary(spark, sf_dir))
    first = board.agg(F.min("series_id")).first()[0]
    files.write_ranking(board.where(F.col("series_id") <= first), path)
    files.write_ranking(board, path)
    return spark.read.parquet(path).drop("pair")


@query(SUMMARY + " SELECT series_id, model, round(mae, 2) AS mae, round(rmse, 2) AS rmse, round(smape, 2) AS smape FROM v")
def sink_metrics_csv(spark, sf_dir):
    path = _again(spark, "metrics-csv")
    files.write_metrics_csv(_summary(spark, sf_dir).select("series_id", "model", "mae", "rmse", "smape"), path)
    return spark.read.schema("series_id string, model string, mae double, rmse double, smape double").option("header", True).csv(path)


@query(HOURLY + MEAN_F + " SELECT series_id, idx, round(y_hat, 6) AS y_hat, 'mean' AS model FROM sp JOIN f USING (series_id) WHERE idx >= n_train")
def sink_forecasts(spark, sf_dir):
    path = _again(spark, "forecast-sink")
    files.write_forecasts(baselines.mean(_split(spark, sf_dir)).select("series_id", "idx", "y_hat").withColumn("model", F.lit("mean")), path)
    return spark.read.parquet(path)


@query("SELECT DISTINCT event_type AS series_id, m.model FROM events, (VALUES ('mean'), ('naive')) m(model) WHERE NOT (m.model = 'mean' AND event_type < 'm')")
def sink_skips_done(spark, sf_dir):
    """Tasks whose output isn't there yet: series that have a forecast of a model are left out."""
    tasks = tables.read(spark, sf_dir, "events").select(F.col("event_type").alias("series_id")).distinct().withColumn("model", F.explode(F.array(F.lit("mean"), F.lit("naive"))))
    path = _again(spark, "done")
    tasks.where("model = 'mean' and series_id < 'm'").write.parquet(path)
    return files.not_yet_written(tasks, spark.read.parquet(path), ["series_id", "model"])


# generated series

_U = "((('0x' || substr(md5('{k}|{key}), 1, 8))::BIGINT)::DOUBLE + 0.5) / 4294967296.0"


def _normal(key: str) -> str:
    return f"sqrt(-2 * ln({_U.format(k='u', key=key)})) * cos(2 * pi() * {_U.format(k='v', key=key)})"


_PRODUCTS = "(VALUES " + ", ".join(f"('{n}', {s}, {u}, {a}, {p})" for n, s, u, a, p in synthetic.PRODUCTS) + ") p(series_id, slope, unit, amplitude, period)"


@query(f"""WITH RECURSIVE hs AS (SELECT unnest(range(5112)) AS idx), cl AS (SELECT series_id, idx, 100 + slope * (idx / 24.0) / unit + amplitude * sin(2 * pi() * (idx / 24.0) / period) AS clean, {_normal("42|' || series_id || '|' || idx")} * 10 AS draw FROM hs, {_PRODUCTS}),
n(series_id, idx, noise) AS (SELECT series_id, idx, draw FROM cl WHERE idx = 0 UNION ALL SELECT n.series_id, n.idx + 1, 0.5 * noise + sqrt(0.75) * draw FROM n JOIN cl ON cl.series_id = n.series_id AND cl.idx = n.idx + 1),
s AS (SELECT series_id, idx, clean, clean + noise AS y FROM cl JOIN n USING (series_id, idx))
SELECT series_id, idx, round(clean, 4) AS clean, round(y, 4) AS y FROM s UNION ALL SELECT 'all', idx, round(sum(clean), 4), round(sum(y), 4) FROM s GROUP BY idx""")
def generated_products(spark, sf_dir):
    """Three hourly products with trend, season and correlated noise, and their sum."""
    return synthetic.products(spark).select("series_id", "idx", F.round("clean", 4).alias("clean"), F.round("y", 4).alias("y"))


def _sine_sql(n: int, period: int, amplitude: float, slope: float, noise: float, step: str) -> str:
    return f"SELECT idx, round({amplitude} * sin(2 * pi() * idx / {period}) + {slope} * idx + {noise} * {_normal(chr(52) + '2|' + step + chr(124) + chr(39) + ' || idx')}, 4) AS y FROM (SELECT unnest(range({n})) AS idx)"


@query(_sine_sql(300, 12, 10.0, 0.05, 1.5, "month"))
def generated_monthly(spark, sf_dir):
    return synthetic.demo_monthly(spark).select("idx", F.round("y", 4).alias("y"))


@query(_sine_sql(720, 24, 10.0, 0.01, 1.5, "hour"))
def generated_hourly(spark, sf_dir):
    return synthetic.demo_hourly(spark).select("idx", F.round("y", 4).alias("y"))


@query(_sine_sql(36, 12, 1.0, 0.0, 0.2, "month").replace("SELECT idx,", "SELECT strftime(last_day(DATE '2020-01-01' + to_months(CAST(idx AS INT))), '%Y-%m-%d') AS t,", 1))
def generated_month_ends(spark, sf_dir):
    return synthetic.month_ends(spark).select(F.date_format("t", "yyyy-MM-dd").alias("t"), F.round("y", 4).alias("y"))


# data behind plots


@query(HOURLY + MEAN_F + " SELECT series_id, idx, CASE WHEN idx < n_train THEN 'train' ELSE 'test' END AS role, round(y, 6) AS y FROM sp UNION ALL SELECT series_id, idx, 'forecast', round(y_hat, 6) FROM sp JOIN f USING (series_id) WHERE idx >= n_train")
def plot_roles(spark, sf_dir):
    """Train, test and forecast of each series under one another."""
    df = _split(spark, sf_dir)
    own = df.select("series_id", "idx", F.when(F.col("train"), "train").otherwise("test").alias("role"), "y")
    return own.unionByName(baselines.mean(df).select("series_id", "idx", F.lit("forecast").alias("role"), F.col("y_hat").alias("y")))


@query(HOURLY + MEAN_F + NAIVE_F.replace(", f AS", ", g AS") + " SELECT series_id, idx, 'train' AS model, y FROM sp WHERE idx < n_train AND idx >= n_train - 168 UNION ALL SELECT series_id, idx, 'mean', round(y_hat, 6) FROM sp JOIN f USING (series_id) WHERE idx >= n_train UNION ALL SELECT series_id, idx, 'naive', round(y_hat, 6) FROM sp JOIN g USING (series_id) WHERE idx >= n_train")
def plot_combined(spark, sf_dir):
    """The last 168 train rows, and the forecasts of all models."""
    df = _split(spark, sf_dir)
    tail = df.where("train and idx >= n_train - 168").select("series_id", "idx", F.lit("train").alias("model"), "y")
    each = [m(df).select("series_id", "idx", F.lit(n).alias("model"), F.col("y_hat").alias("y")) for n, m in (("mean", baselines.mean), ("naive", baselines.naive))]
    return tail.unionByName(each[0]).unionByName(each[1])


_TWO = HOURLY + MEAN_F + NAIVE_F.replace(", f AS", ", g AS") + ", l AS (SELECT series_id, idx, y, 'mean' AS model, y_hat AS f FROM sp JOIN f USING (series_id) WHERE idx >= n_train UNION ALL SELECT series_id, idx, y, 'naive', y_hat FROM sp JOIN g USING (series_id) WHERE idx >= n_train)"


def _two(spark, sf_dir) -> DataFrame:
    df = _split(spark, sf_dir)
    return baselines.mean(df).withColumn("model", F.lit("mean")).unionByName(baselines.naive(df).withColumn("model", F.lit("naive")))


@query(_TWO + " SELECT series_id, idx, model, y, round(f, 6) AS y_hat, round(avg(abs(y - f)) OVER g, 6) AS mae, round(sqrt(avg((y - f) * (y - f)) OVER g), 6) AS rmse FROM l WINDOW g AS (PARTITION BY series_id, model)")
def plot_grid(spark, sf_dir):
    """Forecasts beside the errors of their model."""
    both = _two(spark, sf_dir)
    return both.join(metrics.error(both, ["series_id", "model"]), ["series_id", "model"]).select("series_id", "idx", "model", "y", "y_hat", "mae", "rmse")


@query(WALK + " SELECT model, round(min(rmse), 6) AS low, round(quantile_cont(rmse, 0.25), 6) AS q1, round(quantile_cont(rmse, 0.5), 6) AS median, round(quantile_cont(rmse, 0.75), 6) AS q3, round(max(rmse), 6) AS high, round(avg(rmse), 6) AS mean, count(rmse) AS n FROM w GROUP BY model")
def plot_origin_box(spark, sf_dir):
    return evaluation.with_quartiles(_walk(spark, sf_dir), ["model"], "rmse")


@query(SUMMARY + " SELECT model, round(min(skill), 6) AS low, round(quantile_cont(skill, 0.25), 6) AS q1, round(quantile_cont(skill, 0.5), 6) AS median, round(quantile_cont(skill, 0.75), 6) AS q3, round(max(skill), 6) AS high, round(avg(skill), 6) AS mean, count(skill) AS n FROM v GROUP BY model")
def plot_skill_box(spark, sf_dir):
    return evaluation.with_quartiles(_summary(spark, sf_dir), ["model"], "skill")


@query(BOARD + " SELECT series_id, best_model, round(best_skill, 6) AS best_skill, CAST(row_number() OVER (ORDER BY best_skill DESC, series_id) AS INT) AS place FROM lb ORDER BY lb.best_skill DESC, series_id LIMIT 20")
def plot_leaderboard(spark, sf_dir):
    """The first 20 places."""
    rows = evaluation.leaderboard(_summary(spark, sf_dir)).orderBy(F.desc("best_skill"), "series_id").limit(20)
    return rows.withColumn("place", F.row_number().over(evaluation.Window.orderBy(F.desc("best_skill"), "series_id"))).select("series_id", "best_model", "best_skill", "place")


# orders, limits and sets


@query(SUMMARY + f", o AS (SELECT series_id, model, {_r('rmse')}, CAST(row_number() OVER (PARTITION BY series_id ORDER BY rmse, model) AS INT) AS place FROM v) SELECT * FROM o")
def models_by_rmse(spark, sf_dir):
    """Models of each series from the smallest error on."""
    w = evaluation.Window.partitionBy("series_id").orderBy("rmse", "model")
    return _summary(spark, sf_dir).withColumn("place", F.row_number().over(w)).select("series_id", "model", "rmse", "place")


@query(BOARD + ", r AS (SELECT *, row_number() OVER (ORDER BY best_skill DESC, series_id) AS hi, row_number() OVER (ORDER BY best_skill, series_id) AS lo FROM lb) SELECT 'top' AS list, series_id, round(best_skill, 6) AS best_skill FROM r WHERE hi <= 15 UNION ALL SELECT 'bottom', series_id, round(best_skill, 6) FROM r WHERE lo <= 5")
def leaderboard_ends(spark, sf_dir):
    """The first 15 and the last 5."""
    board = evaluation.leaderboard(_summary(spark, sf_dir)).select("series_id", "best_skill")
    top, bottom = board.orderBy(F.desc("best_skill"), "series_id").limit(15), board.orderBy("best_skill", "series_id").limit(5)
    return top.withColumn("list", F.lit("top")).unionByName(bottom.withColumn("list", F.lit("bottom"))).select("list", "series_id", "best_skill")


@query(BOARD + " SELECT count(*) FILTER (best_skill > 1) AS n_real, count(*) AS n, CAST(max(greatest(best_skill, 1)) > 1 AS BOOLEAN) AS any_real FROM lb")
def real_pairs(spark, sf_dir):
    """How many series have real skill."""
    board = evaluation.leaderboard(_summary(spark, sf_dir))
    return board.agg(F.count_if(F.col("best_skill") > 1).alias("n_real"), F.count("*").alias("n"), (F.max(F.greatest("best_skill", F.lit(1.0))) > 1).alias("any_real"))


@query(SUMMARY + ", x AS (SELECT series_id, max(CASE WHEN model = 'mean' THEN rmse END) AS a, max(CASE WHEN model = 'naive' THEN rmse END) AS b, max(CASE WHEN model = 'seasonal_naive' THEN rmse END) AS c FROM v GROUP BY 1) SELECT round(median(greatest(a, b, c)), 6) AS median_worst, round(max(greatest(a, b, c)), 6) AS worst FROM x")
def worst_of_three(spark, sf_dir):
    """The largest of three models' errors in each series: its median and maximum."""
    wide = _summary(spark, sf_dir).groupBy("series_id").pivot("model", ["mean", "naive", "seasonal_naive"]).agg(F.max("rmse"))
    worst = F.greatest("mean", "naive", "seasonal_naive")
    return wide.agg(F.median(worst).alias("median_worst"), F.max(worst).alias("worst"))


@query(BOARD + f", p AS (SELECT series_id, max(CASE WHEN model = 'naive' THEN skill END) AS skill_naive, max(CASE WHEN model = 'seasonal_naive' THEN skill END) AS skill_seasonal_naive FROM v GROUP BY 1) SELECT series_id, best_model, {_r('best_skill', 'best_rmse', 'mean_rmse')}, best_skill > 1 AS real_skill, {_r('skill_naive', 'skill_seasonal_naive')} FROM lb JOIN p USING (series_id)")
def pair_ranking(spark, sf_dir):
    return evaluation.pair_ranking(_summary(spark, sf_dir), ["naive", "seasonal_naive"])


@query("SELECT DISTINCT c_nationkey AS n, c_mktsegment AS s FROM customer ORDER BY 1, 2 LIMIT 7")
def first_pairs(spark, sf_dir):
    """The first pairs only: a smoke limit."""
    return tables.read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("n"), F.col("c_mktsegment").alias("s")).distinct().orderBy("n", "s").limit(7)


@query(WALK + ", u AS (SELECT 'b' AS tag, 0 AS ord, * FROM w WHERE model <> 'mean' UNION ALL SELECT 'a', 1, series_id, cutoff, model, mae + 1, rmse + 1, smape FROM w), r AS (SELECT *, row_number() OVER (PARTITION BY series_id, cutoff, model ORDER BY ord) AS rn FROM u) SELECT series_id, cutoff, model, tag, round(rmse, 6) AS rmse FROM r WHERE rn = 1")
def sparsity_combine(spark, sf_dir):
    """Scores of several tags put together; of rows with equal keys that of the first tag stays."""
    walk = _walk(spark, sf_dir)
    one = walk.where("model <> 'mean'").withColumns({"tag": F.lit("b"), "ord": F.lit(0)})
    two = walk.withColumns({"tag": F.lit("a"), "ord": F.lit(1), "rmse": F.col("rmse") + 1})
    return evaluation.first_tag(one.unionByName(two), ["series_id", "cutoff", "model"], "ord").select("series_id", "cutoff", "model", "tag", "rmse")


def _tests_sql(values: dict[str, str]) -> str:
    """For each metric the groups' adjusted p-values: CTEs named b_<metric> (g, p, q)."""
    out = "WITH x0 AS (SELECT CAST(floor(l_extendedprice / 20000) AS BIGINT) AS g, l_extendedprice, l_discount, l_tax FROM lineitem)"
    for m, v in values.items():
        out += f""", x_{m} AS (SELECT g, round({v}, 2) AS v FROM x0),
c_{m} AS (SELECT v, count(*) AS c, sum(count(*)) OVER (ORDER BY v) - count(*) AS below FROM x_{m} GROUP BY v),
o_{m} AS (SELECT g, v, mine, c, below - (sum(c) OVER (PARTITION BY g ORDER BY v) - c) AS others FROM (SELECT g, v, count(*) AS mine FROM x_{m} GROUP BY ALL) JOIN c_{m} USING (v)),
s_{m} AS (SELECT g, CAST(sum(mine * others) AS DOUBLE) AS u, CAST(sum(mine) AS DOUBLE) AS m, (SELECT count(*) FROM x_{m}) - sum(c) AS k, (SELECT sum(CAST(c AS DOUBLE) * c * c - c) FROM c_{m}) - sum(CAST(c AS DOUBLE) * c * c - c) + sum(CAST(mine AS DOUBLE) * mine * mine - mine) AS tie FROM o_{m} GROUP BY g),
z_{m} AS (SELECT g, u, (u + 0.5 - m * k / 2) / nullif(sqrt(m * k / 12 * (m + k + 1 - tie / ((m + k) * (m + k - 1)))), 0) AS z FROM s_{m}),
t_{m} AS (SELECT g, u, z, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z_{m}),
p_{m} AS (SELECT g, u, z, CASE WHEN z < 0 THEN tail ELSE 1 - tail END AS p FROM (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) / 2 AS tail FROM t_{m})),
b_{m} AS (SELECT g, p, least(1.0, min(raw) OVER (ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM (SELECT g, p, p * count(*) OVER () / (rank() OVER (ORDER BY p) + count(*) OVER (PARTITION BY p) - 1) AS raw FROM p_{m} WHERE p IS NOT NULL))"""
    return out


_VALUES = {"price": "l_extendedprice", "net": "l_extendedprice * (1 - l_discount)", "gross": "l_extendedprice * (1 + l_tax)"}


def _tested(spark, sf_dir, name: str) -> DataFrame:
    value = {"price": F.col("l_extendedprice"), "net": F.col("l_extendedprice") * (1 - F.col("l_discount")), "gross": F.col("l_extendedprice") * (1 + F.col("l_tax"))}[name]
    return tables.read(spark, sf_dir, "lineitem").select(F.floor(F.col("l_extendedprice") / 20000).alias("g"), near(value, 2).alias("v"))


@query(_tests_sql({"price": _VALUES["price"]}) + " SELECT g, round(u, 6) AS u, round(z, 5) AS z, round(p, 6) AS p FROM p_price")
def mann_whitney_others(spark, sf_dir):
    """Each group's values against those that it doesn't have."""
    return evaluation.mann_whitney_others(_tested(spark, sf_dir, "price"), "g", "v").withColumn("z", F.round("z", 5))


@query(_tests_sql(_VALUES) + " " + " INTERSECT ".join(f"SELECT g FROM b_{m} WHERE q <= 0.05" for m in _VALUES))
def significant_groups(spark, sf_dir):
    """Groups that are significantly smaller by all three metrics."""
    lists = [evaluation.significant(_tested(spark, sf_dir, m), "g", "v").where("significant").select("g") for m in _VALUES]
    return evaluation.in_all(lists)


@query("SELECT c_mktsegment AS g, round(z, 5) AS z FROM (WITH x AS (SELECT c_mktsegment, c_acctbal AS v FROM customer), r AS (SELECT c_mktsegment, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x), t AS (SELECT sum(n * n * n - n) AS tie FROM (SELECT count(*) AS n FROM x GROUP BY v)), s AS (SELECT c_mktsegment, CAST(sum(r) AS DOUBLE) AS r, count(*) AS m, (SELECT count(*) FROM x) AS n FROM r GROUP BY 1) SELECT c_mktsegment, (r - m * (m + 1) / 2.0 + 0.5 - m * (n - m) / 2.0) / sqrt(m * (n - m) / 12.0 * (n + 1 - CAST(tie AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1)))) AS z FROM s, t)")
def mann_whitney_unrounded(spark, sf_dir):
    """The test on continuous values."""
    out = evaluation.mann_whitney_less(tables.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.col("c_acctbal").alias("v")), "g", "v")
    return out.select("g", F.round("z", 5).alias("z"))

#: All ways to choose up to 8 of the ranks 1 to n, by how many and their sum; of them each group's rank sum or less.
_RANK_SUMS = """WITH RECURSIVE x AS (SELECT s_nationkey AS g, s_acctbal AS v FROM supplier WHERE s_acctbal IS NOT NULL),
r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r, count(*) OVER () AS n FROM x),
tie AS (SELECT CAST(sum(c * c * c - c) AS DOUBLE) AS tie FROM (SELECT count(*) AS c FROM x GROUP BY v)),
s AS (SELECT g, CAST(sum(r) AS DOUBLE) - m * (m + 1) / 2 AS u, m, n - m AS k, n FROM (SELECT *, count(*) OVER (PARTITION BY g) AS m FROM r) GROUP BY g, m, n),
w(i, j, total, ways) AS (SELECT 0, 0, 0, CAST(1 AS DOUBLE) UNION ALL
    SELECT i + 1, j + d, total + d * (i + 1), sum(ways) FROM w, (SELECT unnest([0, 1]) AS d) WHERE i < (SELECT count(*) FROM x) AND j + d <= 8 GROUP BY ALL),
e AS (SELECT g, sum(CASE WHEN total - m * (m + 1) / 2 <= u THEN ways ELSE 0 END) / sum(ways) AS few FROM s JOIN w ON i = n AND j = m, tie WHERE tie = 0 GROUP BY g),
z AS (SELECT g, u, (u + 0.5 - m * k / 2.0) / nullif(sqrt(m * k / 12.0 * (n + 1 - tie / (n * (n - 1.0)))), 0) AS z FROM s, tie),
y AS (SELECT *, 1 / (1 + 0.3275911 * abs(z) / sqrt(2.0)) AS t FROM z),
q AS (SELECT *, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-z * z / 2) / 2 AS tail FROM y)"""


@query(_RANK_SUMS + " SELECT g, round(u, 6) AS u, round(coalesce(few, CASE WHEN z < 0 THEN tail ELSE 1 - tail END), 6) AS p FROM q LEFT JOIN e USING (g)")
def mann_whitney_small(spark, sf_dir):
    """The test on groups of few values, by the exact law where they are at most 8 and none repeats."""
    rows = tables.read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("g"), F.col("s_acctbal").alias("v"))
    return evaluation.mann_whitney_less(rows, "g", "v").select("g", "u", F.round("p", 6).alias("p"))


@query(
    HOURLY
    + """, m AS (SELECT series_id, idx, y, CASE WHEN count(y) OVER a = 24 AND count(y) OVER b = 24 THEN sum(y) OVER a + sum(y) OVER b END AS held FROM h WINDOW a AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), b AS (PARTITION BY series_id ORDER BY idx ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)),
o AS (SELECT series_id, idx % 24 AS place, sum(y * 48 - held) / (48 * count(held)) AS own FROM m GROUP BY ALL),
l AS (SELECT series_id, list_reduce(list(own ORDER BY place), lambda a, b: a + b) / count(*) AS level FROM o WHERE own IS NOT NULL GROUP BY 1),
s AS (SELECT series_id, place, own - level AS seasonal FROM o JOIN l USING (series_id))
SELECT m.series_id, idx, y, round(held / 48, 6) AS trend, round(seasonal, 6) AS seasonal, round(y - held / 48 - seasonal, 6) AS rest FROM m JOIN s ON s.series_id = m.series_id AND s.place = m.idx % 24"""
)
def seasonal_decomposition(spark, sf_dir):
    return stationarity.decompose(tables.hourly_count(spark, sf_dir))


@query(HOURLY + ", i AS (SELECT *, CAST(round_even(0.8 * n_train, 0) AS BIGINT) AS cut FROM sp WHERE idx < n_train) SELECT series_id, idx, y, idx < cut AS inner_train FROM i")
def inner_holdout(spark, sf_dir):
    """The last fifth of the train rows scores the candidates of a grid."""
    return series.split(_split(spark, sf_dir).where("train").drop("n_train", "train")).select("series_id", "idx", "y", F.col("train").alias("inner_train"))


@query("SELECT event_type AS series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS t, count(*) AS y FROM events GROUP BY 1, 2")
def streamed_hourly_counts(spark, sf_dir):
    """The same counts from a stream that reads the table once, with a watermark; hours are complete at its end."""
    path = shared_folder(spark, "stream")
    schema = tables.read(spark, sf_dir, "events").schema
    counts = hourly.hourly_counts(hourly.event_stream(spark, f"{sf_dir}/events.parquet*", schema))
    name = "tarnflow_hours_" + path.rsplit("-", 1)[1]
    counts.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", path).trigger(availableNow=True).start().awaitTermination()
    return spark.table(name).select("series_id", F.date_format("t", "yyyy-MM-dd HH").alias("t"), "y")
