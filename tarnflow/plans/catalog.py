"""Every query of the library by name, with its twin in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnflow.functions.scalars import kaprekar, near
from tarnflow.operators import baselines, evaluation, metrics, paths, series, spatial, spectral
from tarnflow.session import saved
from tarnflow.sources import tables
from tarnflow.streaming import hourly

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

HOURLY = """WITH ev AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS t FROM events),
cal AS (SELECT s.series_id, c.t FROM (SELECT DISTINCT series_id FROM ev) s, (SELECT unnest(generate_series((SELECT min(t) FROM ev), (SELECT max(t) FROM ev), INTERVAL 1 HOUR)) AS t) c),
h AS (SELECT series_id, t, row_number() OVER (PARTITION BY series_id ORDER BY t) - 1 AS idx, CAST(coalesce(n, 0) AS DOUBLE) AS y FROM cal LEFT JOIN (SELECT series_id, t, count(*) AS n FROM ev GROUP BY ALL) USING (series_id, t)),
sp AS (SELECT *, CAST(round_even(0.8 * count(*) OVER (PARTITION BY series_id), 0) AS BIGINT) AS n_train FROM h)"""
SALES = """WITH s0 AS (SELECT p_type AS category, CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice) AS sales, sum(l_quantity) AS quantity, sum(l_discount) AS discount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY ALL),
b AS (SELECT category, {lo} AS lo, {hi} AS hi FROM s0 GROUP BY category),
cal AS (SELECT category, CAST(unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d FROM b),
s AS (SELECT category, d, coalesce(sales, 0) AS sales, coalesce(quantity, 0) AS quantity, coalesce(discount, 0) AS discount FROM cal LEFT JOIN s0 USING (category, d))"""
SALES_ALL, SALES_OWN = (SALES.format(lo=lo, hi=hi) for lo, hi in (("(SELECT min(d) FROM s0)", "(SELECT max(d) FROM s0)"), ("min(d)", "max(d)")))
STATIONS = """WITH st AS (SELECT CAST(label AS BIGINT) AS t, vec_id AS zsid, CAST(embedding[1] AS DOUBLE) AS e, CAST(embedding[2] AS DOUBLE) AS n, CASE WHEN vec_id % 11 <> 0 THEN abs(CAST(embedding[3] AS DOUBLE)) * 1000 END AS cnt FROM embeddings),
near AS (SELECT a.t, a.zsid, b.cnt AS c, row_number() OVER (PARTITION BY a.t, a.zsid ORDER BY (a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n), b.zsid) AS rn FROM st a JOIN st b ON a.t = b.t WHERE a.cnt IS NULL AND b.cnt IS NOT NULL),
full_ AS (SELECT st.t, st.zsid, st.e, st.n, coalesce(st.cnt, f.m) AS cnt FROM st LEFT JOIN (SELECT t, zsid, {how}(c) AS m FROM near WHERE rn <= 4 GROUP BY ALL) f USING (t, zsid)),
pairs AS (SELECT a.t, a.zsid AS src, b.zsid AS dst, (a.e - b.e) * (a.e - b.e) + (a.n - b.n) * (a.n - b.n) AS d, b.cnt FROM full_ a JOIN full_ b ON a.t = b.t),
cost AS (SELECT t, src, dst, d / max(d) OVER (PARTITION BY t) AS dist, CASE WHEN src = dst THEN 0.0 ELSE 0.5 * d / max(d) OVER (PARTITION BY t) + 0.5 * cnt / max(cnt) OVER (PARTITION BY t) END AS cost FROM pairs),
knn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY t, src ORDER BY dist, dst) AS rn FROM cost) WHERE rn <= 8 AND src <> dst)"""
MEDIAN = STATIONS.format(how="median")


def _rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _rounded_pairs(df: DataFrame) -> DataFrame:
    """For results of all pairs, where round()'s decimal numbers take most of the time."""
    return df.select(*(near(F.col(c), 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def query(sql: str | None = None, rounded: Callable[[DataFrame], DataFrame] = _rounded):
    """Registers a query; doubles are rounded in its result, and in the SQL by its text."""

    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n.split('.')[-1]}" for n in names)


def _split(spark, sf_dir):
    return series.split(tables.hourly_count(spark, sf_dir))


@query(HOURLY + " SELECT series_id, idx, y, n_train, idx < n_train AS train FROM sp")
def series_split(spark, sf_dir):
    return _split(spark, sf_dir).select("series_id", "idx", "y", "n_train", "train")


@query(HOURLY + f", sh AS (SELECT series_id, idx, coalesce(100 * y / nullif(sum(y) OVER (PARTITION BY t), 0), 0) AS y FROM h) SELECT series_id, idx, {_r('y')} FROM sh")
def hourly_share(spark, sf_dir):
    return tables.hourly_share(spark, sf_dir).select("series_id", "idx", "y")


@query(HOURLY + ", x AS (SELECT series_id, idx, y - lag(y) OVER (PARTITION BY series_id ORDER BY idx) AS dy FROM h) SELECT * FROM x WHERE dy IS NOT NULL")
def series_diff(spark, sf_dir):
    return series.difference(tables.hourly_count(spark, sf_dir)).select("series_id", "idx", "dy")


@query(HOURLY + ", x AS (SELECT series_id, idx, y - lag(y, 24) OVER (PARTITION BY series_id ORDER BY idx) AS dy FROM h) SELECT * FROM x WHERE dy IS NOT NULL")
def seasonal_diff(spark, sf_dir):
    return series.difference(tables.hourly_count(spark, sf_dir), 24).select("series_id", "idx", "dy")


_W = "OVER (PARTITION BY series_id ORDER BY idx"


def _full_mean(w: int, y: str = "y") -> str:
    frame = f"{_W} ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)"
    return f"CASE WHEN count({y}) {frame} = {w} THEN avg({y}) {frame} END"


@query(HOURLY + " SELECT series_id, idx, " + ", ".join(f"lag(y, {k}) {_W}) AS lag_{k}" for k in series.LAGS) + ", " + ", ".join(f"round({_full_mean(w)}, 6) AS mean_{w}" for w in (24, 168)) + " FROM h")
def lag_features(spark, sf_dir):
    return series.lag_features(tables.hourly_count(spark, sf_dir)).drop("t", "y")


@query(HOURLY + ", c AS (SELECT series_id, idx, CAST(hour(t) AS BIGINT) AS hour, CAST(isodow(t) - 1 AS BIGINT) AS weekday FROM h) SELECT *, CAST(weekday >= 5 AS BIGINT) AS weekend, " + ", ".join(f"round({f}(2 * pi() * {x} / {n}), 6) AS {p}_{f}" for x, n, p in (("hour", 24, "hour"), ("weekday", 7, "day")) for f in ("sin", "cos")) + " FROM c")
def calendar_features(spark, sf_dir):
    return series.calendar_features(tables.hourly_count(spark, sf_dir)).drop("t", "y")


@query(HOURLY + f" SELECT series_id, idx, round(avg(y) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 6) AS mean_before FROM h")
def expanding_mean(spark, sf_dir):
    return series.expanding_mean(tables.hourly_count(spark, sf_dir)).select("series_id", "idx", "mean_before")


_THIN = ", th AS (SELECT series_id, idx, CASE WHEN idx > 0 AND idx < n - 1 AND rn <= round_even({p} / 100.0 * (n - 2), 0) THEN NULL ELSE y END AS y, y AS true_y FROM (SELECT *, row_number() OVER (PARTITION BY series_id, idx > 0 AND idx < n - 1 ORDER BY md5('42|' || series_id || '|{p}|' || idx)) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM h))), nb AS (SELECT *, max(CASE WHEN y IS NOT NULL THEN idx END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ia, min(CASE WHEN y IS NOT NULL THEN idx END) OVER (PARTITION BY series_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ib FROM th), ip AS (SELECT nb.series_id, nb.idx, nb.true_y, coalesce(nb.y, a.y + (b.y - a.y) * (nb.idx - ia) / (ib - ia)) AS y FROM nb JOIN th a ON a.series_id = nb.series_id AND a.idx = ia JOIN th b ON b.series_id = nb.series_id AND b.idx = ib)"


@query(HOURLY + _THIN.format(p=40) + f" SELECT series_id, idx, {_r('y')} FROM ip")
def interpolate_linear(spark, sf_dir):
    return series.interpolate_linear(series.sparsify(tables.hourly_count(spark, sf_dir), 40)).select("series_id", "idx", "y")


@query(HOURLY + f", x AS (SELECT series_id, idx, lag(y + 0.5) {_W}) AS v FROM h) SELECT series_id, idx, CASE WHEN v IS NOT NULL THEN greatest(v, 0) END AS y_hat FROM x")
def undifference(spark, sf_dir):
    return series.undifference(tables.hourly_count(spark, sf_dir).withColumn("d_hat", F.lit(0.5))).select("series_id", "idx", "y_hat")


@query(SALES_ALL + " SELECT category, strftime(d, '%Y-%m-%d') AS d, round(sales, 2) AS sales, round(quantity, 2) AS quantity FROM s")
def calendar_fill_global(spark, sf_dir):
    return tables.daily_sales(spark, sf_dir).select("category", F.date_format("d", "yyyy-MM-dd").alias("d"), F.round("sales", 2).alias("sales"), F.round("quantity", 2).alias("quantity"))


@query(SALES_OWN + " SELECT category, strftime(d, '%Y-%m-%d') AS d, round(sales, 2) AS sales, round(quantity, 2) AS quantity FROM s")
def calendar_fill_group(spark, sf_dir):
    return tables.daily_sales(spark, sf_dir, per_group=True).select("category", F.date_format("d", "yyyy-MM-dd").alias("d"), F.round("sales", 2).alias("sales"), F.round("quantity", 2).alias("quantity"))


@query("SELECT p_type AS category, strftime(l_shipdate, '%Y-%m-%d') AS d, round(sum(l_extendedprice), 2) AS sales, round(sum(l_quantity), 2) AS quantity, round(sum(l_discount), 4) AS discount FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1, 2")
def daily_category_sum(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    rows = tables.read(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy("category", F.date_format("l_shipdate", "yyyy-MM-dd").alias("d"))
    return rows.agg(F.round(F.sum("l_extendedprice"), 2).alias("sales"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_discount"), 4).alias("discount"))


@query("SELECT p_type AS category, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1")
def category_counts(spark, sf_dir):
    part = tables.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_type").alias("category"))
    return tables.read(spark, sf_dir, "lineitem").join(part, "l_partkey").groupBy("category").agg(F.count("*").alias("n"))


@query(SALES_ALL + " SELECT a.category AS a, b.category AS b, round(corr(a.sales, b.sales), 6) AS r FROM s a JOIN s b USING (d) GROUP BY ALL")
def category_corr(spark, sf_dir):
    s = tables.daily_sales(spark, sf_dir)
    return s.select("d", F.col("category").alias("a"), F.col("sales").alias("x")).join(s.select("d", F.col("category").alias("b"), F.col("sales").alias("y")), "d").groupBy("a", "b").agg(F.corr("x", "y").alias("r"))


@query(HOURLY + " SELECT series_id, min(y) AS lo, max(y) AS hi, round(avg(y), 6) AS mean, count(*) AS n FROM h GROUP BY 1")
def series_profile(spark, sf_dir):
    return tables.hourly_count(spark, sf_dir).groupBy("series_id").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.avg("y").alias("mean"), F.count("*").alias("n"))


@query("WITH RECURSIVE k(n, v, i) AS (SELECT DISTINCT o_orderkey % 10000, o_orderkey % 10000, 0 FROM orders UNION ALL SELECT n, CAST(array_to_string(list_sort(string_split(lpad(CAST(v AS VARCHAR), 4, '0'), ''), 'DESC'), '') AS BIGINT) - CAST(array_to_string(list_sort(string_split(lpad(CAST(v AS VARCHAR), 4, '0'), '')), '') AS BIGINT), i + 1 FROM k WHERE i < 7) SELECT n, max(CASE WHEN i = 7 THEN v END) AS ends, CAST(count(*) FILTER (i < 7 AND v <> 6174 AND v <> 0) AS BIGINT) AS steps FROM k GROUP BY n")
def kaprekar_routine(spark, sf_dir):
    ends, steps = kaprekar(F.col("n"))
    return tables.read(spark, sf_dir, "orders").select((F.col("o_orderkey") % 10000).alias("n")).distinct().select("n", ends.alias("ends"), steps.alias("steps"))


# forecasts

_TEST = " FROM sp JOIN f USING (series_id) WHERE idx >= n_train"
_BAND = ", round(y_hat, 6) AS y_hat, round(y_hat - 1.96 * sd, 6) AS lower, round(y_hat + 1.96 * sd, 6) AS upper"
MEAN_F = ", f AS (SELECT series_id, avg(y) AS y_hat, stddev_samp(y) AS sd FROM sp WHERE idx < n_train GROUP BY 1)"
NAIVE_F = f", f AS (SELECT series_id, arg_max(y, idx) AS y_hat, stddev_samp(dy) AS sd FROM (SELECT *, y - lag(y) {_W}) AS dy FROM sp WHERE idx < n_train) GROUP BY 1)"
SEASON_S = f", ss AS (SELECT series_id, CAST(s AS BIGINT) AS s, avg(abs(y - b)) AS mae FROM (SELECT series_id, y, unnest([24, 168]) AS s, unnest([lag(y, 24) {_W}), lag(y, 168) {_W})]) AS b FROM sp WHERE idx < n_train) WHERE b IS NOT NULL GROUP BY ALL)"
WINDOW_S = ", ws AS (SELECT series_id, CAST(w AS BIGINT) AS w, avg(abs(y - b)) AS mae FROM (SELECT series_id, y, unnest([3, 6, 12, 24, 48, 168]) AS w, unnest([" + ", ".join(_full_mean(w) for w in baselines.WINDOWS) + "]) AS b FROM sp WHERE idx < n_train) WHERE b IS NOT NULL GROUP BY ALL)"
SEASON_F = SEASON_S + f", b AS (SELECT series_id, arg_min(s, mae * 1000000 + s * 1e-6) AS s FROM ss GROUP BY 1), x AS (SELECT sp.*, s, CASE s WHEN 24 THEN y - lag(y, 24) {_W}) ELSE y - lag(y, 168) {_W}) END AS res FROM sp JOIN b USING (series_id)), sdt AS (SELECT series_id, stddev_pop(res) AS sd FROM x WHERE idx < n_train GROUP BY 1), fc AS (SELECT a.series_id, a.idx, a.y, p.y AS y_hat, sd FROM x a JOIN x p ON a.series_id = p.series_id AND p.idx = a.n_train - a.s + (a.idx - a.n_train) % a.s JOIN sdt ON sdt.series_id = a.series_id WHERE a.idx >= a.n_train)"


@query(HOURLY + MEAN_F + " SELECT series_id, idx, y" + _BAND + _TEST)
def forecast_mean(spark, sf_dir):
    return baselines.mean(_split(spark, sf_dir))


@query(HOURLY + NAIVE_F + " SELECT series_id, idx, y" + _BAND + _TEST)
def forecast_naive(spark, sf_dir):
    return baselines.naive(_split(spark, sf_dir))


@query(HOURLY + SEASON_F + " SELECT series_id, idx, y" + _BAND + " FROM fc")
def forecast_seasonal_naive(spark, sf_dir):
    return baselines.seasonal_naive(_split(spark, sf_dir))


_PICK = "CASE b.w " + " ".join(f"WHEN {w} THEN {_full_mean(w)}" for w in baselines.WINDOWS) + " END"


@query(HOURLY + WINDOW_S + f", b AS (SELECT series_id, arg_min(w, mae * 1000000 + w * 1e-6) AS w FROM ws GROUP BY 1), x AS (SELECT sp.*, b.w, y - {_PICK} AS res FROM sp JOIN b USING (series_id) WHERE idx < n_train), f AS (SELECT series_id, avg(CASE WHEN idx >= n_train - w THEN y END) AS y_hat, stddev_samp(res) AS sd FROM x GROUP BY 1) SELECT series_id, idx, y" + _BAND + _TEST)
def forecast_moving_average(spark, sf_dir):
    return baselines.moving_average(_split(spark, sf_dir))


@query(HOURLY + WINDOW_S + f" SELECT series_id, w, {_r('mae')} FROM ws")
def ma_window_search(spark, sf_dir):
    return baselines.window_search(_split(spark, sf_dir))


@query(HOURLY + SEASON_S + f" SELECT series_id, s, {_r('mae')} FROM ss")
def season_search(spark, sf_dir):
    return baselines.season_search(_split(spark, sf_dir))


# metrics

_SN = HOURLY + SEASON_F


@query(_SN + f", e AS (SELECT *, y - y_hat AS e, y - lag(y, 24) {_W}) AS s, y - lag(y) {_W}) AS dy, y_hat - lag(y_hat) {_W}) AS df FROM fc) SELECT series_id, round(avg(abs(e)), 6) AS mae, round(median(abs(e)), 6) AS medae, round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(100 * avg(abs(e / nullif(y, 0))), 6) AS mape, round(100 * avg(2 * abs(e) / nullif(abs(y) + abs(y_hat), 0)), 6) AS smape, round(avg(abs(e)) / nullif(avg(abs(s)), 0), 6) AS mase, round(sqrt(avg(e * e) / nullif(avg(s * s), 0)), 6) AS rmsse, round(1 - sum(e * e) / nullif(var_pop(y) * count(y), 0), 6) AS r2, round(100 * avg(CAST(sign(dy) = sign(df) AS DOUBLE)), 6) AS direction, round(avg(greatest(0.5 * e, -0.5 * e)), 6) AS pinball FROM e GROUP BY 1")
def metrics_all(spark, sf_dir):
    return metrics.all_metrics(baselines.seasonal_naive(_split(spark, sf_dir)), ["series_id"])


@query(_SN + " SELECT series_id, round(avg(abs(y - y_hat)), 6) AS mae, round(sqrt(avg((y - y_hat) * (y - y_hat))), 6) AS rmse, round(100 * avg(abs((y - y_hat) / nullif(y, 0))), 6) AS mape FROM fc GROUP BY 1")
def pipeline_metrics(spark, sf_dir):
    return metrics.pipeline_metrics(baselines.seasonal_naive(_split(spark, sf_dir)), ["series_id"])


@query(_SN + f", e AS (SELECT *, abs(y - lag(y) {_W})) AS nv FROM fc) SELECT series_id, round(avg(abs(y - y_hat)), 6) AS mae, round(avg((y - y_hat) * (y - y_hat)), 6) AS mse, round(avg(abs((y - y_hat) / nullif(y, 0))), 6) AS mape, round(avg(nv) / nullif(avg(abs(y - y_hat)), 0), 6) AS mase_inverse FROM e GROUP BY 1")
def sales_metrics(spark, sf_dir):
    return metrics.sales_metrics(baselines.seasonal_naive(_split(spark, sf_dir)), ["series_id"])


@query(_SN + " SELECT series_id, CAST(hour(h.t) AS BIGINT) AS hour, round(avg(abs(fc.y - y_hat)), 6) AS mae FROM fc JOIN h USING (series_id, idx) GROUP BY ALL")
def error_by_hour(spark, sf_dir):
    df = _split(spark, sf_dir)
    return baselines.seasonal_naive(df).join(df.select("series_id", "idx", F.hour("t").cast("long").alias("hour")), ["series_id", "idx"]).groupBy("series_id", "hour").agg(F.avg(F.abs(F.col("y") - F.col("y_hat"))).alias("mae"))


@query(_SN + ", e AS (SELECT series_id, y_hat - y AS r, min(y_hat - y) OVER (PARTITION BY series_id) AS lo, max(y_hat - y) OVER (PARTITION BY series_id) AS hi FROM fc) SELECT series_id, CAST(least(24, floor(25 * (r - lo) / nullif(hi - lo, 0))) AS BIGINT) AS bin, count(*) AS n FROM e GROUP BY ALL")
def residual_histogram(spark, sf_dir):
    fc = baselines.seasonal_naive(_split(spark, sf_dir)).withColumn("r", F.col("y_hat") - F.col("y"))
    ends = fc.groupBy("series_id").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    place = F.least(F.lit(24), F.floor(F.try_divide(25 * (F.col("r") - F.col("lo")), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))))).cast("long")
    return fc.join(ends, "series_id").groupBy("series_id", place.alias("bin")).agg(F.count("*").alias("n"))


# evaluation

_ORIG = ", og AS (SELECT DISTINCT series_id, CAST(CASE WHEN lo < n - 24 THEN round_even(lo + (n - 24 - lo) * i / {d}.0, 0) ELSE n - 24 END AS BIGINT) AS cutoff FROM (SELECT series_id, count(*) AS n, round_even(0.65 * count(*), 0) AS lo FROM h GROUP BY 1), (SELECT unnest(range({c})) AS i))"
_WALK = ", {n}r AS (SELECT s.*, cutoff FROM {src} s JOIN og USING (series_id)), {n}p AS (SELECT series_id, cutoff, avg(y) AS mean, arg_max(y, idx) AS naive FROM {n}r WHERE idx < cutoff GROUP BY ALL), {n}d AS (SELECT series_id, cutoff, idx - cutoff + 24 AS hh, y AS seasonal_naive FROM {n}r WHERE idx >= cutoff - 24 AND idx < cutoff), {n}t AS (SELECT series_id, cutoff, {y} AS y, (idx - cutoff) % 24 AS hh FROM {n}r WHERE idx >= cutoff AND idx < cutoff + 24), {n}l AS (SELECT series_id, cutoff, y, unnest(['mean', 'naive', 'seasonal_naive']) AS model, unnest([mean, naive, seasonal_naive]) AS f FROM {n}t JOIN {n}p USING (series_id, cutoff) JOIN {n}d USING (series_id, cutoff, hh)), {n} AS (SELECT series_id, cutoff, model, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse, 100 * avg(coalesce(2 * abs(y - f) / nullif(abs(y) + abs(f), 0), 0)) AS smape FROM {n}l GROUP BY ALL)"
WALK = HOURLY + _ORIG.format(c=6, d=5) + _WALK.format(n="w", src="h", y="y")
_SKILL = "coalesce(100 * (1 - rmse / CASE WHEN {b} > 0 THEN {b} END), 0)"
_BASE = "coalesce(max(CASE WHEN model = 'mean' THEN rmse END) OVER (PARTITION BY {g}), max(rmse) OVER (PARTITION BY {g}))"
SUMMARY = WALK + ", u AS (SELECT series_id, model, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape, coalesce(stddev_samp(rmse), 0) AS rmse_sd FROM w GROUP BY ALL), v AS (SELECT *, " + _SKILL.format(b=_BASE.format(g="series_id")) + " AS skill FROM u)"
BOARD = SUMMARY + ", lb AS (SELECT * FROM (SELECT series_id, arg_max(model, skill) AS best_model, max(skill) AS best_skill, min(rmse) AS best_rmse FROM v WHERE model <> 'mean' GROUP BY 1) JOIN (SELECT series_id, rmse AS mean_rmse FROM v WHERE model = 'mean') USING (series_id))"
_LB = f" SELECT series_id, best_model, {_r('best_skill', 'best_rmse', 'mean_rmse')}, best_skill > 1 AS real_skill FROM lb"


def _walk(spark, sf_dir):
    df = tables.hourly_count(spark, sf_dir)
    return evaluation.walk_forward(df, evaluation.rolling_origins(df))


def _summary(spark, sf_dir):
    return evaluation.summary(_walk(spark, sf_dir), ["series_id"])


@query(HOURLY + _ORIG.format(c=6, d=5) + " SELECT series_id, cutoff FROM og")
def rolling_origins(spark, sf_dir):
    return evaluation.rolling_origins(tables.hourly_count(spark, sf_dir)).select("series_id", "cutoff")


@query(WALK + f" SELECT series_id, cutoff, model, {_r('mae', 'rmse', 'smape')} FROM w")
def walk_forward_baselines(spark, sf_dir):
    return _walk(spark, sf_dir)


@query(SUMMARY + f" SELECT series_id, model, {_r('mae', 'rmse', 'smape', 'rmse_sd', 'skill')} FROM v")
def wf_summary(spark, sf_dir):
    return _summary(spark, sf_dir)


@query(BOARD + _LB)
def pair_leaderboard(spark, sf_dir):
    return evaluation.leaderboard(_summary(spark, sf_dir))


@query(BOARD + _LB + " ORDER BY lb.best_skill DESC, series_id LIMIT 3")
def leaderboard_top(spark, sf_dir):
    return evaluation.leaderboard(_summary(spark, sf_dir)).orderBy(F.desc("best_skill"), "series_id").limit(3)


@query(BOARD + _LB + " ORDER BY lb.best_skill, series_id LIMIT 2")
def leaderboard_bottom(spark, sf_dir):
    return evaluation.leaderboard(_summary(spark, sf_dir)).orderBy("best_skill", "series_id").limit(2)


@query(HOURLY + f", x AS (SELECT series_id, idx, y, avg(y) {_W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m, lag(y) {_W}) AS p, lag(y, 24) {_W}) AS s FROM h), l AS (SELECT series_id, y, unnest(['mean', 'persistence', 'seasonal24']) AS model, unnest([m, p, s]) AS f FROM x WHERE idx >= 24), u AS (SELECT series_id, model, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse, 100 * avg(coalesce(2 * abs(y - f) / nullif(abs(y) + abs(f), 0), 0)) AS smape FROM l GROUP BY ALL), v AS (SELECT *, " + _SKILL.format(b=_BASE.format(g="series_id")) + f" AS skill FROM u) SELECT series_id, model, {_r('mae', 'rmse', 'smape', 'skill')} FROM v")
def one_step_skill(spark, sf_dir):
    return evaluation.one_step_skill(tables.hourly_count(spark, sf_dir))


_SWEEP = HOURLY + _ORIG.format(c=4, d=3) + "".join(_THIN.format(p=p).replace("th AS", f"th{p} AS").replace("nb AS", f"nb{p} AS").replace("ip AS", f"ip{p} AS").replace("FROM th)", f"FROM th{p})").replace("FROM nb JOIN th a", f"FROM nb{p} nb JOIN th{p} a").replace("JOIN th b", f"JOIN th{p} b") + _WALK.format(n=f"w{p}", src=f"ip{p}", y="true_y") for p in (0, 20, 40, 60)) + ", sw AS (" + " UNION ALL ".join(f"SELECT *, CAST({p} AS BIGINT) AS drop_rate FROM w{p}" for p in (0, 20, 40, 60)) + ")"


@query(_SWEEP + f" SELECT series_id, cutoff, model, drop_rate, {_r('mae', 'rmse', 'smape')} FROM sw")
def sparsity_sweep(spark, sf_dir):
    return evaluation.sparsity_sweep(tables.hourly_count(spark, sf_dir))


@query(_SWEEP + ", u AS (SELECT model, drop_rate, avg(mae) AS mae, avg(rmse) AS rmse, avg(smape) AS smape, coalesce(stddev_samp(rmse), 0) AS rmse_sd FROM sw GROUP BY ALL), v AS (SELECT *, " + _SKILL.format(b=_BASE.format(g="drop_rate")) + f" AS skill FROM u) SELECT model, drop_rate, {_r('mae', 'rmse', 'smape', 'rmse_sd', 'skill')} FROM v")
def sparsity_skill(spark, sf_dir):
    return evaluation.summary(evaluation.sparsity_sweep(tables.hourly_count(spark, sf_dir)), ["drop_rate"])


@query(_SWEEP + " SELECT model, " + ", ".join(f"round(avg(CASE WHEN drop_rate = {p} THEN rmse END), 6) AS drop_{p}" for p in (0, 20, 40, 60)) + " FROM sw GROUP BY 1")
def sparsity_pivot(spark, sf_dir):
    wide = evaluation.sparsity_sweep(tables.hourly_count(spark, sf_dir)).groupBy("model").pivot("drop_rate", [0, 20, 40, 60]).agg(F.avg("rmse"))
    return wide.select("model", *(F.col(str(p)).alias(f"drop_{p}") for p in (0, 20, 40, 60)))


@query(SUMMARY + " SELECT model, round(avg(rmse), 6) AS mean_rmse, round(median(rmse), 6) AS median_rmse, round(quantile_cont(rmse, 0.995), 6) AS p995 FROM v GROUP BY 1")
def model_center(spark, sf_dir):
    return _summary(spark, sf_dir).groupBy("model").agg(F.avg("rmse").alias("mean_rmse"), F.median("rmse").alias("median_rmse"), F.percentile("rmse", 0.995).alias("p995"))


@query(SUMMARY + ", l AS (SELECT series_id, model, unnest(['mae', 'rmse', 'smape']) AS metric, unnest([mae, rmse, smape]) AS value FROM v) SELECT series_id, model, metric, round(value, 6) AS value, round(value / max(value) OVER (PARTITION BY series_id, metric), 6) AS relative FROM l")
def metrics_normalized(spark, sf_dir):
    long = _summary(spark, sf_dir).unpivot(["series_id", "model"], ["mae", "rmse", "smape"], "metric", "value")
    top = long.groupBy("series_id", "metric").agg(F.max("value").alias("top"))
    return long.join(top, ["series_id", "metric"]).select("series_id", "model", "metric", "value", F.try_divide("value", "top").alias("relative"))


@query("WITH p AS (SELECT c_custkey, 1.0 / (1 + c_custkey % 97) / (1 + c_custkey % 13) AS p, c_nationkey FROM customer), r AS (SELECT *, p * count(*) OVER (PARTITION BY c_nationkey) / (rank() OVER (PARTITION BY c_nationkey ORDER BY p) + count(*) OVER (PARTITION BY c_nationkey, p) - 1) AS raw FROM p), a AS (SELECT c_custkey, least(1.0, min(raw) OVER (PARTITION BY c_nationkey ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS q FROM r) SELECT c_custkey, round(CAST(q AS DOUBLE), 6) AS p_adjusted, q <= 0.05 AS significant FROM a".replace("1.0 /", "CAST(1 AS DOUBLE) /"))
def bh_fdr(spark, sf_dir):
    p = tables.read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", (F.lit(1.0) / (1 + F.col("c_custkey") % 97) / (1 + F.col("c_custkey") % 13)).alias("p"))
    return evaluation.benjamini_hochberg(p, ["c_nationkey"]).select("c_custkey", "p_adjusted", "significant")


@query("WITH x AS (SELECT c_mktsegment AS g, round(c_acctbal, 0) AS v FROM customer), r AS (SELECT g, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0 AS r FROM x), t AS (SELECT sum(n * n * n - n) AS tie FROM (SELECT count(*) AS n FROM x GROUP BY v)), s AS (SELECT g, CAST(sum(r) AS DOUBLE) AS r, count(*) AS m, (SELECT count(*) FROM x) AS n FROM r GROUP BY g) SELECT g, round(r - m * (m + 1) / 2.0, 6) AS u, round((r - m * (m + 1) / 2.0 + 0.5 - m * (n - m) / 2.0) / sqrt(m * (n - m) / 12.0 * (n + 1 - CAST(tie AS DOUBLE) / (CAST(n AS DOUBLE) * (n - 1)))), 6) AS z FROM s, t")
def mann_whitney(spark, sf_dir):
    return evaluation.mann_whitney_less(tables.read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("g"), F.round("c_acctbal", 0).alias("v")), "g", "v").select("g", "u", "z")


_LONG = SUMMARY + ", l AS (SELECT series_id, model, unnest(['mae', 'rmse', 'smape']) AS metric, unnest([mae, rmse, smape]) AS value FROM v)"


def _scores(spark, sf_dir):
    return _summary(spark, sf_dir).unpivot(["series_id", "model"], ["mae", "rmse", "smape"], "metric", "value")


@query(_LONG + f" SELECT series_id, model, metric, {_r('value')} FROM l")
def score_melt(spark, sf_dir):
    return _scores(spark, sf_dir)


@query(SUMMARY + " SELECT series_id, " + ", ".join(f"round(avg(CASE WHEN model = '{m}' THEN rmse END), 6) AS {m}" for m in ("mean", "naive", "seasonal_naive")) + " FROM v GROUP BY 1")
def score_matrix(spark, sf_dir):
    return _summary(spark, sf_dir).groupBy("series_id").pivot("model", ["mean", "naive", "seasonal_naive"]).agg(F.avg("rmse"))


@query(_LONG + " SELECT metric, round(quantile_cont(value, 0.995), 6) AS p995 FROM l GROUP BY 1")
def score_p995(spark, sf_dir):
    return _scores(spark, sf_dir).groupBy("metric").agg(F.percentile("value", 0.995).alias("p995"))


@query(_SWEEP + " SELECT model, drop_rate, round(avg(mae), 6) AS mae, round(avg(rmse), 6) AS rmse, round(avg(smape), 6) AS smape FROM sw GROUP BY ALL")
def sparsity_summary(spark, sf_dir):
    return evaluation.sparsity_sweep(tables.hourly_count(spark, sf_dir)).groupBy("model", "drop_rate").agg(*(F.avg(c).alias(c) for c in ("mae", "rmse", "smape")))


@query(ORACLE_SQL["one_step_skill"].rsplit(" SELECT", 1)[0] + " SELECT model, round(median(skill), 6) AS median_skill, round(100 * avg(CAST(skill > 1 AS INT)), 6) AS share_real, max(skill) > 1 AS real_skill FROM v GROUP BY 1")
def skill_verdict(spark, sf_dir):
    """Median skill of each model over all series, and the share of series where it is real (above 1 %)."""
    skill = evaluation.one_step_skill(tables.hourly_count(spark, sf_dir))
    real = F.col("skill") > 1
    return skill.groupBy("model").agg(F.median("skill").alias("median_skill"), (100 * F.avg(real.cast("int"))).alias("share_real"), F.bool_or(real).alias("real_skill"))


@query(HOURLY + MEAN_F + f" SELECT series_id, idx, y, {_r('y_hat')}" + _TEST)
def align_inner(spark, sf_dir):
    """Truth and forecast where both have a row."""
    df = _split(spark, sf_dir)
    return df.select("series_id", "idx", "y").join(baselines.mean(df).select("series_id", "idx", "y_hat"), ["series_id", "idx"])


@query(HOURLY + f", a AS (SELECT series_id, idx, y - lag(y) {_W}) AS day FROM h), b AS (SELECT series_id, idx + 12 AS idx, y AS shifted FROM h) SELECT series_id, idx, day, shifted FROM (SELECT * FROM a WHERE day IS NOT NULL) FULL JOIN b USING (series_id, idx)")
def wide_outer(spark, sf_dir):
    """Two series side by side over all places that either has."""
    h = tables.hourly_count(spark, sf_dir)
    shifted = h.select("series_id", (F.col("idx") + 12).alias("idx"), F.col("y").alias("shifted"))
    return series.difference(h).select("series_id", "idx", F.col("dy").alias("day")).join(shifted, ["series_id", "idx"], "full")


# stations


def _full(spark, sf_dir):
    return spatial.knn_impute(tables.stations(spark, sf_dir))


@query(MEDIAN + f" SELECT t, zsid, {_r('cnt')} FROM full_")
def knn_impute_median(spark, sf_dir):
    return _full(spark, sf_dir).select("t", "zsid", "cnt")


@query(STATIONS.format(how="avg") + f" SELECT t, zsid, {_r('cnt')} FROM full_")
def knn_impute_mean(spark, sf_dir):
    return spatial.knn_impute(tables.stations(spark, sf_dir), how="mean").select("t", "zsid", "cnt")


@query(MEDIAN + " SELECT t, count(*) AS n, round(avg(cnt), 6) AS cnt FROM full_ GROUP BY t")
def station_agg(spark, sf_dir):
    return spatial.station_agg(_full(spark, sf_dir)).groupBy("t").agg(F.count("*").alias("n"), F.avg("cnt").alias("cnt"))


@query(MEDIAN + f" SELECT t, src, dst, {_r('dist', 'cost')} FROM cost", _rounded_pairs)
def cost_edges(spark, sf_dir):
    return spatial.cost_edges(_full(spark, sf_dir))


@query(MEDIAN + f" SELECT t, src, dst, {_r('dist', 'cost')} FROM knn")
def knn_edges(spark, sf_dir):
    return spatial.knn_edges(_full(spark, sf_dir)).select("t", "src", "dst", "dist", "cost")


@query(MEDIAN + f" SELECT t, src, dst, {_r('dist')} FROM cost", _rounded_pairs)
def pair_distance_norm(spark, sf_dir):
    return spatial.cost_edges(_full(spark, sf_dir)).select("t", "src", "dst", "dist")


@query(MEDIAN + " SELECT t, zsid, round(cnt, 6) AS cnt, CAST(0 AS DOUBLE) AS low, round(max(cnt) OVER (PARTITION BY t), 6) AS high FROM full_")
def frame_scale(spark, sf_dir):
    """Stations with the colour scale of their snapshot: from 0 to its largest count."""
    full = _full(spark, sf_dir)
    return full.join(full.groupBy("t").agg(F.max("cnt").alias("high")), "t").select("t", "zsid", "cnt", F.lit(0.0).alias("low"), "high")


_GRID = ", bx AS (SELECT t, min(e) AS e0, max(e) AS e1, min(n) AS n0, max(n) AS n1 FROM full_ GROUP BY t), gr AS (SELECT t, p, e0 + (p % {s}) * (e1 - e0) / ({s} - 1) AS e, n0 + (p // {s}) * (n1 - n0) / ({s} - 1) AS n FROM bx, (SELECT unnest(range({s} * {s})) AS p))"


@query(MEDIAN + _GRID.format(s=200) + f" SELECT t, p, {_r('e', 'n')} FROM gr")
def grid_cells(spark, sf_dir):
    return spatial.grid(_full(spark, sf_dir))


@query(MEDIAN + _GRID.format(s=30) + " SELECT t, p, zsid FROM (SELECT g.t, g.p, f.zsid, row_number() OVER (PARTITION BY g.t, g.p ORDER BY (g.e - f.e) * (g.e - f.e) + (g.n - f.n) * (g.n - f.n), f.zsid) AS rn FROM gr g JOIN full_ f ON g.t = f.t) WHERE rn = 1")
def nearest_station(spark, sf_dir):
    full = _full(spark, sf_dir)
    return spatial.nearest_station(spatial.grid(full, 30), full)


@query(MEDIAN + _GRID.format(s=200) + " SELECT g.t, g.p, arg_min(f.zsid, {'d': (g.e - f.e) * (g.e - f.e) + (g.n - f.n) * (g.n - f.n), 'z': f.zsid}) AS zsid FROM gr g JOIN full_ f ON g.t = f.t GROUP BY g.t, g.p")
def nearest_station_raster(spark, sf_dir):
    """nearest_station over the whole raster of 200 x 200 cells."""
    full = _full(spark, sf_dir)
    return spatial.nearest_station(spatial.grid(full), full)


def _kde_sql(points: str, name: str) -> str:
    """CTEs: covariance terms of both kernels, and `name` (t, p, weight, log_weight) at `points` (t, p, e, n)."""
    terms = ""
    for k, w in (("1", "cnt"), ("2", "1.0")):
        terms += f""", wt{k} AS (SELECT t, e, n, CAST({w} AS DOUBLE) / sum(CAST({w} AS DOUBLE)) OVER (PARTITION BY t) AS w, sum(CAST({w} AS DOUBLE)) OVER (PARTITION BY t) AS total FROM full_),
mn{k} AS (SELECT t, sum(w * e) AS me, sum(w * n) AS mn, 1 - sum(w * w) AS free FROM wt{k} GROUP BY t),
cv{k} AS (SELECT t, 0.3 * 0.3 * sum(w * (e - me) * (e - me)) / max(free) AS a, 0.3 * 0.3 * sum(w * (e - me) * (n - mn)) / max(free) AS b, 0.3 * 0.3 * sum(w * (n - mn) * (n - mn)) / max(free) AS d, max(total) AS total FROM wt{k} JOIN mn{k} USING (t) GROUP BY t),
tm{k} AS (SELECT t, d / (a * d - b * b) AS a{k}, -b / (a * d - b * b) AS b{k}, a / (a * d - b * b) AS d{k}, 1 / sqrt(a * d - b * b) AS norm{k}, total AS total{k} FROM cv{k})"""
    q = lambda k: f"(x * x * a{k} + 2 * x * y * b{k} + y * y * d{k}) / 2"
    return terms + f""", kp AS (SELECT t, p, cnt, {q("1")} AS q1, {q("2")} AS q2, norm1, norm2, total1, total2 FROM (SELECT g.t, g.p, f.cnt, g.e - f.e AS x, g.n - f.n AS y FROM {points} g JOIN full_ f ON g.t = f.t) JOIN tm1 USING (t) JOIN tm2 USING (t)),
km AS (SELECT *, min(q1) OVER c AS m1, min(q2) OVER c AS m2 FROM kp WINDOW c AS (PARTITION BY t, p)),
ks AS (SELECT t, p, max(m2) - max(m1) AS off, sum(cnt * exp(m1 - q1)) * max(norm1) AS s1, sum(exp(m2 - q2)) / max(total2) * max(norm2) AS s2 FROM km GROUP BY t, p),
{name} AS (SELECT t, p, s1 / s2 * exp(least(off, 300.0)) AS weight, ln(s1) - ln(s2) + off AS log_weight FROM ks)"""


@query()
def kde_surface(spark, sf_dir):
    full = _full(spark, sf_dir)
    return spatial.kde_surface(spatial.grid(full, 200), full).select("t", "p", "weight")


@query(MEDIAN + _GRID.format(s=200) + _kde_sql("gr", "kd") + " SELECT t, p, round(log_weight, 3) AS log_weight FROM kd")
def kde_log_surface(spark, sf_dir):
    """Logarithm of the surface, whose values span hundreds of powers of ten."""
    full = _full(spark, sf_dir)
    return spatial.kde_surface(spatial.grid(full, 200), full).select("t", "p", F.round("log_weight", 3).alias("log_weight"))


_CELL = ", cl AS (SELECT full_.t, zsid, CAST(coalesce(floor((n - n0) * 199 / nullif(n1 - n0, 0) + 0.5), 0) * 200 + coalesce(floor((e - e0) * 199 / nullif(e1 - e0, 0) + 0.5), 0) AS BIGINT) AS p FROM full_ JOIN bx USING (t)), atc AS (SELECT gr.* FROM gr JOIN (SELECT DISTINCT t, p FROM cl) USING (t, p))"
DENSITY = MEDIAN + _GRID.format(s=200) + _CELL + _kde_sql("atc", "kd") + ", dn AS (SELECT t, zsid, weight * (SELECT sum(cnt) FROM full_ f WHERE f.t = cl.t) / sum(weight) OVER (PARTITION BY t) AS density FROM cl JOIN kd USING (t, p))"


@query(DENSITY + " SELECT t, zsid, round(density, 3) AS density FROM dn")
def density_per_node(spark, sf_dir):
    return spatial.density_per_node(_full(spark, sf_dir)).withColumn("density", F.round("density", 3))


def _hubs(full):
    return full.groupBy("t").agg(F.array_distinct(F.array(F.min("zsid"), F.max("zsid"))).alias("z")).select("t", F.explode("z").alias("zsid"))


def _assigned(spark, sf_dir):
    full = saved(_full(spark, sf_dir), "stations")
    return full, paths.hub_costs(spatial.knn_edges(full), _hubs(full), paths.regions(full))


@query(MEDIAN.replace("WITH st", "WITH RECURSIVE st") + ", hub AS (SELECT t, unnest(list_distinct([min(zsid), max(zsid)])) AS zsid FROM full_ GROUP BY t), it(i, t, zsid, cost, hub) AS (SELECT 0, t, zsid, CAST(0 AS DOUBLE), zsid FROM hub UNION ALL SELECT i + 1, t, zsid, m.c, m.h FROM (SELECT i, t, zsid, min({'c': cost, 'h': hub}) AS m FROM (SELECT i, t, zsid, cost, hub FROM it WHERE i < 30 UNION ALL SELECT it.i, k.t, k.src, k.cost + it.cost, it.hub FROM it JOIN knn k ON k.t = it.t AND k.dst = it.zsid WHERE it.i < 30) GROUP BY ALL)) SELECT t, zsid, round(cost, 6) AS cost, hub FROM it WHERE i = 30")
def hub_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)[1]


@query(ORACLE_SQL["hub_assignment"].rsplit(" SELECT", 1)[0] + " SELECT t, hub, count(*) AS stations, round(avg(cost), 6) AS mean_cost FROM it WHERE i = 30 GROUP BY ALL")
def hub_counts(spark, sf_dir):
    return _assigned(spark, sf_dir)[1].groupBy("t", "hub").agg(F.count("*").alias("stations"), F.avg("cost").alias("mean_cost"))


@query(ORACLE_SQL["hub_assignment"].rsplit(" SELECT", 1)[0] + _GRID.format(s=200) + ", ns AS (SELECT g.t, g.p, arg_min(f.zsid, {'d': (g.e - f.e) * (g.e - f.e) + (g.n - f.n) * (g.n - f.n), 'z': f.zsid}) AS zsid FROM gr g JOIN full_ f ON g.t = f.t GROUP BY g.t, g.p) SELECT ns.t, hub, count(*) AS cells, round(100 * count(*) / 40000.0, 6) AS share FROM ns LEFT JOIN (SELECT * FROM it WHERE i = 30) b ON b.t = ns.t AND b.zsid = ns.zsid GROUP BY ALL")
def hub_share_exact(spark, sf_dir):
    """Share of all cells of the raster whose nearest station goes to each hub."""
    full, best = _assigned(spark, sf_dir)
    near = spatial.nearest_station(spatial.grid(full), full)
    share = near.join(best, ["t", "zsid"], "left").groupBy("t", "hub").agg(F.count("*").alias("cells"))
    return share.withColumn("share", 100 * F.col("cells") / F.lit(200 * 200))


# spectra and models


@query(HOURLY + ", m AS (SELECT series_id, avg(y) AS m, var_pop(y) * count(*) AS ss FROM h GROUP BY 1), z AS (SELECT h.series_id, idx, y - m AS d, ss FROM h JOIN m USING (series_id)) SELECT a.series_id, b.idx - a.idx AS lag, round(sum(a.d * b.d) / max(a.ss), 6) AS acf FROM z a JOIN z b ON a.series_id = b.series_id AND b.idx - a.idx BETWEEN 0 AND 30 GROUP BY ALL")
def acf(spark, sf_dir):
    return spectral.acf(tables.hourly_count(spark, sf_dir))


@query(HOURLY + ", c AS (SELECT series_id, count(*) AS n FROM h GROUP BY 1), x AS (SELECT series_id, y, k, -2 * pi() * ((k * idx) % n) / n AS a FROM h JOIN c USING (series_id), (SELECT unnest(range(60)) AS k)) SELECT series_id, k, round(sqrt(sum(y * cos(a)) * sum(y * cos(a)) + sum(y * sin(a)) * sum(y * sin(a))), 4) AS amplitude FROM x GROUP BY ALL")
def dft_spectrum(spark, sf_dir):
    return spectral.dft(tables.hourly_count(spark, sf_dir), 60).withColumn("amplitude", F.round("amplitude", 4))


@query(
    HOURLY
    + """, c AS (SELECT series_id, count(*) AS n FROM h GROUP BY 1),
k AS (SELECT series_id, n, unnest(range(greatest(1, n // 2))) AS k FROM c),
x AS (SELECT series_id, k, sum(y * cos(2 * pi() * ((k * idx) % n) / n)) AS re, sum(y * sin(2 * pi() * ((k * idx) % n) / n)) AS im FROM h JOIN k USING (series_id) GROUP BY ALL)
SELECT series_id, k, round(sqrt(re * re + im * im), 4) AS amplitude FROM x"""
)
def dft_half_spectrum(spark, sf_dir):
    """The first half of all bins of each series, by a fast transform."""
    return spectral.dft(tables.hourly_count(spark, sf_dir)).withColumn("amplitude", F.round("amplitude", 4))


_LS = HOURLY + ", x AS (SELECT series_id, p AS period, y, cos(2 * pi() * idx / p) AS c, sin(2 * pi() * idx / p) AS s FROM h, (SELECT CAST(unnest([6, 8, 12, 24, 48, 84, 168]) AS DOUBLE) AS p)), m AS (SELECT series_id, period, avg(y*y)-avg(y)*avg(y) AS yy, avg(y*c)-avg(y)*avg(c) AS yc, avg(y*s)-avg(y)*avg(s) AS ys, avg(c*c)-avg(c)*avg(c) AS cc, avg(s*s)-avg(s)*avg(s) AS ss, avg(c*s)-avg(c)*avg(s) AS cs FROM x GROUP BY ALL) SELECT series_id, period, round((ss*yc*yc + cc*ys*ys - 2*cs*yc*ys) / nullif(yy*(cc*ss-cs*cs), 0), 6) AS power FROM m"


@query(_LS)
def lomb_scargle(spark, sf_dir):
    return spectral.lomb_scargle(tables.hourly_count(spark, sf_dir), [6, 8, 12, 24, 48, 84, 168])


@query(f"SELECT series_id, arg_max(period, power) AS period, max(power) AS power FROM ({_LS}) GROUP BY 1")
def periodogram_top(spark, sf_dir):
    p = _rounded(spectral.lomb_scargle(tables.hourly_count(spark, sf_dir), [6, 8, 12, 24, 48, 84, 168]))
    return p.groupBy("series_id").agg(F.max_by("period", "power").alias("period"), F.max("power").alias("power"))


_LS_GRID = (
    HOURLY
    + """, b AS (SELECT series_id, min(idx) AS lo, max(idx) - min(idx) AS span, count(*) AS n FROM h GROUP BY 1 HAVING max(idx) > min(idx)),
g AS (SELECT *, 1 / CAST(span AS DOUBLE) / 5 AS step FROM b),
f AS (SELECT *, unnest(range(1 + CAST(round_even((5 * 0.5 * n / span - step / 2) / step, 0) AS BIGINT))) AS i FROM g),
x AS (SELECT series_id, i, step / 2 + step * i AS freq, y, 2 * pi() * (((idx - lo) * (2 * i + 1)) % (10 * span)) / (10 * span) AS a FROM h JOIN f USING (series_id)),
m AS (SELECT series_id, 1 / freq AS period, avg(y * y) - avg(y) * avg(y) AS yy, avg(y * cos(a)) - avg(y) * avg(cos(a)) AS yc, avg(y * sin(a)) - avg(y) * avg(sin(a)) AS ys, avg(cos(a) * cos(a)) - avg(cos(a)) * avg(cos(a)) AS cc, avg(sin(a) * sin(a)) - avg(sin(a)) * avg(sin(a)) AS ss, avg(cos(a) * sin(a)) - avg(cos(a)) * avg(sin(a)) AS cs FROM x GROUP BY series_id, i, freq),
p AS (SELECT series_id, period, CASE WHEN cc * ss - cs * cs > 1e-9 THEN (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / nullif(yy * (cc * ss - cs * cs), 0) END AS power FROM m)"""
)


@query(_LS_GRID + f" SELECT series_id, {_r('period', 'power')} FROM p")
def lomb_scargle_grid(spark, sf_dir):
    """The periodogram over the whole frequency grid of each series, by fast transforms."""
    return spectral.lomb_scargle(tables.hourly_count(spark, sf_dir))


@query(_LS_GRID + ", t AS (SELECT series_id, round(power, 8) AS power, max(period) AS period FROM p WHERE power IS NOT NULL GROUP BY ALL) SELECT series_id, round(arg_max(period, power), 6) AS period, round(max(power), 6) AS power FROM t GROUP BY 1")
def periodogram_grid_top(spark, sf_dir):
    """The period of the largest power; the longest one of equal powers (8 places), as each has its mirror images beyond half of the sampling rate."""
    p = spectral.lomb_scargle(tables.hourly_count(spark, sf_dir)).where("power is not null").withColumn("power", F.round("power", 8))
    p = p.groupBy("series_id", "power").agg(F.max("period").alias("period"))
    return p.groupBy("series_id").agg(F.max_by("period", "power").alias("period"), F.max("power").alias("power"))


@query(HOURLY + MEAN_F + NAIVE_F.replace(", f AS", ", g AS") + f", l AS (SELECT series_id, y, 'mean' AS model, y_hat AS f FROM sp JOIN f USING (series_id) WHERE idx >= n_train UNION ALL SELECT series_id, y, 'naive', y_hat FROM sp JOIN g USING (series_id) WHERE idx >= n_train), u AS (SELECT series_id, model, avg(abs(y - f)) AS mae, sqrt(avg((y - f) * (y - f))) AS rmse, 100 * avg(coalesce(2 * abs(y - f) / nullif(abs(y) + abs(f), 0), 0)) AS smape FROM l GROUP BY ALL), v AS (SELECT *, " + _SKILL.format(b=_BASE.format(g="series_id")) + f" AS skill FROM u) SELECT series_id, model, {_r('mae', 'rmse', 'smape', 'skill')} FROM v")
def model_comparison(spark, sf_dir):
    df = _split(spark, sf_dir)
    both = baselines.mean(df).withColumn("model", F.lit("mean")).unionByName(baselines.naive(df).withColumn("model", F.lit("naive")))
    return metrics.skill(metrics.error(both, ["series_id", "model"]), ["series_id"])


@query("SELECT event_type AS series_id, strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS t, count(*) AS y FROM events GROUP BY 1, 2")
def hourly_event_counts(spark, sf_dir):
    return hourly.hourly_counts(tables.read(spark, sf_dir, "events")).select("series_id", F.date_format("t", "yyyy-MM-dd HH").alias("t"), "y")
