"""Fitted models, tests of series, surfaces and streams against plain NumPy."""

import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import evaluation, models, series, spatial, stationarity
from tarnflow.session import checkpoints
from tarnflow.sources import files
from tarnflow.streaming import hourly

SCHEMA = "series_id string, t timestamp_ntz, idx long, y double"


def frame(spark, of):
    start = pd.Timestamp("2024-01-01")
    return spark.createDataFrame([(k, (start + pd.Timedelta(hours=i)).to_pydatetime(), i, float(v)) for k, y in of.items() for i, v in enumerate(y)], SCHEMA)


def wave(n, seed=0, noise=0.2):
    return 10 + 5 * np.sin(2 * np.pi * np.arange(n) / 24) + np.random.default_rng(seed).normal(0, noise, n)


def test_periods():
    assert stationarity.periods_of(np.sin(2 * np.pi * np.arange(480) / 24)) == [24]
    assert stationarity.periods_of(np.ones(100)) == [] and stationarity.periods_of(np.arange(4.0)) == []
    assert stationarity.periods_of(np.arange(100.0)) == [100]  # a peak that the autocorrelation can't confirm


def test_adf_follows_the_published_values():
    for tau, p in ((-3.43, 0.01), (-2.86, 0.05), (-2.57, 0.10)):
        z = sum(c * tau**i for i, c in enumerate(stationarity.SMALL_P))
        assert 0.5 * np.vectorize(__import__("math").erfc)(-z / np.sqrt(2)) == pytest.approx(p, abs=0.001)
    r = np.random.default_rng(1)
    walk = np.cumsum(r.normal(size=600))
    assert stationarity.adf_p(walk) > 0.1 and stationarity.adf_p(np.diff(walk)) < 1e-6 and stationarity.adf_p(np.ones(50)) == 1.0
    assert models.differencing(walk, 24)[0] == 1


def test_adf_statistic_is_the_regression():
    y = np.cumsum(np.random.default_rng(2).normal(size=200)) * 0.5
    tau, lags = stationarity.adf_statistic(y)
    d = np.diff(y)
    x = np.array([[y[t], 1, *(d[t - i] for i in range(1, lags + 1))] for t in range(lags, len(d))])
    b, res, *_ = np.linalg.lstsq(x, d[lags:], rcond=None)
    se = np.sqrt(res[0] / (len(x) - x.shape[1]) * np.linalg.inv(x.T @ x)[0, 0])
    assert tau == pytest.approx(b[0] / se)


def test_pacf_is_the_last_coefficient():
    y = wave(300, noise=2.0)
    got = stationarity.pacf_of(y, 12)
    d = y - y.mean()
    g = np.array([d[k:] @ d[: len(d) - k] / (len(d) - k) for k in range(13)])
    for k in range(1, 13):
        a = np.array([[g[abs(i - j)] for j in range(k)] for i in range(k)])
        assert got[k] == pytest.approx(np.linalg.solve(a, g[1 : k + 1])[-1])


@pytest.mark.parametrize("name", models.MODELS)
def test_models_follow_a_sine(name):
    y = wave(528)
    fit, grid, _ = models.MODELS[name]
    scores = []
    for i, own in enumerate(grid(y[:504])):
        try:
            scores.append((models.candidate_score(name, y[:504], own), i))
        except ValueError:
            continue
    hat, low, high, _ = fit(y[:504], 24, **grid(y[:504])[min(scores)[1]])
    assert len(hat) == 24 and (low <= hat).all() and (hat <= high).all() and np.abs(hat - y[504:]).mean() < 1.0


def test_sarima_finds_an_autoregression():
    r, y = np.random.default_rng(3), np.zeros(3000)
    for t in range(1, 3000):
        y[t] = 0.7 * y[t - 1] + r.normal()
    hat, low, high, _ = models.sarima(y, 6, (1, 0, 0))
    assert np.allclose(hat - y.mean(), (y[-1] - y.mean()) * 0.7 ** np.arange(1, 7), atol=0.15)
    assert np.allclose((high - hat) / 1.96, np.sqrt(np.cumsum(0.7 ** (2 * np.arange(6)))), rtol=0.08)


def test_smoothing_is_the_plain_recursion():
    y, (a, b, phi) = wave(120, noise=1.0), (0.3, 0.2, 0.9)
    hats = models._smooth(y, 1, ("add", "add", None, True), np.array([[a, b, 0.0, phi]]))[0][:, 0]
    level, slope = y[0], y[1] - y[0]
    for v, hat in zip(y, hats, strict=True):
        assert hat == pytest.approx(level + phi * slope)
        e = v - hat
        level, slope = hat + a * e, phi * slope + a * b * e
    assert len(models.ets_forms(True)) == 30 and all("mul" not in f[:3] for f in models.ets_forms(False))


def test_grid_and_forecast(spark):
    df = series.split(frame(spark, {"a": wave(400), "b": wave(400, 1) - 9, "short": wave(9)}))
    grid = models.grid_search(df, "ets").toPandas()
    assert grid[grid["series_id"] == "a"].shape[0] == 30 and (grid[grid["series_id"] == "b"]["params"].dropna().str.contains("mul") == False).all()  # noqa: E712
    best = {r.series_id: r.ordinal for r in models.best_candidates(models.grid_search(df, "ets"), ["series_id"]).collect()}
    for k in ("a", "b"):
        own = grid[(grid["series_id"] == k) & grid["score"].notna()].sort_values(["score", "ordinal"])
        assert best[k] == own["ordinal"].iloc[0]
    out = models.forecast(df, "dlinear").toPandas()
    assert out[out["series_id"] == "short"]["y_hat"].isna().all() and (out[out["series_id"] == "short"]["status"] != "ok").all()
    own = out[out["series_id"] == "a"]
    assert len(own) == 80 and (own["status"] == "ok").all() and (own["y"] - own["y_hat"]).abs().mean() < 1.0


def test_walk_forward_records_failures(spark):
    df = frame(spark, {"a": wave(300), "short": wave(60)})
    origins = evaluation.rolling_origins(df, 2)
    rows = models.walk_forward(df, origins, ("ar", "detected_naive")).toPandas()
    failed = rows[rows["status"] != "ok"]
    assert set(failed["series_id"]) == {"short"} and set(failed["model"]) == {"ar"} and failed["y_hat"].isna().all()
    y, cut = wave(300), 276
    own = rows[(rows["series_id"] == "a") & (rows["model"] == "ar") & (rows["cutoff"] == cut)].sort_values("idx")
    assert np.allclose(own["y_hat"], models.ar(y[:cut], 24)[0]) and np.allclose(own["y"], y[cut:])
    scores = evaluation.scored(models.walk_forward(df, origins, ("ar",)), ["series_id", "model"]).toPandas().set_index("series_id")
    assert scores.loc["short", "failed"] == 1 and scores.loc["short", "n"] == 0 and scores.loc["a", "failed"] == 0 and scores.loc["a", "n"] == 48


def test_ar_one_step(spark):
    y = wave(200, noise=1.0)
    got = models.ar_one_step(series.split(frame(spark, {"a": y, "b": y[:20]}))).toPandas()
    own, n = got[got["series_id"] == "a"].sort_values("idx"), 160
    x = np.array([[1, *y[t - 24 : t]] for t in range(24, 200)])
    b, *_ = np.linalg.lstsq(x[: n - 24], y[24:n], rcond=None)
    assert np.allclose(own["y_hat"], x[n - 24 :] @ b)
    short = got[got["series_id"] == "b"].sort_values("idx")
    assert np.allclose(short["y_hat"], [y[:t].mean() for t in range(16, 20)])


def test_rolling_ma1_is_the_plain_recursion(spark):
    y = np.abs(np.cumsum(np.random.default_rng(5).normal(size=150)) * 3 + 20)
    got = series.undifference(models.rolling_ma1(frame(spark, {"a": y}))).toPandas().sort_values("idx")
    d = np.diff(y)

    def run(theta):
        e, hats = 0.0, []
        for v in d:
            hats.append(theta * e)
            e = v - hats[-1]
        return np.array(hats)

    best = min(np.arange(-99, 100) / 100, key=lambda th: float(np.sum((d - run(th))[:-10] ** 2)))
    assert np.allclose(got["d_hat"], run(best)) and got["train"].sum() == len(d) - 10
    assert np.allclose(got["y_hat"].iloc[1:], np.maximum(0, y[1:-1] + run(best)[:-1])) and np.isnan(got["y_hat"].iloc[0])


def test_boosted_trees(spark):
    checkpoints(spark)
    df = series.split(frame(spark, {"a": wave(300), "b": wave(300, 1), "short": wave(100)}))
    out = models.gbt_recursive(df, horizon=3, trees=8, rate=0.4).toPandas()
    assert out.groupby("series_id").size().to_dict() == {"a": 3, "b": 3, "short": 3}
    assert (out[out["series_id"] == "short"]["status"] == "under 170 train rows").all()
    own = out[out["series_id"] != "short"]
    assert (own["status"] == "ok").all() and (own["y"] - own["y_hat"]).abs().mean() < 1.5 and (own["lower"] <= own["y_hat"]).all() and (own["upper"] <= 100).all()


def stations(spark, n, seed=0):
    r = np.random.default_rng(seed)
    return [(t, i, float(r.normal()), float(r.normal()), float(r.integers(1, 900))) for t in (0, 1) for i in range(n)]


def test_surface_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(spatial, "BLOCK", 7)
    monkeypatch.setattr(spatial, "TILE", 50)
    rows = stations(spark, 30)
    df = spark.createDataFrame(rows, "t long, zsid long, e double, n double, cnt double")
    got = spatial.kde_surface(spatial.grid(df, 12), df).toPandas().set_index(["t", "p"])
    near = spatial.nearest_station(spatial.grid(df, 12), df).toPandas().set_index(["t", "p"])
    for t in (0, 1):
        own = np.array([r[2:] for r in rows if r[0] == t])
        at, w = own[:, :2].T, own[:, 2]
        gx, gy = (np.linspace(v.min(), v.max(), 12) for v in at)
        cells = np.array([(x, y) for y in gy for x in gx])

        def density(w):
            w = w / w.sum()
            off = at - (at @ w)[:, None]
            cov = 0.09 * (off * w) @ off.T / (1 - w @ w)
            d = cells[:, :, None] - at
            q = np.einsum("ain,ij,ajn->an", d, np.linalg.inv(cov), d) / 2
            return np.exp(-q) @ w / np.sqrt(np.linalg.det(cov))

        want = density(w) / density(np.ones(len(w))) * w.sum()
        mine = got.loc[t].sort_index()
        assert np.allclose(mine["weight"], want, rtol=1e-8) and np.allclose(mine["log_weight"], np.log(want), atol=1e-8)
        d = ((cells[:, :, None] - at) ** 2).sum(axis=1)
        assert (near.loc[t].sort_index()["zsid"].to_numpy() == d.argmin(axis=1)).all()


def test_blur(spark):
    rows = stations(spark, 9, 3)
    df = spark.createDataFrame(rows, "t long, zsid long, e double, n double, cnt double")
    size, sigma = 10, 2.0
    got = spatial.gaussian_surface(df, size, sigma).toPandas().set_index(["t", "p"])["value"]
    near = spatial.nearest_station(spatial.grid(df, size), df).toPandas().set_index(["t", "p"])["zsid"]
    w = np.array(spatial.gaussian_weights(sigma))
    assert len(w) == 17 and w.sum() == pytest.approx(1)
    value = {(t, i): c for t, i, _, _, c in rows}
    for t in (0, 1):
        z = np.array([value[t, near.loc[t, p]] for p in range(size * size)]).reshape(size, size)
        pad = np.pad(z, len(w) // 2, mode="symmetric")
        want = np.array([[w @ pad[j : j + 17, i : i + 17] @ w for i in range(size)] for j in range(size)])
        assert np.allclose(got.loc[t].sort_index().to_numpy().reshape(size, size), want)


def test_paths_have_their_cost(spark):
    checkpoints(spark)
    df = spark.createDataFrame(stations(spark, 40, 4), "t long, zsid long, e double, n double, cnt double")
    edges = spatial.knn_edges(df, 5).checkpoint()
    hubs = spark.createDataFrame([(0, 0), (0, 7), (1, 3)], "t long, zsid long")
    cost = {(r.t, r.src, r.dst): r.cost for r in edges.collect()}
    plain = {(r.t, r.zsid): r.cost for r in spatial.hub_costs(edges, hubs).collect()}
    rows = spatial.hub_costs(edges, hubs, path=True).collect()
    assert {(r.t, r.zsid) for r in rows} == set(plain)
    for r in rows:
        assert r.path[0] == r.zsid and r.path[-1] == r.hub
        assert sum(cost[r.t, a, b] for a, b in zip(r.path[:-1], r.path[1:], strict=True)) == pytest.approx(plain[r.t, r.zsid]) == pytest.approx(r.cost)


def test_counts_below_in_ranges(spark):
    r = np.random.default_rng(6)
    x = np.concatenate([r.normal(size=3000).round(2), np.zeros(1000)])
    got = {v.v: (v.ties, v.below) for v in evaluation.count_below(spark.createDataFrame([(float(v),) for v in x], "v double"), "v", 20).collect()}
    s = np.sort(x)
    assert got == {v: (int((x == v).sum()), int(np.searchsorted(s, v))) for v in map(float, np.unique(x))}


def test_normal_cdf(spark):
    from math import erfc, sqrt

    z = [(float(v),) for v in np.linspace(-6, 6, 49)]
    for r in spark.createDataFrame(z, "z double").select("z", evaluation.normal_cdf(F.col("z")).alias("p")).collect():
        assert r.p == pytest.approx(0.5 * erfc(-r.z / sqrt(2)), abs=2e-7)


def test_metric_store_of_one_object(spark, tmp_path):
    store = {"a": {"mean": {"mae": 1.0, "rmse": 2.0}}, "b": {"naive": {"mae": 3.0}}}
    (tmp_path / "store.json").write_text(json.dumps(store, indent=2))
    got = {(r.series, r.model, r.metric): r.value for r in files.scan_metric_store(spark, str(tmp_path / "store.json")).collect()}
    assert got == {("a", "mean", "mae"): 1.0, ("a", "mean", "rmse"): 2.0, ("b", "naive", "mae"): 3.0}


def test_stream_drops_late_rows(spark, tmp_path):
    import os
    import time

    schema = "event_type string, ts timestamp"
    for k, times in enumerate((["2024-01-01 08:10:00", "2024-01-01 12:05:00"], ["2024-01-01 12:30:00", "2024-01-01 18:00:00"], ["2024-01-01 08:20:00", "2024-01-01 18:30:00"], ["2024-01-02 09:00:00"])):
        spark.createDataFrame([("a", t) for t in times], "event_type string, ts string").select("event_type", F.col("ts").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "all" / f"part{k}"))
        for f in (tmp_path / "all" / f"part{k}").glob("*.parquet"):
            (tmp_path / "in").mkdir(exist_ok=True)
            os.rename(f, tmp_path / "in" / f"{k}.parquet")
            os.utime(tmp_path / "in" / f"{k}.parquet", (time.time() + k, time.time() + k))
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    hourly.hourly_counts(events).writeStream.format("memory").queryName("late_rows").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    got = {str(r.t)[:13]: r.y for r in spark.table("late_rows").collect()}
    assert got == {"2024-01-01 08": 1, "2024-01-01 12": 2, "2024-01-01 18": 2}
