"""Boosted trees against trees that are grown by trying every split."""

import datetime

import numpy as np
import pytest

from tarnflow.operators import boosting, series


def plain_tree(x, cuts, g, rows, shape):
    """A function of a row; splits are tried one by one."""

    def split(own):
        best = None
        for c in range(x.shape[1]):
            for cut in cuts[c]:
                left, right = own[x[own, c] <= cut], own[x[own, c] > cut]
                if min(len(left), len(right)) >= shape.least:
                    part = lambda r: g[r].sum() ** 2 / (len(r) + shape.penalty)
                    gain = part(left) + part(right) - part(own)
                    if gain > 1e-12 and (best is None or gain > best[0] + 1e-9):
                        best = (gain, c, cut, left, right)
        return best

    root = {"rows": rows, "depth": 0}
    leaves = [root]
    while shape.leaves is None or len(leaves) < shape.leaves:
        found = [(split(n["rows"]), n) for n in leaves if shape.depth is None or n["depth"] < shape.depth]
        found = [(s, n) for s, n in found if s]
        if not found:
            break
        s, node = max(found, key=lambda f: f[0][0])
        node |= {"c": s[1], "cut": s[2], "ends": [{"rows": r, "depth": node["depth"] + 1} for r in s[3:]]}
        leaves = [n for n in leaves if n is not node] + node["ends"]

    def value(row):
        n = root
        while "ends" in n:
            n = n["ends"][0 if row[n["c"]] <= n["cut"] else 1]
        return -g[n["rows"]].sum() / (len(n["rows"]) + shape.penalty)

    return value


@pytest.mark.parametrize("shape", [boosting.Shape(3, None, 1, 1.0), boosting.Shape(None, 6, 4, 0.0), boosting.Shape(2, 3, 2, 0.5, bins=5)])
def test_trees_are_those_of_every_split(shape):
    for seed in (1, 2):
        r = np.random.default_rng(seed)
        x = np.column_stack([r.normal(size=60), r.integers(0, 4, 60), np.zeros(60)])
        y = np.sin(x[:, 0] * 2) + x[:, 1] + r.normal(size=60) * 0.1
        model, hat = boosting.fit(x, y, shape, 5, 0.3)
        cuts, want, made = boosting.cuts_of(x, shape.bins), np.full(60, y.mean()), []
        assert max(map(len, cuts)) < shape.bins and len(cuts[2]) == 0
        for _ in range(5):
            made.append(plain_tree(x, cuts, want - y, np.arange(60), shape))
            want = want + 0.3 * np.array([made[-1](row) for row in x])
        assert np.allclose(hat, want, atol=1e-9)
        fresh = np.column_stack([r.normal(size=9), r.integers(-1, 5, 9), r.normal(size=9)])
        assert np.allclose([model(row) for row in fresh], [y.mean() + 0.3 * sum(t(row) for t in made) for row in fresh], atol=1e-9)
        leaves = [(t >= 0).sum() for t in model.column]
        assert shape.leaves is None or max(leaves) <= shape.leaves - 1


def test_limits_of_the_shapes():
    r = np.random.default_rng(3)
    x = r.normal(size=(500, 4))
    y = (x**2).sum(1) + r.normal(size=500)
    for name, shape in boosting.SHAPES.items():
        model, hat = boosting.fit(x, y, shape, 40, 0.05)
        splits = (model.column >= 0) & (model.left != np.arange(model.left.shape[1]))
        assert splits.sum(1).max() <= (30 if name == "leaves31" else 63) and np.std(y - hat) < 0.8 * np.std(y)
        assert np.isclose(model(x[7]), hat[7])


def test_lagged():
    y = np.arange(200.0) ** 1.5
    got = boosting.lagged(y, np.array([169, 199]))
    assert np.allclose(got[:, : len(series.LAGS)], [[y[i - k] for k in series.LAGS] for i in (169, 199)])
    assert np.allclose(got[:, len(series.LAGS) :], [[y[i - w : i].mean() for w in (24, 168)] for i in (169, 199)])
    assert np.isnan(boosting.lagged(y, np.array([168]))[0]).sum() == 1


def test_forecast(spark):
    start = datetime.datetime(2024, 1, 1)
    r = np.random.default_rng(1)
    made = {"a": 50 + 20 * np.sin(2 * np.pi * np.arange(320) / 24) + r.normal(size=320), "b": np.full(260, 150.0), "short": np.arange(100.0)}
    df = spark.createDataFrame([(k, start + datetime.timedelta(hours=i), i, float(v)) for k, y in made.items() for i, v in enumerate(y)], "series_id string, t timestamp, idx long, y double")
    for config in boosting.SHAPES:
        out = boosting.forecast(series.split(df), config, trees=60, rate=0.1).toPandas()
        assert out.groupby("series_id").size().to_dict() == {"a": 64, "b": 52, "short": 20}
        a, b, short = (out[out["series_id"] == k] for k in ("a", "b", "short"))
        assert (a["status"] == "ok").all() and (a["y"] - a["y_hat"]).abs().mean() < 3 and ((a["lower"] <= a["y_hat"]) & (a["y_hat"] <= a["upper"])).all()
        assert (b["y_hat"] == 100).all() and short["y_hat"].isna().all() and (short["status"] == "under 170 train rows").all()
    assert boosting.forecast(series.split(df.limit(0))).count() == 0
