"""Fast transforms and periodograms against plain sums."""

import numpy as np
import pandas as pd
import pytest

from tarnflow.operators import fourier, spectral


def rows(spark, series):
    """(series_id, j, re, im, m) of {name: (m, places, values)}."""
    out = [(k, int(j), float(v.real), float(v.imag), m) for k, (m, at, x) in series.items() for j, v in zip(at, x, strict=True)]
    return spark.createDataFrame(out, "series_id string, j long, re double, im double, m long")


def made(seed, n):
    r = np.random.default_rng(seed)
    return r.normal(size=n) + 1j * r.normal(size=n)


def test_transform_is_the_sum(spark):
    """Lengths that fit, that have two near factors, and that are prime; missing places, places given twice."""
    series = {f"n{m}": (m, np.arange(m), made(m, m)) for m in (1, 2, 7, 16, 30, 48, 60, 64, 97, 101, 127)}
    series["sparse"] = (90, np.array([3, 3, 88]), made(5, 3))
    want = {}
    for k, (m, at, x) in series.items():
        z = np.zeros(m, complex)
        np.add.at(z, at, x)
        want[k] = np.fft.fft(z)
    for local in (1 << 20, 32):
        got = fourier.transform(rows(spark, series), local).toPandas()
        assert len(got) == sum(len(w) for w in want.values())
        for k, own in got.groupby("series_id"):
            own = own.sort_values("k")
            assert own["k"].tolist() == list(range(len(want[k]))) and np.abs(own["re"] + 1j * own["im"] - want[k]).max() < 1e-9, (k, local)
    assert fourier.transform(rows(spark, series).limit(0)).count() == 0


def test_long_series_in_two_passes(spark):
    """Values made by Spark, 16 times as many as a task takes; no pairs of places meet."""
    m, local = 4096, 256
    made_rows = spark.range(m).selectExpr("cast(id % 1 as string) as series_id", "id as j", "cos(id) as re", "sin(id * id) as im", f"{m} + id % 1 as m")
    plan = fourier.transform(made_rows, local)
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text
    got = plan.toPandas().sort_values("k")
    j = np.arange(m)
    want = np.fft.fft(np.cos(j) + 1j * np.sin(j.astype(float) * j))
    assert np.abs(got["re"].to_numpy() + 1j * got["im"].to_numpy() - want).max() < 1e-8


@pytest.mark.parametrize("modes", [1, 5, 200, 1001])
def test_modes_at_any_places(spark, modes):
    r = np.random.default_rng(modes)
    x, c = r.random(300), made(1, 300)
    want = np.exp(-2j * np.pi * np.arange(modes)[:, None] * x) @ c
    bound = 1e-9 * np.abs(c).sum()
    assert np.abs(fourier.modes_at(x, c, modes) - want).max() < bound
    df = spark.createDataFrame([("s", float(a), float(v.real), float(v.imag), modes) for a, v in zip(x, c, strict=True)], "series_id string, x double, re double, im double, modes long")
    got = fourier.modes_of(df, 64).toPandas().sort_values("k")
    assert got["k"].tolist() == list(range(modes)) and np.abs(got["re"].to_numpy() + 1j * got["im"].to_numpy() - want).max() < bound


def plain(t, y):
    """Power over the whole grid, frequency by frequency."""
    span, n = float(t.max() - t.min()), len(t)
    step = 1 / span / 5
    last = int(np.rint((5 * 0.5 * n / span - step / 2) / step))
    out = []
    for f in step / 2 + step * np.arange(last + 1):
        c, s = np.cos(2 * np.pi * f * (t - t.min())), np.sin(2 * np.pi * f * (t - t.min()))
        less = lambda a, b: (a * b).mean() - a.mean() * b.mean()
        cc, ss, cs, yc, ys = less(c, c), less(s, s), less(c, s), less(y, c), less(y, s)
        det = cc * ss - cs * cs
        out.append((1 / f, (ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys) / (less(y, y) * det) if det > 1e-9 else None))
    return out


@pytest.mark.parametrize("most", [1 << 21, 50])
def test_periodogram(spark, monkeypatch, most):
    """Whole and broken times, with gaps; in one task and in many."""
    monkeypatch.setattr(spectral, "FREQUENCIES", most)
    r = np.random.default_rng(4)
    times = {"whole": np.arange(90.0), "gaps": np.sort(r.choice(400, 80, replace=False)).astype(float) - 50, "broken": np.sort(r.uniform(-5, 60, 70))}
    series = {k: (t, 3 + np.sin(2 * np.pi * t / 7.3) + 0.3 * r.normal(size=len(t))) for k, t in times.items()}
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (t, y) in series.items() for a, b in zip(t, y, strict=True)] + [("one", 1.0, 2.0), ("whole", 500.0, None)], "series_id string, at double, y double")
    got = spectral.lomb_scargle(df, time="at").toPandas()
    assert set(got["series_id"]) == set(series)
    for k, (t, y) in series.items():
        own = got[got["series_id"] == k].sort_values("period", ascending=False)
        want = plain(t, y)
        assert np.allclose(own["period"], [p for p, _ in want], rtol=1e-12)
        mine, theirs = own["power"].astype(float).to_numpy(), np.array([np.nan if v is None else v for _, v in want])
        assert (np.isnan(mine) == np.isnan(theirs)).mean() > 0.998
        assert np.nanmax(np.abs(mine - theirs)) < (1e-9 if k != "broken" and most > 50 else 1e-6)


def test_constant_series_has_no_power(spark):
    got = spectral.lomb_scargle(spark.createDataFrame(pd.DataFrame({"series_id": "a", "idx": range(30), "y": 2.0}))).toPandas()
    assert len(got) and got["power"].isna().all()
