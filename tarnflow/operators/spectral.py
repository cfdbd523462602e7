"""Autocorrelation, Fourier amplitudes and the Lomb-Scargle periodogram: a few bins as sums over joins, whole spectra by fast transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import fourier


def acf(df: DataFrame, lags: int = 30) -> DataFrame:
    """Biased autocorrelation (series_id, lag, acf)."""
    mean = df.groupBy("series_id").agg(F.avg("y").alias("m"), (F.var_pop("y") * F.count("y")).alias("ss"))
    rows = df.join(mean, "series_id").select("series_id", "idx", (F.col("y") - F.col("m")).alias("d"), "ss")
    back = rows.select("series_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(lags).cast("long"))).alias("lag"), "idx", F.col("d").alias("d0"), "ss").withColumn("idx", F.col("idx") + F.col("lag"))
    return back.join(rows.select("series_id", "idx", "d"), ["series_id", "idx"]).groupBy("series_id", "lag").agg(F.try_divide(F.sum(F.col("d") * F.col("d0")), F.nullif(F.first("ss"), F.lit(0.0))).alias("acf"))


def dft(df: DataFrame, bins: int | None = None) -> DataFrame:
    """Amplitudes of the first Fourier bins: (series_id, k, amplitude). For given `bins` every row meets each of them and is summed before the shuffle; n // 2 bins of a series of n, if not given, come from a fast transform."""
    if bins is None:
        n = df.groupBy("series_id").agg(F.count("*").alias("m"))
        rows = df.join(n, "series_id").select("series_id", F.pmod("idx", "m").alias("j"), F.coalesce("y", F.lit(0.0)).alias("re"), F.lit(0.0).alias("im"), "m")
        out = fourier.transform(rows).join(n, "series_id").where(F.col("k") < F.greatest(F.lit(1), F.floor(F.col("m") / 2)))
        return out.select("series_id", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude"))
    n = df.groupBy("series_id").agg(F.count("*").alias("n"))
    last = F.lit(bins - 1).cast("long")
    a = -2 * F.pi() * ((F.col("k") * F.col("idx")) % F.col("n")) / F.col("n")
    rows = df.join(n, "series_id").withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    s = rows.groupBy("series_id", "k").agg(F.sum(F.col("y") * F.cos(a)).alias("re"), F.sum(F.col("y") * F.sin(a)).alias("im"))
    return s.select("series_id", "k", F.sqrt(F.col("re") * F.col("re") + F.col("im") * F.col("im")).alias("amplitude"))


def frequency_grid(df: DataFrame, time: str = "idx", per_peak: int = 5, nyquist: int = 5) -> DataFrame:
    """(series_id, base, step, last): frequencies base + step * (0..last) of each series, `per_peak` to a peak's width, up to `nyquist` times half of the mean rate."""
    span = F.max(time) - F.min(time)
    g = df.groupBy("series_id").agg(span.cast("double").alias("span"), F.count("*").alias("n")).where("span > 0")
    step = 1 / F.col("span") / per_peak
    return g.select("series_id", (step / 2).alias("base"), step.alias("step"), F.bround((nyquist * 0.5 * F.col("n") / F.col("span") - step / 2) / step).cast("long").alias("last"))


#: Frequencies of one series that one task works out at once.
FREQUENCIES = 1 << 21


def _power(y: np.ndarray, w: np.ndarray, w2: np.ndarray, yy: np.ndarray | float) -> np.ndarray:
    """The normalised power from means of (y, 1) exp(-i a) and exp(-2 i a), y without its mean."""
    c, s, yc, ys = w.real, -w.imag, y.real, -y.imag
    cc, ss, cs = (1 + w2.real) / 2 - c * c, (1 - w2.real) / 2 - s * s, -w2.imag / 2 - c * s
    det = cc * ss - cs * cs
    low = yy * det
    top = ss * yc * yc + cc * ys * ys - 2 * cs * yc * ys
    return np.where((det > 1e-9) & (low != 0), top / np.where(low != 0, low, 1.0), np.nan)


def _periodogram(df: DataFrame, time: str, per_peak: int = 5) -> DataFrame:
    """Power over frequency_grid(), from three transforms of each series: of its values, of its times, and of its times at double frequency.

    Times that are whole numbers fall on the transform's own grid, so the sums are exact but for rounding; others are spread over
    a finer grid (an error of about 1e-10 of the values' sum). Series of more than FREQUENCIES frequencies are spread and transformed in several tasks.
    """
    rows = df.where("y is not null").select(F.col("series_id").cast("string").alias("series_id"), F.col(time).cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    sizes = rows.groupBy("series_id").agg(F.min("x").alias("low"), F.count("*").alias("n"), F.avg("y").alias("mean"), F.var_pop("y").alias("yy"))
    rows = rows.join(sizes.join(frequency_grid(rows, "x"), "series_id"), "series_id").withColumns({"x": F.col("x") - F.col("low"), "y": F.col("y") - F.col("mean")})
    most = FREQUENCIES

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        x, y = own["x"].to_numpy(), own["y"].to_numpy()
        base, step, last, n = (own[c].iloc[0] for c in ("base", "step", "last", "n"))
        i, m = np.arange(int(last) + 1), int(per_peak * x.max())
        if (x == np.floor(x)).all() and m <= 4 * most:
            at = x.astype(np.int64)
            half = np.exp(-1j * np.pi * x / m)

            def summed(c: np.ndarray, k: np.ndarray) -> np.ndarray:
                z = np.zeros(m, complex)
                np.add.at(z, at, c)
                return np.fft.fft(z)[k % m]

            sums = summed(y * half, i), summed(half, i), summed(np.ones(len(x)), 2 * i + 1)
        else:
            at, half = x * step, np.exp(-1j * np.pi * x * step)
            sums = fourier.modes_at(at, y * half, len(i)), fourier.modes_at(at, half, len(i)), fourier.modes_at(at, half * half, 2 * len(i))[::2]
        power = _power(*(z / n for z in sums), (y * y).mean())
        return pd.DataFrame({"series_id": key[0], "period": 1 / (base + step * i), "power": power})

    rows = rows.withColumn("long", F.col("last") >= most)
    out = rows.where("not long").groupBy("series_id").applyInPandas(run, "series_id string, period double, power double")
    if not rows.where("long").isEmpty():
        out = out.unionByName(_long_periodogram(rows.where("long")))
    return out.withColumn("power", F.nullif("power", F.lit(float("nan"))))


def _long_periodogram(rows: DataFrame) -> DataFrame:
    """The same for series that don't fit into a task: three channels of each, spread and transformed together."""
    at, many = F.col("x") * F.col("step"), F.col("last") + 1
    turn = lambda c, a: [(c * F.cos(a)).alias("re"), (c * F.sin(a)).alias("im")]
    channel = lambda name, c, a, modes: rows.select(F.concat(F.lit(name), "series_id").alias("series_id"), at.alias("x"), *turn(c, a), modes.alias("modes"))
    one = F.lit(1.0)
    all_ = channel("y", F.col("y"), -F.pi() * at, many).unionByName(channel("w", one, -F.pi() * at, many)).unionByName(channel("2", one, -2 * F.pi() * at, 2 * many))
    sums = fourier.modes_of(all_).withColumns({"channel": F.substring("series_id", 1, 1), "series_id": F.expr("substring(series_id, 2)")})
    sums = sums.where("channel <> '2' or k % 2 = 0").withColumn("i", F.when(F.col("channel") == "2", F.floor(F.col("k") / 2)).otherwise(F.col("k")))
    of = lambda c, v: F.max(F.when(F.col("channel") == c, F.col(v))).alias(f"{v}{c}")
    wide = sums.groupBy("series_id", "i").agg(*(of(c, v) for c in "yw2" for v in ("re", "im")))
    grid = rows.select("series_id", "base", "step", "n", "yy").distinct()

    def run(batches):
        for own in batches:
            z = [(own[f"re{c}"] + 1j * own[f"im{c}"]).to_numpy() / own["n"].to_numpy() for c in "yw2"]
            yield pd.DataFrame({"series_id": own["series_id"], "period": 1 / (own["base"] + own["step"] * own["i"]), "power": _power(*z, own["yy"].to_numpy())})

    return wide.join(grid, "series_id").mapInPandas(run, "series_id string, period double, power double")


def lomb_scargle(df: DataFrame, periods: list[float] | None = None, time: str = "idx") -> DataFrame:
    """Normalised generalised periodogram with a floating mean: (series_id, period, power), at the given periods or over frequency_grid().

    On the grid, power is null where the sampled sine and cosine can't be told apart, and work grows as n log n.
    """
    if periods is None:
        return _periodogram(df, time)
    rows = df.withColumn("period", F.explode(F.array(*(F.lit(float(p)) for p in periods))))
    a = 2 * F.pi() * F.col(time) / F.col("period")
    c, s, y = F.cos(a), F.sin(a), F.col("y")
    m = rows.groupBy("series_id", "period").agg(F.avg(y).alias("my"), F.avg(c).alias("mc"), F.avg(s).alias("ms"), F.avg(y * y).alias("yy"), F.avg(y * c).alias("yc"), F.avg(y * s).alias("ys"), F.avg(c * c).alias("cc"), F.avg(s * s).alias("ss"), F.avg(c * s).alias("cs"))
    less = {n: F.col(n) - F.col(f"m{n[0]}") * F.col(f"m{n[1]}") for n in ("yy", "yc", "ys", "cc", "ss", "cs")}
    m = m.select("series_id", "period", *(v.alias(n) for n, v in less.items()))
    det = F.col("cc") * F.col("ss") - F.col("cs") * F.col("cs")
    top = F.col("ss") * F.col("yc") * F.col("yc") + F.col("cc") * F.col("ys") * F.col("ys") - 2 * F.col("cs") * F.col("yc") * F.col("ys")
    return m.select("series_id", "period", F.try_divide(top, F.nullif(F.col("yy") * det, F.lit(0.0))).alias("power"))
