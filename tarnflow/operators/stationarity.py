"""Periods, unit roots and partial autocorrelation of series: small NumPy helpers and the grouped maps that apply them."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.series import by

#: MacKinnon's published response surface of the Dickey-Fuller statistic with a constant, for one series: bounds, the statistic
#: where the two polynomials meet, and their coefficients. Fixed values.
TAU_LEAST, TAU_MOST, TAU_MEET = -18.83, 2.74, -1.61
SMALL_P, LARGE_P = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)


def acf_of(x: np.ndarray, lags: int) -> np.ndarray:
    """Biased autocorrelation of lags 0 to `lags`; 0 for a constant."""
    d = x - x.mean()
    ss = d @ d
    return np.array([d[k:] @ d[: len(d) - k] / ss if ss else 0.0 for k in range(lags + 1)])


def periods_of(y: np.ndarray, longest: int = 365, top: int = 3) -> list[int]:
    """Periods at strong local peaks of the spectrum that the autocorrelation confirms, strongest first.

    Without a peak the strongest bins count as peaks; if the autocorrelation confirms none, the unconfirmed are returned.
    """
    n = len(y)
    if n < 8 or not np.ptp(y):
        return []
    power = np.abs(np.fft.rfft(y - y.mean()))
    freq = np.fft.rfftfreq(n)
    with np.errstate(divide="ignore"):
        period = 1 / freq
    power[(period < 2) | (period > longest) | (power < 1e-9 * power.max())] = 0  # rounding leaves no peak
    if not len(pos := power[power > 0]):
        return []
    inner = power[1:-1]
    peaks = np.flatnonzero((inner > power[:-2]) & (inner >= power[2:])) + 1
    peaks = peaks[power[peaks] >= np.quantile(pos, 0.75)]
    if not len(peaks):
        peaks = np.argsort(-power, kind="stable")[:top]
        peaks = peaks[power[peaks] > 0]
    each = list(dict.fromkeys(int(round(period[k])) for k in peaks[np.argsort(-power[peaks], kind="stable")]))
    rho = acf_of(y, max(0, min(longest + 10, n // 2 - 1)))
    return ([p for p in each if p < len(rho) and rho[p] > 0.1] or each)[:top]


def ridge(x: np.ndarray, y: np.ndarray, a: float = 1e-6) -> np.ndarray:
    return np.linalg.solve(x.T @ x + a * np.eye(x.shape[1]), x.T @ y)


def pacf_of(y: np.ndarray, lags: int) -> np.ndarray:
    """Partial autocorrelation of lags 0 to `lags` by Durbin and Levinson's recursion, of autocovariances over n - lag products."""
    d, n = y - y.mean(), len(y)
    rho = np.array([d[k:] @ d[: n - k] / (n - k) for k in range(lags + 1)])
    if not rho[0]:
        return np.array([1.0, *[0.0] * lags])
    rho = rho / rho[0]
    out, phi = [1.0], np.zeros(0)
    for k in range(1, lags + 1):
        below = 1 - phi @ rho[1:k]
        last = (rho[k] - phi @ rho[1:k][::-1]) / below if below else 0.0
        phi = np.append(phi - last * phi[::-1], last)
        out.append(last)
    return np.array(out)


def adf_statistic(y: np.ndarray) -> tuple[float, int]:
    """Dickey and Fuller's t with a constant, and the number of lagged differences, chosen by AIC up to 12 * (n / 100) ** 0.25."""
    n = len(y)
    most = max(0, min(int(math.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2))
    d = np.diff(y)

    def fit(lags: int, start: int) -> tuple[float, float]:
        rows = np.arange(start, len(d))
        x = np.column_stack([y[rows], np.ones(len(rows)), *(d[rows - i] for i in range(1, lags + 1))])
        b, *_ = np.linalg.lstsq(x, d[rows], rcond=None)
        res = d[rows] - x @ b
        ss, free = float(res @ res), len(rows) - x.shape[1]
        aic = len(rows) * math.log(max(ss / len(rows), 1e-300)) + 2 * x.shape[1]
        var = ss / max(free, 1) * np.linalg.pinv(x.T @ x)[0, 0]
        return aic, float(b[0] / math.sqrt(var)) if var > 0 else -math.inf

    lags = min(range(most + 1), key=lambda k: fit(k, most)[0])
    return fit(lags, lags)[1], lags


def adf_p(y: np.ndarray) -> float:
    """p-value of a unit root; 1 for a series of under 8 values or a constant one."""
    if len(y) < 8 or not np.ptp(y):
        return 1.0
    tau = adf_statistic(y)[0]
    if tau > TAU_MOST:
        return 1.0
    if tau < TAU_LEAST:
        return 0.0
    z = sum(c * tau**i for i, c in enumerate(SMALL_P if tau <= TAU_MEET else LARGE_P))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def _series(df: DataFrame) -> DataFrame:
    return df.where("y is not null").select("series_id", "idx", "y")


def _values(pdf: pd.DataFrame) -> np.ndarray:
    return pdf.sort_values("idx")["y"].to_numpy(float)


def detect_periodicity(df: DataFrame, longest: int = 365) -> DataFrame:
    """(series_id, rank, period)"""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = periods_of(_values(pdf), longest)
        return pd.DataFrame({"series_id": [key[0]] * len(found), "rank": np.arange(1, len(found) + 1), "period": np.array(found, np.int64)})

    return _series(df).groupBy("series_id").applyInPandas(run, "series_id string, rank bigint, period bigint")


def pacf(df: DataFrame, lags: int = 30) -> DataFrame:
    """(series_id, lag, pacf), of as many lags as half of the series allows."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        own = pacf_of(_values(pdf), max(0, min(lags, len(pdf) // 2 - 1)))
        return pd.DataFrame({"series_id": [key[0]] * len(own), "lag": np.arange(len(own)), "pacf": own})

    return _series(df).groupBy("series_id").applyInPandas(run, "series_id string, lag bigint, pacf double")


def adf(df: DataFrame) -> DataFrame:
    """(series_id, statistic, lags, p_value); null statistic for a series of under 8 values or a constant one."""

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = _values(pdf)
        stat, lags = adf_statistic(y) if len(y) >= 8 and np.ptp(y) else (None, None)
        return pd.DataFrame({"series_id": [key[0]], "statistic": [stat], "lags": pd.array([lags], "Int64"), "p_value": [adf_p(y)]})

    return _series(df).groupBy("series_id").applyInPandas(run, "series_id string, statistic double, lags bigint, p_value double")


def decompose(df: DataFrame, season: int = 24) -> DataFrame:
    """(series_id, idx, y, trend, seasonal, rest): centred moving average over one season, means of what is left by place in the season (less their mean), and the rest; all by windows.

    Means are sums divided once, and places are added in their order, so that whole numbers give the same result in any order of rows.
    """
    w, half = by(), season // 2

    def total(low: int, high: int) -> Column:
        frame = w.rowsBetween(low, high)
        return F.when(F.count("y").over(frame) == high - low + 1, F.sum("y").over(frame))

    even = season % 2 == 0
    width = 2 * season if even else season
    held = total(-half, season - 1 - half) + total(1 - season + half, half) if even else total(-half, half)
    rows = df.select("series_id", "idx", "y").withColumn("held", held).withColumns({"place": F.col("idx") % season, "trend": F.col("held") / width})
    means = rows.groupBy("series_id", "place").agg((F.sum(F.col("y") * width - F.col("held")) / (width * F.count("held"))).alias("own"))
    level = means.where("own is not null").groupBy("series_id").agg(F.sort_array(F.collect_list(F.struct("place", "own"))).alias("all"))
    level = level.select("series_id", (F.aggregate("all", F.lit(0.0), lambda acc, x: acc + x["own"]) / F.size("all")).alias("level"))
    seasonal = means.join(level, "series_id").select("series_id", "place", (F.col("own") - F.col("level")).alias("seasonal"))
    return rows.join(seasonal, ["series_id", "place"]).select("series_id", "idx", "y", "trend", "seasonal", (F.col("y") - F.col("trend") - F.col("seasonal")).alias("rest"))
