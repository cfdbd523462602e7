"""Forecast models that iterate: small NumPy fits in grouped maps. Grids are made once a series (and origin); each of their candidates is a group of its own, for all series at once."""

from __future__ import annotations

from ast import literal_eval
from collections.abc import Callable, Iterable
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import arma, laplace
from tarnflow.operators.stationarity import adf_p, periods_of, ridge
from tarnflow.session import spread

FORECAST = "series_id string, idx bigint, y double, y_hat double, lower double, upper double, status string"
Z = 1.96

#: A fit gives the forecast of so many hours and its band: (y_hat, lower, upper), and its score in the grid (smaller is better).
Fit = tuple[np.ndarray, np.ndarray, np.ndarray, float]


def flat_band(hat: np.ndarray, sd: float, score: float) -> Fit:
    return hat, hat - Z * sd, hat + Z * sd, score


# autoregression


def ar(y: np.ndarray, horizon: int, order: int = 24) -> Fit:
    """Least squares on the last `order` values with an intercept, applied step by step; the band grows with the steps."""
    if len(y) < 3 * order:
        raise ValueError(f"under {3 * order} values")
    rows = np.lib.stride_tricks.sliding_window_view(y, order + 1)
    x = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
    b = ridge(x, rows[:, -1])
    res = rows[:, -1] - x @ b
    past = list(y[-order:])
    for _ in range(horizon):
        past.append(b[0] + b[1:] @ np.array(past[-order:]))
    sd = _spread(b[1:][::-1], np.zeros(0), horizon) * res.std()
    hat = np.array(past[order:])
    return hat, hat - Z * sd, hat + Z * sd, float(len(res) * np.log(max(res @ res / len(res), 1e-300)) + 2 * len(b))


def _spread(a: np.ndarray, m: np.ndarray, horizon: int) -> np.ndarray:
    """Deviation of each step ahead for errors of 1: root of the summed squares of the response to one error, for x_t = sum a_i x_{t-i} + e_t + sum m_j e_{t-j}."""
    psi = np.zeros(horizon)
    for h in range(horizon):
        psi[h] = (1.0 if h == 0 else m[h - 1] if h <= len(m) else 0.0) + sum(a[i] * psi[h - 1 - i] for i in range(min(h, len(a))))
    return np.sqrt(np.cumsum(np.square(psi)))


# seasonal ARIMA


def differencing(y: np.ndarray, s: int, most_d: int = 2, most_seasonal: int = 1) -> tuple[int, int]:
    """Smallest d and D at which the lag-d and lag-D*s differences have no unit root (ADF p < 0.05), or the most."""
    plain = next((d for d in range(most_d + 1) if adf_p(y[d:] - y[:-d] if d else y) < 0.05), most_d)
    seasonal = next((d for d in range(most_seasonal + 1) if adf_p(y[d * s :] - y[: -d * s] if d else y) < 0.05), most_seasonal) if s > 1 else 0
    return plain, seasonal


def sarima(y: np.ndarray, horizon: int, order: tuple[int, int, int] = (1, 0, 1), seasonal: tuple[int, int, int, int] = (0, 0, 0, 1)) -> Fit:
    """Seasonal ARIMA by the exact likelihood of the differenced values (without their mean, if differenced at most once), scored by AIC; band from the responses to one error."""
    (p, d, q), (sp, sd, sq, s) = order, seasonal
    poly = np.array([1.0])
    for _ in range(d):
        poly = np.convolve(poly, [1, -1])
    for _ in range(sd):
        poly = np.convolve(poly, [1, *[0] * (s - 1), -1])
    if len(y) < len(poly) + max(p + s * sp, q + s * sq) + 20:
        raise ValueError("too few values for these lags")
    x = np.convolve(y, poly, mode="valid")
    mu = x.mean() if d + sd < 2 else 0.0
    u, score = arma.fit(x - mu, p, q, sp, sq, s)
    if not np.isfinite(score):
        raise ValueError("no finite likelihood")
    ar, ma = arma.polynomials(u[None], p, q, sp, sq, s)
    _, var, state, phi = arma.kalman(x - mu, ar, ma)
    full, z = list(y), state[0]
    for _ in range(horizon):
        full.append(z[0] + mu - sum(c * full[-1 - i] for i, c in enumerate(poly[1:]) if c))
        z = phi[0] * z[0] + np.append(z[1:], 0.0)
    dev = _spread(-np.convolve(ar[0], poly)[1:], ma[0, 1:], horizon) * np.sqrt(var[0])
    hat = np.array(full[len(y) :])
    return hat, hat - Z * dev, hat + Z * dev, score + 2 * (len(u) + 1)


def sarima_grid(y: np.ndarray, most: int = 2, most_seasonal: int = 1, longest: int = 365) -> list[dict]:
    """Candidates: period detected, d and D by ADF, p and q to `most`, P and Q to `most_seasonal`."""
    s = int(next(iter(periods_of(y, longest)), 1))
    s = s if 1 < s <= len(y) // 4 else 1
    d, seasonal_d = differencing(y, s)
    grid = product(range(most + 1), range(most + 1), range(most_seasonal + 1) if s > 1 else (0,), range(most_seasonal + 1) if s > 1 else (0,))
    return [{"order": (p, d, q), "seasonal": (sp, seasonal_d, sq, s)} for p, q, sp, sq in grid]


def weekly_grid(y: np.ndarray) -> list[dict]:
    """Candidates with a season of 7."""
    d, seasonal_d = differencing(y, 7)
    return [{"order": (p, d, q), "seasonal": (sp, seasonal_d, sq, 7)} for p, q, sp, sq in product(range(3), range(3), range(2), range(2))]


# exponential smoothing


def _smooth(y: np.ndarray, s: int, form: tuple, par: np.ndarray) -> tuple[np.ndarray, ...]:
    """One-step predictions of all parameter rows (alpha, beta, gamma, phi) at once, and the states at the end."""
    error, trend, season, _ = form
    k = len(par)
    a, b, g, phi = par.T
    base = y[:s].mean()
    level = np.full(k, base)
    slope = np.full(k, (y[s : 2 * s].mean() - base) / s if trend == "add" else (max(y[s : 2 * s].mean(), 1e-9) / max(base, 1e-9)) ** (1 / s) if trend == "mul" else 0.0)
    first = y[:s] - base if season == "add" else y[:s] / base if season == "mul" else np.zeros(s)
    ss = np.repeat(first[:, None], k, axis=1)
    hats = np.empty((len(y), k))
    with np.errstate(all="ignore"):
        for t, v in enumerate(y):
            moved = level + phi * slope if trend == "add" else level * slope**phi if trend == "mul" else level
            c = ss[t % s]
            hat = moved + c if season == "add" else moved * c if season == "mul" else moved
            hats[t] = hat
            e = v - hat if error == "add" else (v - hat) / hat * 1.0
            # in terms of the additive error, with the multiplicative one scaled by the prediction
            raw = e if error == "add" else e * hat
            own = raw / c if season == "mul" else raw
            new = moved + a * own
            if trend == "add":
                slope = phi * slope + a * b * own
            elif trend == "mul":
                slope = slope**phi + a * b * own / np.maximum(np.abs(level), 1e-9)
            if season == "add":
                ss[t % s] = c + g * raw
            elif season == "mul":
                ss[t % s] = c + g * raw / np.maximum(np.abs(moved), 1e-9)
            level = new
    return hats, level, slope, ss


def ets_forms(positive: bool) -> list[tuple]:
    """(error, trend, season, damped): 30 forms, or those without a multiplied part if a value isn't positive."""
    grid = product(("add", "mul"), (None, "add", "mul"), (None, "add", "mul"), (False, True))
    return [f for f in grid if not (f[3] and f[1] is None) and (positive or "mul" not in f[:3])]


#: Open ranges in which alpha, beta, gamma and phi are searched.
RANGES = np.array([(1e-4, 0.9999), (1e-4, 0.9999), (1e-4, 0.9999), (0.8, 0.98)])


def ets_score(y: np.ndarray, s: int, form: tuple, par: np.ndarray) -> np.ndarray:
    """-2 log likelihood of each parameter row, but for a constant; inf where it isn't finite."""
    hats = _smooth(y, s, form, par)[0]
    with np.errstate(all="ignore"):
        e = y[:, None] - hats if form[0] == "add" else (y[:, None] - hats) / hats
        out = len(y) * np.log(np.maximum((e * e).sum(axis=0), 1e-300)) + (0 if form[0] == "add" else 2 * np.log(np.abs(hats)).sum(axis=0))
    return np.where(np.isfinite(out), out, np.inf)


def ets_coarse(form: tuple) -> np.ndarray:
    """Rows of a coarse grid of the form's parameters; those it doesn't have are fixed."""
    _, trend, season, damped = form
    return np.array(list(product((0.05, 0.2, 0.5, 0.9), (0.01, 0.1, 0.4) if trend else (0.0,), (0.01, 0.1, 0.4) if season else (0.0,), (0.85, 0.97) if damped else (1.0,))))


def ets_search(y: np.ndarray, s: int, form: tuple, starts: np.ndarray, rounds: int = 60, tol: float = 1e-6) -> tuple[np.ndarray, np.ndarray]:
    """Quasi-Newton search from all starts at once, each step a few calls with all its rows: parameters and score of each, never above the start's.

    Works on logits within RANGES; slopes are central differences, each step is the best of ten lengths, and a start rests when a step along the plain slope gains under `tol`.
    """
    free = np.array([True, form[1] is not None, form[2] is not None, form[3]])
    low, wide = RANGES[free, 0], RANGES[free, 1] - RANGES[free, 0]
    count, dim = len(starts), int(free.sum())

    def par(z: np.ndarray) -> np.ndarray:
        out = np.tile([0.0, 0.0, 0.0, 1.0], (len(z), 1))
        out[:, free] = low + wide / (1 + np.exp(-z))
        return out

    def value(z: np.ndarray) -> np.ndarray:
        return ets_score(y, s, form, par(z.reshape(-1, dim))).reshape(z.shape[:-1])

    share = np.clip((starts[:, free] - low) / wide, 1e-4, 1 - 1e-4)
    z = np.log(share / (1 - share))
    best, curve, plain = value(z), np.tile(np.eye(dim), (count, 1, 1)), np.ones(count, bool)
    rest, before = ~np.isfinite(best), None
    lengths, shift = 2.0 ** -np.arange(-2, 8), 1e-4 * np.vstack([np.eye(dim), -np.eye(dim)])
    for _ in range(rounds):
        if rest.all():
            break
        at = value(z[:, None] + shift)
        with np.errstate(invalid="ignore"):
            slope = np.nan_to_num((at[:, :dim] - at[:, dim:]) / 2e-4, posinf=0.0, neginf=0.0)
        for i in np.flatnonzero(~rest):
            if before is not None and not plain[i]:
                move, turn = z[i] - before[0][i], slope[i] - before[1][i]
                if move @ turn > 1e-12:
                    left = np.eye(dim) - np.outer(move, turn) / (move @ turn)
                    curve[i] = left @ curve[i] @ left.T + np.outer(move, move) / (move @ turn)
        way = -np.einsum("ijk,ik->ij", curve, slope)
        size = np.linalg.norm(way, axis=1, keepdims=True)
        way = way / np.maximum(size, 1.0)
        tried = np.clip(z[:, None] + lengths[:, None] * way[:, None], -9.0, 9.0)
        found = value(tried)
        pick = found.argmin(axis=1)
        before = z.copy(), slope
        for i in np.flatnonzero(~rest):
            gain = best[i] - found[i, pick[i]]
            if gain > 0:
                z[i], best[i] = tried[i, pick[i]], found[i, pick[i]]
            if gain > tol:
                plain[i] = False
            elif plain[i]:
                rest[i] = True
            else:  # once more along the plain slope
                curve[i], plain[i] = np.eye(dim), True
    own = ets_score(y, s, form, starts)
    worse = ~(best <= own)
    return np.where(worse[:, None], starts, par(z)), np.where(worse, own, best)


def ets_parameters(y: np.ndarray, s: int, form: tuple) -> tuple[np.ndarray, float]:
    """Parameters of least -2 log likelihood and that: searched from the best of a coarse grid and from the best of those with another alpha."""
    rows = ets_coarse(form)
    score = ets_score(y, s, form, rows)
    first = rows[score.argmin()]
    other = rows[np.where(rows[:, 0] == first[0], np.inf, score).argmin()]
    found, score = ets_search(y, s, form, np.array([first, other]))
    return found[score.argmin()], float(score.min())


def ets(y: np.ndarray, horizon: int, form: tuple = ("add", "add", "add", True), s: int = 24, seed: int = 1, paths: int = 400) -> Fit:
    """One form of exponential smoothing: parameters by a quasi-Newton search of the likelihood, AIC as score, band from simulated paths."""
    error, trend, season, damped = form
    s = s if season else 1
    if len(y) < 2 * max(s, 2) + 2:
        raise ValueError(f"under {2 * max(s, 2) + 2} values")
    best, least = ets_parameters(y, s, form)
    if not np.isfinite(least):
        raise ValueError("no finite likelihood")
    hats, level, slope, ss = (x[..., 0] for x in _smooth(y, s, form, best[None]))
    with np.errstate(all="ignore"):
        e = y - hats if error == "add" else (y - hats) / hats
    free = (trend is not None) + (season is not None) + damped + 1
    states = 1 + (trend is not None) + (s if season else 0)
    sd, rng = float(np.sqrt(np.mean(e * e))), np.random.default_rng(seed)
    draws = np.vstack([np.zeros((1, horizon)), rng.normal(0, sd, (paths, horizon))])
    out, k = np.empty((paths + 1, horizon)), paths + 1
    level, slope, ss = np.full(k, level), np.full(k, slope), np.repeat(ss[:, None], k, axis=1)
    a, b, g, phi = best
    with np.errstate(all="ignore"):
        for h in range(horizon):
            moved = level + phi * slope if trend == "add" else level * slope**phi if trend == "mul" else level
            c = ss[(len(y) + h) % s]
            hat = moved + c if season == "add" else moved * c if season == "mul" else moved
            raw = draws[:, h] if error == "add" else draws[:, h] * hat
            out[:, h] = hat + raw
            own = raw / c if season == "mul" else raw
            slope = phi * slope + a * b * own if trend == "add" else slope**phi + a * b * own / np.maximum(np.abs(level), 1e-9) if trend == "mul" else slope
            if season == "add":
                ss[(len(y) + h) % s] = c + g * raw
            elif season == "mul":
                ss[(len(y) + h) % s] = c + g * raw / np.maximum(np.abs(moved), 1e-9)
            level = moved + a * own
    if not np.isfinite(out[0]).all():
        raise ValueError("the forecast isn't finite")
    low, high = np.nanquantile(out[1:], [0.025, 0.975], axis=0)
    return out[0], low, high, least + 2 * (free + states + 1)


def ets_grid(y: np.ndarray) -> list[dict]:
    s = int(next(iter(periods_of(y, 365)), 1))
    s = s if 1 < s <= len(y) // 3 else 24 if len(y) >= 72 else 1
    return [{"form": f, "s": s} for f in ets_forms(bool((y > 0).all())) if f[2] is None or s > 1]


# trend and Fourier terms


def _trend_terms(n: int, horizon: int, trend_prior: float, season_prior: float, periods: tuple, knots: int, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Columns of level, slope, changes of slope (knots even over the first 80 %) and Fourier terms, and the scales of their Gaussian and Laplace priors."""
    at = np.arange(n + horizon) / max(1, n - 1)
    cuts = np.unique(np.linspace(0, max(int(0.8 * n) - 1, 1), knots + 1).round()[1:]) / max(1, n - 1)
    waves = [f(2 * np.pi * k * np.arange(n + horizon) / p) for p in periods for k in range(1, min(order, p // 2) + 1) for f in (np.sin, np.cos)]
    x = np.column_stack([np.ones(n + horizon), at, *(np.maximum(0, at - c) for c in cuts), *waves])
    gauss = np.r_[5.0, 5.0, np.full(len(cuts), np.inf), np.full(len(waves), season_prior)]
    return x, gauss, np.where(np.isfinite(gauss), np.inf, trend_prior)


def fourier(y: np.ndarray, horizon: int, trend_prior: float = 0.1, season_prior: float = 10.0, periods: tuple = (), knots: int = 25, order: int = 5) -> Fit:
    """Piecewise-linear trend and Fourier terms at given periods, of greatest posterior density: changes of slope have a Laplace prior, so most are zero, the rest Gaussian ones; the band counts trend changes ahead."""
    n, scale = len(y), np.abs(y).max() or 1.0
    if n < 10:
        raise ValueError("under 10 values")
    x, gauss, prior = _trend_terms(n, horizon, trend_prior, season_prior, periods, knots, order)
    b, var = laplace.fit(x[:n], y / scale, gauss, prior)
    changes = b[np.isfinite(prior)]
    ahead = np.arange(1, horizon + 1) / max(1, n - 1)
    drift = 2 * np.abs(changes).mean() ** 2 * len(changes) / 0.8 * ahead**3 / 3
    hat = scale * (x[n:] @ b)
    sd = scale * np.sqrt(var + drift)
    return hat, hat - Z * sd, hat + Z * sd, float(n * np.log(var))


def fourier_grid(y: np.ndarray) -> list[dict]:
    periods = tuple(int(p) for p in periods_of(y, min(365, len(y) // 2)))
    return [{"trend_prior": a, "season_prior": b, "periods": periods} for a, b in product((0.01, 0.1, 0.5), (1.0, 10.0))]


# decomposed linear maps


def dlinear(y: np.ndarray, horizon: int, times: int = 2, smooth: int = 25, steps: int = 200, rate: float = 0.005) -> Fit:
    """Linear maps from a window's moving average and from the rest to all hours ahead at once, trained by Adam; window: `times` the horizon."""
    window = times * horizon
    count = len(y) - window - horizon + 1
    if count < 4:
        raise ValueError(f"under {window + horizon + 3} values")
    mean, sd = y.mean(), y.std() or 1.0
    z = (y - mean) / sd

    def parts(w: np.ndarray) -> np.ndarray:
        pad = np.pad(w, ((0, 0), (smooth // 2, smooth - 1 - smooth // 2)), mode="edge")
        c = np.cumsum(np.pad(pad, ((0, 0), (1, 0))), axis=1)
        trend = (c[:, smooth:] - c[:, :-smooth]) / smooth
        return np.concatenate([trend, w - trend, np.ones((len(w), 1))], axis=1)

    rows = np.lib.stride_tricks.sliding_window_view(z, window + horizon)
    x, goal = parts(rows[:, :window]), rows[:, window:]
    w = np.vstack([np.full((2 * window, horizon), 1 / window), np.zeros((1, horizon))])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for i in range(1, steps + 1):
        grad = x.T @ (x @ w - goal) * (2 / len(x))
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= rate * (m / (1 - 0.9**i)) / (np.sqrt(v / (1 - 0.999**i)) + 1e-8)
    res = (goal - x @ w) * sd
    return flat_band(mean + sd * (parts(z[-window:][None]) @ w)[0], float(res.std()), float(np.mean(res * res)))


def dlinear_grid(y: np.ndarray) -> list[dict]:
    return [{"times": t, "smooth": m, "steps": s} for t, m, s in product((2, 3), (25, 49), (200, 500))]


# detected seasons


def detected_naive(y: np.ndarray, horizon: int, seasons: Iterable[int] = (24, 168)) -> Fit:
    """The last season repeated: of detected periods and the given ones, at least 2 and under the length, that of the least in-sample error."""
    each = [s for s in dict.fromkeys([*periods_of(y), *seasons]) if 2 <= s < len(y)]
    if not each:
        raise ValueError("no season is shorter than the series")
    errors = [float(np.abs(y[s:] - y[:-s]).mean()) for s in each]
    s = each[int(np.argmin(errors))]
    return flat_band(y[-s:][np.arange(horizon) % s], float((y[s:] - y[:-s]).std()), min(errors))


#: name -> (fit, candidates of its grid, scored on a holdout of the last fifth rather than by the fit's own score)
MODELS: dict[str, tuple[Callable[..., Fit], Callable[[np.ndarray], list[dict]], bool]] = {
    "ar": (ar, lambda y: [{}], False),
    "ets": (ets, ets_grid, False),
    "sarima": (sarima, sarima_grid, False),
    "sarima_wide": (sarima, lambda y: sarima_grid(y, 4, 1, 50), False),
    "prophet_like": (fourier, fourier_grid, True),
    "dlinear": (dlinear, dlinear_grid, True),
    "detected_naive": (detected_naive, lambda y: [{}], False),
    "auto_weekly": (sarima, weekly_grid, False),
    "sarimax_fixed": (sarima, lambda y: [{"order": (1, 1, 1), "seasonal": (1, 1, 1, 12)}], False),
}
#: Known models that need a library that isn't there.
UNAVAILABLE = ("nhits", "tft")


def _of(model: str) -> tuple[Callable[..., Fit], Callable[[np.ndarray], list[dict]], bool]:
    if model in UNAVAILABLE:
        raise ValueError(f"{model} is not available here")
    return MODELS[model]


def candidate_score(model: str, y: np.ndarray, own: dict) -> float:
    """Score of a candidate of the model's grid: that of the fit, or the root of the mean squared error on the last fifth."""
    fit, _, holdout = _of(model)
    if not holdout:
        return fit(y, 1, **own)[3]
    cut = round(0.8 * len(y))
    hat = fit(y[:cut], len(y) - cut, **own)[0]
    return float(np.sqrt(np.mean(np.square(y[cut:] - hat))))


def _types(df: DataFrame, by: list[str]) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema if f.name in by)


def candidates(rows: DataFrame, by: list[str]) -> DataFrame:
    """Grids of the series in (by, model, idx, y), made once each: (by, model, ordinal, params); null params where no grid can be made."""
    keys = [*by, "model"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            grid = [repr(own) for own in _of(key[-1])[1](pdf.sort_values("idx")["y"].to_numpy(float))]
        except (ValueError, np.linalg.LinAlgError):
            grid = [None]
        return pd.DataFrame([(*key, i, own) for i, own in enumerate(grid)], columns=[*keys, "ordinal", "params"])

    rows = rows.select(*keys, "idx", "y")
    return rows.groupBy(*keys).applyInPandas(run, f"{_types(rows, keys)}, ordinal int, params string")


def searched(rows: DataFrame, by: list[str]) -> DataFrame:
    """Every candidate of every series and model in (by, model, idx, y) with its score, a group for each: (by, model, ordinal, params, score, status). A failed fit has a null score and says why."""
    keys = [*by, "model", "ordinal", "params"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        score, status = None, "no grid"
        try:
            if key[-1] is not None:
                score, status = candidate_score(key[-3], pdf.sort_values("idx")["y"].to_numpy(float), literal_eval(key[-1])), "ok"
        except (ValueError, np.linalg.LinAlgError) as e:
            status = str(e)
        return pd.DataFrame([(*key, score, status)], columns=[*keys, "score", "status"])

    rows = rows.select(*by, "model", "idx", "y").join(candidates(rows, by), [*by, "model"])
    return spread(rows, *keys).groupBy(*keys).applyInPandas(run, f"{_types(rows, keys)}, score double, status string")


def grid_search(df: DataFrame, model: str) -> DataFrame:
    """Every candidate of a model's grid on each series' train rows: (series_id, model, ordinal, params, score, status). Expects series.split()."""
    return searched(df.where("train").withColumn("model", F.lit(model)), ["series_id"])


def best_candidates(grid: DataFrame, by: list[str]) -> DataFrame:
    """The first of the smallest score of each series: (by, ordinal, params, reason); where every fit failed they are null, and the reason is one of the failures'."""
    first = [F.expr(f"min_by({c}, struct(score, ordinal)) FILTER (WHERE score IS NOT NULL)").alias(c) for c in ("ordinal", "params")]
    return grid.groupBy(*by).agg(*first, F.min(F.expr("CASE WHEN score IS NULL THEN status END")).alias("reason"))


def _fitted(model: str, own: str | None, reason: str | None, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
    """Forecast of n values and its band by the candidate, and its status; no numbers where there is none or its fit fails."""
    none = np.full(n, np.nan)
    if own is None:
        return none, none, none, f"no candidate fits: {reason}"
    try:
        return *_of(model)[0](y, n, **literal_eval(own))[:3], "ok"
    except (ValueError, np.linalg.LinAlgError) as e:
        return none, none, none, str(e)


def forecast(df: DataFrame, model: str) -> DataFrame:
    """Forecast of each series' test rows by the best candidate of the model's grid; expects series.split(). Where no candidate fits, rows have no forecast and a status that says so."""
    best = best_candidates(grid_search(df, model), ["series_id"])
    rows = df.select("series_id", "idx", "y", "train").join(best, "series_id", "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        train, test = pdf[pdf["train"]], pdf[~pdf["train"]]
        hat, low, high, status = _fitted(model, pdf["params"].iloc[0], pdf["reason"].iloc[0], train["y"].to_numpy(float), len(test))
        return test[["series_id", "idx", "y"]].assign(y_hat=hat, lower=low, upper=high, status=status)

    done = rows.groupBy("series_id").applyInPandas(run, FORECAST)
    return done.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("y_hat", "lower", "upper")})


def walk_forward(df: DataFrame, origins: DataFrame, models: tuple[str, ...], horizon: int = 24, truth: str = "y") -> DataFrame:
    """Forecasts of fitted models at each origin: (series_id, cutoff, model, idx, y, y_hat, status). Each candidate of each series, origin and model is a group; a failed fit leaves one row that says why."""
    keys = ["series_id", "cutoff", "model"]
    each = origins.select("series_id", "cutoff").withColumn("model", F.explode(F.array(*map(F.lit, models))))
    rows = df.select("series_id", "idx", F.col("y").alias("seen"), F.col(truth).alias("y")).join(each, "series_id").where(F.expr(f"idx < cutoff + {horizon}"))
    past = rows.where("idx < cutoff").select(*keys, "idx", F.col("seen").alias("y"))
    rows = rows.join(best_candidates(searched(past, keys[:2]), keys), keys, "left")

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        past, test = pdf[pdf["idx"] < key[1]], pdf[pdf["idx"] >= key[1]]
        hat, _, _, status = _fitted(key[2], pdf["params"].iloc[0], pdf["reason"].iloc[0], past["seen"].to_numpy(float), len(test))
        out = pd.DataFrame({"series_id": key[0], "cutoff": key[1], "model": key[2], "idx": test["idx"].astype("Int64"), "y": test["y"], "y_hat": hat, "status": status})
        return out if status == "ok" else out.iloc[:1].assign(idx=None, y=None, y_hat=None)

    return rows.groupBy(*keys).applyInPandas(run, "series_id string, cutoff bigint, model string, idx bigint, y double, y_hat double, status string")


def ar_one_step(df: DataFrame, order: int = 24) -> DataFrame:
    """One-step predictions of the test rows by an autoregression fitted on the train rows; the mean so far where the train rows are too few for a fit. Expects series.split()."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        y, n = pdf["y"].to_numpy(float), int(pdf["train"].sum())
        test = pdf.iloc[n:]
        if n <= order:
            hat = np.array([y[:t].mean() if t else np.nan for t in range(n, len(y))])
        else:
            rows = np.lib.stride_tricks.sliding_window_view(y, order + 1)
            x = np.column_stack([np.ones(len(rows)), rows[:, :-1]])
            hat = x[n - order :] @ np.linalg.lstsq(x[: n - order], rows[: n - order, -1], rcond=None)[0]
        return pd.DataFrame({"series_id": test["series_id"], "idx": test["idx"], "y": test["y"], "y_hat": hat})

    return df.select("series_id", "idx", "y", "train").groupBy("series_id").applyInPandas(run, "series_id string, idx bigint, y double, y_hat double")


#: Coefficients that an MA(1) is chosen from.
MA_GRID = np.arange(-99, 100) / 100


def _ma1(d: np.ndarray, cut: int) -> tuple[np.ndarray, np.ndarray]:
    """Predictions of all differences by each coefficient, and the sums of squared errors of those before `cut`."""
    e, sums, states = np.zeros(len(MA_GRID)), np.zeros(len(MA_GRID)), np.empty((len(d), len(MA_GRID)))
    for t, v in enumerate(d):
        states[t] = MA_GRID * e
        e = v - states[t]
        if t < cut:
            sums += e * e
    return states, sums


def ma1_coefficients(df: DataFrame, test: int = 10) -> DataFrame:
    """(series_id, theta): the coefficient that rolling_ma1() goes by; series that are too short for a fit are left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = np.diff(pdf.sort_values("idx")["y"].to_numpy(float))
        own = pdf[["series_id"]].iloc[: int(len(d) - test > 2)]
        return own.assign(theta=float(MA_GRID[_ma1(d, len(d) - test)[1].argmin()]))

    return df.select("series_id", "idx", "y").groupBy("series_id").applyInPandas(run, "series_id string, theta double")


def rolling_ma1(df: DataFrame, test: int = 10) -> DataFrame:
    """One-step predictions of first differences by an MA(1) without intercept, fitted on all but the last `test` rows, whose state takes in each new value without a refit.

    The coefficient is that of the least squared errors among -0.99, -0.98, ... 0.99, the smallest on ties. Returns
    (series_id, idx, y, train, d, d_hat): d is the difference from the row before, d_hat its prediction. Undifference with series.undifference().
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("idx")
        y = pdf["y"].to_numpy(float)
        d = np.diff(y)
        cut = len(d) - test
        states, sums = _ma1(d, cut)
        hat = states[:, sums.argmin()] if cut > 2 else np.full(len(d), np.nan)
        return pd.DataFrame({"series_id": pdf["series_id"].iloc[1:], "idx": pdf["idx"].iloc[1:], "y": y[1:], "train": np.arange(len(d)) < cut, "d": d, "d_hat": hat})

    return df.select("series_id", "idx", "y").groupBy("series_id").applyInPandas(run, "series_id string, idx bigint, y double, train boolean, d double, d_hat double")


#: Two configurations of boosted trees: (depth, bins). The first is that of deep even trees, the second about one of 31 leaves.
BOOSTED = {"deep": (6, 64), "leaves31": (5, 255)}


def gbt_recursive(df: DataFrame, config: str = "deep", horizon: int = 24, trees: int = 60, rate: float = 0.1) -> DataFrame:
    """Boosted trees on lags, rolling means and calendar of all series, then one distributed step for each hour ahead; clipped to [0, 100].

    Expects series.split() with t. Series of under 170 train rows have no row with all features: they aren't learned from, and their rows come with the
    status "under 170 train rows". Band: 1.96 population deviations of the errors on train rows of the series, clipped too.
    """
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    from tarnflow.functions.scalars import clip
    from tarnflow.operators import series

    depth, bins = BOOSTED[config]
    names = [*(f"lag_{k}" for k in series.LAGS), "mean_24", "mean_168", "hour", "weekday", "weekend", "hour_sin", "hour_cos", "day_sin", "day_cos"]
    vector = VectorAssembler(inputCols=names, outputCol="x")
    train = df.where("train").select("series_id", "t", "idx", "y", "n_train")
    learned = vector.transform(series.calendar_features(series.lag_features(train)).na.drop()).select("series_id", "y", "x").checkpoint()
    out = df.where("idx >= n_train").where(F.col("idx") < F.col("n_train") + horizon).select("series_id", "idx", "y", "n_train")
    if learned.isEmpty():
        return out.select("series_id", "idx", "y", *(F.lit(None).cast("double").alias(c) for c in ("y_hat", "lower", "upper")), F.lit("under 170 train rows").alias("status"))
    model = GBTRegressor(featuresCol="x", labelCol="y", predictionCol="y_hat", maxIter=trees, maxDepth=depth, maxBins=bins, stepSize=rate, subsamplingRate=0.9, featureSubsetStrategy="0.9", seed=1).fit(learned)
    sd = model.transform(learned).groupBy("series_id").agg(F.stddev_pop(F.col("y") - F.col("y_hat")).alias("sd"))
    past = train.where("idx >= n_train - 169 and n_train >= 170")
    step = F.expr("interval 1 hour")
    w = series.by()
    for _ in range(horizon):
        ahead = past.groupBy("series_id").agg(F.max("t").alias("t"), F.max("idx").alias("idx"), F.max("n_train").alias("n_train"))
        ahead = ahead.select("series_id", (F.col("t") + step).alias("t"), (F.col("idx") + 1).alias("idx"), F.lit(None).cast("double").alias("y"), "n_train")
        x = series.calendar_features(series.lag_features(past.unionByName(ahead))).withColumn("next", F.lead("idx").over(w)).where("next is null")
        y = model.transform(vector.transform(x.drop("y"))).select("series_id", "t", "idx", clip(F.col("y_hat")).alias("y"), "n_train")
        past = past.unionByName(y).checkpoint()
    hat = past.where("idx >= n_train").select("series_id", "idx", F.col("y").alias("y_hat")).join(sd, "series_id")
    out = out.join(hat, ["series_id", "idx"], "left")
    band = {"lower": clip(F.col("y_hat") - Z * F.col("sd")), "upper": clip(F.col("y_hat") + Z * F.col("sd"))}
    status = F.when(F.col("y_hat").isNull(), "under 170 train rows").otherwise("ok")
    return out.withColumns(band).select("series_id", "idx", "y", "y_hat", *(F.when(F.col("y_hat").isNotNull(), F.col(c)).alias(c) for c in band), status.alias("status"))
