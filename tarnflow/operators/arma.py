"""Seasonal ARMA by exact likelihood: a Kalman filter over many rows of coefficients at once, and a quasi-Newton search over free numbers."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import numpy as np

from tarnflow.operators.stationarity import ridge


def stable(u: np.ndarray, s: int = 1) -> np.ndarray:
    """Polynomials 1 - c_1 B^s - c_2 B^2s ... with all roots outside of the unit circle, one for each row of free numbers: their tanh are the partial autocorrelations."""
    r = 0.999 * np.tanh(u)
    c = np.zeros_like(r)
    for k in range(r.shape[1]):
        c[:, :k] -= r[:, k : k + 1] * c[:, :k][:, ::-1]
        c[:, k] = r[:, k]
    out = np.zeros((len(u), s * u.shape[1] + 1))
    out[:, 0] = 1.0
    out[:, s::s] = -c
    return out


def free(c: np.ndarray) -> np.ndarray:
    """Free numbers of the stable polynomial with these coefficients; of one near by where it isn't stable."""
    c, r = np.array(c, float), np.zeros(len(c))
    for k in range(len(c) - 1, -1, -1):
        r[k] = np.clip(c[k], -0.98, 0.98)
        c = (c[:k] + r[k] * c[:k][::-1]) / (1 - r[k] ** 2)
    return np.arctanh(r / 0.999)


def polynomials(u: np.ndarray, p: int, q: int, sp: int, sq: int, s: int) -> tuple[np.ndarray, np.ndarray]:
    """The autoregressive and the moving-average polynomial, plain times seasonal, of each row of p + sp + q + sq free numbers."""
    parts = np.split(u, np.cumsum([p, sp, q]), axis=1)
    out = []
    for own, seasonal in ((parts[0], parts[1]), (parts[2], parts[3])):
        a, b = stable(own), stable(seasonal, s)
        both = np.zeros((len(u), a.shape[1] + b.shape[1] - 1))
        for i in range(a.shape[1]):
            both[:, i : i + b.shape[1]] += a[:, i : i + 1] * b
        out.append(both)
    return out[0], out[1]


def kalman(x: np.ndarray, ar: np.ndarray, ma: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each row of polynomials: -2 log likelihood at the best variance of the errors, that variance, the predicted state after the last value, and phi.

    The state's covariance starts at its stationary value and moves by rank-one increments (Morf, Sidhu and Kailath, 1974), so a step takes
    as long as the state is, not its square; once the increments vanish only the state moves. Row t of the state is what is known of x t steps ahead.
    """
    k, r = len(ar), max(ar.shape[1] - 1, ma.shape[1])
    phi, theta, psi = np.zeros((k, r)), np.zeros((k, r)), np.zeros((k, r))
    phi[:, : ar.shape[1] - 1], theta[:, : ma.shape[1]] = -ar[:, 1:], ma
    for i in range(r):
        psi[:, i] = theta[:, i] + (phi[:, :i] * psi[:, :i][:, ::-1]).sum(axis=1)
    # autocovariances: gamma_i - sum_l phi_l gamma_|i-l| = sum_j theta_j psi_{j-i}
    right = np.stack([*((theta[:, j:] * psi[:, : r - j]).sum(axis=1) for j in range(r)), np.zeros(k)], axis=1)
    left, rows = np.tile(np.eye(r + 1), (k, 1, 1)), np.arange(r + 1)
    for lag in range(1, r + 1):
        left[:, rows, np.abs(rows - lag)] -= phi[:, lag - 1 : lag]
    gamma = np.linalg.solve(left, right[..., None])[..., 0]
    start = np.stack([(phi[:, j:] * gamma[:, 1 : r - j + 1]).sum(axis=1) + right[:, j] for j in range(r)], axis=1)

    def ahead(z: np.ndarray) -> np.ndarray:
        out = phi * z[:, :1]
        out[:, :-1] += z[:, 1:]
        return out

    f, gain, state = start[:, 0].copy(), ahead(start), np.zeros((k, r))
    w, m, moves = gain, -1 / f, True
    squares, logs = np.zeros(k), np.zeros(k)
    for t, value in enumerate(x):
        share = (value - state[:, 0]) / f
        squares += share * share * f
        logs += np.log(f)
        state = ahead(state) + gain * share[:, None]
        if moves:
            head, moved, old = w[:, 0], ahead(w), f
            f = f + m * head * head
            gain = gain + moved * (m * head)[:, None]
            m = m + m * m * head * head / old
            w = moved - gain * (head / f)[:, None]
            moves = bool(t % 16 or (np.abs(m)[:, None] * w * w).max() > 1e-10)
    var = np.maximum(squares / len(x), 1e-300)
    return len(x) * (np.log(2 * np.pi * var) + 1) + logs, var, state, phi


def least(value: Callable[[np.ndarray], np.ndarray], u: np.ndarray, rounds: int = 40, gain: float = 5e-3, width: float = 1e-4) -> tuple[np.ndarray, float]:
    """Minimum of a function of rows, from u, by BFGS: central differences in one call, then the best of twelve lengths of a step in another. Never above the start."""
    n, best = len(u), float(value(u[None])[0])
    if not n:
        return u, best

    def slope(at: np.ndarray) -> np.ndarray:
        both = value(np.concatenate([at + width * np.eye(n), at - width * np.eye(n)]))
        return (both[:n] - both[n:]) / (2 * width)

    g = slope(u)
    fresh, h = True, np.eye(n) / max(1.0, np.abs(g).max())
    for _ in range(rounds):
        lengths = 0.5 ** np.arange(-2, 10)
        steps = np.clip(u - lengths[:, None] * (h @ g), -4, 4)
        found = value(steps)
        i = int(found.argmin())
        if not found[i] < best - gain:
            if fresh:
                break
            fresh, h = True, np.eye(n) / max(1.0, np.abs(g).max())
            continue
        d, after = steps[i] - u, slope(steps[i])
        e = after - g
        u, best, g = steps[i], float(found[i]), after
        if d @ e > 1e-12:
            h = np.eye(n) * (d @ e) / (e @ e) if fresh else h
            turn = np.eye(n) - np.outer(d, e) / (d @ e)
            h, fresh = turn @ h @ turn.T + np.outer(d, d) / (d @ e), False
        else:
            fresh, h = True, np.eye(n) / max(1.0, np.abs(g).max())
    return u, best


def regressions(x: np.ndarray, p: int, q: int, sp: int, sq: int, s: int) -> np.ndarray:
    """Free numbers to start from, by Hannan and Rissanen's two regressions: the first gives errors, the second the coefficients. Zeros where values are too few."""
    own_a, own_m = ([*range(1, a + 1), *(s * j for j in range(1, b + 1))] for a, b in ((p, sp), (q, sq)))
    long = max(20, *own_a, *own_m, 0)
    at = long + max([*own_m, 0])
    if len(x) < 2 * long + 20 or len(x) - at < len(own_a) + len(own_m) + 10 or not own_a + own_m:
        return np.zeros(p + q + sp + sq)
    rows = np.lib.stride_tricks.sliding_window_view(x, long + 1)
    e = np.concatenate([np.zeros(long), rows[:, -1] - rows[:, :-1] @ ridge(rows[:, :-1], rows[:, -1])])
    b = ridge(np.column_stack([x[at - i : len(x) - i] for i in own_a] + [e[at - i : len(e) - i] for i in own_m]), x[at:])
    a, m = b[: p + sp], -b[p + sp :]
    return np.concatenate([free(c) for c in (a[:p], a[p:], m[:q], m[q:])])


#: Partial autocorrelations that seasonal coefficients start from, beside the regressions' own: a likelihood with both has several peaks.
SEASONAL_STARTS = (-0.5, 0.0, 0.5, 0.9, 0.97)
#: Without a season the search runs from so many of the likeliest starts, with one from the likeliest.
SEARCHES = 2


def fit(x: np.ndarray, p: int, q: int, sp: int, sq: int, s: int, gain: float = 5e-3) -> tuple[np.ndarray, float]:
    """Free numbers of the largest likelihood found, and -2 log likelihood there; never less likely than the regressions or the fit without a season.

    Starts: plain coefficients from the regressions (with a season: from the fit without one), or either kind of them 0, with seasonal ones from SEASONAL_STARTS.
    """

    def value(u: np.ndarray) -> np.ndarray:
        with np.errstate(all="ignore"):
            out = kalman(x, *polynomials(u, p, q, sp, sq, s))[0]
        return np.where(np.isfinite(out), out, np.inf)

    own = regressions(x, p, q, sp, sq, s)
    plain = [own[[*range(p), *range(p + sp, p + sp + q)]]] if sp + sq == 0 else [fit(x, p, q, 0, 0, 1, gain)[0]]
    for i, j in ((1, 0), (0, 1), (0, 0)):
        plain.append(plain[0] * ([i] * p + [j] * q))
    seasonal = np.arctanh(np.array(SEASONAL_STARTS))
    starts = [own]
    for z, c, e in product(plain, product(seasonal, repeat=sp), product(seasonal, repeat=sq)):
        starts.append(np.concatenate([z[:p], c, z[p:], e]))
    starts = np.unique(np.stack(starts), axis=0)
    order = value(starts).argsort(kind="stable")[: 1 if sp + sq else SEARCHES]
    return min((least(value, starts[i], gain=gain) for i in order), key=lambda found: found[1])
