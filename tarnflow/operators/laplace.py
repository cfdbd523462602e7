"""Regression with Gaussian priors on some coefficients and Laplace priors on the others, by coordinate descent."""

from __future__ import annotations

import numpy as np


def _shrunk(q: np.ndarray, quad: np.ndarray, rate: np.ndarray, d: np.ndarray, sweeps: int = 40, tries: int = 500) -> np.ndarray:
    """Least of d' quad d / 2 - q' d + rate |d|. After some sweeps the set of non-zero ones and their signs are tried as final; done once no slope contradicts them."""
    d, g = d.copy(), quad @ d
    for _ in range(tries):
        for _ in range(sweeps):
            for j in range(len(d)):
                at = q[j] - g[j] + quad[j, j] * d[j]
                new = np.sign(at) * max(abs(at) - rate[j], 0.0) / quad[j, j]
                if new != d[j]:
                    g += quad[:, j] * (new - d[j])
                    d[j] = new
        on = d != 0
        trial = np.zeros_like(d)
        trial[on] = np.linalg.solve(quad[np.ix_(on, on)], q[on] - rate[on] * np.sign(d[on]))
        slope = quad @ trial - q
        if (np.sign(trial[on]) == np.sign(d[on])).all() and (np.abs(slope[~on]) <= rate[~on] * (1 + 1e-7)).all():
            return trial
        g = quad @ d
    return d


def cost(x: np.ndarray, z: np.ndarray, b: np.ndarray, var: float, gauss: np.ndarray, laplace: np.ndarray) -> float:
    """Negative log posterior, but for constants: normal errors, whose deviation has a half-normal prior of scale 0.5; gauss and laplace are the priors' scales (inf where a coefficient has none of that kind)."""
    res = z - x @ b
    return float(len(z) / 2 * np.log(var) + res @ res / (2 * var) + 2 * var + np.sum(np.square(b / gauss)) / 2 + np.sum(np.abs(b) / laplace))


def fit(x: np.ndarray, z: np.ndarray, gauss: np.ndarray, laplace: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Coefficients and error variance of greatest posterior density: each given the other in turn, until neither moves the cost by more than 1e-9 of it."""
    flat = ~np.isfinite(laplace)
    a, s = x[:, flat], x[:, ~flat]
    aa, as_, ss, az, sz = a.T @ a, a.T @ s, s.T @ s, a.T @ z, s.T @ z
    b, var, last = np.zeros(x.shape[1]), max(float(np.var(z)), 1e-12), np.inf
    for _ in range(rounds):
        own = aa + np.diag(var / np.square(gauss[flat])) + 1e-9 * np.eye(len(aa))
        inv = np.linalg.solve(own, np.column_stack([as_, az]))
        quad = ss - as_.T @ inv[:, :-1]
        quad = (quad + quad.T) / 2 + 1e-9 * np.eye(len(ss))
        b[~flat] = _shrunk(sz - as_.T @ inv[:, -1], quad, var / laplace[~flat], b[~flat])
        b[flat] = inv[:, -1] - inv[:, :-1] @ b[~flat]
        rss, n = float(np.sum(np.square(z - x @ b))), len(z)
        var = max((np.sqrt(n * n + 16 * rss) - n) / 8, 1e-12)
        now = cost(x, z, b, var, gauss, laplace)
        if last - now <= 1e-9 * abs(now):
            break
        last = now
    return b, var
