"""Trend changes with a Laplace prior: conditions of the optimum, few changes, no worse than squares."""

from __future__ import annotations

import time

import numpy as np
import pytest

from tarnflow.operators import laplace, models


def bent(n: int = 400, at: float = 0.4, noise: float = 0.02, seed: int = 1) -> np.ndarray:
    r, t = np.random.default_rng(seed), np.arange(n) / (n - 1)
    return 1 + t - 2.5 * np.maximum(0, t - at) + 0.2 * np.sin(2 * np.pi * np.arange(n) / 24) + r.normal(0, noise, n)


@pytest.mark.parametrize("trend_prior", [0.01, 0.1, 0.5])
@pytest.mark.parametrize("kind", ["bent", "noise", "counts", "flat"])
def test_conditions_of_the_optimum(kind, trend_prior):
    r = np.random.default_rng(7)
    y = {"bent": bent(), "noise": r.normal(0, 1, 300), "counts": r.poisson(3, 500).astype(float), "flat": np.full(120, 2.0)}[kind]
    z = y / np.abs(y).max()
    x, gauss, prior = models._trend_terms(len(z), 0, trend_prior, 10.0, (24, 12), 25, 5)
    b, var = laplace.fit(x, z, gauss, prior)
    slope = x.T @ (z - x @ b) / var - b / np.square(gauss)
    scale = np.abs(x.T @ z).max() / var
    on = np.isfinite(prior) & (b != 0)
    off = np.isfinite(prior) & (b == 0)
    assert np.abs(slope[~np.isfinite(prior)]).max() < 1e-4 * scale
    assert np.abs(slope[on] - np.sign(b[on]) / prior[on]).max(initial=0) < 1e-4 * max(scale, 1 / trend_prior)
    assert np.all(np.abs(slope[off]) <= (1 + 1e-4) / trend_prior + 1e-6 * scale)


@pytest.mark.parametrize("trend_prior,most,share", [(0.01, 3, 0.95), (0.1, 10, 0.75)])
def test_one_change_gives_few(trend_prior, most, share):
    """The break lies between two knots: nearly all change is at these, and most of the 25 are exactly zero."""
    for seed in range(5):
        y = bent(seed=seed)
        x, gauss, prior = models._trend_terms(len(y), 0, trend_prior, 10.0, (24,), 25, 5)
        changes = np.abs(laplace.fit(x, y / np.abs(y).max(), gauss, prior)[0][np.isfinite(prior)])
        assert np.count_nonzero(changes) <= most and changes[11:13].sum() >= share * changes.sum()


def test_posterior_no_less_than_of_squares():
    """The ridge fit of the same terms, at its own best variance and at that of the fit, is nowhere likelier."""
    for y in (bent(), bent(seed=3, noise=0.3), np.random.default_rng(2).poisson(4, 300).astype(float)):
        z = y / np.abs(y).max()
        x, gauss, prior = models._trend_terms(len(z), 0, 0.1, 10.0, (24,), 25, 5)
        b, var = laplace.fit(x, z, gauss, prior)
        mine = laplace.cost(x, z, b, var, gauss, prior)
        both = np.where(np.isfinite(prior), prior, gauss)
        for v in (var, var * 0.9, var * 1.1):
            ridge = np.linalg.solve(x.T @ x + v * np.diag(1 / both**2), x.T @ z)
            assert laplace.cost(x, z, ridge, v, gauss, prior) >= mine
            assert laplace.cost(x, z, b, v, gauss, prior) >= mine


def test_forecast_goes_on_along_the_last_slope():
    hat, low, high, _ = models.fourier(bent(noise=0.01), 48, 0.1, 10.0, (24,))
    t = (400 + np.arange(48)) / 399
    want = 1 + t - 2.5 * (t - 0.4) + 0.2 * np.sin(2 * np.pi * (400 + np.arange(48)) / 24)
    assert np.abs(hat - want).max() < 0.06 and np.all(low < hat) and np.all(hat < high) and np.all(np.diff(high - low) >= 0)


def test_short_and_long_series_end():
    for n in (10, 11, 30, 5_000):
        began = time.time()
        out = models.fourier(np.random.default_rng(n).poisson(2, n).astype(float), 5, 0.01, 1.0, (7,))
        assert np.isfinite(np.concatenate(out[:3])).all() and time.time() - began < 20
    assert np.isfinite(models.fourier(np.zeros(50), 5)[0]).all()
