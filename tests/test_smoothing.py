"""The search of smoothing parameters: never worse than a grid, the same end from two starts, and where known parameters are."""

from __future__ import annotations

from itertools import product

import numpy as np
import pytest

from tarnflow.operators import models


def level_series(alpha: float, n: int = 1500, seed: int = 2) -> np.ndarray:
    """A level that moves by alpha times each error."""
    e = np.random.default_rng(seed).normal(0, 1, n)
    return 50 + e + alpha * np.r_[0, np.cumsum(e)[:-1]]


def hourly(n: int = 240, seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).poisson(20 + 10 * np.sin(2 * np.pi * np.arange(n) / 24)).astype(float) + 1


@pytest.mark.parametrize("form", models.ets_forms(True))
def test_no_form_is_worse_than_a_finer_grid(form):
    y, s = hourly(), 24 if form[2] else 1
    par, score = models.ets_parameters(y, s, form)
    assert score == pytest.approx(models.ets_score(y, s, form, par[None])[0], abs=1e-9)
    _, trend, season, damped = form
    fine = np.array(list(product((0.01, 0.05, 0.2, 0.5, 0.9), (0.01, 0.1, 0.4) if trend else (0.0,), (0.005, 0.01, 0.1, 0.4) if season else (0.0,), (0.82, 0.9, 0.97) if damped else (1.0,))))
    assert score <= models.ets_score(y, s, form, fine).min() + 1e-9
    assert np.all((par[[0]] > 0) & (par[[0]] < 1)) and (damped or par[3] == 1) and (trend or par[1] == 0) and (season or par[2] == 0)


@pytest.mark.parametrize("alpha", [0.1, 0.4, 0.8])
def test_known_alpha_from_two_starts(alpha):
    form = ("add", None, None, False)
    starts = np.array([[0.02, 0, 0, 1], [0.97, 0, 0, 1]])
    par, score = models.ets_search(level_series(alpha), 1, form, starts)
    assert par[0] == pytest.approx(par[1], abs=1e-3) and score[0] == pytest.approx(score[1], abs=1e-4)
    assert par[0, 0] == pytest.approx(alpha, abs=0.08)
    y = level_series(alpha)
    line = np.array([[a, 0, 0, 1] for a in np.linspace(0.001, 0.999, 999)])
    assert score.min() <= models.ets_score(y, 1, form, line).min() + 1e-6


def test_never_above_the_starts():
    y = hourly(seed=9)
    for form in (("add", "add", "add", True), ("mul", "mul", "mul", True), ("mul", None, "add", False)):
        rows = models.ets_coarse(form)
        rows = np.vstack([rows[:: max(1, len(rows) // 6)], [[0.99999, 0.0, 0.0, 1.0]]])
        before = models.ets_score(y, 24, form, rows)
        after = models.ets_search(y, 24, form, rows)[1]
        assert np.all((after <= before) | ~np.isfinite(before))
