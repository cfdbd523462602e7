"""The exact likelihood of seasonal ARMA against a dense normal density, and its search."""

import numpy as np
import pytest

from tarnflow.operators import arma, models

ORDERS = [(0, 0, 0, 0, 1), (1, 0, 0, 0, 1), (0, 1, 0, 0, 1), (2, 2, 0, 0, 1), (1, 1, 1, 1, 4), (2, 0, 0, 1, 7), (0, 2, 1, 0, 12), (0, 0, 1, 1, 24)]


def covariance(ar, ma, n, terms=20_000):
    """Of n values with errors of variance 1, from the responses to one error."""
    psi = np.zeros(terms)
    for i in range(terms):
        psi[i] = (ma[i] if i < len(ma) else 0) - sum(ar[j] * psi[i - j] for j in range(1, min(i, len(ar) - 1) + 1))
    gamma = np.array([psi[: terms - k] @ psi[k:] for k in range(n)])
    return gamma[np.abs(np.subtract.outer(np.arange(n), np.arange(n)))]


def simulated(ar, ma, n, seed, burn=500):
    e = np.random.default_rng(seed).normal(size=n + burn)
    x = np.zeros(n + burn)
    for t in range(len(ma) + len(ar), n + burn):
        x[t] = ma @ e[t - np.arange(len(ma))] - ar[1:] @ x[t - 1 - np.arange(len(ar) - 1)]
    return x[burn:]


@pytest.mark.parametrize("order", ORDERS)
def test_likelihood_is_the_dense_normal_one(order):
    r = np.random.default_rng(sum(order))
    u = r.uniform(-0.9, 0.9, (3, sum(order[:4])))
    x = r.normal(size=60).cumsum() * 0.3
    got, var, state, phi = arma.kalman(x, *arma.polynomials(u, *order))
    for i in range(3):
        ar, ma = (z[0] for z in arma.polynomials(u[i : i + 1], *order))
        cov = covariance(ar, ma, 63, 2_000)
        own = cov[:60, :60]
        best = x @ np.linalg.solve(own, x) / 60
        assert var[i] == pytest.approx(best) and got[i] == pytest.approx(60 * (np.log(2 * np.pi * best) + 1) + np.linalg.slogdet(own)[1])
        # the state foretells as the conditional mean does
        hats, z = [], state[i]
        for _ in range(3):
            hats.append(z[0])
            z = phi[i] * z[0] + np.append(z[1:], 0.0)
        assert np.allclose(hats, cov[60:, :60] @ np.linalg.solve(own, x), atol=1e-8)


def test_free_numbers_and_stability():
    r = np.random.default_rng(1)
    for n in range(1, 5):
        u = r.normal(size=(20, n)) * 0.7
        polys = arma.stable(u)
        assert np.allclose([arma.free(-c[1:]) for c in polys], u)
        assert all(np.abs(np.roots(c)).max() < 1 for c in polys)
    assert np.abs(np.roots(arma.stable(arma.free(np.array([1.4, -0.1]))[None])[0])).max() < 1
    assert arma.stable(np.zeros((2, 0)), 24).tolist() == [[1.0], [1.0]]


@pytest.mark.parametrize("order", [(1, 0, 0, 0, 1), (1, 1, 0, 0, 1), (0, 1, 0, 1, 12), (1, 0, 1, 0, 24)])
def test_search_is_no_worse_than_its_start_and_finds_the_coefficients(order):
    true = np.arctanh(np.array([0.6, -0.4, 0.5][: sum(order[:4])]))[None]
    ar, ma = arma.polynomials(true, *order)
    x = simulated(ar[0], ma[0], 1500, 4)
    u, score = arma.fit(x, *order)
    at = lambda v: arma.kalman(x, *arma.polynomials(v[None], *order))[0][0]
    assert score <= at(arma.regressions(x, *order)) and score <= at(true[0]) and score == pytest.approx(at(u))
    assert np.allclose(0.999 * np.tanh(u), np.tanh(true[0]), atol=0.1)
    # a second start ends there too, and no small move is better
    again, value = arma.least(lambda v: arma.kalman(x, *arma.polynomials(v, *order))[0], u + 0.3)
    assert value == pytest.approx(score, abs=0.05) and np.allclose(again, u, atol=0.05)
    assert all(at(u + d) > score - 0.01 for d in np.vstack([np.eye(len(u)), -np.eye(len(u))]) * 0.01)


def test_sarima_undoes_its_differences():
    y = np.cumsum(np.random.default_rng(2).normal(size=300)) + 5 * np.tile([0, 1, 3, 2], 75)
    hat, low, high, aic = models.sarima(y, 8, (0, 1, 0), (0, 1, 0, 4))
    plain = list(y)
    for _ in range(8):
        plain.append(plain[-1] + plain[-4] - plain[-5])
    assert np.allclose(hat, plain[300:]) and ((high - low)[1:] > (high - low)[:-1]).all() and np.isfinite(aic)
    with pytest.raises(ValueError, match="too few"):
        models.sarima(y[:30], 3, (1, 1, 1), (1, 1, 1, 12))
    flat = models.sarima(np.full(100, 3.0), 4, (1, 0, 1))
    assert np.allclose(flat[0], 3.0)
