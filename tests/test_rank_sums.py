"""The exact law of the rank sum against enumeration, and where it is used."""

from __future__ import annotations

from itertools import combinations
from math import comb

import numpy as np
import pytest

from tarnflow.operators import evaluation


@pytest.mark.parametrize("m,k", [(1, 1), (1, 9), (2, 7), (3, 8), (5, 5), (8, 8), (8, 3)])
def test_law_by_enumeration(m, k):
    sums = np.array([sum(c) for c in combinations(range(m + k), m)]) - m * (m - 1) // 2
    want = [int((sums == u).sum()) for u in range(m * k + 1)]
    assert evaluation.u_counts(min(m, k), max(m, k), m * k).tolist() == want
    for u in range(-1, m * k + 2):
        assert evaluation.u_at_most(u, m, k) == pytest.approx(float((sums <= u).mean()), abs=1e-15)


@pytest.mark.parametrize("m", range(1, 9))
def test_sum_of_draws_goes_on_where_counting_ends(m, monkeypatch):
    k = evaluation.COUNTED // m
    at = [int(m * k * f) for f in (1e-3, 0.05, 0.3, 0.5)]
    counted = [evaluation.u_at_most(u, m, k) for u in at]
    assert counted[-1] == pytest.approx(0.5, abs=1e-3) and sum(evaluation.u_counts(m, 20, m * 20)) == comb(m + 20, m)
    monkeypatch.setattr(evaluation, "COUNTED", 0)
    assert [evaluation.u_at_most(u, m, k) for u in at] == pytest.approx(counted, abs=1e-6)


def test_groups_without_ties_take_the_exact_law(spark):
    r = np.random.default_rng(4)
    rows = [("a", float(v)) for v in r.normal(-1, 1, 4)] + [("b", float(v)) for v in r.normal(0, 1, 30)] + [("c", float(v)) for v in r.normal(1, 1, 9)] + [("d", None)]
    for method in (evaluation.mann_whitney_less, evaluation.mann_whitney_others):
        got = {x.g: x for x in method(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
        assert set(got) == {"a", "b", "c"}
        for g, few in (("a", True), ("b", False), ("c", False)):
            mine, others = ([v for h, v in rows if (h == g) is own and v is not None] for own in (True, False))
            u = sum(x > y for x in mine for y in others)
            assert got[g].u == u
            assert (got[g].p == pytest.approx(evaluation.u_at_most(u, len(mine), len(others)), abs=1e-14)) is few
        tied = {x.g: x for x in method(spark.createDataFrame(rows + [("b", 5.0), ("c", 5.0)], "g string, v double"), "g", "v").collect()}
        assert tied["a"].p != pytest.approx(evaluation.u_at_most(int(tied["a"].u), 4, 41), abs=1e-6)
