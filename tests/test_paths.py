"""Cheapest paths by regions against relaxation by hops and a plain search."""

from __future__ import annotations

import heapq

import numpy as np
import pytest

from tarnflow.operators import paths, spatial
from tarnflow.session import checkpoints

EDGE, PLACE = "t long, src long, dst long, cost double", "t long, zsid long, e double, n double, cnt double"


def network(spark, each: int, snapshots: int, seed: int = 3):
    """Snapshots of different sizes, a third of the stations in one dense spot."""
    r = np.random.default_rng(seed)
    rows = []
    for t in range(snapshots):
        place = r.uniform(0, 1, (each // (t + 1), 2))
        place[::3] = 0.3 + place[::3] * 1e-3
        rows += [(t, z, float(e), float(n), float(r.integers(1, 50))) for z, (e, n) in enumerate(place)]
    return spark.createDataFrame(rows, PLACE)


def plain(edges: list, hubs: list) -> dict:
    """Label of each (t, zsid) by one search over everything."""
    into: dict = {}
    for t, src, dst, cost in edges:
        into.setdefault((t, dst), []).append((src, cost))
    best = {(t, z): (0.0, z) for t, z in hubs}
    heap = [(0.0, z, t, z) for t, z in hubs]
    while heap:
        cost, hub, t, z = heapq.heappop(heap)
        if best[t, z] != (cost, hub):
            continue
        for src, more in into.get((t, z), ()):
            if (cost + more, hub) < best.get((t, src), (np.inf, 0)):
                best[t, src] = (cost + more, hub)
                heapq.heappush(heap, (cost + more, hub, t, src))
    return best


def test_regions_are_small_and_hold_every_station(spark):
    df = network(spark, 3000, 2).union(spark.createDataFrame([(0, 9000 + i, 0.5, 0.5, 1.0) for i in range(400)], PLACE))
    got = paths.regions(df, 64)
    assert got.count() == df.count() == got.select("t", "zsid").distinct().count()
    sizes = sorted(r["count"] for r in got.groupBy("t", "region").count().collect())
    assert sizes[-1] < 2 * 64
    cells = {r.region for r in got.where("t = 0 and zsid >= 9000").select("region").distinct().collect()}
    assert len(cells) >= 400 // 64
    assert [r.region for r in paths.regions(df, 10**6).select("region").distinct().collect()] == ["0"]


@pytest.mark.parametrize("size", [40, 10**6])
def test_same_labels_and_paths_as_by_hops(spark, size):
    checkpoints(spark)
    df = network(spark, 400, 3)
    edges = spatial.knn_edges(df, 5).checkpoint()
    hubs = spark.createDataFrame([(0, 0), (0, 7), (1, 3), (2, 5), (2, 77)], "t long, zsid long")
    home = paths.regions(df, size)
    want = {tuple(r)[:2]: tuple(r)[2:] for r in spatial.hub_costs(edges, hubs, path=True).select("t", "zsid", "cost", "hub", "path").collect()}
    got = {tuple(r)[:2]: tuple(r)[2:] for r in paths.hub_costs(edges, hubs, home, path=True).select("t", "zsid", "cost", "hub", "path").collect()}
    assert got == want
    bare = {(r.t, r.zsid): (r.cost, r.hub) for r in paths.hub_costs(edges, hubs, home).collect()}
    assert bare == {k: v[:2] for k, v in want.items()} == plain([tuple(r) for r in edges.select("t", "src", "dst", "cost").collect()], [tuple(r) for r in hubs.collect()])


def test_rounds_are_regions_not_hops(spark):
    n = 2001
    edges = spark.createDataFrame([(0, i + 1, i, 1.0 + i % 7) for i in range(n - 1)], EDGE)
    home = paths.regions(spark.createDataFrame([(0, i, float(i), 0.0, 1.0) for i in range(n)], PLACE), 200)
    some = home.select("region").distinct().count()
    rows = paths.hub_costs(edges, spark.createDataFrame([(0, 0)], "t long, zsid long"), home, path=True, counted=True).collect()
    costs = np.concatenate([[0], np.cumsum(1.0 + np.arange(n - 1) % 7)])
    assert {r.zsid: r.cost for r in rows} == dict(enumerate(costs))
    assert all(r.path == list(range(r.zsid, -1, -1)) for r in rows)
    assert 10 <= some <= 20 and max(r["round"] for r in rows) == some


def test_a_path_that_returns_to_its_region(spark):
    """Stations of odd and even ids in two regions: each hop crosses, and a dear edge inside gives way to cheap ones outside."""
    rows = [(0, i + 1, i, 1.0) for i in range(6)] + [(0, 6, 0, 50.0), (0, 4, 0, 1.5)]
    home = spark.createDataFrame([(0, i, str(i % 2)) for i in range(7)], "t long, zsid long, region string")
    got = {r.zsid: (r.cost, r.path) for r in paths.hub_costs(spark.createDataFrame(rows, EDGE), spark.createDataFrame([(0, 0)], "t long, zsid long"), home, path=True).collect()}
    assert got[4] == (1.5, [4, 0]) and got[6] == (3.5, [6, 5, 4, 0]) and got[3] == (3.0, [3, 2, 1, 0])


def test_ties_nulls_loops_and_nothing(spark):
    """Free loops end, nulls and NaN don't count, a hub outside of all regions has its own row, ties go to the smaller hub and path."""
    rows = [(0, 1, 2, 0.0), (0, 2, 1, 0.0), (0, 1, 9, 1.0), (0, 2, 9, 1.0), (0, 1, 8, 1.0), (0, 3, 3, 0.0), (0, 4, None, 1.0), (None, 4, 9, 1.0), (0, 4, 9, float("nan")), (0, 5, 9, None)]
    edges = spark.createDataFrame(rows * 2, EDGE)
    home = spark.createDataFrame([(0, 1, "a"), (0, 2, "b")], "t long, zsid long, region string")
    hubs = spark.createDataFrame([(0, 8), (0, 9), (0, 9), (0, None), (1, 8)], "t long, zsid long")
    got = {(r.t, r.zsid): (r.cost, r.hub, r.path) for r in paths.hub_costs(edges, hubs, home, path=True).collect()}
    assert got == {(0, 8): (0.0, 8, [8]), (0, 9): (0.0, 9, [9]), (1, 8): (0.0, 8, [8]), (0, 1): (1.0, 8, [1, 8]), (0, 2): (1.0, 8, [2, 1, 8])}
    assert paths.hub_costs(edges.where("t > 5"), hubs, home).count() == 3
    assert paths.hub_costs(edges, hubs.where("t > 5"), home).count() == 0
    with pytest.raises(ValueError, match="negative"):
        paths.hub_costs(spark.createDataFrame([(0, 1, 2, -1.0)], EDGE), hubs, home)
