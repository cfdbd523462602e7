"""All pairs of stations against plain loops, and that they are made by blocks."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import spatial
from tarnflow.plans import catalog, networks  # noqa: F401
from tarnflow.sources import tables

PLACE = "t long, zsid long, e double, n double, cnt double"


def plain(rows: list, a: float = 0.5, b: float = 0.5) -> dict:
    """(dist, cost) of each (t, src, dst)."""
    out = {}
    for t in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == t]
        d = {(x[1], y[1]): (x[2] - y[2]) ** 2 + (x[3] - y[3]) ** 2 if None not in (*x[2:4], *y[2:4]) else None for x in own for y in own}
        known = [v for v in d.values() if v is not None]
        top = math.nan if any(v != v for v in known) else max(known, default=0)
        most = max((r[4] for r in own if r[4] is not None), default=0)
        for y in own:
            traffic = None if y[4] is None or not most else y[4] / most
            for x in own:
                v = d[x[1], y[1]]
                dist = None if v is None or top == 0 else v / top
                out[t, x[1], y[1]] = dist, 0.0 if x[1] == y[1] else None if dist is None or traffic is None else a * dist + b * traffic
    return out


def like(x: float | None, y: float | None) -> bool:
    return x is y or (None not in (x, y) and (x == pytest.approx(y, rel=1e-12) or (x != x and y != y)))


@pytest.fixture
def rows() -> list:
    r = np.random.default_rng(8)
    out = [(t, z, float(e), float(n), float(r.integers(1, 90))) for t, size in ((0, 70), (1, 9)) for z, (e, n) in enumerate(r.normal(size=(size, 2)))]
    out += [(2, 5, 1.0, 1.0, 3.0), (2, 6, 1.0, 1.0, None), (3, 1, None, 2.0, 4.0), (4, 1, 0.0, 0.0, 0.0), (4, 2, 3.0, 4.0, 0.0), (5, 1, float("inf"), 0.0, 1.0), (5, 2, 1.0, 0.0, 2.0)]
    return out + [(6, 1, float("nan"), None, 1.0), (6, 2, 1.0, 0.0, 2.0), (6, 3, None, 0.0, 2.0), (6, 4, 1.0, 2.0, 1.0), (7, 1, float("nan"), 1.0, 1.0), (7, 2, 1.0, 0.0, 2.0)]


@pytest.mark.parametrize("block", [4, 2_048])
def test_pairs_are_those_of_plain_loops(spark, rows, monkeypatch, block):
    monkeypatch.setattr(spatial, "BLOCK", block)
    df = spark.createDataFrame([*rows, (None, 1, 0.0, 0.0, 1.0)], PLACE)
    for weights in ((0.5, 0.5), (0.8, 0.2)):
        got = spatial.cost_edges(df, *weights).collect()
        want = plain(rows, *weights)
        assert len(got) == len(want)
        for r in got:
            assert all(map(like, (r.dist, r.cost), want[r.t, r.src, r.dst])), r


def test_pairs_of_a_snapshot_are_dealt_to_many_tasks_and_not_shuffled(spark, monkeypatch):
    """Where no table is small enough to be broadcast, one snapshot's pairs lie in many partitions, and no exchange or sort holds pairs."""
    monkeypatch.setattr(spatial, "BLOCK", 20)
    r = np.random.default_rng(9)
    df = spark.createDataFrame([(0, z, float(e), float(n), 1.0) for z, (e, n) in enumerate(r.normal(size=(300, 2)))], PLACE)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = spatial.cost_edges(df)
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    assert sum(sizes) == 300 * 300 and len(sizes) > 8 and max(sizes) < 300 * 300 / 4
    above = plan[: plan.index("Join")]
    assert "Exchange" not in above and "Sort " not in above


def test_rounding_of_pairs(spark):
    """As round() of Python and of Spark, but for exact halves; what isn't a number stays, and large numbers too."""
    r = np.random.default_rng(10)
    values = [*r.uniform(-2, 2, 5_000).tolist(), *(r.integers(0, 10**6, 2_000) / 1e6).tolist(), *(r.uniform(-1, 1, 500) * 1e8).tolist(), 0.0, 1.0, -1.0, 4e-7, 6e-7, 0.0000005, 1e300, -1e18, 2.5e9, None, math.nan, math.inf, -math.inf]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double")
    got = {x.i: x.v for x in catalog._rounded_pairs(df).collect()}
    want = {x.i: x.v for x in df.select("i", F.round("v", 6).alias("v")).collect()}
    assert [i for i, v in enumerate(values) if not (got[i] == want[i] or like(got[i], want[i]) and v != v)] == []


def test_pair_queries_round_by_doubles(spark):
    for name in ("cost_edges", "pair_distance_norm"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "1000000.0" in plan


def test_pairs_by_density_are_dealt_by_blocks(spark, monkeypatch):
    """Without broadcasts, each of the session's four shuffle partitions would hold whole snapshots, one of them a quarter of all pairs at least."""
    monkeypatch.setattr(spatial, "BLOCK", 10)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = catalog.QUERIES["cost_by_density"](spark, "/root/testdata/sf0.001")
        assert "1000000.0" in out._jdf.queryExecution().executedPlan().toString()
        sizes = [x["count"] for x in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    stations = tables.stations(spark, "/root/testdata/sf0.001").groupBy("t").count().collect()
    assert sum(sizes) == sum(r["count"] ** 2 for r in stations) and max(sizes) < sum(sizes) / 4
