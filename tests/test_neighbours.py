"""Nearest neighbours against brute force, and how many pairs are looked at."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.operators import neighbours, spatial


def frame(spark, t, xy, ids=None, name="zsid"):
    ids = range(len(xy)) if ids is None else ids
    return spark.createDataFrame([(t, int(i), float(x), float(y)) for i, (x, y) in zip(ids, xy, strict=True)], f"t long, {name} long, e double, n double")


def plain(points, sites, k):
    """{p: ids of the k nearest}, the smaller id on ties."""
    out = {}
    for p, (x, y) in points.items():
        d = sorted(((a - x) * (a - x) + (b - y) * (b - y), i) for i, (a, b) in sites.items())
        out[p] = [i for _, i in d[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("t", "p", "rank").collect():
        out.setdefault(r.p, []).append(r.zsid)
    return out


def shapes(kind, n):
    r = np.random.default_rng(7)
    if kind == "even":
        return r.uniform(0, 1000, (n, 2))
    if kind == "clusters":
        return np.concatenate([r.normal(0, 1e-3, (n // 2, 2)), r.uniform(-500, 500, (n // 4, 2)), r.normal(300, 5, (n - n // 2 - n // 4, 2))])
    if kind == "lattice":
        return r.integers(0, 12, (n, 2)).astype(float)
    if kind == "line":
        return np.stack([r.uniform(0, 100, n), np.full(n, 3.0)], 1)
    return np.concatenate([np.zeros((n // 2, 2)), r.uniform(0, 1, (n - n // 2, 2))])


KINDS = ["even", "clusters", "lattice", "line", "one place"]


def test_nearest_is_brute_force(spark):
    """A snapshot of each shape; small cells, so that the tree is deep; points inside and far outside of the sites' box; ties; a snapshot of few sites, one of none."""
    r, want = np.random.default_rng(3), {7000: [900, 901]}
    lost = spark.createDataFrame([(1, 5000, None, 1.0), (1, 5001, float("nan"), 1.0)], "t long, zsid long, e double, n double")
    sites = frame(spark, 20, [(0.0, 0.0), (1.0, 1.0)], [900, 901]).union(lost)
    places = frame(spark, 20, [(0.2, 0.1)], [7000], "p").union(frame(spark, 30, [(0.2, 0.1)], [8000], "p")).union(lost)
    for t, kind in enumerate(KINDS):
        own = shapes(kind, 400)
        ids = r.permutation(len(own))
        points = np.concatenate([own[r.integers(0, len(own), 60)], r.uniform(-2000, 2000, (30, 2)), r.uniform(0, 1, (30, 2))])
        names = [t * 1000 + i for i in range(len(points))]
        sites, places = sites.union(frame(spark, t, own, ids)), places.union(frame(spark, t, points, names, "p"))
        want |= plain(dict(zip(names, points, strict=True)), dict(zip(ids.tolist(), own, strict=True)), 5)
    assert found(neighbours.nearest(places, sites, 5, cap=4, tile=16, chunk=16)) == want


def test_no_stations(spark):
    none = spark.createDataFrame([], "t long, zsid long, e double, n double")
    places = frame(spark, 1, [(0.0, 0.0)], name="p")
    assert neighbours.nearest(places, none, 3).count() == 0
    assert neighbours.nearest(places.limit(0), frame(spark, 1, [(1.0, 1.0)]), 3).count() == 0


def test_fifty_thousand_stations_in_one_snapshot(spark):
    """Against brute force on a sample; each station meets few others, and their number doesn't grow with the stations."""
    met, dealt = {}, {}
    for n in (12_500, 50_000):
        sites = np.concatenate([np.random.default_rng(1).uniform(0, 1e5, (n // 2, 2)), np.random.default_rng(2).normal(5e4, 50, (n - n // 2, 2))])
        made = spark.range(n).select(F.lit(1).cast("long").alias("t"), F.col("id").alias("zsid"))
        at = spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(sites)], "zsid long, e double, n double")
        df = made.join(at, "zsid").select("t", "zsid", "e", "n")
        points = df.select("t", F.col("zsid").alias("p"), "e", "n")
        mine, near = neighbours.candidates(points.withColumn("scale", F.lit(None).cast("double")), df, 8)
        key = [*neighbours.TILE_KEY, "chunk"]
        both = mine.groupBy(*key).agg(F.count("*").alias("a")).join(near.groupBy(*key).agg(F.count("*").alias("b")), key)
        row = both.agg(F.sum(F.col("a") * F.col("b")), F.sum("a"), F.sum("b")).first()
        met[n] = row[0] / n
        dealt[n] = row[2] / n
        assert row[1] == n
    assert max(met.values()) < 2_500 and met[50_000] < 1.5 * met[12_500]
    assert max(dealt.values()) < 20 and dealt[50_000] < 1.5 * dealt[12_500]
    got = found(neighbours.nearest(points.where("p % 500 = 3"), df, 8))
    x = sites
    for p, ids in got.items():
        d = ((x - x[p]) ** 2).sum(1)
        assert ids == np.lexsort((np.arange(n), d))[:8].tolist()
    assert len(got) == 100


def test_widest(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 50)
    df, want = frame(spark, 9, [(1.0, 1.0)], [9]), {9: 0.0}
    for t, kind in enumerate(KINDS):
        x = shapes(kind, 300)
        df, want[t] = df.union(frame(spark, t, x)), max(float(((x - p) ** 2).sum(1).max()) for p in x)
    assert {r.t: r.top for r in neighbours.widest(df).collect()} == pytest.approx(want, rel=1e-12)


def test_edges_are_those_of_all_pairs(spark):
    x = shapes("clusters", 200)
    df = frame(spark, 1, x).withColumn("cnt", F.col("zsid") % 17 + 0.5)
    from pyspark.sql.window import Window

    w = Window.partitionBy("t", "src").orderBy("dist", "dst")
    want = spatial.cost_edges(df).withColumn("rn", F.row_number().over(w)).where("rn <= 8 and src <> dst").drop("rn")
    key = lambda r: (r.src, r.dst)
    got = spatial.knn_edges(df)
    for a, b in zip(sorted(got.collect(), key=key), sorted(want.collect(), key=key), strict=True):
        assert key(a) == key(b) and a.dist == pytest.approx(b.dist, rel=1e-9) and a.cost == pytest.approx(b.cost, rel=1e-9)
