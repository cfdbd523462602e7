"""Cheapest paths to hubs, region by region: a task settles all stations of a region, and between rounds only labels at borders move."""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators.neighbours import Tree
from tarnflow.session import saved

#: Stations of a region at most (of many at one place: about).
SIZE = 512


def regions(stations: DataFrame, size: int = SIZE) -> DataFrame:
    """(t, zsid, region): stations of a cell that holds at most `size`; those of an even denser place are dealt by a hash. Stations without a place have no row, repeated ones the smallest region."""
    at = stations.where("e is not null and n is not null and not isnan(e) and not isnan(n)").select("t", "zsid", "e", "n")
    at = saved(at, "sites")
    if (at.groupBy("t").count().agg(F.max("count")).first()[0] or 0) <= size:
        return at.select("t", "zsid", F.lit("0").alias("region")).distinct()
    tree = Tree(at, size, size)
    cells = tree.descended(tree.rows, "tile").select("t", "zsid", F.concat_ws("/", "s", "cx", "cy").alias("region"))
    if tree.crowded():
        parts = cells.groupBy("t", "region").agg(F.ceil(F.count("*") / size).alias("parts"))
        cells = cells.join(parts, ["t", "region"]).select("t", "zsid", F.concat_ws("/", "region", F.pmod(F.xxhash64("zsid"), "parts")).alias("region"))
    return cells.groupBy("t", "zsid").agg(F.min("region").alias("region"))


def _settle(edges: pd.DataFrame, labels: pd.DataFrame, path: bool) -> list[tuple]:
    """Stations of a region whose labels are new, or get better by its own edges: (zsid, cost, hub, path)."""
    into: dict = {}
    for src, dst, cost in zip(edges["src"].tolist(), edges["dst"].tolist(), edges["cost"].tolist(), strict=True):
        into.setdefault(dst, []).append((src, cost))
    ways = [tuple(p) for p in labels["path"]] if path else [()] * len(labels)
    best, heap, changed = {}, [], set()
    for z, cost, hub, way, new in zip(labels["zsid"].tolist(), labels["cost"].tolist(), labels["hub"].tolist(), ways, labels["new"].tolist(), strict=True):
        if z not in best or (cost, hub, way) < best[z]:
            best[z] = (cost, hub, way)
        if new:
            heap.append((cost, hub, way, z))
            changed.add(z)
    heapq.heapify(heap)
    while heap:
        *label, z = heapq.heappop(heap)
        cost, hub, way = label
        if best[z] != (cost, hub, way):
            continue
        for src, more in into.get(z, ()):
            found = (cost + more, hub, (src, *way) if path else way)
            if (src not in best or found < best[src]) and src not in way:
                best[src] = found
                changed.add(src)
                heapq.heappush(heap, (*found, src))
    return [(z, *best[z]) for z in changed]


def hub_costs(edges: DataFrame, hubs: DataFrame, home: DataFrame, path: bool = False, counted: bool = False) -> DataFrame:
    """Cheapest cost from each station to a hub and which hub: (t, zsid, cost, hub), and the path of stations if asked for; the smaller hub id, then path, on ties.

    edges: (t, src, dst, cost), hubs: (t, zsid), home: (t, zsid, region) as of `regions`; a station without a
    region is one of its own. Each round settles the regions with new labels (one task each,
    at most a region's own edges) and carries what changed over edges between regions, so rounds are the regions that a
    path passes, not its stations; `counted` adds the round of each label. Every round is written, so a lost executor repeats only that.
    A path visits no station twice. Edges with a null, a NaN or both ends alike don't count, negative
    costs raise an error, unreachable stations have no row, and without hubs the result is empty.
    """
    edges = edges.where("src <> dst and t is not null and cost is not null and not isnan(cost)").select("t", "src", "dst", "cost")
    for end, name in (("src", "region"), ("dst", "far")):
        edges = edges.join(home.select("t", F.col("zsid").alias(end), F.col("region").alias(name)), ["t", end], "left")
        edges = edges.withColumn(name, F.coalesce(name, F.concat(F.lit("alone/"), F.col(end).cast("string"))))
    edges = saved(edges, "edges")
    if not edges.where("cost < 0").isEmpty():
        raise ValueError("a negative cost")
    inner, cross = edges.where("region = far").drop("far"), edges.where("region <> far").drop("far")

    names = ["cost", "hub", *["path"] * path]
    kinds = dict(hubs.dtypes)
    t, z = kinds["t"], kinds["zsid"]
    shape = f"t {t}, region string, zsid {z}, cost double, hub {z}" + f", path array<{z}>" * path

    def run(key: tuple, own: pd.DataFrame, labels: pd.DataFrame) -> pd.DataFrame:
        rows = [(*key, zsid, cost, hub, *[list(way)] * path) for zsid, cost, hub, way in _settle(own, labels, path)]
        return pd.DataFrame(rows, columns=["t", "region", "zsid", *names])

    start = hubs.where("t is not null and zsid is not null").distinct().join(home, ["t", "zsid"], "left")
    alone = F.concat(F.lit("alone/"), F.col("zsid").cast("string"))
    new = start.select("t", F.coalesce("region", alone).alias("region"), "zsid", F.lit(0.0).alias("cost"), F.col("zsid").alias("hub"), *[F.array("zsid").alias("path")] * path)
    new, best, turn = saved(new, "labels"), None, 0
    while not new.isEmpty():
        turn += 1
        active = new.select("t", "region").distinct()
        known = new.withColumn("new", F.lit(True))
        if best is not None:
            known = known.unionByName(best.drop("round").join(active, ["t", "region"], "left_semi").withColumn("new", F.lit(False)))
        own = inner.join(active, ["t", "region"], "left_semi").select("t", "region", "src", "dst", "cost")
        settled = saved(own.groupBy("t", "region").cogroup(known.groupBy("t", "region")).applyInPandas(run, shape), "settled")
        rows = settled.withColumn("round", F.lit(turn))
        if best is not None:
            rows = rows.unionByName(best).groupBy("t", "region", "zsid").agg(F.min(F.struct(*names, "round")).alias("m")).select("t", "region", "zsid", "m.*")
        best = saved(rows, "best")
        labels = settled.select("t", F.col("zsid").alias("dst"), F.col("cost").alias("rest"), *names[1:])
        way = [F.concat(F.array("src"), "path").alias("path")] * path
        step = cross.join(labels, ["t", "dst"])
        step = step.where("not array_contains(path, src)") if path else step
        step = step.select("t", "region", F.col("src").alias("zsid"), (F.col("cost") + F.col("rest")).alias("cost"), "hub", *way)
        step = step.groupBy("t", "region", "zsid").agg(F.min(F.struct(*names)).alias("m"))
        old = best.select("t", "region", "zsid", F.struct(*names).alias("old"))
        new = saved(step.join(old, ["t", "region", "zsid"], "left").where("old is null or m < old").select("t", "region", "zsid", "m.*"), "labels")
    out = new.withColumn("round", F.lit(turn)) if best is None else best
    return out.select("t", "zsid", *names, *["round"] * counted)
