"""Stations, nearest neighbours, density surfaces and cheapest paths, for all snapshots of a table at once."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tarnflow.operators import neighbours
from tarnflow.session import saved, spread

SNAP = "t"


def station_agg(df: DataFrame, first: tuple[str, ...] = ()) -> DataFrame:
    """One row for each snapshot and station: means of count and place, and of other columns (name, height, time) the first that isn't null, in the order of their values."""
    return df.groupBy(SNAP, "zsid").agg(F.avg("cnt").alias("cnt"), F.avg("e").alias("e"), F.avg("n").alias("n"), *(F.min(c).alias(c) for c in first))


def knn_impute(df: DataFrame, k: int = 4, how: str = "median", seed: int = 42) -> DataFrame:
    """Missing counts from the k nearest stations of the snapshot that have one: their median, mean, or one of them (sample: the first by a checksum); ties go to the smaller id."""
    df = saved(df, "counts")
    gaps, known = df.where("cnt is null"), df.where("cnt is not null")
    near = neighbours.nearest(gaps.select("t", F.col("zsid").alias("p"), "e", "n"), known, k, stored=True)
    near = near.select("t", F.col("p").alias("zsid"), F.col("zsid").alias("other")).join(known.select("t", F.col("zsid").alias("other"), F.col("cnt").alias("c")), ["t", "other"])
    drawn = F.min_by("c", F.md5(F.concat_ws("|", F.lit(str(seed)), "t", "zsid", "other")))
    fill = near.groupBy("t", "zsid").agg({"median": F.median("c"), "mean": F.avg("c"), "sample": drawn}[how].alias("filled"))
    return df.join(fill, ["t", "zsid"], "left").withColumn("cnt", F.coalesce("cnt", "filled")).drop("filled")


def spans(df: DataFrame) -> DataFrame:
    """(t, scale, most): the largest squared distance between two stations of each snapshot and the largest count; null instead of 0, and NaN if a place isn't finite. No pairs are made."""
    gap = F.isnan((F.col("e") - F.col("e")) + (F.col("n") - F.col("n")))  # infinity less itself is NaN too; a null place has no distance
    whole = df.groupBy("t").agg(F.max("cnt").alias("most"), F.bool_or(gap).alias("odd"))
    whole = whole.join(neighbours.widest(df.where(~gap)), "t", "left")
    top = F.when(F.col("odd"), F.lit(float("nan"))).otherwise(F.col("top"))
    return whole.select("t", F.nullif(top, F.lit(0.0)).alias("scale"), F.nullif("most", F.lit(0.0)).alias("most"))


def pair_distances(df: DataFrame) -> DataFrame:
    """(t, src, dst, dist, traffic): squared distances of all pairs of a snapshot over the largest, and the count of the goal over the largest.

    Stations are dealt to blocks, and each two blocks of a snapshot meet in a partition of their own: what is shuffled are stations, one copy for each
    block that they meet; pairs are made last and go straight to the result.
    """
    df = saved(df.select("t", "zsid", "e", "n", "cnt"), "stations")
    blocks = df.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    rows = df.join(spans(df), "t").join(blocks, "t").withColumns({"own": F.pmod(F.xxhash64("zsid"), "blocks").cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    left = rows.select("t", F.col("own").alias("a"), F.col("other").alias("b"), F.col("zsid").alias("src"), F.col("e").alias("e1"), F.col("n").alias("n1"))
    right = rows.select("t", F.col("other").alias("a"), F.col("own").alias("b"), F.col("zsid").alias("dst"), F.col("e").alias("e2"), F.col("n").alias("n2"), "scale", F.try_divide("cnt", "most").alias("traffic"))
    pairs = spread(left, "t", "a", "b").hint("shuffle_hash").join(spread(right, "t", "a", "b"), ["t", "a", "b"])
    dx, dy = F.col("e1") - F.col("e2"), F.col("n1") - F.col("n2")
    return pairs.select("t", "src", "dst", F.try_divide(dx * dx + dy * dy, "scale").alias("dist"), "traffic")


def cost_edges(df: DataFrame, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """cost = a * distance + b * traffic of the goal; 0 to itself."""
    return pair_distances(df).select("t", "src", "dst", "dist", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(a * F.col("dist") + b * F.col("traffic")).alias("cost"))


def knn_edges(df: DataFrame, k: int = 8, a: float = 0.5, b: float = 0.5) -> DataFrame:
    """The k nearest of each station, itself counted and then dropped: (t, src, dst, dist, cost) as of cost_edges(), without the pairs that are further."""
    df = saved(df.select("t", "zsid", "e", "n", "cnt"), "stations")
    whole = neighbours.widest(df).join(df.groupBy("t").agg(F.max("cnt").alias("most")), "t")
    whole = whole.select("t", "most", F.nullif("top", F.lit(0.0)).alias("scale"))
    near = neighbours.nearest(df.join(whole, "t").select("t", F.col("zsid").alias("p"), "e", "n", "scale"), df, k, stored=True)
    near = near.where("p <> zsid").select("t", F.col("p").alias("src"), F.col("zsid").alias("dst"), "d")
    goals = df.join(whole, "t").select("t", F.col("zsid").alias("dst"), "scale", F.try_divide("cnt", F.nullif("most", F.lit(0.0))).alias("traffic"))
    dist = F.try_divide("d", "scale")
    return near.join(goals, ["t", "dst"]).select("t", "src", "dst", dist.alias("dist"), (a * dist + b * F.col("traffic")).alias("cost"))


#: Cells of a tile, stations of a block, and cells of a tile that meet a block at once.
TILE, BLOCK, STEP = 4_096, 2_048, 512


def _tiled(points: DataFrame, df: DataFrame, work: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Points (t, p, e, n) against the stations of their snapshot: a task for each tile of points and block of stations, so that pairs stay inside of it and no snapshot has to fit into one task."""
    blocks = df.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    tiled = points.select("t", "p", "e", "n", F.floor(F.col("p") / TILE).alias("tile"))
    left = tiled.join(blocks, "t").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    right = df.join(blocks, "t").withColumn("block", F.pmod(F.xxhash64("zsid"), "blocks").cast("int")).drop("blocks").join(tiled.select("t", "tile").distinct(), "t")
    keys = ("t", "tile", "block")
    left, right = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (left, right))  # both may come from one frame
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(work, schema)


def nearest_station(points: DataFrame, df: DataFrame) -> DataFrame:
    """For each point (t, p, e, n) the nearest station of its snapshot; the smaller id on ties. Points of a snapshot without stations have no row."""
    return neighbours.nearest(points, df, 1).select("t", "p", "zsid")


def grid(df: DataFrame, size: int = 200) -> DataFrame:
    """size x size cells over each snapshot's bounding box; cell = row * size + column."""
    box = df.groupBy("t").agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    cells = box.withColumn("p", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(size * size - 1).cast("long"))))
    i, j = F.col("p") % size, F.floor(F.col("p") / size)
    return cells.select("t", "p", (F.col("e0") + i * (F.col("e1") - F.col("e0")) / (size - 1)).alias("e"), (F.col("n0") + j * (F.col("n1") - F.col("n0")) / (size - 1)).alias("n"))


def _kde_terms(df: DataFrame, weight: Column, h: float, name: str) -> DataFrame:
    """Per snapshot the inverse covariance and norm of a Gaussian kernel density with weights."""
    total = df.groupBy("t").agg(F.sum(weight).alias("total"))
    w = df.join(total, "t").withColumn("w", weight / F.col("total"))
    m = w.groupBy("t").agg(F.sum(F.col("w") * F.col("e")).alias("me"), F.sum(F.col("w") * F.col("n")).alias("mn"), (1 - F.sum(F.col("w") * F.col("w"))).alias("free"))
    c = w.join(m, "t")
    de, dn = F.col("e") - F.col("me"), F.col("n") - F.col("mn")
    cov = lambda x: h * h * F.sum(F.col("w") * x) / F.first("free")
    c = c.groupBy("t").agg(cov(de * de).alias("a"), cov(de * dn).alias("b"), cov(dn * dn).alias("d"), F.first("total").alias("total"))
    det = F.col("a") * F.col("d") - F.col("b") * F.col("b")
    return c.select("t", (F.col("d") / det).alias(f"a{name}"), (-F.col("b") / det).alias(f"b{name}"), (F.col("a") / det).alias(f"d{name}"), (1 / F.sqrt(det)).alias(f"norm{name}"), F.col("total").alias(f"total{name}"))


def kde_surface(points: DataFrame, df: DataFrame, h: float = 0.3) -> DataFrame:
    """Weighted over plain density at each point, times the sum of counts: (t, p, weight, log_weight). Exponents are taken relative to the nearest station's."""
    terms = _kde_terms(df, F.col("cnt"), h, "1").join(_kde_terms(df, F.lit(1.0), h, "2"), "t")

    def work(points: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            e, n, w1 = (own[c].to_numpy(float) for c in ("e", "n", "cnt"))
            forms = [[own[f"{c}{k}"].iloc[0] for c in "abd"] for k in "12"]
            for low in range(0, len(points), STEP):
                part = points.iloc[low : low + STEP]
                x, y = part["e"].to_numpy()[:, None] - e, part["n"].to_numpy()[:, None] - n
                row = {"t": part["t"], "p": part["p"]}
                for k, (a, b, d), w in (("1", forms[0], w1), ("2", forms[1], np.ones(len(e)))):
                    q = (x * x * a + 2 * x * y * b + y * y * d) / 2
                    row[f"m{k}"] = least = q.min(axis=1)
                    row[f"s{k}"] = np.exp(least[:, None] - q) @ w
                out.append(pd.DataFrame(row))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("t", "p", "m1", "s1", "m2", "s2")})

    rows = df.join(terms, "t").select("t", "zsid", "e", "n", "cnt", *(f"{c}{k}" for k in "12" for c in "abd"))
    parts = _tiled(points, rows, work, "t bigint, p bigint, m1 double, s1 double, m2 double, s2 double")
    parts = parts.groupBy("t", "p").agg(F.min("m1").alias("m1"), F.min("m2").alias("m2"), F.collect_list(F.struct("m1", "s1", "m2", "s2")).alias("of"))  # one for each block
    total = lambda k: F.aggregate("of", F.lit(0.0), lambda acc, x: acc + x[f"s{k}"] * F.exp(F.col(f"m{k}") - x[f"m{k}"]))
    out = parts.withColumns({"s1": total("1"), "s2": total("2")}).join(terms, "t")
    log = F.log(F.col("s1") * F.col("norm1")) - F.log(F.col("s2") / F.col("total2") * F.col("norm2")) + F.col("m2") - F.col("m1")
    ratio = F.col("s1") * F.col("norm1") / (F.col("s2") / F.col("total2") * F.col("norm2"))
    return out.select("t", "p", (ratio * F.exp(F.least(F.col("m2") - F.col("m1"), F.lit(300.0)))).alias("weight"), log.alias("log_weight"))


def nearest_cell(df: DataFrame, size: int) -> DataFrame:
    """The grid cell of each station by arithmetic: (t, zsid, p)."""
    box = df.groupBy("t").agg(F.min("e").alias("e0"), F.max("e").alias("e1"), F.min("n").alias("n0"), F.max("n").alias("n1"))
    at = lambda v, lo, hi: F.coalesce(F.floor(F.try_divide((F.col(v) - F.col(lo)) * (size - 1), F.nullif(F.col(hi) - F.col(lo), F.lit(0.0))) + 0.5), F.lit(0))
    return df.join(box, "t").select("t", "zsid", (at("n", "n0", "n1") * size + at("e", "e0", "e1")).cast("long").alias("p"))


#: A Gaussian window is cut after so many deviations.
TRUNCATE = 4.0


def gaussian_weights(sigma: float) -> list[float]:
    """Weights of the offsets -r to r, r = TRUNCATE * sigma rounded, that sum to 1."""
    r = int(TRUNCATE * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-r, r + 1)]
    return [v / sum(raw) for v in raw]


def gaussian_surface(df: DataFrame, size: int = 200, sigma: float = 3.0) -> DataFrame:
    """The count of the nearest station in each cell (0 if it has none), blurred: (t, p, value). Two passes along rows and columns, with values mirrored at the edges; each row or column is an array of `size`."""
    near = nearest_station(grid(df, size), df).join(df.select("t", "zsid", F.coalesce("cnt", F.lit(0.0)).alias("value")), ["t", "zsid"])
    weights, r = F.array(*map(F.lit, gaussian_weights(sigma))), (len(gaussian_weights(sigma)) - 1) // 2
    mirrored = lambda k: F.when(F.pmod(k, F.lit(2 * size)) < size, F.pmod(k, F.lit(2 * size))).otherwise(2 * size - 1 - F.pmod(k, F.lit(2 * size)))
    offsets = F.sequence(F.lit(-r), F.lit(r))

    def blurred(rows: DataFrame, line: str, place: str) -> DataFrame:
        lines = rows.groupBy("t", line).agg(F.transform(F.sort_array(F.collect_list(F.struct(place, "value"))), lambda x: x["value"]).alias("v"))
        smooth = lambda i: F.aggregate(offsets, F.lit(0.0), lambda acc, k: acc + F.get(weights, k + r) * F.get("v", mirrored(i + k).cast("int")))
        return lines.select("t", line, F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(size - 1)), smooth)).alias(place, "value"))

    cells = near.select("t", F.floor(F.col("p") / size).cast("int").alias("j"), (F.col("p") % size).cast("int").alias("i"), "value")
    both = blurred(blurred(cells, "j", "i"), "i", "j")
    return both.select("t", (F.col("j") * size + F.col("i")).cast("long").alias("p"), "value")


def density_per_node(df: DataFrame, size: int = 200, h: float = 0.3) -> DataFrame:
    """Each station's surface value, scaled so that a snapshot keeps its total."""
    cells = nearest_cell(df, size)
    where = grid(df, size).join(cells.select("t", "p").distinct(), ["t", "p"], "left_semi")
    at = cells.join(kde_surface(where, df, h), ["t", "p"])
    sums = at.groupBy("t").agg(F.sum("weight").alias("all")).join(df.groupBy("t").agg(F.sum("cnt").alias("total")), "t")
    return at.join(sums, "t").select("t", "zsid", (F.col("weight") * F.col("total") / F.col("all")).alias("density"))


def with_traffic(df: DataFrame, kind: str = "count") -> DataFrame:
    """Stations whose traffic is their raw count, or their smoothed density."""
    if kind == "count":
        return df
    return df.drop("cnt").join(density_per_node(df), ["t", "zsid"]).withColumnRenamed("density", "cnt")


def flagged(df: DataFrame, ids: list[int]) -> DataFrame:
    """Stations with a flag for those of a fixed list."""
    return df.withColumn("hub", F.col("zsid").isin(ids))


def hub_costs(edges: DataFrame, hubs: DataFrame, rounds: int | None = None, keep: Callable[[DataFrame], DataFrame] | None = None, path: bool = False) -> DataFrame:
    """Cheapest cost from each station to a hub and which hub: (t, zsid, cost, hub), and the path of stations if asked for; the smaller hub id, then path, on ties.

    Relaxes backwards from all hubs of all snapshots at once, until nothing
    changes. A cheapest path has fewer hops than the largest snapshot has stations (or `rounds`); if
    costs still change after so many, an error is raised. keep(frame) materialises a round. Unreachable stations have no row.
    """
    keep = keep or (lambda df: df.checkpoint())
    names = ["cost", "hub", *["path"] * path]
    best = keep(hubs.select("t", "zsid", F.lit(0.0).alias("cost"), F.col("zsid").alias("hub"), *([F.array("zsid").alias("path")] * path)).withColumn("changed", F.lit(True)))
    if rounds is None:
        at = edges.select("t", F.explode(F.array("src", "dst")).alias("zsid")).union(hubs.select("t", "zsid")).distinct()
        rounds = at.groupBy("t").count().agg(F.max("count")).first()[0] or 1
    for _ in range(rounds):
        if best.where("changed").isEmpty():
            return best.drop("changed")
        way = [F.concat(F.array("src"), "path").alias("path")] * path
        step = edges.join(best.where("changed").select("t", F.col("zsid").alias("dst"), F.col("cost").alias("rest"), "hub", *["path"] * path), ["t", "dst"])
        step = step.select("t", F.col("src").alias("zsid"), (F.col("cost") + F.col("rest")).alias("cost"), "hub", *way, F.lit(True).alias("new"))
        both = best.select("t", "zsid", *names, F.lit(False).alias("new")).unionByName(step)
        both = both.groupBy("t", "zsid").agg(F.min(F.struct(*names, "new")).alias("m"))
        best = keep(both.select("t", "zsid", *(F.col(f"m.{c}") for c in names), F.col("m.new").alias("changed")))
    if best.where("changed").isEmpty():
        return best.drop("changed")
    raise ValueError(f"costs still change after {rounds} rounds: a cycle of negative cost, or too few rounds")


def origins(df: DataFrame, count: int = 100, size: int = 200, seed: int = 42) -> DataFrame:
    """Draws of cells with replacement, by checksums: (t, draw, p), `count` for each snapshot."""
    draws = df.select("t").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))))
    text = F.concat_ws("|", F.lit(str(seed)), F.col("t").cast("string"), F.col("draw").cast("string"))
    return draws.withColumn("p", F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % (size * size))


def demand(df: DataFrame, costs: DataFrame, count: int = 100, size: int = 200, seed: int = 42) -> DataFrame:
    """How many of the drawn origins go to each hub, by way of their nearest station: (t, hub, n); a null hub counts those that reach none."""
    drawn = origins(df, count, size, seed)
    cells = grid(df, size).join(drawn.select("t", "p").distinct(), ["t", "p"], "left_semi")
    near = drawn.join(nearest_station(cells, df), ["t", "p"]).join(costs.select("t", "zsid", "hub"), ["t", "zsid"], "left")
    return near.groupBy("t", "hub").agg(F.count("*").alias("n"))


def lv95_to_wgs84(e: Column, n: Column) -> tuple[Column, Column]:
    """Longitude and latitude of Swiss LV95 metres by the published approximation (about 1 m)."""
    y, x = (e - 2_600_000) / 1_000_000, (n - 1_200_000) / 1_000_000
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lon * 100 / 36, lat * 100 / 36


def wgs84_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    r = 6_378_137.0
    return F.radians(lon) * r, F.log(F.tan(F.lit(0.7853981633974483) + F.radians(lat) / 2)) * r
