"""The k nearest sites of each point within its snapshot, by a tree of counted cells; no step meets all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.session import saved

#: A snapshot's box is cut into 4 x 4 cells, up to so many times.
LEVELS = 10
#: A cell of more sites than this is cut; a tile of points lies in a cell of at most so many sites; points that meet their candidates at once.
CAP, TILE, CHUNK = 16, 512, 2_048
#: A table of at most so many rows is broadcast.
FEW = 10_000
#: Relative room for rounding when a cell is left out because it is too far.
SLACK = 1e-9
#: Pairs of a chunk whose distances are held at once.
PAIRS = 2_000_000
#: What a cell knows: its sites, and their box.
CELL = ("s", "cx", "cy", "sites", "e0", "e1", "n0", "n1")


def _few(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= FEW else df


def _cell(axis: str, level: int | str) -> Column:
    """The cell of a place on an axis at a level."""
    return F.expr(f"shiftright({axis}, 2 * ({LEVELS} - {level}))")


def _bounds(e: str = "e", n: str = "n") -> list[Column]:
    return [F.min(e).alias("e0"), F.max(e).alias("e1"), F.min(n).alias("n0"), F.max(n).alias("n1")]


def _at(rows: DataFrame) -> DataFrame:
    """Rows that have a place."""
    return rows.where("e is not null and n is not null and not isnan(e) and not isnan(n)")


class Tree:
    """Cells of all snapshots' sites (t, zsid, e, n). Those of a snapshot of more than `tile` sites are cut down to `cap` sites (or the last level)."""

    def __init__(self, sites: DataFrame, cap: int = CAP, tile: int = TILE) -> None:
        self.cap, self.tile = cap, tile
        box = sites.groupBy("t").agg(F.min("e").alias("left"), F.min("n").alias("low"), F.greatest(F.max("e") - F.min("e"), F.max("n") - F.min("n")).alias("side"), F.count("*").alias("all"))
        self.box = saved(box.withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0)), "boxes")
        self.snapshots = self.box.count()
        self.rows = self.placed(sites)
        finest = self.rows.join(_few(self.box.select("t", F.when(F.col("all") > tile, LEVELS).otherwise(0).alias("depth")), self.snapshots), "t")
        finest = finest.groupBy("t", "x", "y", "depth").agg(F.count("*").alias("sites"), *_bounds()).withColumn("s", F.explode(F.expr("sequence(0, depth)")))
        sums = [F.sum("sites").alias("sites"), F.min("e0").alias("e0"), F.max("e1").alias("e1"), F.min("n0").alias("n0"), F.max("n1").alias("n1")]
        self.cells = saved(finest.groupBy("t", "depth", "s", _cell("x", "s").alias("cx"), _cell("y", "s").alias("cy")).agg(*sums), "cells")
        cut = [F.sum(F.when(F.col("sites") > c, 1).otherwise(0)).alias(n) for c, n in ((cap, "cap"), (tile, "tile"))]
        self.levels = {r["s"]: r for r in self.cells.where("depth > 0").groupBy("s").agg(*cut).collect()}

    def placed(self, rows: DataFrame) -> DataFrame:
        """Rows with their place (x, y) in the finest cells; places outside of the box count as on its border."""
        last = (1 << 2 * LEVELS) - 1
        at = lambda v, lo: F.greatest(F.lit(0), F.least(F.lit(last), F.floor((F.col(v) - F.col(lo)) / F.col("side") * (last + 1)))).cast("int")
        return rows.join(_few(self.box.select("t", "left", "low", "side"), self.snapshots), "t").withColumns({"x": at("e", "left"), "y": at("n", "low")}).drop("left", "low", "side")

    def cut(self, by: str) -> list[tuple[int, int, DataFrame]]:
        """Of each level the cells of more than `cap` or `tile` sites, and how many they are."""
        most = {"cap": self.cap, "tile": self.tile}[by]
        some = [(level, self.levels[level][by]) for level in sorted(self.levels) if level < LEVELS and self.levels[level][by]]
        return [(level, count, self.cells.where((F.col("s") == level) & (F.col("depth") > level) & (F.col("sites") > most))) for level, count in some]

    def crowded(self) -> bool:
        """Whether cells of the last level hold more than `cap` sites."""
        return LEVELS in self.levels and self.levels[LEVELS]["cap"] > 0

    def descended(self, rows: DataFrame, by: str) -> DataFrame:
        """Placed rows with their cell (s, cx, cy): the coarsest of at most `cap` or `tile` sites."""
        out = rows.withColumn("s", F.lit(0))
        for level, count, cells in self.cut(by):
            inner = cells.select("t", F.col("cx").alias("ax"), F.col("cy").alias("ay"), F.lit(level + 1).alias("below"))
            out = out.withColumns({"ax": _cell("x", level), "ay": _cell("y", level)}).join(_few(inner, count), ["t", "ax", "ay"], "left")
            out = out.withColumn("s", F.coalesce("below", "s")).drop("ax", "ay", "below")
        return out.withColumns({"cx": _cell("x", "s"), "cy": _cell("y", "s")}).drop("x", "y")


TILE_KEY = ["t", "ts", "tx", "ty"]


def _gaps() -> tuple[Column, Column]:
    """Squared least and largest distance of a tile's box (p-) from a cell's."""
    least, most = [], []
    for a in "en":
        lo, hi, c0, c1 = (F.col(c) for c in (f"p{a}0", f"p{a}1", f"{a}0", f"{a}1"))
        least.append(F.greatest(F.lit(0.0), c0 - hi, lo - c1))
        most.append(F.greatest(c1 - lo, hi - c0))
    return least[0] * least[0] + least[1] * least[1], most[0] * most[0] + most[1] * most[1]


def _pruned(frontier: DataFrame, k: int) -> DataFrame:
    """A tile's cells without those that are further than some that hold k sites already."""
    least, most = _gaps()
    rows = frontier.withColumns({"least": least, "most": most})
    so_far = Window.partitionBy(*TILE_KEY).orderBy("most", "s", "cx", "cy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("held", F.sum("sites").over(so_far))
    enough = F.min(F.when(F.col("held") >= k, F.col("most"))).over(Window.partitionBy(*TILE_KEY))
    return rows.withColumn("enough", enough).where(F.col("enough").isNull() | (F.col("least") <= F.col("enough") * (1 + SLACK))).drop("least", "most", "held", "enough")


def candidates(points: DataFrame, sites: DataFrame, k: int, cap: int = CAP, tile: int = TILE, chunk: int = CHUNK, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Points (t, p, e, n, scale) and the sites (t, zsid, e, n) that may be among their k nearest, both with the key (TILE_KEY and chunk) under which they meet.

    Points of a cell are a tile. All tiles go down the tree at once: a tile's cells are replaced by their
    children, and those that are too far for its box are left out. What is left near a leaf depends on k and the caps, not on the
    number of sites. Tiles of many points are dealt to chunks; of many sites at one place
    only the k smallest ids can be among the nearest, so others are left out. Sites are read several times: they are
    written first, unless they are `stored` already.
    """
    sites, points = _at(sites).select("t", "zsid", "e", "n"), _at(points)
    sites = sites if stored else saved(sites, "sites")
    most = sites.groupBy("t").count().agg(F.max("count")).first()[0] or 0
    if most <= tile:  # a tree wouldn't be cut
        here = [F.lit(0).alias(c) for c in TILE_KEY[1:]]
        return _dealt(points.select("*", *here), points.groupBy("t").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks")).select("*", *here), sites.select("*", *here))

    tree = Tree(sites, cap, tile)
    tiled = saved(tree.descended(tree.placed(points), "tile").withColumnsRenamed({"s": "ts", "cx": "tx", "cy": "ty"}), "tiled")
    tiles = tiled.groupBy(*TILE_KEY).agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"), *(c.alias(f"p{n}") for c, n in zip(_bounds(), ("e0", "e1", "n0", "n1"), strict=True)))
    tiles = saved(tiles, "tiles")

    roots = tree.cells.where("s = 0").select("t", *CELL)
    frontier = tiles.drop("chunks").join(_few(roots, tree.snapshots), "t")
    for level, count, cells in tree.cut("cap"):
        inner = cells.select("t", F.col("cx").alias("ax"), F.col("cy").alias("ay"))
        below = tree.cells.where(F.col("s") == level + 1).withColumns({"ax": F.shiftright("cx", 2), "ay": F.shiftright("cy", 2)}).join(_few(inner, count), ["t", "ax", "ay"], "left_semi")
        below = below.groupBy("t", F.col("ax").alias("cx"), F.col("ay").alias("cy")).agg(F.collect_list(F.struct(*CELL)).alias("below")).withColumn("s", F.lit(level))
        opened = frontier.join(_few(below, count), ["t", "s", "cx", "cy"], "left").withColumn("cell", F.explode(F.coalesce("below", F.array(F.struct(*CELL)))))
        frontier = _pruned(opened.select(*TILE_KEY, *(f"p{c}" for c in ("e0", "e1", "n0", "n1")), "cell.*"), k)

    frontier, leaves = saved(frontier, "frontier"), saved(tree.descended(tree.rows, "cap"), "leaves")
    if tree.crowded():
        for key in (["t", "e", "n", F.pmod(F.xxhash64("zsid"), F.lit(64))], ["t", "e", "n"]):
            leaves = leaves.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("zsid"))).where(F.col("rank") <= k).drop("rank")
    near = frontier.select(*TILE_KEY, "s", "cx", "cy").join(leaves, ["t", "s", "cx", "cy"]).select(*TILE_KEY, "zsid", "e", "n")
    return _dealt(tiled, tiles.select(*TILE_KEY, "chunks"), near)


def _dealt(points: DataFrame, tiles: DataFrame, near: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points in one of their tile's chunks each, its candidates in all of them."""
    every = near.join(tiles, TILE_KEY).withColumn("chunk", F.explode(F.expr("sequence(0, chunks - 1)"))).drop("chunks")
    return points.join(tiles, TILE_KEY).withColumn("chunk", F.pmod(F.xxhash64("p"), "chunks").cast("int")).drop("chunks"), every


def nearest(points: DataFrame, sites: DataFrame, k: int = 1, **how: int) -> DataFrame:
    """The k nearest sites of each point in its snapshot: (t, p, zsid, d, rank), d the squared distance; the smaller id on ties.

    points: (t, p, e, n) and optionally `scale`, a number that distances are divided by before they are compared. sites:
    (t, zsid, e, n), ids unique in a snapshot. Points and sites without a place are left out, as are points of a
    snapshot without sites; where there are fewer than k sites, all of them are near. Results don't depend on `how` (see candidates()).
    """
    scale = F.col("scale").cast("double") if "scale" in points.columns else F.lit(None).cast("double")
    mine, near = candidates(points.select("t", "p", "e", "n", scale.alias("scale")), sites, k, **how)
    # both may come from one frame
    mine, near = (side.select(*(F.col(c).alias(c) for c in side.columns)) for side in (mine, near))

    def work(points: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(own):
            own = own.sort_values("zsid")
            e, n, ids = (own[c].to_numpy() for c in ("e", "n", "zsid"))
            step = max(1, PAIRS // len(own))
            for low in range(0, len(points), step):
                part = points.iloc[low : low + step]
                dx, dy = part["e"].to_numpy()[:, None] - e, part["n"].to_numpy()[:, None] - n
                d = dx * dx + dy * dy
                scales = part["scale"].to_numpy(float)[:, None]
                best = np.argsort(np.where(scales > 0, d / np.where(scales > 0, scales, 1.0), d), axis=1, kind="stable")[:, :k]
                many = best.shape[1]
                out.append(pd.DataFrame({"t": np.repeat(part["t"].to_numpy(), many), "p": np.repeat(part["p"].to_numpy(), many), "zsid": ids[best].ravel(), "d": np.take_along_axis(d, best, 1).ravel(), "rank": np.tile(np.arange(1, many + 1), len(part))}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in ("t", "p", "zsid", "d", "rank")})

    key = [*TILE_KEY, "chunk"]
    return mine.groupBy(*key).cogroup(near.groupBy(*key)).applyInPandas(work, "t bigint, p bigint, zsid bigint, d double, rank int")


#: Sites of a block whose hull is taken in one task.
BLOCK = 4_096


def _hull(e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Places of the corners of the convex hull, by sorted chains."""
    order = np.lexsort((n, e))
    if len(order) < 3:
        return order

    def chain(at: np.ndarray) -> list[int]:
        out: list[int] = []
        for i in at.tolist():
            while len(out) > 1 and (e[out[-1]] - e[out[-2]]) * (n[i] - n[out[-2]]) - (n[out[-1]] - n[out[-2]]) * (e[i] - e[out[-2]]) <= 0:
                out.pop()
            out.append(i)
        return out

    return np.unique(chain(order) + chain(order[::-1]))


def widest(sites: DataFrame) -> DataFrame:
    """(t, top): the largest squared distance between two sites of each snapshot.

    It lies between corners of the convex hull: blocks of sites leave their corners, and one task for each
    snapshot compares the corners of those (few, unless the sites lie on a curve).
    """
    def corners(rows: pd.DataFrame) -> pd.DataFrame:
        return rows.iloc[_hull(rows["e"].to_numpy(), rows["n"].to_numpy())][["t", "e", "n"]]

    def largest(rows: pd.DataFrame) -> pd.DataFrame:
        own = corners(rows)
        e, n, top = own["e"].to_numpy(), own["n"].to_numpy(), 0.0
        for low in range(0, len(e), BLOCK):
            dx, dy = e[low : low + BLOCK, None] - e, n[low : low + BLOCK, None] - n
            top = max(top, float((dx * dx + dy * dy).max()))
        return pd.DataFrame({"t": [rows["t"].iloc[0]], "top": [top]})

    left = _at(sites).select("t", "e", "n")
    sizes = left.groupBy("t").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    if (sizes.agg(F.max("blocks")).first()[0] or 0) > 1:
        dealt = left.join(sizes, "t").withColumn("block", F.pmod(F.xxhash64("e", "n"), "blocks"))
        left = dealt.groupBy("t", "block").applyInPandas(corners, "t bigint, e double, n double")
    return left.groupBy("t").applyInPandas(largest, "t bigint, top double")
