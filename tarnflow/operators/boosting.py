"""Boosted trees for each series: gradient histograms, trees grown level by level or by the best leaf, and recursive forecasts."""

from __future__ import annotations

import heapq
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.operators import series

#: Deviations of a 95 % band.
Z = 1.96
WINDOWS = (24, 168)
CALENDAR = ["hour", "weekday", "weekend", "hour_sin", "hour_cos", "day_sin", "day_cos"]


class Shape(NamedTuple):
    """Limits of a tree (None: no limit), the penalty on its leaves' values, and the shares of rows and columns that it sees."""

    depth: int | None
    leaves: int | None
    least: int
    penalty: float
    rows: float = 1.0
    columns: float = 1.0
    bins: int = 256


#: Even trees of depth 6, and trees of 31 leaves split where most is gained, with the published defaults of two common libraries.
SHAPES = {"deep": Shape(6, None, 1, 1.0, 0.9, 0.9), "leaves31": Shape(None, 31, 20, 0.0, 1.0, 0.9, 255)}


class Tree(NamedTuple):
    """Nodes: the column and the cut of a split (a row goes left if it isn't above), both ends, and the value of a leaf."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray


def cuts_of(x: np.ndarray, bins: int) -> list[np.ndarray]:
    """Cuts of each column: halfway between its values, or between quantiles of a column of many values."""
    out = []
    for column in x.T:
        own = np.unique(column)
        if len(own) > bins:
            own = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="inverted_cdf"))
        out.append((own[1:] + own[:-1]) / 2)
    return out


def _best(placed: np.ndarray, wide: int, g: np.ndarray, rows: np.ndarray, shape: Shape) -> tuple[float, int, int] | None:
    """(gain, column, bin) of the best split of some rows, from histograms of all columns at once; the first on ties. placed: bins, each column's after those of the one before."""
    all_n, many = len(rows), placed.shape[1]
    if all_n < 2 * shape.least:
        return None
    at, own = placed[rows].ravel(), g[rows]
    n = np.bincount(at, minlength=many * wide).reshape(many, wide).cumsum(axis=1)[:, :-1]
    s = np.bincount(at, np.repeat(own, many), many * wide).reshape(many, wide).cumsum(axis=1)[:, :-1]
    all_s = own.sum()
    fits = (n >= shape.least) & (all_n - n >= shape.least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = s * s / (n + shape.penalty) + (all_s - s) ** 2 / (all_n - n + shape.penalty) - all_s**2 / (all_n + shape.penalty)
    gain = np.where(fits, gain, -np.inf)
    if not gain.size:
        return None
    best = int(gain.argmax())
    top = gain.flat[best]
    return (float(top), *divmod(best, wide - 1)) if top > 1e-12 else None


def grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, rows: np.ndarray, columns: np.ndarray, shape: Shape) -> Tree:
    """One tree for gradients g (second derivatives are 1): leaves are split in order of what they gain."""
    wide = max((len(cuts[c]) for c in columns), default=0) + 1
    binned = np.stack([np.searchsorted(cuts[c], x[:, c], side="left") for c in columns], axis=1)
    placed = binned + np.arange(len(columns)) * wide
    nodes: list[list] = []
    waiting: list[tuple] = []

    def add(own: np.ndarray, depth: int) -> int:
        k = len(nodes)
        nodes.append([-1, 0.0, k, k, -g[own].sum() / (len(own) + shape.penalty)])
        found = _best(placed, wide, g, own, shape) if shape.depth is None or depth < shape.depth else None
        if found:
            heapq.heappush(waiting, (-found[0], k, found[1], found[2], own, depth))
        return k

    add(rows, 0)
    leaves = 1
    while waiting and (shape.leaves is None or leaves < shape.leaves):
        _, k, c, b, own, depth = heapq.heappop(waiting)
        goes = binned[own, c] <= b
        nodes[k][:2] = [int(columns[c]), float(cuts[columns[c]][b])]
        nodes[k][2:4] = [add(own[goes], depth + 1), add(own[~goes], depth + 1)]
        leaves += 1
    return Tree(*(np.array(v) for v in zip(*nodes, strict=True)))


class Forest:
    """All trees side by side, so that a row goes down all of them at once."""

    def __init__(self, start: float, rate: float, trees: list[Tree]) -> None:
        self.start, self.rate, size = start, rate, max((len(t.value) for t in trees), default=0)
        fill = lambda name, kind: np.stack([np.pad(getattr(t, name), (0, size - len(t.value))) for t in trees]).astype(kind)
        self.column, self.left, self.right = (fill(n, np.int64) for n in ("column", "left", "right"))
        self.cut, self.value = fill("cut", float), fill("value", float)

    def __call__(self, row: np.ndarray) -> float:
        tree, at = np.arange(len(self.value)), np.zeros(len(self.value), np.int64)
        while True:
            column = self.column[tree, at]
            new = np.where(column < 0, at, np.where(row[column] <= self.cut[tree, at], self.left[tree, at], self.right[tree, at]))
            if (new == at).all():
                return self.start + self.rate * float(self.value[tree, at].sum())
            at = new


def _leaf(tree: Tree, x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    while True:
        column = tree.column[at]
        new = np.where(column < 0, at, np.where(x[np.arange(len(x)), column] <= tree.cut[at], tree.left[at], tree.right[at]))
        if (new == at).all():
            return at
        at = new


def fit(x: np.ndarray, y: np.ndarray, shape: Shape, trees: int, rate: float, seed: int = 0) -> tuple[Forest, np.ndarray]:
    """Trees for the squared error, each on what the ones before leave, and their predictions of the rows they were grown on."""
    draw, cuts = np.random.default_rng(seed), cuts_of(x, shape.bins)
    hat, made = np.full(len(y), y.mean()), []
    for _ in range(trees):
        rows = np.sort(draw.permutation(len(y))[: max(1, round(shape.rows * len(y)))])
        columns = np.sort(draw.permutation(x.shape[1])[: max(1, int(shape.columns * x.shape[1]))])
        tree = grow(x, cuts, hat - y, rows, columns, shape)
        hat = hat + rate * tree.value[_leaf(tree, x)]
        made.append(tree)
    return Forest(float(y.mean()), rate, made), hat


def lagged(y: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Lags and means of the values before each place; not-a-number where there are too few."""
    y = np.concatenate([np.full(max(series.LAGS), np.nan), y])
    at = at + max(series.LAGS)
    sums = [np.array([y[i - w : i].mean() for i in at]) for w in WINDOWS]
    return np.column_stack([*(y[at - k] for k in series.LAGS), *sums])


def forecast(df: DataFrame, config: str = "deep", trees: int = 600, rate: float = 0.05, low: float = 0.0, high: float = 100.0, seed: int = 0) -> DataFrame:
    """A model of its own for each series, fitted on lags, rolling means and calendar of its train rows, and all its test rows one after the other, each from the predictions before: (series_id, idx, y, y_hat, lower, upper, status).

    Expects series.split() with t and no gaps. One grouped map after one shuffle; a series goes whole into one task, which is where its trees
    have to follow one another, and series are independent. Predictions and the band (1.96 population deviations of the errors on train rows) are
    clipped to low and high. A series without a row that has all features (under 170 train rows) has the status "under 170 train rows" and no predictions.
    """
    shape, need = SHAPES[config], max(series.LAGS) + 1

    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("idx")
        n, y, calendar = int(own["train"].sum()), own["y"].to_numpy(float), own[CALENDAR].to_numpy(float)
        out = own.iloc[n:][["series_id", "idx", "y"]].assign(y_hat=np.nan, lower=np.nan, upper=np.nan, status=f"under {need} train rows")
        at = np.arange(max(series.LAGS), n)
        if not len(at) or not len(out):
            return out
        model, hat = fit(np.column_stack([lagged(y[:n], at), calendar[at]]), y[at], shape, trees, rate, seed)
        seen = np.concatenate([y[:n], np.zeros(len(out))])
        for i in range(n, len(seen)):
            row = np.concatenate([lagged(seen[i - max(series.LAGS) : i], np.array([max(series.LAGS)]))[0], calendar[i]])
            seen[i] = min(high, max(low, model(row)))
        band = Z * float(np.std(y[at] - hat))
        return out.assign(y_hat=seen[n:], lower=np.clip(seen[n:] - band, low, high), upper=np.clip(seen[n:] + band, low, high), status="ok")

    rows = series.calendar_features(df.select("series_id", "t", "idx", "y", "train")).drop("t")
    # few bytes and much work: a stated number keeps small partitions from being put together into one task
    spark = df.sparkSession
    rows = rows.repartition(4 * max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), "series_id")
    return rows.groupBy("series_id").applyInPandas(run, "series_id string, idx bigint, y double, y_hat double, lower double, upper double, status string")
