"""Fast Fourier transforms of series of any length: whole in one task, or in two grouped passes over columns and rows."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values that one task transforms at once. Longer series are cut into columns and rows.
LOCAL = 1 << 20
#: A value is spread over so many places of the grid on each side; the error is then about 1e-10 of the sum of absolute values.
SPREAD = 12

OUT = "series_id string, k bigint, re double, im double"


@lru_cache(maxsize=10_000)
def factors(m: int, most: int) -> tuple[int, int] | None:
    """The factors of m nearest to its root, if neither exceeds `most`."""
    for a in range(math.isqrt(m), 0, -1):
        if m // a > most:
            return None
        if m % a == 0:
            return a, m // a
    return None


def _rows(key: tuple, k: np.ndarray, z: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"series_id": np.full(k.size, key[0], object), "k": k.ravel(), "re": z.real.ravel(), "im": z.imag.ravel()})


def _whole(rows: DataFrame) -> DataFrame:
    def run(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        m = int(own["m"].iloc[0])
        x = np.zeros(m, complex)
        np.add.at(x, own["j"].to_numpy(), own["re"].to_numpy() + 1j * own["im"].to_numpy())
        return _rows(key, np.arange(m), np.fft.fft(x))

    return rows.groupBy("series_id").applyInPandas(run, OUT)


def _two_passes(rows: DataFrame, local: int) -> DataFrame:
    """j = j1 * n2 + j2 and k = k1 + n1 * k2: columns (j2) are transformed over j1 and turned by their twiddles, then rows (k1) over j2."""

    @F.pandas_udf("long")
    def short(m: pd.Series) -> pd.Series:
        return m.map({v: factors(int(v), local)[0] for v in m.unique()})

    def columns(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        m, n1 = (int(own[c].iloc[0]) for c in ("m", "n1"))
        n2, wide = m // n1, max(1, local // n1)
        low = int(key[1]) * wide
        x = np.zeros((n1, min(wide, n2 - low)), complex)
        np.add.at(x, (own["j"].to_numpy() // n2, own["j"].to_numpy() % n2 - low), own["re"].to_numpy() + 1j * own["im"].to_numpy())
        k1, j2 = np.arange(n1)[:, None], low + np.arange(x.shape[1])
        z = np.fft.fft(x, axis=0) * np.exp(-2j * np.pi * (k1 * j2 % m) / m)
        return _rows(key, k1 * n2 + j2, z).assign(m=m, n1=n1)

    def lines(key: tuple, own: pd.DataFrame) -> pd.DataFrame:
        m, n1 = (int(own[c].iloc[0]) for c in ("m", "n1"))
        n2 = m // n1
        wide = max(1, local // n2)
        low = int(key[1]) * wide
        x = np.zeros((min(wide, n1 - low), n2), complex)
        x[own["k"].to_numpy() // n2 - low, own["k"].to_numpy() % n2] = own["re"].to_numpy() + 1j * own["im"].to_numpy()
        return _rows(key, low + np.arange(x.shape[0])[:, None] + n1 * np.arange(n2), np.fft.fft(x, axis=1))

    block = lambda at, size: F.floor(at / F.greatest(F.lit(1), F.floor(F.lit(local) / size))).cast("long")
    rows = rows.withColumn("n1", short("m")).withColumn("n2", F.floor(F.col("m") / F.col("n1")))
    first = rows.withColumn("block", block(F.col("j") % F.col("n2"), F.col("n1"))).groupBy("series_id", "block").applyInPandas(columns, OUT + ", m bigint, n1 bigint")
    n2 = F.floor(F.col("m") / F.col("n1"))
    return first.withColumn("block", block(F.floor(F.col("k") / n2), n2)).groupBy("series_id", "block").applyInPandas(lines, OUT)


def _chirped(rows: DataFrame, local: int) -> DataFrame:
    """Of lengths with a large prime factor: a convolution with a chirp, by transforms of a power of two (Bluestein)."""
    size = F.pow(F.lit(2), F.ceil(F.log2(2 * F.col("m") - 1))).cast("long")

    def turned(j: Column, m: Column, sign: int) -> tuple[Column, Column]:
        a = sign * F.pi() * ((j * j) % (2 * m)) / m
        return F.cos(a), F.sin(a)

    def times(a: tuple[Column, Column], b: tuple[Column, Column]) -> list[Column]:
        return [(a[0] * b[0] - a[1] * b[1]).alias("re"), (a[0] * b[1] + a[1] * b[0]).alias("im")]

    z = (F.col("re"), F.col("im"))
    data = rows.select("series_id", "j", "m", *times(z, turned(F.col("j"), F.col("m"), -1))).withColumnRenamed("m", "n").withColumn("m", F.pow(F.lit(2), F.ceil(F.log2(2 * F.col("n") - 1))).cast("long")).drop("n")
    lengths = rows.select("series_id", F.col("m").alias("n"), size.alias("m")).distinct()
    block = 1 << 16
    each = lengths.withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / block)))).withColumn("j", F.explode(F.sequence(F.col("b") * block, F.least(F.col("n"), (F.col("b") + 1) * block) - 1)))
    re, im = turned(F.col("j"), F.col("n"), 1)
    chirp = each.withColumn("at", F.explode(F.array_distinct(F.array("j", (F.col("m") - F.col("j")) % F.col("m"))))).select("series_id", F.col("at").alias("j"), "m", re.alias("re"), im.alias("im"))
    a, b = (_two_passes(x, local).select("series_id", "k", F.col("re").alias(f"re{i}"), F.col("im").alias(f"im{i}")) for i, x in ((1, data), (2, chirp)))
    both = a.join(b, ["series_id", "k"]).join(lengths, "series_id")
    product = times((F.col("re1"), F.col("im1")), (F.col("re2"), F.col("im2")))
    back = _two_passes(both.select("series_id", F.col("k").alias("j"), "m", product[0], (-product[1]).alias("im")), local).join(lengths, "series_id").where("k < n")
    own = (F.col("re") / F.col("m"), -F.col("im") / F.col("m"))
    return back.select("series_id", "k", *times(own, turned(F.col("k"), F.col("n"), -1)))


def transform(rows: DataFrame, local: int | None = None) -> DataFrame:
    """Sums of (re + i im) exp(-2 pi i j k / m) for k under m: (series_id, k, re, im).

    rows: (series_id, j, re, im, m); m is a series' length, places j that have no row count as 0, rows of one place are added. A series of up
    to `local` places goes into one task; of a longer one (up to its square; its half, if m has a large prime factor) no task holds more than about that many. Work grows as m log m.
    """
    local = local or LOCAL
    rows = rows.select(F.col("series_id").cast("string").alias("series_id"), F.col("j").cast("long").alias("j"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"), F.col("m").cast("long").alias("m"))
    most = rows.agg(F.max("m")).first()[0] or 0
    out = _whole(rows.where(F.col("m") <= local))
    if most <= local:
        return out
    most_local = local

    @F.pandas_udf("boolean")
    def even(m: pd.Series) -> pd.Series:
        return m.map({v: factors(int(v), most_local) is not None for v in m.unique()})

    long = rows.where(F.col("m") > local)
    return out.unionByName(_two_passes(long.where(even("m")), local)).unionByName(_chirped(long.where(~even("m")), local))


def _width(modes: int, m: int) -> float:
    """Width of the Gaussian that spreads values on m places for so many modes (Greengard and Lee)."""
    r = m / modes
    return math.pi * SPREAD / (modes * modes * r * (r - 0.5))


def modes_at(x: np.ndarray, c: np.ndarray, modes: int) -> np.ndarray:
    """Sums of c exp(-2 pi i k x) for k under `modes` at any places x in [0, 1), by a fast transform of a grid."""
    m = 1 << max(6, math.ceil(math.log2(2 * modes)))
    tau, half = _width(modes, m), modes // 2
    c = c * np.exp(-2j * np.pi * half * x)
    near = np.floor(x * m).astype(np.int64)
    steps = np.arange(1 - SPREAD, SPREAD + 1)
    off = 2 * np.pi * (x[:, None] - (near[:, None] + steps) / m)
    grid = np.zeros(m, complex)
    np.add.at(grid, (near[:, None] + steps) % m, c[:, None] * np.exp(-off * off / (4 * tau)))
    k = np.arange(modes) - half
    return math.sqrt(math.pi / tau) * np.exp(k * k * tau) * np.fft.fft(grid)[k % m] / m


def modes_of(rows: DataFrame, local: int | None = None) -> DataFrame:
    """The same sums for series of any length: rows (series_id, x, re, im, modes) give (series_id, k, re, im), k under modes.

    Each row is spread over the grid before the shuffle; the grid goes through transform().
    """
    m = F.pow(F.lit(2), F.greatest(F.lit(6), F.ceil(F.log2(2 * F.col("modes"))))).cast("long")
    rows = rows.withColumn("m", m).withColumn("r", F.col("m") / F.col("modes")).withColumn("half", F.floor(F.col("modes") / 2))
    tau = F.pi() * SPREAD / (F.col("modes") * F.col("modes") * F.col("r") * (F.col("r") - 0.5))
    a = -2 * F.pi() * F.col("half") * F.col("x")
    rows = rows.withColumns({"tau": tau, "near": F.floor(F.col("x") * F.col("m")), "c": F.col("re") * F.cos(a) - F.col("im") * F.sin(a), "d": F.col("re") * F.sin(a) + F.col("im") * F.cos(a)})
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1 - SPREAD), F.lit(SPREAD))))
    off = 2 * F.pi() * (F.col("x") - (F.col("near") + F.col("step")) / F.col("m"))
    rows = rows.withColumns({"j": F.pmod(F.col("near") + F.col("step"), F.col("m")), "g": F.exp(-off * off / (4 * F.col("tau")))})
    grid = rows.groupBy("series_id", "j", "m").agg(F.sum(F.col("c") * F.col("g")).alias("re"), F.sum(F.col("d") * F.col("g")).alias("im"))
    sizes = rows.select("series_id", "modes", "m", "half", "tau").distinct()
    out = transform(grid, local).join(sizes, "series_id").withColumn("q", F.when(F.col("k") < F.col("modes") - F.col("half"), F.col("k")).when(F.col("k") >= F.col("m") - F.col("half"), F.col("k") - F.col("m")))
    scale = F.sqrt(F.pi() / F.col("tau")) * F.exp(F.col("q") * F.col("q") * F.col("tau")) / F.col("m")
    return out.where("q is not null").select("series_id", (F.col("q") + F.col("half")).alias("k"), (F.col("re") * scale).alias("re"), (F.col("im") * scale).alias("im"))
