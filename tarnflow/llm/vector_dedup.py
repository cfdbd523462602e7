"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact cosine at the end."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import components, give_back, heavy, labelled, salted, save, unit

#: Vectors that centroids and codebooks are fitted on; vectors of a list at about; centroids of the upper level.
SAMPLE, LIST, COARSE = 16_384, 1_500, 1_024
#: Subspaces, codes of each, rounds of k-means.
SUBSPACES, CODES, ROUNDS = 8, 256, 8
#: Probed are the lists of the nearest borders, of these the ones whose border is within so much of a link's distance (the plane between two linked vectors is within half of it of one of them).
#: So many at most on one level, and so many more for each doubling of the lists beyond COARSE: of links of cosine 0.951 in 64 and 384 dimensions, 0.995 were found
#: with 1,024 lists and 10 probes, 0.993 with 8,000 and 20, 0.983 and more with 100,000 and 40 (0.9 with 10).
PROBES, MORE_PROBES, REACH = 10, 5, 0.55
#: Vectors of a block of a list, and queries that meet it in one task; queries in one table look-up; vectors encoded and pairs compared exactly at once.
BLOCK, QUERIES, STEP, ENCODED, PAIRS = 2_048, 4_096, 256, 1_024, 16_384


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS, seed: int = 10) -> np.ndarray:
    """Centroids, at most k, that start from different rows."""
    rng, own = np.random.default_rng(seed), np.unique(x, axis=0)
    c = own[rng.choice(len(own), min(k, len(own)), replace=False)].copy()
    for _ in range(rounds):
        own = nearest(x, c)[0]
        n = np.bincount(own, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and all squared distances."""
    d = np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None], 0)
    return d.argmin(1), d


def borders(x: np.ndarray, c: np.ndarray, gaps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest centroid of each row, and its distance to the plane between that one and every centroid."""
    home, d = nearest(x, c)
    return home, (d - d[np.arange(len(x)), home][:, None]) / np.maximum(2 * gaps[home], 1e-12)


def units(column: pd.Series) -> np.ndarray:
    """Vectors of length 1, whatever their scale."""
    x = np.stack(column.to_numpy()).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class Index:
    """Coarse centroids, below them the same finer centroids of what is left (if more lists are wanted than COARSE), and codebooks of residuals.

    Fitted on a bounded sample of unit vectors; the number of lists grows with the table, and the number of probes with that of
    the lists (`probes`: a number instead; None: every list within REACH, so that no link is missed).
    """

    def __init__(self, sample: np.ndarray, lists: int, coarse: int = COARSE, probes: int | str | None = "auto"):
        self.most = PROBES + math.ceil(MORE_PROBES * math.log2(max(1, lists / coarse))) if probes == "auto" else probes
        self.coarse = kmeans(sample, min(lists, coarse))
        rest = sample - self.coarse[nearest(sample, self.coarse)[0]]
        self.fine = kmeans(rest, -(-lists // coarse)) if lists > coarse else np.zeros((1, sample.shape[1]))
        rest -= self.fine[nearest(rest, self.fine)[0]]
        self.parts = [p for p in np.array_split(np.arange(sample.shape[1]), SUBSPACES) if len(p)]
        self.books = [kmeans(rest[:, p], CODES) for p in self.parts]
        self.gaps, self.fine_gaps = (np.sqrt(nearest(c, c)[1]) for c in (self.coarse, self.fine))

    def center(self, at: np.ndarray | int) -> np.ndarray:
        return self.coarse[at // len(self.fine)] + self.fine[at % len(self.fine)]

    def probes(self, x: np.ndarray, link: float) -> tuple[np.ndarray, list[list[int]]]:
        """The list of each vector, and the lists to probe for links within a distance, its own first."""
        rows = np.arange(len(x))
        home, plane = borders(x, self.coarse, self.gaps)
        few = min(self.most or len(self.coarse), len(self.coarse))
        best = np.argpartition(plane, few - 1, axis=1)[:, :few]
        i, j, far = np.repeat(rows, few), best.ravel(), np.take_along_axis(plane, best, axis=1).ravel()
        near = far <= REACH * link
        i, j, far = i[near], j[near], far[near]
        if len(self.fine) > 1:
            own, plane = borders(x[i] - self.coarse[j], self.fine, self.fine_gaps)
            mine = j == home[i]
            first = np.zeros(len(x), np.int64)
            first[i[mine]] = own[mine]
            home = home * len(self.fine) + first
            few = min(self.most or len(self.fine), len(self.fine))
            best = np.argpartition(plane, few - 1, axis=1)[:, :few]
            far = np.maximum(far[:, None], np.take_along_axis(plane, best, axis=1)).ravel()
            i, j = np.repeat(i, few), (j[:, None] * len(self.fine) + best).ravel()
            near = far <= REACH * link
            i, j, far = i[near], j[near], far[near]
        far = np.where(j == home[i], -1.0, far)
        order = np.lexsort((far, i))
        cut = np.searchsorted(i[order], np.arange(len(x) + 1))
        return home, [j[order[a : min(b, a + (self.most or b))]].tolist() for a, b in zip(cut[:-1], cut[1:], strict=True)]

    def encode(self, x: np.ndarray, link: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[list[int]]]:
        """List, codes, length of what the codes miss, and the lists to probe."""
        home, probes = self.probes(x, link)
        rest = x - self.center(home)
        codes = np.stack([nearest(rest[:, p], b)[0] for p, b in zip(self.parts, self.books, strict=True)], axis=1).astype(np.uint8)
        miss = np.sqrt(sum(((rest[:, p] - b[codes[:, m]]) ** 2).sum(1) for m, (p, b) in enumerate(zip(self.parts, self.books, strict=True))))
        return home, codes, miss, probes

    def tables(self, q: np.ndarray, at: int) -> list[np.ndarray]:
        """For each subspace the squared distances of queries, less the list's centroid, to all codes."""
        rest = q - self.center(at)
        return [nearest(rest[:, p], b)[1].astype(np.float32) for p, b in zip(self.parts, self.books, strict=True)]


def near_vectors(vectors: DataFrame, cosine: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding", list_size: int = LIST, coarse: int = COARSE, probes: int | str | None = "auto") -> DataFrame:
    """Vectors linked by a cosine of at least `cosine`, in double precision.

    Equal vectors are one class from the start. Each class has a coarse list, of about `list_size` vectors at any size of the table,
    and codes of its residual. It probes its own list and those of the nearest borders, so many at most as `probes` says (see Index; None is exact); table look-ups bound each distance from below, and what stays within
    the bound is compared exactly. So a link can be missed only if neither
    vector probes the other's list. Lists and their queries are cut into
    blocks, and a task returns counts, and no more links than connect its vectors.

    Returns vec_id, n_links (other vectors linked directly), component_id
    (smallest vec_id reachable), kept (it is that one). Null or zero vectors, those with null
    or non-finite components or of another length than most link with nothing. Repeated
    rows and rows with a null id count as vectors; a component of null ids only has a null component_id, and all its rows are kept.
    Other columns never matter. An empty table gives no rows. Vectors of floats travel as floats, all others as doubles.
    """
    kind = "array<float>" if vectors.schema[vec_col].dataType.simpleString() == "array<float>" else "array<double>"
    rows = save(vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast(kind).alias("vec")), "vectors")
    finite = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))) & F.exists("vec", lambda v: v != 0)
    width = rows.where(finite).groupBy(F.size("vec").alias("w")).count().orderBy(F.desc("count"), "w").limit(1).collect()
    ok = F.coalesce(finite & (F.size("vec") == F.lit(width[0]["w"] if width else -1)), F.lit(False))
    hashed = rows.withColumn("cls", F.when(ok, F.xxhash64("vec", F.lit(9))))
    classes = save(hashed.where("cls is not null").groupBy("cls", "vec").agg(F.count("*").alias("n")), "classes")
    count = classes.count()
    if not count:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))

    drawn = classes.where(unit("cls", seed=6) < min(1.0, SAMPLE / count)).select("vec").limit(2 * SAMPLE).toPandas()
    if drawn.empty:
        drawn = classes.select("vec").limit(1).toPandas()
    index = Index(units(drawn["vec"]), -(-count // list_size), min(coarse, len(drawn)), probes)
    link = float(np.sqrt(2 - 2 * cosine))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for low in range(0, len(pdf), ENCODED):
                part = pdf.iloc[low : low + ENCODED]
                home, codes, miss, probes = index.encode(units(part["vec"]), link)
                yield part.assign(home=home.astype(np.int32), codes=[c.tobytes() for c in codes], miss=miss, probes=probes)

    coded = save(classes.mapInPandas(encode, f"cls bigint, vec {kind}, n bigint, home int, codes binary, miss double, probes array<int>"), "coded")
    asked = coded.select("cls", "vec", "n", "home", F.explode("probes").alias("at"))
    plan = coded.groupBy(F.col("home").alias("at")).agg(F.count("*").alias("held")).join(asked.groupBy("at").agg(F.count("*").alias("asked")), "at", "left")
    plan = save(plan.fillna(1, "asked"), "lists")
    of = plan.select("at", F.ceil(F.col("held") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERIES).cast("int").alias("batches"))
    salt = lambda name, seed: F.pmod(F.xxhash64("cls", F.lit(seed)), F.col(name)).cast("int")
    upto = lambda name: F.explode(F.sequence(F.lit(0), F.col(name) - 1))
    base = salted(coded.withColumn("at", F.col("home")), of, ["at"], heavy(plan, ["at"], count, "held"), ["cls"])
    base = base.select("at", salt("blocks", 1).alias("block"), upto("batches").alias("batch"), "cls", "vec", "n", "codes", "miss", "probes")
    query = salted(asked, of, ["at"], heavy(plan, ["at"], plan.agg(F.sum("asked")).first()[0], "asked"), ["cls"])
    query = query.select("at", salt("batches", 2).alias("batch"), upto("blocks").alias("block"), F.col("cls").alias("q_cls"), F.col("vec").alias("q_vec"), F.col("n").alias("q_n"), F.col("home").alias("q_home"))

    def compare(key: tuple, q: pd.DataFrame, d: pd.DataFrame) -> pd.DataFrame:
        give_back()
        if q.empty or d.empty:
            return pd.DataFrame({"node": [], "links": [], "other": []}).astype("int64")
        at, x, y = int(key[0]), units(q["q_vec"]), units(d["vec"])
        codes = np.frombuffer(b"".join(d["codes"]), np.uint8).reshape(len(d), -1)
        bound = ((link + d["miss"].to_numpy() + 1e-4) ** 2).astype(np.float32)
        qn, dn, qc, dc = q["q_n"].to_numpy(), d["n"].to_numpy(), q["q_cls"].to_numpy(), d["cls"].to_numpy()
        homes = q["q_home"].to_numpy()
        asks = [set(p) for p in d["probes"]]
        links: dict[int, int] = {}
        up: dict[int, int] = {}
        edges = []

        def top(v: int) -> int:
            while (w := up.get(v, v)) != v:
                up[v] = up.get(w, w)
                v = w
            return v

        for low in range(0, len(q), STEP):
            tables = index.tables(x[low : low + STEP], at)
            far = tables[0][:, codes[:, 0]]
            for m in range(1, len(tables)):
                far += tables[m][:, codes[:, m]]
            i, j = np.nonzero(far <= bound)
            for part in range(0, len(i), PAIRS):
                a, b = i[part : part + PAIRS] + low, j[part : part + PAIRS]
                real = (np.einsum("ij,ij->i", x[a], y[b]) >= cosine) & (qc[a] != dc[b])
                for s, t in zip(a[real], b[real], strict=True):
                    u, v = int(qc[s]), int(dc[t])
                    links[u] = links.get(u, 0) + int(dn[t])
                    if int(homes[s]) not in asks[t]:
                        links[v] = links.get(v, 0) + int(qn[s])
                    if (c := top(u)) != (e := top(v)):
                        up[c] = e
                        edges.append((u, 0, v))
        return pd.DataFrame([*((u, n, u) for u, n in links.items()), *edges], columns=["node", "links", "other"], dtype="int64")

    keys = ("at", "block", "batch")
    found = save(query.groupBy(*keys).cogroup(base.groupBy(*keys)).applyInPandas(compare, "node bigint, links bigint, other bigint"), "links")
    sums = found.groupBy("node").agg(F.sum("links").alias("links"))
    root = components(found.where("node <> other").select(F.col("node").alias("src"), F.col("other").alias("dst")))
    per = classes.select("cls", "n").join(sums, F.col("cls") == sums["node"], "left").drop("node").join(root, F.col("cls") == root["node"], "left")
    per = per.select("cls", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "cls").alias("label"))
    hot = heavy(classes.select("cls", "n"), ["cls"], rows.count())
    full = save(salted(hashed.select("vec_id", "cls"), per, ["cls"], hot, ["vec_id"], "left"), "linked")
    out = labelled(full, "label", "vec_id", "least").withColumn("component_id", F.when(F.col("label").isNull(), F.col("vec_id")).otherwise(F.col("least")))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))
