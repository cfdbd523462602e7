"""Source mixing by iterative proportional fitting of token weights."""

from __future__ import annotations

import string
import warnings
from collections.abc import Iterator, Mapping
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import discard, heavy, narrowed, salted, save, slices, tidy, unit
from tarnflow.llm.tokens import TOKENIZER, numbers, sizes, tokenizer_path

#: Marginals are raked in turn until all are within TOLERANCE of their targets, or so many rounds are done and a warning is given.
ROUNDS, TOLERANCE = 200, 1e-6
#: Target shares are the observed ones to this power unless they are given; the entry for values that given shares don't name.
TEMPER, OTHERS = 0.8, "*"
#: Cells are raked in the driver while there are no more than this; else by Spark.
LOCAL = 100_000
#: Topics, and bytes of text that are read at once.
TOPICS, AT_ONCE = 8, 1_000_000
#: Topics start from the best of TRIES fits to the means of all documents about SEEDS of them; then all documents are gone
#: through until no centroid moves by more than MOVED, or so often and a warning is given.
SEEDS, TRIES, MOVED, PASSES = 256, 20, 1e-4, 100
#: Marks are added up as whole multiples of 1 / EXACT, so that no sum depends on its order.
EXACT = 1 << 24
#: Marks that tell topics apart, each a kind of its own; then digits, capitals and all else (which doesn't count).
MARKS = "\n\t" + string.punctuation
_KINDS = len(MARKS) + 3
_KIND = np.full(256, _KINDS - 1, np.uint8)
for _i, _c in enumerate(MARKS):
    _KIND[ord(_c)] = _i
_KIND[ord("0") : ord("9") + 1], _KIND[ord("A") : ord("Z") + 1] = len(MARKS), len(MARKS) + 1


def marks(texts: pa.Array) -> np.ndarray:
    """How often each text has each kind of mark, roots of counts as a vector of length 1 (0 without marks)."""
    texts = pa.concat_arrays([pc.fill_null(texts, "").cast(pa.large_string())])
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    kinds = _KIND[np.frombuffer(texts.buffers()[2] or b"", np.uint8)]
    seen = np.array([np.bincount(kinds[a:b], minlength=_KINDS) for a, b in pairwise(bounds.tolist())]).reshape(len(texts), _KINDS)
    seen = np.sqrt(seen[:, :-1])
    return seen / np.maximum(np.linalg.norm(seen, axis=1, keepdims=True), 1e-12)


def _packed(seen: np.ndarray) -> list[bytes]:
    return [x.tobytes() for x in seen.astype(np.float32)]


def _unpacked(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, _KINDS - 1).astype(float)


def closest(seen: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Number of the nearest centroid of each row; of equally near ones (to 9 digits) the first."""
    return (seen @ (2 * centroids).T - (centroids * centroids).sum(1)).round(9).argmax(1)


def fit_topics(docs: DataFrame, topics: int = TOPICS, text_col: str = "text") -> np.ndarray:
    """Topics are kinds of texts (prose, tables, lists, shouting, code) in any language: centroids by k-means of the marks of all documents whose text isn't null. None without documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0, AT_ONCE):
                yield pa.RecordBatch.from_pydict({"mix_marks": pa.array(_packed(marks(part.column(0))), pa.binary())})

    rows = save(narrowed(docs, text=text_col).where("text is not null").mapInArrow(tidy(run), "mix_marks binary"), "marks")
    out = fit_marks(rows, topics)
    discard(rows)
    return out


def fit_marks(rows: DataFrame, topics: int = TOPICS) -> np.ndarray:
    """Centroids of the column mix_marks of saved rows, nulls left out: each the mean of all rows nearest to it, within MOVED. They don't depend on the order of rows or how they are spread."""
    rows = rows.select("mix_marks").where("mix_marks is not null")
    seeds = _seeds(rows)
    if not len(seeds):
        return seeds
    n, total = _sums(rows, seeds)
    centroids, moved = _start(total[n > 0] / n[n > 0, None], n[n > 0], topics), np.inf
    for _ in range(PASSES):
        n, total = _sums(rows, centroids)
        new = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], centroids)
        centroids, moved = new, float(np.linalg.norm(new - centroids, axis=1).max())
        if moved <= MOVED:
            break
    else:
        warnings.warn(f"after {PASSES} passes a topic still moves by {moved:.3g}", stacklevel=2)
    return centroids


def _seeds(rows: DataFrame) -> np.ndarray:
    """SEEDS different rows of the least hashes: where a summary of all rows starts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, bytes] = {}
        for batch in batches:
            held |= zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
            held = {h: held[h] for h in sorted(held)[:SEEDS]}
        yield pa.RecordBatch.from_pydict({"hash": pa.array(list(held), pa.int64()), "mix_marks": pa.array(list(held.values()), pa.binary())})

    few = rows.select(F.xxhash64("mix_marks").alias("hash"), "mix_marks").mapInArrow(tidy(run), "hash long, mix_marks binary")
    return _unpacked(few.distinct().orderBy("hash", "mix_marks").limit(SEEDS).select("mix_marks").toArrow().column(0))


def _sums(rows: DataFrame, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many rows each centroid is nearest to, and their sum. A number for each centroid and kind of mark reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(centroids), _KINDS), np.int64)
        for batch in batches:
            seen = _unpacked(batch.column(0))
            own = np.eye(len(centroids))[closest(seen, centroids)]
            sums += (own.T @ np.column_stack([np.ones(len(seen)), np.rint(seen * EXACT)])).astype(np.int64)  # whole numbers below 2 ** 53
        yield pa.RecordBatch.from_pydict({"at": pa.array(range(len(sums))), "sums": pa.array(sums.tolist(), pa.list_(pa.int64()))})

    each = rows.mapInArrow(tidy(run), "at long, sums array<long>").select("at", F.posexplode("sums").alias("kind", "sum"))
    out = np.zeros((len(centroids), _KINDS))
    for r in each.groupBy("at", "kind").agg(F.sum("sum").alias("sum")).collect():
        out[r["at"], r["kind"]] = r["sum"]
    return out[:, 0], out[:, 1:] / EXACT


def _start(means: np.ndarray, n: np.ndarray, topics: int) -> np.ndarray:
    """The best of TRIES weighted k-means of a few means, at most SEEDS, each from rows drawn by weight and squared distance to those before."""
    rng, best, least = np.random.default_rng(6), means[:1], np.inf
    off = lambda c: ((means[:, None] - c[None]) ** 2).sum(2)
    for _ in range(TRIES):
        c = means[[rng.choice(len(means), p=n / n.sum())]]
        while len(c) < topics and (far := off(c).min(1) * n).sum() > 0:
            c = np.vstack([c, means[rng.choice(len(means), p=far / far.sum())]])
        for _ in range(PASSES):
            own = np.eye(len(c))[closest(means, c)] * n[:, None]
            held, was = own.sum(0)[:, None], c
            c = np.where(held > 0, own.T @ means / np.maximum(held, 1), c)
            if np.array_equal(c, was):
                break
        if (error := (off(c).min(1) * n).sum()) < least:
            best, least = c, error
    return best


def profiled(docs: DataFrame, topics: np.ndarray | None, text_col: str = "text", tokenizer: str = TOKENIZER, keep: list[str] | None = None, at_once: int = AT_ONCE) -> DataFrame:
    """The columns `keep` (all but the text, if not given) with mix_tokens (ids of the tokenizer, 0 for null) and mix_topic (number of the nearest centroid; null without tokens).

    Without topics, mix_marks (null for null) stands in place of mix_topic: for fit_marks() and topical(), which then need no second pass over the texts.
    """
    path = tokenizer_path(tokenizer)
    last = "mix_marks" if topics is None else "mix_topic"
    keep = [c for c in keep or [c for c in docs.columns if c != text_col] if c not in ("mix_tokens", last)]
    rows = docs.select(docs[text_col].alias("mix_text"), *(docs[c] for c in keep if c != text_col))  # the text travels once

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sizes(path)
        for batch in batches:
            for part in slices(batch, 0, at_once):
                tokens, packed = numbers(part.column(0), known), _packed(marks(part.column(0)))
                if topics is None:
                    new = pa.array([x if there else None for x, there in zip(packed, part.column(0).is_valid().to_pylist(), strict=True)], pa.binary())
                else:
                    new = _topics(pa.array(packed, pa.binary()), pa.array(tokens, pa.int64()), topics)
                yield pa.RecordBatch.from_pydict({c: part.column("mix_text" if c == text_col else c) for c in keep} | {"mix_tokens": pa.array(tokens, pa.int64()), last: new})

    types = docs.select(*(docs[c] for c in keep)).schema.add("mix_tokens", "long").add(last, "binary" if topics is None else "string")
    return rows.mapInArrow(tidy(run, keeps=True), types)


def _topics(packed: pa.Array, tokens: pa.Array, topics: np.ndarray) -> pa.Array:
    some = pc.and_(pc.greater(tokens, 0 if len(topics) else 1 << 62), packed.is_valid())
    near = iter(closest(_unpacked(packed.filter(some)), topics).tolist() if len(topics) else [])
    return pa.array([str(next(near)) if x else None for x in some.to_pylist()], pa.string())


def topical(rows: DataFrame, topics: np.ndarray) -> DataFrame:
    """Rows of profiled() without topics, with mix_topic in place of mix_marks."""

    @F.arrow_udf("string")
    def topic(packed: pa.Array, tokens: pa.Array) -> pa.Array:
        return _topics(packed, tokens, topics)

    return rows.withColumn("mix_topic", topic("mix_marks", "mix_tokens")).drop("mix_marks")


def targets(cells: DataFrame, by: list[str], given: Mapping[str, Mapping[str, float]] | None = None, temper: float = TEMPER) -> DataFrame:
    """Rows (dim, value, goal): shares of the tokens of each value of each marginal. Given shares count in proportion among the values that occur; values that they don't name have that of "*", or 0."""
    out = None
    for dim in by:
        own = cells.groupBy(F.col(dim).alias("value")).agg(F.sum("tokens").alias("tokens")).where("tokens > 0")
        if given and dim in given:
            wish = F.create_map(*(F.lit(x) for name, share in given[dim].items() for x in (name, float(share))))
            own = own.withColumn("raw", F.coalesce(F.try_element_at(wish, "value"), F.lit(float(given[dim].get(OTHERS, 0.0)))))
        else:
            own = own.withColumn("raw", F.pow(F.col("tokens").cast("double"), F.lit(temper)))
        total = own.agg(F.sum("raw").alias("all"))
        part = own.join(F.broadcast(total)).select(F.lit(dim).alias("dim"), "value", F.expr("coalesce(try_divide(raw, `all`), 0.0)").alias("goal"))
        out = part if out is None else out.unionByName(part)
    return out


def rake(cells: DataFrame, by: list[str], goals: DataFrame, rounds: int = ROUNDS, tolerance: float = TOLERANCE, local: int = LOCAL) -> tuple[DataFrame, float]:
    """Cells with a weight: shares of tokens whose marginals meet the goals; and by how much the worst marginal misses its goal.

    Up to `local` cells, a checked number, are raked in the driver; more by Spark, one written table a round. Goals that the
    cells can't meet (a value occurs only together with others that have too little) leave a gap, of which a warning tells.
    """
    work = _rake_local if cells.count() <= local else _rake_spark
    out, gap = work(cells, by, goals, rounds, tolerance)
    if gap > tolerance:
        warnings.warn(f"after {rounds} rounds a marginal misses its target share by {gap:.3g}", stacklevel=2)
    return out, gap


def _rake_local(cells: DataFrame, by: list[str], goals: DataFrame, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    pdf, goal = cells.toPandas(), goals.toPandas()
    codes, wish = [], []
    for dim in by:
        code, values = pd.factorize(pdf[dim])
        codes.append(code)
        own = goal[goal["dim"] == dim].set_index("value")["goal"]
        wish.append(own.reindex(values).fillna(0.0).to_numpy(float))
    w = pdf["tokens"].to_numpy(float)
    sums = lambda k: np.bincount(codes[k], w, len(wish[k]))
    gap = 0.0
    for _ in range(rounds if len(pdf) else 0):
        for k in range(len(by)):
            now = sums(k)
            w = w * np.divide(wish[k], now, out=np.zeros(len(now)), where=now > 0)[codes[k]]
        gap = max(float(np.abs(sums(k) - wish[k]).max()) for k in range(len(by)))
        if gap <= tolerance:
            break
    return cells.sparkSession.createDataFrame(pdf.assign(weight=w), cells.withColumn("weight", F.lit(0.0)).schema), gap


def _rake_spark(cells: DataFrame, by: list[str], goals: DataFrame, rounds: int, tolerance: float) -> tuple[DataFrame, float]:
    goal = {dim: goals.where(F.col("dim") == dim).select(F.col("value").alias(dim), "goal") for dim in by}
    off = lambda df, dim: df.groupBy(dim).agg(F.sum("weight").alias("now")).join(goal[dim], dim)
    cells, gap = save(cells.withColumn("weight", F.col("tokens").cast("double")), "cells"), 0.0
    for _ in range(rounds):
        new = cells
        for dim in by:
            factor = off(new, dim).select(dim, F.coalesce(F.expr("try_divide(goal, now)"), F.lit(0.0)).alias("factor"))
            new = new.join(factor, dim).withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")
        new = save(new, "cells")
        discard(cells)
        cells, worst = new, None
        for dim in by:
            own = off(cells, dim).select(F.abs(F.col("now") - F.col("goal")).alias("off"))
            worst = own if worst is None else worst.union(own)
        gap = worst.agg(F.max("off")).first()[0] or 0.0
        if gap <= tolerance:
            break
    return cells, gap


def rates(cells: DataFrame, keep: float) -> DataFrame:
    """Cells with the probability that a document of theirs is drawn.

    In proportion to weight by tokens, at most 1, such that `keep` of all
    tokens are expected; what capped cells can't give is shared by the others.
    """
    cells = cells.withColumn("ratio", F.coalesce(F.expr("try_divide(weight, tokens)"), F.lit(0.0)))
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    scale, capped = 0.0, -1
    while total:
        full = F.col("ratio") * F.lit(scale) >= 1
        s = cells.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("tokens")).otherwise(0)).alias("fixed"), F.sum(F.when(~full, F.col("ratio") * F.col("tokens")).otherwise(0.0)).alias("free")).first()
        if s["n"] == capped or not s["free"]:
            break
        capped, scale = s["n"], max(scale, (keep * total - s["fixed"]) / s["free"])
    return cells.withColumns({"prob": F.least(F.lit(1.0), F.col("ratio") * F.lit(scale)), "total": F.lit(float(total))})


def mix(docs: DataFrame, by: list[str], tokens: Column, keep: float = 0.5, given: Mapping[str, Mapping[str, float]] | None = None, id_col: str = "doc_id", temper: float = TEMPER, seed: int = 6, local: int = LOCAL) -> DataFrame:
    """The rows with mix_weight (calibration of their tokens), mix_prob, mix_keep (drawn), mix_gap (by which the raked marginals miss their goals) and mix_tokens.

    Token weights of the cells of the columns `by` are raked to the target
    share of each value of each column: those given, or the observed ones to the power `temper`.
    A row is drawn if a hash of its id falls below its cell's probability.

    Null values of a column form a cell value of their own, "\\N". Rows without
    tokens have weight 0 and are never drawn. Rows of one id share their draw, rows of a null id one draw by cell.
    An empty table gives no rows. The added columns replace those of the same name.
    """
    dims = [f"mix_dim{i}" for i in range(len(by))]
    rows = docs.withColumns({d: F.coalesce(docs[c].cast("string"), F.lit("\\N")) for d, c in zip(dims, by, strict=True)} | {"mix_tokens": tokens})
    rows = rows.drop("mix_weight", "mix_prob", "mix_keep", "mix_gap")
    cells = save(rows.where("mix_tokens > 0").groupBy(*dims).agg(F.sum("mix_tokens").alias("tokens"), F.count("*").alias("n")), "cells")
    named = {d: given[c] for d, c in zip(dims, by, strict=True) if c in given} if given else None
    raked, gap = rake(cells, dims, save(targets(cells, dims, named, temper), "goals"), local=local)
    drawn = save(rates(raked, keep).select(*dims, (F.col("ratio") * F.col("total")).alias("mix_weight"), F.col("prob").alias("mix_prob")), "rates")
    count, total = cells.agg(F.count("*"), F.sum("n")).first()
    out = rows.join(F.broadcast(drawn), dims, "left") if count <= local else salted(rows, drawn, dims, heavy(cells, dims, total), [id_col], "left")
    some = F.col("mix_tokens") > 0
    out = out.withColumns({c: F.coalesce(F.when(some, F.col(c)), F.lit(0.0)) for c in ("mix_weight", "mix_prob")} | {"mix_gap": F.lit(gap)})
    return out.withColumn("mix_keep", unit(F.col(id_col), seed=seed) < F.col("mix_prob")).drop(*dims)
