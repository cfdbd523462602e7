"""Exact de-duplication of a new batch against an immutable snapshot, screened by binary-fuse filters."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import heavy, marked, narrowed, salted, save, tidy

#: Digests of the snapshot, and of a piece of the batch, in one bucket at most, at about.
FILTER_KEYS = 100_000

_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)


def _mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    h = keys + np.uint64((seed * 0x9E3779B97F4A7C15) & (2**64 - 1))
    for m in (_M1, _M2):
        h = (h ^ (h >> np.uint64(33))) * m
    return h ^ (h >> np.uint64(33))


def _places(h: np.ndarray, length: int, count: int) -> np.ndarray:
    """Three places of each hash, in three segments in a row; and nothing outside count + 2 segments of a length."""
    first = ((h >> np.uint64(32)) * np.uint64(count * length) >> np.uint64(32)).astype(np.int64)
    mask = length - 1
    second = (first + length) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
    third = (first + 2 * length) ^ (h.astype(np.int64) & mask)
    return np.stack([first, second, third])


def _prints(h: np.ndarray) -> np.ndarray:
    return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)


def fuse_build(keys: np.ndarray) -> tuple[int, int, int, bytes]:
    """A static 3-wise binary-fuse filter with 16-bit fingerprints: (seed, segment length, segments, table).

    All places that hold one key are peeled at once, round by round; the
    rounds are then filled backwards. A seed that leaves a core is replaced.
    """
    keys = np.unique(keys.astype(np.uint64))
    n = len(keys)
    length = 1 << max(2, int(np.floor(np.log(max(n, 2)) / np.log(3.33) + 2.25)))
    room = int(n * max(1.125, 0.875 + 0.25 * np.log(1e6) / np.log(max(n, 2)))) + 4 * length
    count = max(1, -(-room // length) - 2)
    for seed in range(1, 200):
        h = _mixed(keys, seed)
        at = _places(h, length, count)
        size = (count + 2) * length
        alive = np.ones(n, bool)
        degree = np.bincount(at.ravel(), minlength=size)
        inside = np.zeros(size, np.int64)
        np.bitwise_xor.at(inside, at.ravel(), np.tile(np.arange(n), 3))
        rounds = []
        while len(single := np.flatnonzero(degree == 1)):
            k, where = np.unique(inside[single], return_index=True)
            rounds.append((k, single[where]))
            alive[k] = False
            np.subtract.at(degree, at[:, k].ravel(), 1)
            np.bitwise_xor.at(inside, at[:, k].ravel(), np.tile(k, 3))
        if alive.any():
            continue
        table, prints = np.zeros(size, np.uint16), _prints(h)
        for k, own in reversed(rounds):
            table[own] = 0
            table[own] = prints[k] ^ np.bitwise_xor.reduce(table[at[:, k]], axis=0)
        return seed, length, count, table.tobytes()
    raise RuntimeError("no seed gives a binary-fuse filter")


def fuse_has(keys: np.ndarray, seed: int, length: int, count: int, table: bytes) -> np.ndarray:
    """For each key: may it be in the filter? Never false for a key that is."""
    h = _mixed(keys.astype(np.uint64), seed)
    return _prints(h) == np.bitwise_xor.reduce(np.frombuffer(table, np.uint16)[_places(h, length, count)], axis=0)


def _keys(digests: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(d[:8] for d in digests), "<u8")


def sha256(text: bytes) -> bytes:
    return hashlib.sha256(text).digest()


def _digested(columns: list[str], with_text: bool, digest: Callable[[bytes], bytes]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [(t or "").encode().lower() for t in b.column(0).to_pylist()]
            rows = {c: b.column(c) for c in columns} | {"digest": pa.array([digest(t) for t in texts], pa.binary()), "size": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_pydict(rows | ({"body": pa.array(texts, pa.binary())} if with_text else {}))

    return tidy(run)


def _rows(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Saved: doc_id, text_key, digest, size and a number of the row."""
    rows = narrowed(docs, text=text_col, doc_id=id_col).withColumn("text_key", F.xxhash64("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_digested(["doc_id", "text_key"], False, digest), f"doc_id {kind}, text_key bigint, digest binary, size bigint")
    return save(out.withColumn("row", F.monotonically_increasing_id()), "digests")


def _groups(rows: DataFrame) -> DataFrame:
    return save(rows.groupBy("digest", "size").agg(F.max(F.struct("doc_id", "row")).alias("last"), F.count("*").alias("n")), "groups")


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(buckets)).alias("bucket")


@dataclass(frozen=True)
class Snapshot:
    """An immutable set of documents, digested once: its texts, rows, groups of equal digests, and a filter for each bucket of digests."""

    texts: DataFrame
    rows: DataFrame
    groups: DataFrame
    filters: DataFrame
    buckets: int


def snapshot(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256) -> Snapshot:
    """Digest a snapshot and build its binary-fuse filters, one for each bucket of about FILTER_KEYS digests; all are written, so that any number of batches can meet them."""
    rows = _rows(docs, id_col, text_col, digest)
    groups = _groups(rows)
    buckets = max(16, -(-groups.count() // FILTER_KEYS))

    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        seed, length, count, table = fuse_build(_keys(pdf["digest"]))
        return pd.DataFrame({"bucket": [key[0]], "seed": [seed], "length": [length], "count": [count], "cells": [table]})

    filters = groups.select(_bucket(buckets), "digest").groupBy("bucket").applyInPandas(build, "bucket bigint, seed bigint, length bigint, count bigint, cells binary")
    return Snapshot(narrowed(docs, text=text_col, doc_id=id_col), rows, groups, save(filters, "fuse"), buckets)


def _screened(fresh: DataFrame, old: Snapshot) -> DataFrame:
    """The groups of a batch that the filter of their bucket may hold. A batch that is larger than the snapshot is cut into pieces, which all meet the filter."""
    pieces = max(1, -(-fresh.count() // (old.buckets * FILTER_KEYS)))
    new = fresh.select(_bucket(old.buckets), F.pmod(F.xxhash64("digest", F.lit(1)), F.lit(pieces)).cast("int").alias("piece"), "digest", "size", F.col("last.doc_id").alias("new_id"))
    filters = old.filters.withColumn("piece", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))

    def screen(key: tuple, new: pd.DataFrame, filter_: pd.DataFrame) -> pd.DataFrame:
        if new.empty or filter_.empty:
            return new.iloc[:0][["digest", "size", "new_id"]]
        f = filter_.iloc[0]
        return new[fuse_has(_keys(new["digest"]), int(f["seed"]), int(f["length"]), int(f["count"]), f["cells"])][["digest", "size", "new_id"]]

    kind = fresh.schema["last"].dataType["doc_id"].dataType.simpleString()
    return new.groupBy("bucket", "piece").cogroup(filters.groupBy("bucket", "piece")).applyInPandas(screen, f"digest binary, size bigint, new_id {kind}")


def exact_dedup(incoming: DataFrame, known: DataFrame | Snapshot, id_col: str = "doc_id", text_col: str = "text", digest: Callable[[bytes], bytes] = sha256) -> DataFrame:
    """Groups of equal texts over a snapshot and a new batch; equal: the same after lower-casing A-Z.

    Digests of the snapshot go into static binary-fuse filters, one per digest
    bucket; give a stored Snapshot to use those that it has. Digests of the batch are first grouped among themselves; then the
    filters screen them. Only positives are joined with the exact digests, and
    only for these are texts read again and the bytes of both compared: texts of one digest and size
    that differ form two groups, the snapshot's and the batch's. Rows of a very
    common text are dealt to several tasks.

    Returns a row per input row: doc_id, new (it came with the batch), text_key
    (hash of the text as it is), digest, size, keep_id, group_size, kept. The largest id of a group stays. Null text
    counts as empty. A null id is smaller than any other. Of rows that repeat
    id and text, one stays. Empty tables give no rows. Other columns are left out.
    """
    old = known if isinstance(known, Snapshot) else snapshot(known, id_col, text_col, digest)
    fresh_rows = _rows(incoming, id_col, text_col, digest)
    fresh = _groups(fresh_rows)
    theirs = old.groups.select("digest", "size", F.col("last.doc_id").alias("old_id"))
    hits = save(_screened(fresh, old).join(theirs, ["digest", "size"]), "hits")

    reps = hits.select("digest", "size", "old_id", "new_id")
    texts = [(old.texts, "old_id"), (narrowed(incoming, text=text_col, doc_id=id_col), "new_id")]
    bodies = None
    for docs, rep in texts:
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = marked(docs, ["doc_id"], hits.select(F.col(rep).alias("doc_id"))).where("may").drop("may").mapInArrow(_digested(["doc_id"], True, digest), f"doc_id {kind}, digest binary, size bigint, body binary")
        own = reps.select("digest", "size", F.col(rep).alias("rep_id"))
        part = found.withColumnsRenamed({"digest": "d", "size": "s"}).join(own, (F.col("d") == F.col("digest")) & (F.col("s") == F.col("size")) & F.col("doc_id").eqNullSafe(F.col("rep_id"))).select("digest", "size", "body")
        bodies = part if bodies is None else bodies.unionByName(part)
    same = bodies.groupBy("digest", "size").agg((F.min("body") == F.max("body")).alias("same")).where("same").drop("same")

    merged = old.groups.withColumn("new", F.lit(False)).unionByName(fresh.withColumn("new", F.lit(True))).join(same.withColumn("in_old", F.lit(True)), ["digest", "size"], "left")
    merged = save(merged.withColumn("apart", F.col("new") & F.col("in_old").isNull()), "merged")
    # a row's number is its own only within the snapshot or the batch, so "new" decides between rows of one id
    best = merged.groupBy("digest", "size", "apart").agg(F.max(F.struct("last.doc_id", "new", "last.row")).alias("best"), F.sum("n").alias("group_size"))
    by_group = merged.select("digest", "size", "new", "apart", "n").join(best, ["digest", "size", "apart"]).drop("apart")
    rows = old.rows.withColumn("new", F.lit(False)).unionByName(fresh_rows.withColumn("new", F.lit(True)))
    hot = heavy(merged, ["digest", "size", "new"], rows.count())
    out = salted(rows, by_group.drop("n"), ["digest", "size", "new"], hot, ["row"])
    kept = (F.col("row") == F.col("best.row")) & (F.col("new") == F.col("best.new"))
    return out.select("doc_id", "new", "text_key", "digest", "size", F.col("best.doc_id").alias("keep_id"), F.col("group_size").cast("long"), kept.alias("kept"))
