"""Shards of near-equal size by sampled splitters; DataFrame functions only."""

from __future__ import annotations

import bisect
import heapq
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnflow.llm.shared import narrowed, save, unit

#: Ranges for each shard; sampled keys for each range; bits of a key that find its splitters.
RANGES, SAMPLES, TOP_BITS = 32, 16, 12
#: A range of more than this part of a shard is subdivided.
OVERFULL = 0.5


def _table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A small table of literals."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def shard(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", ranges: int = RANGES) -> DataFrame:
    """Each document's shard, under the law "bytes": sizes of shards are near equal.

    A document's key is a hash of its text, so equal texts lie side by side.
    A sample of keys, weighted by size, gives quantile splitters; these cut the
    keys into shards x ranges ranges. A range that exceeds half a shard (a
    large group of copies, which then lies in several shards, as near equal sizes demand) is subdivided by row. Exact sizes of the ranges, a
    table of a size set by parameters, decide which shard takes each range. A text larger than a shard stays whole, so its shard is larger.

    Returns doc_id, size (UTF-8 bytes and 16), text_crc32, law, shard, slot
    (gapless in its shard), grown_shard (null: this law has none). Null text
    counts as empty, null ids and repeated rows are rows like others. An
    empty table gives no rows.
    """
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    rows = save(rows.select("doc_id", (F.octet_length("text") + 16).cast("long").alias("size"), F.crc32("text").alias("text_crc32"), F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("row")), "sizes")
    spark, total = docs.sparkSession, rows.agg(F.sum("size")).first()[0] or 0
    parts = shards * ranges
    sample = rows.where(unit("row", seed=1) < F.col("size") * (parts * SAMPLES / max(total, 1)))
    cuts = sample.agg(F.percentile_approx("key", [i / parts for i in range(1, parts)], 20 * parts)).first()[0]
    cuts = sorted(set(cuts or []))

    step = 1 << (64 - TOP_BITS)
    tops = [(top, bisect.bisect_left(cuts, top * step), cuts[bisect.bisect_left(cuts, top * step) : bisect.bisect_left(cuts, (top + 1) * step)]) for top in range(-(1 << TOP_BITS - 1), 1 << TOP_BITS - 1)]
    lookup = F.broadcast(_table(spark, tops, "top bigint, below int, cuts array<bigint>"))
    ranged = rows.withColumn("top", F.shiftright("key", 64 - TOP_BITS)).join(lookup, "top")
    ranged = ranged.withColumn("range", F.col("below") + F.size(F.filter("cuts", lambda c: c <= F.col("key")))).drop("top", "below", "cuts")

    sizes = ranged.groupBy("range").agg(F.sum("size").alias("size")).collect()
    split = [(r["range"], -(-r["size"] * parts // total)) for r in sizes if r["size"] * shards > OVERFULL * total]
    divided = F.broadcast(_table(spark, split, "range int, pieces bigint"))
    ranged = ranged.join(divided, "range", "left").withColumn("piece", F.coalesce(F.pmod(F.xxhash64("row"), "pieces"), F.lit(0).cast("long"))).drop("pieces")

    load = [(0, s, 0) for s in range(shards)]
    placed = []
    exact = ranged.groupBy("range", "piece").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect()
    for r in sorted(exact, key=lambda r: (-r["size"], r["range"], r["piece"])):
        size, s, n = heapq.heappop(load)
        placed.append((r["range"], r["piece"], s, n))
        heapq.heappush(load, (size + r["size"], s, n + r["n"]))
    plan = F.broadcast(_table(spark, placed, "range int, piece bigint, shard int, start bigint"))
    inside = Window.partitionBy("range", "piece").orderBy("key", "doc_id", "row")
    return ranged.join(plan, ["range", "piece"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.row_number().over(inside) - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
