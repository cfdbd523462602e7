"""URL rules and lists behind a blocked Bloom filter; possible hits meet an exact hash join."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import ascii_lower, narrowed, save

#: Bits for each listed key, words of 64 bits in a block, the largest part of a filter in MB that is broadcast.
BITS, WORDS, BROADCAST_MB = 16, 8, 32


def host_of(url: Column) -> Column:
    """After the first :// up to / ? # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """One spelling of a page: no www. or m., no .html, no slash at the end, no query or fragment."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html)?/*$", ""))


def _bits(key: Column) -> list[Column]:
    """For each word of a block, the bit that the key sets there."""
    h = F.xxhash64(key, F.lit(2))
    return [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * i).bitwiseAND(F.lit(63)).cast("int")) for i in range(WORDS)]


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(1)), F.lit(blocks))


def bloom_build(keys: DataFrame, blocks: int) -> DataFrame:
    """Rows (block, w0 .. w7): each key sets one bit in every word of its block."""
    return keys.groupBy(_block(F.col("key"), blocks).alias("block")).agg(*(F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("key")))))


def bloom_keep(rows: DataFrame, filter_: DataFrame, blocks: int, broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """The rows whose key the filter may hold.

    The filter is broadcast in shards of at most broadcast_mb, known from the count of blocks, one after the
    other; each row meets the shard of its block. One shard needs no written table.
    """
    shards = max(1, math.ceil(blocks * 8 * (WORDS + 1) / (broadcast_mb * 2**20)))
    may = reduce(lambda a, b: a & b, (F.col(f"w{i}").bitwiseAND(b) == b for i, b in enumerate(_bits(F.col("key")))))
    rows = rows.withColumn("block", _block(F.col("key"), blocks))
    hits = lambda r, f: r.join(F.broadcast(f), "block").where(may).drop("block", *(f"w{i}" for i in range(WORDS)))
    if shards == 1:
        return hits(rows, filter_)
    own = F.pmod(F.col("block"), F.lit(shards))
    rows, filter_ = save(rows, "candidates"), save(filter_, "bloom")
    return reduce(DataFrame.unionByName, [save(hits(rows.where(own == i), filter_.where(own == i)), "hits") for i in range(shards)])


def url_filter(pages: DataFrame, rules: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", broadcast_mb: float = BROADCAST_MB) -> DataFrame:
    """Verdict on each page's url.

    rules (host, path, verdict) fit a host, its subdomains, and paths that
    start with theirs; the longest wins. Without a rule, a page whose canonical
    url is in listed (key) is blocked, any other allowed. Keys of both go into
    one blocked Bloom filter. A url's candidate keys (each parent domain of no more labels than rules
    have, with each path prefix of a length that rules have; and its canonical form) pass
    it first; the exact join removes false positives. Of rules with the same host and path, and of a
    rule and its like, the last verdict by name wins.

    Returns page_id, host, path, rule, verdict, listed. A null url, or one without ://,
    has an empty host and path and is allowed. Each distinct url is judged
    once. Repeated rows and null ids stay as they are; an empty table gives no rows.
    """
    lengths = sorted(r[0] for r in rules.select(F.length("path")).distinct().collect())
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 0
    own = rules.select(F.concat(F.lit("r"), "host", "path").alias("key"), F.concat("host", "path").alias("rule"), "verdict")
    entries = own.unionByName(listed.select(F.concat(F.lit("u"), "key").alias("key"), F.lit(None).cast("string").alias("rule"), F.lit("block").alias("verdict")))
    entries = save(entries.groupBy("key").agg(F.first("rule").alias("rule"), F.max("verdict").alias("verdict")), "listed")
    blocks = max(1, -(-entries.count() * BITS // (64 * WORDS)))
    bloom = bloom_build(entries, blocks)

    rows = narrowed(pages, page_id=id_col, url=url_col)
    urls = rows.where("url is not null").select("url").distinct().withColumns({"host": host_of(F.col("url")), "path": path_of(F.col("url"))})
    parts = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.greatest(F.lit(1), F.size(parts) - labels + 1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    prefixes = F.filter(F.array(*(F.when(F.length("path") >= n, F.substring("path", 1, n)) for n in lengths)), lambda p: p.isNotNull()) if lengths else F.array().cast("array<string>")
    keys = F.flatten(F.transform(parents, lambda d: F.transform(prefixes, lambda p: F.concat(F.lit("r"), d, p))))
    keys = F.concat(keys, F.array(F.concat(F.lit("u"), canonical(F.col("host"), F.col("path")))))
    candidates = urls.where("host <> '' or path <> ''").select("url", F.explode(F.array_distinct(keys)).alias("key"))
    hits = bloom_keep(candidates, bloom, blocks, broadcast_mb).join(entries, "key")
    best = hits.groupBy("url").agg(F.max(F.struct(F.coalesce(F.length("rule"), F.lit(-1)).alias("n"), "rule", "verdict")).alias("best"), F.bool_or(F.col("rule").isNull()).alias("listed"))
    out = rows.join(best, "url", "left")
    return out.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit("allow")).alias("verdict"), F.coalesce("listed", F.lit(False)).alias("listed"))
