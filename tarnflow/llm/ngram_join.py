"""Exact Jaccard join of documents on word n-grams by blocked sparse products of their incidence."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import components, discard, give_back, heavy, labelled, salted, save, tidy

#: Words of an n-gram; links need 100 * common >= PERCENT * union.
WORDS, PERCENT = 5, 80
#: n-grams of a chunk of documents, at about (with very many ranges more, up to MOST), and of a hash range; documents of a block; rows of a product task.
CHUNK, MOST, RANGE, BLOCK, TASK_ROWS = 400_000, 4_000_000, 1_000_000, 128, 4_096
#: Groups of blocks that meet in one cell of an n-gram's grid.
GRID = 256
#: Documents in the sample that finds very common n-grams, and the hits that make one; columns of a dense product at once.
SAMPLE, COMMON_HITS, COLUMNS = 2_000, 8, 16_384
#: Words whose hash a worker remembers.
REMEMBERED = 150_000

_SHIFT, _MIX = np.uint64(29), np.uint64(0xBF58476D1CE4E5B9)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        out = xxhash.xxh64_intdigest(word)
        if len(word) <= 32:
            self[word] = out
        return out


def shingles(text: str | None, known: dict, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct n-grams of a text, A-Z lower-cased; a shorter text is one n-gram."""
    own = (text or "").encode().lower().split()
    if not own:
        return np.zeros(0, np.uint64)
    h = np.fromiter((known[w] for w in own), np.uint64, len(own))
    n = max(1, len(h) - words + 1)
    out = np.full(n, len(h) if len(h) < words else words, np.uint64)
    for i in range(min(words, len(h))):
        out = (out ^ (out >> _SHIFT)) * _MIX + h[i : i + n]
    out = (out ^ (out >> _SHIFT)) * _MIX
    return np.unique(out ^ (out >> _SHIFT))


def need(n: np.ndarray | int, percent: int = PERCENT):
    """n-grams of a set of n that a partner must hold at least."""
    return -(-n * percent // 100)


def _common(docs: DataFrame, words: int) -> np.ndarray:
    """n-grams that several of some sampled documents hold: they would fill one hash range. The choice affects speed only."""
    many = max(1, docs.count())

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for pdf in frames:
            own = [s for t in pdf["text"] if len(s := shingles(t, known, words))]
            if own:
                h, n = np.unique(np.concatenate(own), return_counts=True)
                yield pd.DataFrame({"hash": h.view(np.int64), "n": n})

    drawn = docs.select("text").sample(min(1.0, SAMPLE / many), seed=8)
    found = drawn.mapInPandas(tidy(run), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON_HITS)
    return np.sort(found.select("hash").toPandas()["hash"].to_numpy(np.int64).view(np.uint64))


def _packed(owner: np.ndarray, docs: int) -> bytes:
    """Whose n-grams these are, in order: how many each document has, or each one's document where that is shorter."""
    if 4 * docs <= 2 * len(owner):
        return b"\0" + np.bincount(owner, minlength=docs).astype(np.uint32).tobytes()
    return b"\1" + owner.astype(np.uint16).tobytes()


def _owners(packed: bytes) -> tuple[np.ndarray, int]:
    if packed[0]:
        return np.frombuffer(packed, np.uint16, offset=1).astype(np.int64), 1 << 16
    counts = np.frombuffer(packed, np.uint32, offset=1)
    return np.repeat(np.arange(len(counts)), counts), len(counts)


def _chunks(bits: int, common: np.ndarray, words: int):
    """Rows (chunk, range, kind, doc data): for each chunk of documents its n-grams by hash range, and what is known of its documents."""
    full = min(MOST, max(CHUNK, 8 << bits))

    def flush(chunk: int, ids: list, sets: list[np.ndarray]) -> list[dict]:
        sizes = np.array([len(s) for s in sets], np.int64)
        every = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(sets)), sizes)
        hot = np.isin(every, common, assume_unique=False) if len(common) else np.zeros(len(every), bool)
        cls = np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)
        out = [{"chunk": chunk, "range": chunk % (1 << bits), "meta": True, "a": ids, "b": sizes.tobytes(), "c": cls.tobytes(), "d": np.bincount(owner[hot], minlength=len(sets)).astype(np.uint32).tobytes(), "e": every[hot].tobytes()}]
        rest, owner = every[~hot], owner[~hot]
        where = (rest >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(where, kind="stable")
        rest, owner, where = rest[order] << np.uint64(bits), owner[order], where[order]
        ranges, low = np.unique(where, return_index=True)
        for r, a, b in zip(ranges.tolist(), low.tolist(), [*low[1:].tolist(), len(where)], strict=True):
            h = rest[a:b]
            out.append({"chunk": chunk, "range": r, "meta": False, "a": None, "b": _packed(owner[a:b], len(sets)), "c": (h >> np.uint64(32)).astype(np.uint32).tobytes(), "d": ((h >> np.uint64(24)) & np.uint64(255)).astype(np.uint8).tobytes(), "e": None})
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, chunk, ids, sets, held = _Hashes(), TaskContext.get().partitionId() << 32, [], [], 0
        types = pa.schema([("chunk", pa.int64()), ("range", pa.int64()), ("meta", pa.bool_()), ("a", pa.list_(pa.int64())), *((c, pa.binary()) for c in "bcde")])
        for batch in batches:
            for low in range(0, len(batch), 256):
                part = batch.slice(low, 256)
                for id_, text in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    ids.append(id_)
                    sets.append(shingles(text.as_py(), known, words))
                    held += len(sets[-1])
                    if held >= full or len(sets) >= 60_000:
                        yield pa.RecordBatch.from_pylist(flush(chunk, ids, sets), types)
                        chunk, ids, sets, held = chunk + 1, [], [], 0
        if sets:
            yield pa.RecordBatch.from_pylist(flush(chunk, ids, sets), types)

    return run


_CHUNK = "chunk bigint, range bigint, meta boolean, a array<bigint>, b binary, c binary, d binary, e binary"


def _repeated(pdf: pd.DataFrame) -> pd.DataFrame:
    """Of the n-grams of one hash range, those that several documents hold, with how many do; in the order they came in."""
    give_back()
    meta, pdf = pdf[pdf["meta"]], pdf[~pdf["meta"]]
    if pdf.empty:
        return meta
    parts = [(np.frombuffer(c, np.uint32).astype(np.uint64) << np.uint64(8)) | np.frombuffer(d, np.uint8) for c, d in zip(pdf["c"], pdf["d"], strict=True)]
    _, back, n = np.unique(np.concatenate(parts), return_inverse=True, return_counts=True)
    n = np.minimum(n, 65_535).astype(np.uint16)[back]
    out, low = [], 0
    for (_, row), own in zip(pdf.iterrows(), parts, strict=True):
        df = n[low : low + len(own)]
        low += len(own)
        again = df > 1
        if again.any():
            owner, docs = _owners(row["b"])
            out.append({"chunk": row["chunk"], "range": row["range"], "meta": False, "a": None, "b": _packed(owner[again], docs), "c": np.frombuffer(row["c"], np.uint32)[again].tobytes(), "d": np.frombuffer(row["d"], np.uint8)[again].tobytes(), "e": df[again].tobytes()})
    return pd.concat([meta, pd.DataFrame(out, columns=list(meta.columns))], ignore_index=True) if out else meta


def _assembled(bits: int, percent: int):
    """Of one chunk: a row for every document, with its repeated n-grams where enough are for it to have a partner, once for each set."""
    drop = np.uint64((1 << 64) - (1 << max(0, 24 - bits)))  # bits that a hash range's rows don't carry

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        head = pdf[pdf["meta"]].iloc[0]
        n, cls = np.frombuffer(head["b"], np.int64), np.frombuffer(head["c"], np.int64)
        hashes, owners, dfs = [np.frombuffer(head["e"], np.uint64) & drop], [np.repeat(np.arange(len(n)), np.frombuffer(head["d"], np.uint32))], []
        dfs.append(np.full(len(hashes[0]), 65_535, np.uint16))
        for _, row in pdf[~pdf["meta"]].iterrows():
            low = (np.frombuffer(row["c"], np.uint32).astype(np.uint64) << np.uint64(32)) | (np.frombuffer(row["d"], np.uint8).astype(np.uint64) << np.uint64(24))
            hashes.append((low >> np.uint64(bits)) | (np.uint64(row["range"]) << np.uint64(64 - bits)))
            owners.append(_owners(row["b"])[0])
            dfs.append(np.frombuffer(row["e"], np.uint16))
        h, owner, df = np.concatenate(hashes), np.concatenate(owners), np.concatenate(dfs)
        order = np.lexsort((h, owner))
        h, owner, df = h[order], owner[order], df[order]
        first = np.searchsorted(owner, np.arange(len(n) + 1))
        grams, prefix, weight, seen = [None] * len(n), [None] * len(n), [None] * len(n), set()
        for k in range(len(n)):
            low, high = first[k], first[k + 1]
            least = need(int(n[k]), percent)
            if n[k] and high - low >= least and cls[k] not in seen:
                seen.add(cls[k])
                own, d = h[low:high], df[low:high]
                singles = n[k] - (high - low)
                grams[k] = own.view(np.int64)
                prefix[k] = own[np.lexsort((own, d))[: n[k] - least + 1 - singles]].view(np.int64)
                weight[k] = float(np.log(d).mean())
        return pd.DataFrame({"doc_id": pd.array([None if x is None or x != x else int(x) for x in head["a"]], "Int64"), "n": n, "cls": cls, "grams": grams, "prefix": prefix, "weight": weight})

    return run


def _product(percent: int):
    """Links between blocks of documents: enough of them to connect what is connected."""

    def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
        col = np.intersect1d(np.concatenate(a), np.concatenate(b))
        out = np.zeros((len(a), len(b)), np.float32)
        for low in range(0, len(col), COLUMNS):
            part = col[low : low + COLUMNS]
            x, y = (np.zeros((len(s), len(part)), np.float32) for s in (a, b))
            for m, sets in ((x, a), (y, b)):
                for k, own in enumerate(sets):
                    at = np.searchsorted(part, own)
                    at[at == len(part)] = 0
                    m[k, at[part[at] == own]] = 1
            out += x @ y.T
        return out

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        links = []
        for _, group in pdf.groupby("pair", sort=False):
            a = group[group["side"] == 0]
            b = group[group["side"] == 1] if (group["side"] == 1).any() else a
            n, m = a["n"].to_numpy(), b["n"].to_numpy()
            both = overlaps([np.asarray(g, np.int64) for g in a["grams"]], [np.asarray(g, np.int64) for g in b["grams"]])
            hit = 100 * both.astype(np.int64) >= percent * (n[:, None] + m[None, :] - both.astype(np.int64))
            ids, other = a["cls"].to_numpy(), b["cls"].to_numpy()
            hit &= ids[:, None] != other[None, :]
            up: dict[int, int] = {}

            def top(x: int, up: dict = up) -> int:
                while (y := up.get(x, x)) != x:
                    up[x] = up.get(y, y)
                    x = y
                return x

            for i, j in zip(*np.nonzero(hit), strict=True):
                x, y = top(int(ids[i])), top(int(other[j]))
                if x != y:
                    up[x] = y
                    links.append((int(ids[i]), int(other[j])))
        return pd.DataFrame(links, columns=["src", "dst"], dtype="int64")

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """Documents linked by the Jaccard similarity of their word n-grams, exactly.

    1. n-grams are hashed and counted over all documents, range by range; the number of ranges
       grows with the input. A document takes part if enough of its n-grams occur elsewhere (the
       size bound of a link), with one row for all documents of an equal set.
    2. Two linked sets must share one of their rarest n-grams, as many as the
       bound allows to miss (a prefix). Sets that do are brought together: each is
       dealt to a block of the most typical set among those it shares with. Blocks of
       sets that are linked to it make its star.
    3. Stars that share an n-gram of a prefix are held against each other by their typical sets.
       These may be linked, and then so are the stars. Jaccard distance is a metric, so stars whose
       typical sets are further apart than three links can't be linked at all.
    4. Blocks of the other pairs of stars, and of sets in no star, that share an n-gram of a prefix are
       multiplied, incidence by incidence, so that overlaps of all their pairs are summed.
    5. Links, no more from a product than connect its documents, give components.

    n-grams, typical sets, blocks and labels of very many rows are dealt to several tasks.

    Returns doc_id, n_shingles, class_id (equal for equal sets; null if empty),
    component_id (smallest doc_id of the component). Null and empty texts have
    no n-gram, are linked with nothing and are their own component. Rows of a
    null id take part; a component of null ids only has a null component_id.
    An empty table gives no rows. Hashes have 64 bits; overlaps use the upper 40 at least.
    """
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(6, int(np.ceil(np.log2(max(1, size / 6 / RANGE)))))
    chunks = rows.mapInArrow(tidy(_chunks(bits, _common(rows, words), words)), _CHUNK)
    again = chunks.groupBy("range").applyInPandas(_repeated, _CHUNK)
    whole = save(again.groupBy("chunk").applyInPandas(_assembled(bits, percent), "doc_id bigint, n bigint, cls bigint, grams array<bigint>, prefix array<bigint>, weight double"), "sets")
    sets = save(whole.where("grams is not null").dropDuplicates(["cls"]).select("cls", "n", "grams", "prefix", "weight"), "classes")

    own, entry = _blocks(sets, percent)
    pairs, links = _pairs(own, entry, sets, percent)
    sides = pairs.select("a", "b", F.col("a").alias("block"), F.lit(0).alias("side")).union(pairs.where("a <> b").select("a", "b", "b", F.lit(1)))
    asked = save(sides.groupBy("block").agg(F.count("*").alias("n")), "asked")
    sized = asked.join(own.groupBy("block").count(), "block").agg(F.sum(F.col("n") * F.col("count"))).first()[0] or 0
    shipped = salted(sides, own.select("block", "cls", "n", "grams"), ["block"], heavy(asked, ["block"], 2 * pairs.count()), ["a", "b"])
    shipped = shipped.select(F.xxhash64("a", "b").alias("pair"), F.pmod(F.xxhash64("a", "b", F.lit(3)), F.lit(max(1, -(-sized // TASK_ROWS)))).alias("task"), "side", "cls", "n", "grams")
    links = links.union(shipped.groupBy("task").applyInPandas(_product(percent), "src bigint, dst bigint")).union(own.where("near and cls <> home").select("cls", "home"))

    root = components(links)
    all_rows = whole.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("cls")).alias("cls"))
    hot = heavy(all_rows.where("cls is not null").groupBy("cls").agg(F.count("*").alias("n")), ["cls"], whole.count())
    rows = salted(all_rows, root.withColumnRenamed("node", "cls"), ["cls"], hot, ["doc_id"], "left").withColumn("label", F.coalesce("root", "cls"))
    rows = save(rows.drop("root"), "labelled")
    discard(whole, sets, own, entry, pairs, asked, root)
    out = labelled(rows, "label", "doc_id", "least")
    return out.select("doc_id", "n_shingles", F.col("cls").alias("class_id"), F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def _blocks(sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Saved: sets (cls, n, grams) with their home, whether they are linked to it (near), and their block; and the n-grams of all prefixes that several sets have (gram, cls)."""
    entry = sets.select("cls", "weight", F.explode("prefix").alias("gram"))
    post = save(entry.groupBy("gram").agg(F.max(F.struct("weight", "cls")).alias("lead"), F.count("*").alias("n")).where("n > 1"), "prefixes")
    total = sets.agg(F.sum(F.size("prefix"))).first()[0] or 0
    entry = save(salted(entry.select("gram", "cls"), post.select("gram", "lead"), ["gram"], heavy(post, ["gram"], total), ["cls"]), "entries")
    homes = save(entry.groupBy("cls").agg(F.max("lead").alias("lead")).select("cls", F.col("lead.cls").alias("home")), "homes")
    held = save(homes.groupBy("home").agg(F.count("*").alias("n")), "held")
    typical = sets.select(F.col("cls").alias("home"), F.col("n").alias("m"), F.col("grams").alias("theirs")).join(held.select("home", F.ceil(F.col("n") / BLOCK).alias("blocks")), "home")
    own = salted(sets.select("cls", "n", "grams").join(homes, "cls"), typical, ["home"], heavy(held, ["home"], homes.count()), ["cls"])
    both = F.size(F.array_intersect("grams", "theirs"))
    own = own.withColumn("near", (F.col("cls") == F.col("home")) | (100 * both >= percent * (F.col("n") + F.col("m") - both)))
    block = F.xxhash64("home", "near", F.pmod(F.xxhash64("cls", F.lit(5)), "blocks"))
    own = save(own.select("cls", "n", "grams", "home", "near", block.alias("block")), "blocks")
    discard(post, homes, held)
    return own, entry.select("gram", "cls")


def _pairs(own: DataFrame, entry: DataFrame, sets: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Saved: pairs of blocks (a, b) to multiply, and links (src, dst) between typical sets of stars.

    An n-gram's stars (and blocks outside of stars) meet in the cells of a grid, each of about GRID
    x GRID of them, so that no task takes all of a common n-gram, and those of one star don't meet at all.
    """
    star = F.when(F.col("near"), F.col("home")).otherwise(F.col("block")).alias("star")
    meet = save(entry.join(own.select("cls", "block", "near", star), "cls").select("gram", "block", "star", "near").distinct(), "meet")
    stars = meet.select("gram", "star", "near").distinct()
    held = save(stars.groupBy("gram").agg(F.count("*").alias("n"), F.bool_and("near").alias("all_near")).where("n > 1 or not all_near"), "grams")
    cells = held.select("gram", F.ceil(F.col("n") / GRID).cast("int").alias("cells"))
    at = save(salted(stars, cells, ["gram"], heavy(held, ["gram"], meet.count()), ["star"]).withColumn("cell", F.pmod(F.xxhash64("star", F.lit(7)), "cells").cast("int")), "stars")
    lane = F.explode(F.sequence(F.lit(0), F.col("cells") - 1))
    left = at.select("gram", F.col("cell").alias("r"), lane.alias("c"), F.col("star").alias("a"), F.col("near").alias("a_near"))
    right = at.select("gram", lane.alias("r"), F.col("cell").alias("c"), F.col("star").alias("b"), F.col("near").alias("b_near"))
    met = save(left.join(right, ["gram", "r", "c"]).where("a < b or (a = b and not a_near)").select("gram", "a", "b", (F.col("a_near") & F.col("b_near")).alias("stars")), "met")

    close = save(met.where("stars").select("a", "b").distinct(), "star-pairs")
    total, typical = close.count(), sets.select("cls", "n", "grams")
    both = close
    for c in ("a", "b"):
        hot = heavy(close.groupBy(c).agg(F.count("*").alias("n")), [c], total)
        both = salted(both, typical.withColumnsRenamed({"cls": c, "n": f"n_{c}", "grams": f"grams_{c}"}), [c], hot, ["a" if c == "b" else "b"])
    common = F.size(F.array_intersect("grams_a", "grams_b"))
    close = save(both.select("a", "b", (100 * common).alias("common"), (F.col("n_a") + F.col("n_b") - common).alias("union")), "close")
    links = close.where(F.col("common") >= percent * F.col("union")).select(F.col("a").alias("src"), F.col("b").alias("dst"))
    open_ = close.where((F.col("common") < percent * F.col("union")) & (F.col("common") >= (3 * percent - 200) * F.col("union"))).select("a", "b")

    todo = met.where("not stars").select("gram", "a", "b").union(met.where("stars").select("gram", "a", "b").join(open_, ["a", "b"], "left_semi").select("gram", "a", "b"))
    for c, name in (("a", "x"), ("b", "y")):
        todo = todo.join(meet.select("gram", F.col("star").alias(c), F.col("block").alias(name)), ["gram", c])
    pairs = save(todo.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "pairs")
    discard(meet, held, at, met)
    return pairs, links
