"""Removal of passages that an earlier document, or an earlier place in the same one, already has."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import heavy, narrowed, salted, save, slices, tidy

#: Sentences of a span and words that it has, both at least: a run is grown to so many words, since stock phrases are no passages.
SPAN, LEAST_WORDS = 3, 20
#: Words in a row without a sentence end of which the one with the least hash ends a part; bytes of text cut at once.
WINDOW, AT_ONCE = 8, 300_000
#: Rows of one id and text that a task makes anew from one of them.
LANE = 4_096
#: Bits of a hash that a sketch of repeated ones goes by (8 MB at any size of the input).
SKETCH = 26
#: Blanks; what ends a sentence; characters of scripts without blanks between words, each taken as a word. Fixed values.
BLANKS, ENDS = " \t\r\n\x0b\x0c\x85\xa0\u2028\u3000", ".!?\n\u3002\uff01\uff1f\uff61\u061f\u06d4\u0964\u0965\u2026"
SOLO = ((0x0E00, 0x0EFF), (0x0F00, 0x0FFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9D), (0x20000, 0x3FFFF))
#: A word's hash is that of its characters so far, times BASE, plus the next character, modulo 2 ** 64; it starts from BASE and ends with one more step.
BASE = 0x1E3779B97F4A7C15

_BLANK, _END, _SOLO = 1, 2, 4
_KIND = np.zeros(0x110000, np.uint8)
for _low, _high in SOLO:
    _KIND[_low : _high + 1] = _SOLO
for _c in ENDS:
    _KIND[ord(_c)] = _END
for _c in BLANKS:
    _KIND[ord(_c)] |= _BLANK
_STEP = 0xD6E8FEB86659FD93
_BACK = pow(_STEP, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Parts:
    """Texts cut into parts: `doc` (of each part), `low` (its first character in its text), `first` (part of each text, and their number last).

    A part is a sentence, and of a long sentence what ends with the word of the least
    hash of any WINDOW words that no sentence end divides. Both are read off the
    words around, so a passage is cut alike wherever it stands, and no part has more
    than WINDOW words. Blanks go with the word before; the parts are the text.
    """

    def __init__(self, texts: list[str]):
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(sizes) - sizes
        kind = _KIND[codes]
        before = np.concatenate([[_BLANK], kind[:-1]]).astype(np.uint8)[: len(kind)]
        before[begin[sizes > 0]] = _BLANK
        word = (kind & _BLANK) == 0
        at = np.flatnonzero(word & ((before & _BLANK > 0) | (kind & _SOLO > 0) | ((before & (_END | _SOLO) > 0) & (kind & _END == 0))))
        self.words = n = len(at)
        if not n:
            self.doc = np.flatnonzero(sizes)
            self.low, self.first = np.zeros(len(self.doc), np.int64), np.concatenate([[0], np.cumsum(sizes > 0)])
            return
        place = np.arange(len(codes))
        place[: at[0]] = 0
        place[at[0] :] -= np.repeat(at, np.diff(at, append=len(codes)))
        size = np.add.reduceat(word.astype(np.int64), at)
        left = np.zeros(len(codes), np.int64)
        left[at[0] :] = np.repeat(size, np.diff(at, append=len(codes)))
        left = np.where(word, left - place, 0)
        powers = _powers(BASE, int(size.max()) + 2)
        h = powers[size + 2] + np.add.reduceat(np.where(word, codes.astype(np.uint64), np.uint64(0)) * powers[left], at)
        self._hash = _mixed(h)
        doc = np.searchsorted(begin, at, side="right") - 1
        ends = np.maximum.reduceat(kind & _END, at) > 0
        ends[:-1] |= doc[1:] != doc[:-1]
        ends[-1] = True
        cut = ends.copy()
        if n >= WINDOW:
            sentence = np.cumsum(ends) - ends
            m = n - WINDOW + 1
            inside = sentence[:m] == sentence[WINDOW - 1 :]
            least = h[:m].copy()
            for k in range(1, WINDOW):
                np.minimum(least, h[k : k + m], out=least)
            for k in range(WINDOW):
                cut[k : k + m] |= inside & (h[k : k + m] == least)
        self._at = start = np.flatnonzero(np.concatenate([[True], cut[:-1]]))
        own, low = doc[start], at[start]
        leading = np.concatenate([[True], own[1:] != own[:-1]])
        low = np.where(leading, 0, low - begin[own])
        bare = np.setdiff1d(np.flatnonzero(sizes), own)  # blanks only: one part without words
        self._known = own
        order = np.argsort(np.concatenate([own, bare]), kind="stable")
        self.doc, self.low = np.concatenate([own, bare])[order], np.concatenate([low, np.zeros(len(bare), np.int64)])[order]
        self.first = np.searchsorted(self.doc, np.arange(len(texts) + 1))

    def spans(self, span: int, least_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(text, first part, part after the last, hash) of the shortest runs from each part and to each part that are long enough."""
        if not self.words:
            return (np.zeros(0, np.int64),) * 4
        n, doc, bound = len(self._at), self._known, np.append(self._at, self.words)
        first = np.searchsorted(doc, doc)
        end = np.searchsorted(doc, doc, side="right")
        each = np.arange(n)
        on = np.maximum(each + span, np.searchsorted(bound, bound[:-1] + least_words))
        back = np.minimum(each + 1 - span, np.searchsorted(bound, bound[1:] - least_words, side="right") - 1)
        pairs = np.concatenate([((each << 32) | on)[on <= end], ((back << 32) | (each + 1))[back >= first]])
        pairs = np.unique(pairs)
        low, high = pairs >> 32, pairs & 0xFFFFFFFF
        a, b = bound[low], bound[high]
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self._hash * _powers(_STEP, self.words)[: self.words], dtype=np.uint64)])
        h = _mixed((total[b] - total[a]) * _powers(_BACK, self.words)[a] + (b - a).astype(np.uint64))
        return doc[low], low - first[low], high - first[low], h.view(np.int64)


def sentences(text: str) -> list[str]:
    """The parts of a text."""
    return [text[a:b] for a, b in pairwise([*Parts([text]).low.tolist(), len(text)])]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Stretches of rows with their texts ("" for null)."""
    for batch in batches:
        for part in slices(batch, batch.schema.get_field_index("text"), AT_ONCE):
            yield part, [t or "" for t in part.column("text").to_pylist()]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, least_words: int = LEAST_WORDS) -> DataFrame:
    """Each text without the sentences that a repeated span covers, except where the span comes first.

    Sentences of more than WINDOW words are cut at words that the words around choose
    (Parts). A span is a run of at least `span` of them and `least_words` words; from each
    sentence, and to each sentence, the shortest such run is hashed. So a passage of 50 words that
    repeats, wherever it begins, has 34 words in whole sentences at least, and such a run. Hashes
    are counted first, and a sketch of the repeated ones, of bounded size, spares most others the
    way with their places. The first place of a hash, by id, hash of the text and position, is
    found over all documents with partial aggregates, and only hashes with several places meet the
    spans again; rows of a very common passage are dealt to several tasks. Sentences of any other place are removed.

    Returns doc_id, n_sentences, n_removed, removed (their positions, in order), kept_text.
    A row is known by its id and a hash of its text, so the result doesn't depend on how the input is
    split or read. Null text has no sentence and stays null. A null id comes before all
    others. Of rows that repeat id and text one counts as the first; the others lose every sentence
    of a span. An empty table gives no rows.
    """
    who = F.xxhash64("doc_id", F.lit(1))
    rows = narrowed(docs, doc_id=id_col, text=text_col).withColumns({"who": who, "key": F.xxhash64("text")})
    copies = save(rows.groupBy("who", "key").agg(F.count("*").alias("n")).where("n > 1"), "copies")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _slices(batches):
            h, n = np.unique(Parts(texts).spans(span, least_words)[3], return_counts=True)
            yield pa.RecordBatch.from_pydict({"hash": pa.array(h, pa.int64()), "n": pa.array(n, pa.int64())})

    again = rows.select("text").mapInArrow(tidy(counted), "hash bigint, n bigint").groupBy("hash").agg(F.sum("n").alias("n")).where("n > 1")
    bit = again.select(F.shiftrightunsigned("hash", 64 - SKETCH).alias("bit"))
    words = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")).toArrow()
    sketch = np.zeros(1 << (SKETCH - 6), np.int64)
    sketch[words["word"].to_numpy()] = words["bits"].to_numpy()
    sketch = sketch.view(np.uint64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            doc, at, to, h = Parts(texts).spans(span, least_words)
            bit = h.astype(np.int64).view(np.uint64) >> np.uint64(64 - SKETCH)
            hit = np.flatnonzero((sketch[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1))
            if len(hit):
                own = part.select(["doc_id", "key"]).take(pa.array(doc[hit]))
                yield pa.RecordBatch.from_pydict({"hash": pa.array(h[hit]), "doc_id": own.column("doc_id"), "key": own.column("key"), "at": pa.array(at[hit], pa.int32()), "to": pa.array(to[hit], pa.int32())})

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in _slices(batches):
            parts = Parts(texts)
            removed, kept = [[]] * len(part), part.column("text").to_pylist()
            every: dict[int, list[tuple[int, int]]] = {}
            if any(repeats := part.column("repeat").to_pylist()):
                for d, a, b in zip(*(x.tolist() for x in parts.spans(span, least_words)[:3]), strict=True):
                    every.setdefault(d, []).append((a, b))
            for i, covered in enumerate(part.column("covered").to_pylist()):
                runs = every.get(i, []) if repeats[i] else [(s["at"], s["to"]) for s in covered or []]
                if runs:
                    low = parts.low[parts.first[i] : parts.first[i + 1]].tolist()
                    gone = np.zeros(len(low), bool)
                    for a, b in runs:
                        gone[a:b] = True
                    removed[i] = np.flatnonzero(gone).tolist()
                    kept[i] = "".join(texts[i][a:b] for (a, b), out in zip(pairwise([*low, len(texts[i])]), gone, strict=True) if not out)
            yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_sentences": pa.array(np.diff(parts.first), pa.int32()), "n_removed": pa.array(map(len, removed), pa.int32()), "removed": pa.array(removed, pa.list_(pa.int32())), "kept_text": pa.array(kept, pa.string())})

    id_type = rows.schema["doc_id"].dataType.simpleString()
    spans = save(rows.mapInArrow(tidy(hashed), f"hash bigint, doc_id {id_type}, key bigint, at int, to int"), "spans")
    first = spans.groupBy("hash").agg(F.min(F.struct("doc_id", "key", "at")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = save(first.select("hash", F.xxhash64("first.doc_id", F.lit(1)).alias("first_who"), F.col("first.key").alias("first_key"), F.col("first.at").alias("first_at"), "n"), "first")
    later = salted(spans.withColumn("who", who), first.drop("n"), ["hash"], heavy(first, ["hash"], spans.count()), ["who", "key", "at"])
    later = later.where("who <> first_who or key <> first_key or at <> first_at")
    covered = later.groupBy("who", "key").agg(F.collect_set(F.struct("at", "to")).alias("covered"))

    lone, same = rows, copies.agg(F.sum("n")).first()[0] or 0
    if same:
        hot, split = heavy(copies, ["who", "key"], same), [F.spark_partition_id()]
        lone = salted(rows, copies.select("who", "key"), ["who", "key"], hot, split, "left_anti")
    out = lone.join(covered, ["who", "key"], "left").select("doc_id", "text", "covered", F.lit(False).alias("repeat"))
    if same:
        one = salted(rows, copies, ["who", "key"], hot, split).groupBy("who", "key", "n").agg(F.first("doc_id").alias("doc_id"), F.first("text").alias("text")).join(covered, ["who", "key"], "left")
        lane = one.withColumn("lane", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / LANE)))).hint("rebalance")
        turn = F.explode(F.sequence(F.col("lane") * LANE + 1, F.least(F.col("n"), (F.col("lane") + 1) * LANE)))
        out = out.unionByName(lane.withColumn("turn", turn).select("doc_id", "text", "covered", (F.col("turn") > 1).alias("repeat")))
    return out.mapInArrow(tidy(cleaned), f"doc_id {id_type}, n_sentences int, n_removed int, removed array<int>, kept_text string")
