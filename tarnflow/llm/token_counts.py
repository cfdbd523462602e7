"""Token counts that follow edits: a segment tree of pre-token runs for each document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import narrowed, slices, tidy
from tarnflow.llm.tokens import TOKENIZER, Ids, counts, ids, tokenizer_path

#: Characters of a leaf, at least; a leaf begins before white space, where no token can span.
LEAF = 256
#: Bytes of text whose leaves are counted at once.
AT_ONCE = 2_000_000

EDIT = "array<struct<start:bigint,stop:bigint,text:string>>"


def leaves(text: str) -> list[str]:
    """The text in parts of at least LEAF characters, cut only before a blank, tab or line end."""
    out, low, n = [], 0, len(text)
    while low < n:
        high = low + LEAF
        while high < n and text[high] not in " \t\n\r":
            high += 1
        out.append(text[low:high])
        low = high
    return out


class Tree:
    """Sums of characters and tokens over leaves; a leaf's change updates the nodes above it only."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.n = len(chars)
        self.width = 1 << max(0, self.n - 1).bit_length()
        self.sums = np.zeros((2 * self.width, 2), np.int64)
        if self.n:
            self.sums[self.width : self.width + self.n] = np.array([chars, tokens]).T
        for level in (1 << b for b in reversed(range(self.width.bit_length() - 1))):
            self.sums[level : 2 * level] = self.sums[2 * level : 4 * level : 2] + self.sums[2 * level + 1 : 4 * level : 2]

    @property
    def total(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character `at` (the last, if it is past the end) and where that leaf starts."""
        node, start = 1, 0
        while node < self.width:
            node *= 2
            if at - start >= self.sums[node, 0] and self.sums[node + 1, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.width, start

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        change = (chars, tokens) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2

    def lists(self) -> tuple[list[int], list[int]]:
        own = self.sums[self.width : self.width + self.n]
        own = own[own[:, 0] > 0]
        return own[:, 0].tolist(), own[:, 1].tolist()


def opened(text: str, tree: Tree, start: int, stop: int, new: str) -> tuple[str, int, int, list[str]]:
    """The text after text[start:stop] became new, the first and last leaf that this touches, and the leaves that take their place.

    Touched leaves are made anew, with the leaf before when the edit reaches
    a leaf's first character: the white space that parted the two may be gone.
    """
    start = min(max(start, 0), len(text))
    stop = min(max(stop, start), len(text))
    first, low = tree.find(max(start - 1, 0))
    last, at = tree.find(max(stop - 1, start - 1, 0))
    high = at + int(tree.sums[last + tree.width, 0])
    region = text[low:start] + new + text[stop:high]
    return text[:low] + region + text[high:], first, last, leaves(region)


def replaced(tree: Tree, first: int, last: int, chars: list[int], tokens: list[int]) -> Tree:
    """The tree with other leaves in place of some: sums above them are updated where they fit in, else the tree is made from its leaves."""
    if len(chars) <= last - first + 1 and tree.n:
        for k, leaf in enumerate(range(first, last + 1)):
            tree.put(leaf, *((chars[k], tokens[k]) if k < len(chars) else (0, 0)))
        return tree
    before, after = tree.sums[tree.width : tree.width + first], tree.sums[tree.width + last + 1 : tree.width + tree.n]
    return Tree([*before[:, 0].tolist(), *chars, *after[:, 0].tolist()], [*before[:, 1].tolist(), *tokens, *after[:, 1].tolist()])


def _many(parts: list[list[str]], known: Ids) -> list[list[int]]:
    """Tokens of the leaves of several documents, counted together."""
    n, bounds = counts([*chain.from_iterable(parts)], known).tolist(), [0, *accumulate(map(len, parts))]
    return [n[a:b] for a, b in pairwise(bounds)]


def token_trees(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, keep: bool = False) -> DataFrame:
    """Each document's token count and the leaves of its tree: doc_id, n_tokens, leaf_chars, leaf_tokens (int lists), and its text if keep.

    Null and empty texts have no tokens and no leaves. Null ids and repeated
    rows are rows like others, other columns are left out; an empty table gives no rows.
    """
    path, kind = tokenizer_path(tokenizer), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids(path)
        for batch in batches:
            for b in slices(batch, 1, AT_ONCE):
                parts = [leaves(t or "") for t in b.column(1).to_pylist()]
                tokens = _many(parts, known)
                out = {"doc_id": b.column(0), "n_tokens": pa.array([sum(t) for t in tokens], pa.int64()), "leaf_chars": pa.array([[len(p) for p in own] for own in parts], pa.list_(pa.int32())), "leaf_tokens": pa.array(tokens, pa.list_(pa.int32()))}
                yield pa.RecordBatch.from_pydict(out | ({"text": b.column(1)} if keep else {}))

    return narrowed(docs, doc_id=id_col, text=text_col).mapInArrow(tidy(run, keeps=True), f"doc_id {kind}, n_tokens bigint, leaf_chars array<int>, leaf_tokens array<int>" + ", text string" * keep)


def apply_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits_col: str = "edits", trees: tuple[str, str] | None = None, tokenizer: str = TOKENIZER, with_text: bool = False) -> DataFrame:
    """Token counts before and after each document's edits, applied one after the other.

    edits is an array of (start, stop, text): characters start to stop become
    text; places outside the text are moved to its ends; a null list, edit or text is
    empty. trees names the columns leaf_chars and leaf_tokens of an earlier
    state, such as token_trees() stored; then only the leaves that edits touch are encoded. Without it, or
    where its characters aren't those of the text, the tree is built here.

    Returns doc_id, tokens_before, tokens_after, encoded_chars (of all that was encoded here), text_crc32 of the
    edited text, leaf_chars, leaf_tokens, and the edited text if with_text. Null texts count as empty,
    null ids and repeated rows as rows like others; other columns are left out, an empty table gives no rows.
    Rows don't meet, so nothing is shuffled, and a document's edits must fit into a row.
    """
    path, kind = tokenizer_path(tokenizer), docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), docs[edits_col].cast(EDIT).alias("edits"), *((docs[c] for c in trees) if trees else ()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = ids(path)
        for batch in batches:
            for b in slices(batch, 1, AT_ONCE):
                texts, edits = [t or "" for t in b.column(1).to_pylist()], [[e for e in own or [] if e] for own in b.column(2).to_pylist()]
                state = [Tree(*(x or [] for x in own)) for own in zip(b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True)] if trees else [Tree([], [])] * len(texts)
                stale = [k for k, (t, text) in enumerate(zip(state, texts, strict=True)) if t.sums[1, 0] != len(text)]
                made = [leaves(texts[k]) for k in stale]
                again = [0] * len(texts)
                for k, own, n in zip(stale, made, _many(made, known), strict=True):
                    state[k], again[k] = Tree([len(p) for p in own], n), len(texts[k])
                before = [t.total for t in state]
                for turn in range(max(map(len, edits), default=0)):
                    open_ = [k for k, own in enumerate(edits) if turn < len(own)]
                    found = []
                    for k in open_:
                        e = edits[k][turn]
                        texts[k], *where = opened(texts[k], state[k], e["start"] or 0, e["stop"] or 0, e["text"] or "")
                        found.append(where)
                    for k, (first, last, parts), n in zip(open_, found, _many([parts for _, _, parts in found], known), strict=True):
                        chars = [len(p) for p in parts]
                        state[k], again[k] = replaced(state[k], first, last, chars, n), again[k] + sum(chars)
                lists = [t.lists() for t in state]
                whole = lambda x: pa.array(x, pa.int64())
                out = {"doc_id": b.column(0), "tokens_before": whole(before), "tokens_after": whole([t.total for t in state]), "encoded_chars": whole(again), "text_crc32": whole([zlib.crc32(t.encode()) for t in texts])}
                out |= {name: pa.array([x[i] for x in lists], pa.list_(pa.int32())) for i, name in enumerate(("leaf_chars", "leaf_tokens"))}
                yield pa.RecordBatch.from_pydict(out | ({"text": pa.array(texts, pa.string())} if with_text else {}))

    return rows.mapInArrow(tidy(run, keeps=True), f"doc_id {kind}, tokens_before bigint, tokens_after bigint, encoded_chars bigint, text_crc32 bigint, leaf_chars array<int>, leaf_tokens array<int>" + ", text string" * with_text)


def with_edits(docs: DataFrame, edits: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Documents with their edits (id, seq, start, stop, text) as a list in the order of seq; null where there are none."""
    own = edits.groupBy(id_col).agg(F.sort_array(F.collect_list(F.struct("seq", "start", "stop", "text"))).alias("edits"))
    own = own.select(id_col, F.transform("edits", lambda e: F.struct(e["start"].cast("long").alias("start"), e["stop"].cast("long").alias("stop"), e["text"].alias("text"))).alias("edits"))
    return docs.join(own, id_col, "left")
