"""Best-fit packing of token sequences under several capacities."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnflow.llm.shared import give_back, narrowed, slices, tidy
from tarnflow.llm.tokens import TOKENIZER, encoded, ids, tokenizer_path

#: Bytes of text whose pieces are packed together, in one task; and that are encoded at once.
GROUP_BYTES, AT_ONCE = 6_000_000, 1_000_000
#: Weights of residual tokens, documents and attention cost.
WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(lengths: np.ndarray, tokens: int, documents: int, attention: int, weights=WEIGHTS, by: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece.

    Largest first; among the open bins where tokens, documents and attention
    cost (the sum of squared lengths) all stay within their capacity, the one
    of the smallest weighted residual norm, or the largest weighted dot product
    of need and residual (by="dot"). A piece that exceeds the attention cost
    alone gets a bin of its own.
    """
    need = np.stack([lengths / tokens, np.full(len(lengths), 1 / documents), lengths.astype(float) ** 2 / attention], axis=1)
    order = np.argsort(-lengths, kind="stable")
    w, least = np.asarray(weights), lengths.min(initial=tokens) / tokens - 1e-12
    bins, offsets = np.empty(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    left, number, made = np.empty((64, 3)), np.empty(64, np.int64), 0
    open_ = 0
    for i in order:
        rest = left[:open_] - need[i]
        fits = np.flatnonzero((rest >= -1e-12).all(axis=1))
        if len(fits):
            score = (left[fits] * need[i]) @ w if by == "dot" else -(rest[fits] ** 2 @ w)
            at = fits[score.argmax()]
            bins[i], offsets[i] = number[at], tokens - round(left[at, 0] * tokens)
            left[at] = rest[at]
        else:
            if open_ == len(left):
                left, number = np.concatenate([left, np.empty_like(left)]), np.concatenate([number, np.empty_like(number)])
            at, bins[i] = open_, made
            left[at], number[at] = 1 - need[i], made
            made, open_ = made + 1, open_ + 1
        if (left[at] < [least, 1 / documents - 1e-12, 0]).any():  # full: nothing that is left fits
            open_ -= 1
            left[at], number[at] = left[open_], number[open_]
    return bins, offsets


def _pieces(path: str, tokens: int, end_id: int, groups: int, with_ids: bool, at_once: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = ids(path), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1, at_once):
                flat, bounds = encoded(part.column(1), known)
                raw = np.insert(flat, bounds[1:], np.uint32(end_id)).tobytes()
                out: list[tuple] = []
                for k, (low, high) in enumerate(pairwise((bounds + np.arange(len(bounds))).tolist())):
                    for piece, at in enumerate(range(low, high, tokens)):
                        own = raw[4 * at : 4 * min(at + tokens, high)]
                        out.append((k, piece, at - low, len(own) // 4, zlib.crc32(own), own))
                whose, piece, start, length, crc, own = zip(*out, strict=True)
                number = np.arange(row, row + len(out))
                row += len(out)
                spread = (number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
                rows = {"doc_id": part.column(0).take(pa.array(whose)), "piece": pa.array(piece, pa.int32()), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "pack": pa.array((spread % np.uint64(groups)).astype(np.int64)), "row": pa.array(number, pa.int64())}
                yield pa.RecordBatch.from_pydict(rows | ({"ids": pa.array(own, pa.binary())} if with_ids else {}))

    return tidy(run, keeps=True)


def pack(docs: DataFrame, tokens: int = 2048, documents: int | None = None, attention: int | None = None, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER, end_id: int = 0, weights=WEIGHTS, by: str = "norm", with_ids: bool = False, at_once: int = AT_ONCE) -> DataFrame:
    """Pieces of tokenized documents and the place of each in a sequence of at most so many tokens.

    Every document's ids are followed by end_id; only longer ones are cut. The
    pieces are dealt at random to groups of a fixed expected size (GROUP_BYTES of
    text), so that each has the mixture of the whole, and each group is packed
    by best_fit(); it leaves about half a sequence more than one packing
    of all. documents and attention default to what tokens imply, and then never bind; a piece whose own
    attention cost exceeds `attention` has a sequence to itself.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and
    ids, little-endian unsigned 32-bit, if with_ids). Null and empty texts are
    an end_id only. Null ids and repeated rows are documents like others. An
    empty table gives no rows.
    """
    documents, attention = documents or tokens, attention or tokens * tokens
    rows = narrowed(docs, doc_id=id_col, text=text_col)
    groups = max(1, -(-(rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0) // GROUP_BYTES))
    kind = docs.schema[id_col].dataType.simpleString()
    extra = ", ids binary" if with_ids else ""
    pieces = rows.mapInArrow(_pieces(tokenizer_path(tokenizer), tokens, end_id, groups, with_ids, at_once), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, pack bigint, row bigint{extra}")

    def packed(pdf: pd.DataFrame) -> pd.DataFrame:
        give_back()
        pdf = pdf.sort_values("row", kind="stable")
        bins, offsets = best_fit(pdf["length"].to_numpy(), tokens, documents, attention, weights, by)
        return pdf.assign(sequence_id=(pdf["pack"].to_numpy() << 32) + bins, offset=offsets).drop(columns=["pack", "row"])

    return pieces.groupBy("pack").applyInPandas(packed, f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint{extra}, sequence_id bigint, offset bigint")
