"""Fill-in-middle transformation: a table-driven automaton over the bytes of a text finds its units, and a second pass cuts it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tarnflow.llm.shared import narrowed, slices, tidy

#: The sentinels before prefix, suffix and middle: "<", one of these letters, ">".
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLANKS, LETTERS = b"\x20\x09\x0a\x0b\x0c\x0d", b"PSM"

#: Classes of bytes, states of the automaton, and what a transition emits.
BLANK, WORD, CONTINUES, OPENS, LETTER, CLOSES = range(6)
IN_BLANK, IN_WORD, OPENED, NAMED = range(4)
CHAR, ENDS, SENTINEL = 1, 2, 4


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Class of each byte; the state after (state, class); what that transition emits."""
    kind = np.full(256, WORD, np.uint8)
    kind[0x80:0xC0] = CONTINUES
    kind[list(BLANKS)], kind[list(LETTERS)], kind[ord("<")], kind[ord(">")] = BLANK, LETTER, OPENS, CLOSES
    after, emits = np.full((4, 6), IN_WORD, np.uint8), np.full((4, 6), CHAR, np.uint8)
    after[:, BLANK], after[:, OPENS], after[OPENED, LETTER] = IN_BLANK, OPENED, NAMED
    emits[:, CONTINUES] = 0
    emits[IN_WORD:, BLANK] |= ENDS
    emits[NAMED, CLOSES] |= SENTINEL
    return kind, after, emits


KIND, AFTER, EMITS = _tables()


def scan(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """What the automaton emits at each byte of texts that lie side by side.

    Two bytes decide its state, whatever came before ("<" always opens, a blank
    always ends a word), so each byte's state is looked up from the classes of the two before
    it; before a text's first byte there are blanks.
    """
    kind = KIND[data]
    one, two = np.full(len(kind), BLANK, np.uint8), np.full(len(kind), BLANK, np.uint8)
    one[1:], two[2:] = kind[:-1], kind[:-2]
    one[starts] = two[starts] = BLANK
    two[starts[starts + 1 < len(kind)] + 1] = BLANK
    state = AFTER.ravel()[AFTER[IN_BLANK][two] * np.uint8(6) + one]
    return EMITS.ravel()[state * np.uint8(6) + kind]


def _offsets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string array and where its texts begin and end in them."""
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def transformed(texts: pa.Array, draws: np.ndarray, percent: int = 50, spm_percent: int = 80) -> dict[str, list]:
    """Columns n, form, prefix_chars, middle_chars and output of texts without nulls; draws has four columns."""
    data, at = _offsets(texts)
    emitted = scan(data, at[:-1][at[:-1] < at[1:]])
    ends, marks = np.flatnonzero(emitted & ENDS), np.flatnonzero(emitted & SENTINEL)
    first = np.searchsorted(ends, at)
    n = np.diff(first) + (np.diff(at) > 0)
    plain = (n == 0) | (np.diff(np.searchsorted(marks, at)) > 0) | (draws[:, 2] % 100 >= percent)
    cut = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    out: dict[str, list] = {"n": n.tolist(), "form": [], "prefix_chars": [], "middle_chars": [], "output": []}
    for i in range(len(texts)):
        lo, hi = at[i], at[i + 1]
        if plain[i]:
            row = ("plain", None, None, data[lo:hi].tobytes())
        else:
            a, b = (lo if k == 0 else hi if k == n[i] else ends[first[i] + k - 1] for k in cut[i])
            chars = [int(np.count_nonzero(emitted[x:y] & CHAR)) for x, y in ((lo, a), (a, b))]
            prefix, middle, suffix = (data[x:y].tobytes() for x, y in ((lo, a), (a, b), (b, hi)))
            spm = draws[i, 3] % 100 < spm_percent
            order = ((SUFFIX, suffix), (PREFIX, prefix), (MIDDLE, middle)) if spm else ((PREFIX, prefix), (SUFFIX, suffix), (MIDDLE, middle))
            row = ("spm" if spm else "psm", *chars, b"".join(mark.encode() + part for mark, part in order))
        for name, value in zip(("form", "prefix_chars", "middle_chars", "output"), row, strict=True):
            out[name].append(value)
    return out


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42, percent: int = 50, spm_percent: int = 80, at_once: int = 4_000_000) -> DataFrame:
    """Each document as plain text, or cut in three and put together as suffix-prefix-middle or prefix-suffix-middle.

    A unit is a word with the blanks before it, or blanks at the end. Draws are
    groups of the SHA-256 of the seed and the id. Returns the id, n (units),
    form, prefix_chars and middle_chars (code points; null if plain) and output.
    Each text goes through one scan, in slices of about `at_once` bytes; nothing
    is shuffled, and a lost task is run again with the same result.

    Null and empty texts are plain and empty, texts that hold a sentinel are
    plain. A null id draws as if its decimal were empty. Repeated rows are
    rows like others, an empty table gives no rows, other columns are left out.
    """
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long").alias(f"h{k + 1}")
    rows = narrowed(docs, doc_id=id_col, text=text_col).select("doc_id", F.coalesce("text", F.lit("")).alias("text"), digest.alias("digest"))
    rows = rows.select("doc_id", "text", *map(draw, range(4)))
    schema = StructType([rows.schema["doc_id"]]).add("n", "long").add("form", "string").add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    types = {"n": pa.int64(), "form": pa.string(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, at_once):
                draws = np.stack([part.column(k).to_numpy() for k in range(2, 6)], axis=1)
                out = transformed(part.column(1), draws, percent, spm_percent)
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(out[c], t) for c, t in types.items())], names=["doc_id", *types])

    return rows.mapInArrow(tidy(work), schema)


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. A cut text holds no sentinel, and none arises where parts meet, so the three in the output are the only ones."""
    part = F.split(output, "<[PSM]>", 4)
    at = lambda k: F.get(part, F.lit(k))
    return F.when(form == "plain", output).when(form == "spm", F.concat(at(2), at(3), at(1))).otherwise(F.concat(at(1), at(3), at(2)))
