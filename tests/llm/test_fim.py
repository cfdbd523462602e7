"""The fill-in-middle transformation against plain Python."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from sample import TEXTS

from tarnflow.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain(doc_id, text):
    """(n, form, prefix_chars, middle_chars, output), by regular expressions over code points."""
    digest = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    form = "spm" if h[3] % 100 < 80 else "psm"
    return n, form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


def strange(seed, count):
    r = np.random.default_rng(seed)
    return ["".join(r.choice(list("aPSM<>< \n\t\x0b\x0cü漢😀 "), int(r.integers(0, 30)))) for _ in range(count)]


def stepwise(text):
    """The automaton, one byte at a time."""
    state, out = fim.IN_BLANK, []
    for byte in text.encode():
        kind = fim.KIND[byte]
        out.append(fim.EMITS[state, kind])
        state = fim.AFTER[state, kind]
    return out


def test_two_bytes_decide_the_state():
    for kinds in np.ndindex(6, 6):
        reached = set()
        for state in range(4):
            for kind in kinds:
                state = fim.AFTER[state, kind]
            reached.add(int(state))
        assert len(reached) == 1


@pytest.mark.parametrize("cut", [0, 3])
def test_the_scan_is_the_automaton(cut):
    texts = [*strange(1, 400), "", "<P>", "<", "a", " ", "ü", "<<P>>", "<P<S>"]
    array = pa.array(texts).slice(cut)
    data, at = fim._offsets(array)
    got = fim.scan(data, at[:-1][at[:-1] < at[1:]])
    for i, text in enumerate(texts[cut:]):
        assert got[at[i] : at[i + 1]].tolist() == stepwise(text)
        assert int(np.sum(got[at[i] : at[i + 1]] & fim.CHAR > 0)) == len(text)
        assert bool(np.any(got[at[i] : at[i + 1]] & fim.SENTINEL)) == bool(re.search("<[PSM]>", text))


@pytest.mark.parametrize("at_once", [1, 4_000_000])
def test_fill_in_middle(spark, docs, at_once):
    texts = [*TEXTS, *strange(2, 300), "x <P> y", "a <S", "<P", "M> b"]
    rows = [*enumerate(texts), (3, TEXTS[3]), (None, "no id at all"), (None, "no id at all"), (-5, "a b c d e f g")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"output": F.lit(1), "form": F.lit(2), "h1": F.lit(3), "digest": F.lit(4)})
    out = fim.fill_in_middle(df, at_once=at_once).withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted(((i, *plain(i, t), t or "") for i, t in rows), key=key)
    assert sorted((tuple(r) for r in out), key=key) == want
    assert {r.form for r in out} == {"plain", "spm", "psm"}


def test_fill_in_middle_on_the_edges(docs, empty):
    out = fim.fill_in_middle(docs)
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and out.count() == docs.count()
    assert fim.fill_in_middle(empty).count() == 0
    other = fim.fill_in_middle(docs.withColumnsRenamed({"doc_id": "name", "text": "body"}), "name", "body", seed=7, percent=100, spm_percent=0)
    assert {r.form for r in other.select("form").distinct().collect()} == {"plain", "psm"}
