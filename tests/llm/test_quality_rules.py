"""Statistics of texts against plain Python; learned rules against planted ones."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from sample import TEXTS, words

from tarnflow.llm import quality_rules as rules

SF = "/root/testdata/sf0.01"
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def plain(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def repeating(seed, count):
    r = np.random.default_rng(seed)
    return ["".join(f"{w}{r.choice([' ', ' ', chr(10), '  '])}" for w in r.choice(["a", "b", "ü|", "<d>", "漢", "A1"], int(r.integers(0, 60)))) for _ in range(count)]


@pytest.mark.parametrize("place", [31, 62])
def test_statistics(spark, place, monkeypatch):
    """With two bits of hash nearly all windows meet by chance; the counts stay exact."""
    monkeypatch.setattr(rules, "PLACE", (1 << place) - 1)
    texts = [*TEXTS, *repeating(1, 200), "a a a", "a a a a", "a a", "a b a b a", "a b c a b c", "x\n\n \nx\nx ", words(9, 2000) + " " + words(9, 2000), "A, " * 3000]
    df = spark.createDataFrame([*enumerate(texts), (None, "a b"), (None, "a b"), (3, TEXTS[3])], "doc_id long, text string").withColumns({"words": F.lit(1), "keys": F.lit(2), "n_words": F.lit(3)})
    out = rules.statistics(df).collect()
    assert len(out) == len(texts) + 3
    for r in out:
        assert tuple(r[c] for c in STATS) == plain("a b" if r.doc_id is None else texts[r.doc_id])


def labelled(spark, rows):
    """Rows of (words, symbols, duplicate lines, distinct words, bad)."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_distinct_words", "n_lines", "n_capitals", "n_digits", "n_cries"]
    made = [(n, 5 * n, s, d, 0, u, 20, 9, 0, 0, bad) for n, s, d, u, bad in rows]
    return spark.createDataFrame([tuple(int(v) for v in m[:-1]) + (None if m[-1] is None else bool(m[-1]),) for m in made], ", ".join(f"{c} long" for c in names) + ", bad boolean").withColumns({"bins": F.lit(1), "p": F.lit(2), "grows": F.lit(3)})


def drawn(seed, count, noise=0.0):
    r, out = np.random.default_rng(seed), []
    for _ in range(count):
        n, s, d, u = r.integers(100, 900), r.integers(0, 200), r.integers(0, 20), r.random()
        bad = s / (5 * n) >= 0.15 or (d / 20 >= 0.5 and u < 0.4)
        out.append((n, s, d, u * n, bad ^ (r.random() < noise)))
    return out


@pytest.mark.parametrize("noise, least", [(0.0, 0.98), (0.05, 0.9)])
def test_planted_rules_are_found(spark, noise, least):
    found = rules.learn(labelled(spark, drawn(1, 4000, noise)), least_precision=0.8)
    assert 2 <= len(found) <= 12
    first = {c.feature for rule in found for c in rule}
    assert {"symbols_per_char", "repeated_lines", "distinct_words"} <= first
    fires, keeps = rules.verdict(found)
    fresh = labelled(spark, drawn(2, 2000, noise)).select("bad", keeps.alias("kept"), fires.alias("rule"))
    got = fresh.agg(F.avg((F.col("bad") != F.col("kept")).cast("double"))).first()[0]
    assert got >= least and fresh.where("kept <> (rule is null)").count() == 0


def test_noise_gives_no_rules(spark):
    r = np.random.default_rng(5)
    rows = [(*x[:4], r.random() < 0.3) for x in drawn(6, 1500)]
    assert rules.learn(labelled(spark, rows)) == []


def test_one_class_gives_no_rules(spark):
    rows = drawn(3, 200)
    for bad in (True, False, None):
        found = rules.learn(labelled(spark, [(*x[:4], bad) for x in rows]))
        assert found == [] and rules.verdict(found)[1] is not None
    assert rules.learn(labelled(spark, rows).limit(0)) == []


def test_earlier_rules_come_first(spark):
    a, b = (rules.Condition("chars_per_word", True, 5.0),), (rules.Condition("symbols_per_char", True, 0.0),)
    fires, keeps = rules.verdict([a, b])
    out = labelled(spark, drawn(4, 50)).select(fires.alias("rule"), keeps.alias("kept")).distinct().collect()
    assert [(r["rule"], r["kept"]) for r in out] == [("chars_per_word >= 5", False)]
    assert rules.verdict([])[1] is not None and labelled(spark, drawn(4, 5)).where(rules.verdict([])[1]).count() == 5


def test_held_out_labels(spark):
    """Rules of four fifths of the labels on the last fifth."""
    docs, marks = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    stats = rules.statistics(docs).where(~rules.base_failed())
    known, held = marks.where("doc_id % 5 <> 0"), marks.where("doc_id % 5 = 0")
    keeps = rules.verdict(rules.learn(rules.labelled(stats, known)))[1]
    rows = rules.labelled(stats, held).select("bad", keeps.alias("kept")).collect()
    assert len(rows) > 40 and np.mean([r.bad != r.kept for r in rows]) >= 0.97
    assert all(r.kept for r in rows if not r.bad)


def test_quality_rules(spark, docs, empty):
    marks = spark.read.parquet(f"{SF}/labels.parquet")
    out = rules.quality_rules(docs, marks)
    rows = out.collect()
    assert len(rows) == docs.count() and all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in rows)
    assert rules.quality_rules(empty, marks).count() == 0
    none = rules.quality_rules(docs, marks.limit(0))
    assert none.where("kept = base_failed").count() == 0


def test_no_python_worker(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    keeps = rules.verdict([(rules.Condition("repeated_words", True, 0.5),)])[1]
    plan = rules.statistics(docs).withColumn("kept", keeps)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
