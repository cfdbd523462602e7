"""The filter audit against filters that are really applied, one after the other, in every order."""

import re
from collections import defaultdict
from itertools import permutations

import numpy as np
from pyspark.sql import functions as F
from sample import TEXTS

from tarnflow.llm import filter_audit, shared

COLUMNS = ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


def fails(rows):
    """The letters that each row (doc_id, text, lang) fails."""
    least = {}
    for i, text, _ in rows:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    out = []
    for i, text, _ in rows:
        t = text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        tests = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and i > least[t])
        out.append({f for f, x in zip("ABCDE", tests, strict=True) if x})
    return out


def plain(rows, labels):
    good, toxic = ({i for i, q, t in labels if i is not None and (q, t)[k] == 1} for k in (0, 1))
    failed, out, shapley = fails(rows), {}, defaultdict(int)
    for part in {r[2] or "" for r in rows}:
        mine = [(rows[k][0], failed[k]) for k in range(len(rows)) if (rows[k][2] or "") == part]
        for order in permutations("ABCDE"):
            left = mine
            for step, f in enumerate(order, 1):
                gone, earlier = [x for x in left if f in x[1]], order[: step - 1]
                left = [x for x in left if f not in x[1]]
                redundant = sum(f in x[1] and bool(x[1] & set(earlier)) for x in mine)
                out[part, "".join(order), step] = (len(left), len(gone), redundant, sum(x[1] == {f} for x in mine), sum(x[0] in good for x in gone), sum(x[0] in toxic for x in gone), f)
                shapley[part, f] += len(gone)
    return sorted((*k, *v[:-1], shapley[k[0], v[-1]]) for k, v in out.items())


def made(seed, count):
    """Texts that fail any set of the filters, among them copies."""
    r, texts = np.random.default_rng(seed), []
    for _ in range(count):
        n = int(r.choice([20, 150, 200, 260]))
        pool = [f"w{k}" for k in range(int(n * r.choice([0.3, 0.5, 2])) or 1)]
        words = list(r.choice(pool, n))
        if r.random() < 0.4:
            words = [w.upper() for w in words[: n // 2]] + words[n // 2 :]
        if r.random() < 0.3:
            words[0] = str(r.choice(list("#$%&*|")))
        texts.append(" ".join(map(str, words)))
    return texts + texts[: count // 4] * 2


def test_filter_audit(spark, monkeypatch):
    monkeypatch.setattr(shared, "PARTS", 10)
    texts = [*made(1, 80), *TEXTS, *[TEXTS[3]] * 40]
    r = np.random.default_rng(2)
    ids = r.permutation(len(texts)).tolist()
    rows = [(i, t, [None, "", "en", "de"][int(r.integers(4))]) for i, t in zip(ids, texts, strict=True)] + [(None, texts[0], "en"), (None, texts[0], "en"), (ids[0], texts[0], "en"), (ids[1], texts[0], "de")]
    labels = [(int(i), int(r.integers(2)), int(r.integers(2))) for i in r.choice(ids, 60)] + [(ids[0], 1, None), (ids[0], None, 1), (None, 1, 1), (10**6, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"mask": F.lit(1), "part": F.lit(2), "n": F.lit(3), "words": F.lit(4), "good": F.lit(5)})
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumns({"good": F.lit(7), "mask": F.lit(8)})
    assert len({frozenset(f) for f in fails(rows)}) > 12
    out = filter_audit.filter_audit(docs, marks)
    assert out.columns == COLUMNS and sorted(tuple(x) for x in out.collect()) == plain(rows, labels)


def test_filter_audit_on_the_edges(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(empty, none).count() == 0
    out = filter_audit.filter_audit(docs, none)
    assert out.count() == 600 * docs.select(F.coalesce("lang", F.lit(""))).distinct().count() and out.where("good_lost + toxic_lost > 0").count() == 0


def test_cells_are_few(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = filter_audit.cells(filter_audit.masks(docs), none)
    assert got.groupBy("part").count().where("count > 32").count() == 0 and got.agg(F.sum("n")).first()[0] == docs.count()
