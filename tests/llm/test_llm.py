"""Operators against brute force on small frames with nulls, empty texts, copies, repeated rows and extra columns."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from sample import BASE, TEXTS, words

from tarnflow.llm import exact_dedup, language_id, mixing, ngram_join, packing, sharding, shared, substring_dedup, token_counts, tokens, url_filter, vector_dedup


def components(nodes, links):
    """Smallest node that each can reach."""
    up = {i: i for i in nodes}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return {i: top(i) for i in nodes}


# shared


def test_workers_keep_one_thing():
    made = []
    make = lambda x: shared.kept(x, lambda: made.append(x) or x)
    assert [make("a"), make("a"), make("b"), make("a")] == ["a", "a", "b", "a"] and made == ["a", "b", "a"]
    assert list(shared.tidy(iter, keeps=True)([1, 2])) == [1, 2] and make("a") == "a" and len(made) == 3
    assert list(shared.tidy(iter)([1, 2])) == [1, 2] and make("a") == "a" and len(made) == 4


def test_salted_joins_are_joins(spark, monkeypatch):
    monkeypatch.setattr(shared, "PARTS", 10)
    left = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 300 + [2] * 5 + [3, None, None])], "k long, i long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c"), (None, "d")], "k long, v string")
    counts = left.where("k is not null").groupBy("k").agg(F.count("*").alias("n"))
    hot = shared.heavy(counts, ["k"], left.count())
    assert [r.asDict() for r in hot.collect()] == [{"k": 1, "pieces": 10}]
    for how in ("inner", "left", "left_anti"):
        assert sorted(map(str, shared.salted(left, right, ["k"], hot, ["i"], how).select("i", *["v"] * (how != "left_anti")).collect())) == sorted(map(str, left.join(right, "k", how).select("i", *["v"] * (how != "left_anti")).collect()))


def test_without_drops_members_only(spark, monkeypatch):
    rows = spark.createDataFrame([(i % 50, str(i)) for i in range(200)] + [(None, "x")], "k long, v string")
    gone = spark.createDataFrame([(i,) for i in range(0, 50, 7)], "k long")
    for bits in (6, 24):
        monkeypatch.setattr(shared, "SKETCH", bits)
        got = shared.without(rows, ["k"], gone)
        assert sorted(got.columns) == ["k", "v"] and got.count() == 200 - 4 * 8 + 1 and got.where("k % 7 = 0").count() == 0


def test_components(spark, monkeypatch):
    monkeypatch.setattr(shared, "PARTS", 10)
    r = np.random.default_rng(4)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 340)] + [tuple(map(int, r.integers(400, 700, 2))) for _ in range(200)] + [(5, 5)]
    before = set(shared._WRITTEN)
    got = {x.node: x.root for x in shared.components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    nodes = {x for e in edges if e[0] != e[1] for x in e}
    want = components(nodes, edges)
    assert set(got) == nodes and len(set(zip(got.values(), (want[i] for i in got), strict=True))) == len(set(want.values()))
    assert len(shared._WRITTEN - before) == 1  # earlier rounds are deleted


# 1


def plain_parts(text):
    """Words, and sentences cut at anchors, written plainly: a list of (first word, after the last), and the pieces of text."""
    solo = lambda c: any(a <= ord(c) <= b for a, b in substring_dedup.SOLO)
    starts, before = [], " "
    for i, c in enumerate(text):
        blank, end = c in substring_dedup.BLANKS, c in substring_dedup.ENDS
        if not blank and (before in substring_dedup.BLANKS or solo(c) or (not end and (before in substring_dedup.ENDS or solo(before)))):
            starts.append(i)
        before = c
    pieces = [text[a:b] for a, b in zip(starts, [*starts[1:], len(text)], strict=False)]
    bare = ["".join(c for c in p if c not in substring_dedup.BLANKS) for p in pieces]
    value = []
    for w in bare:
        h = substring_dedup.BASE
        for c in [*map(ord, w), 0]:
            h = (h * substring_dedup.BASE + c) % 2**64
        value.append(h)
    ends = [any(c in substring_dedup.ENDS for c in p) for p in pieces]
    cuts, low = set(), 0
    for i in range(len(pieces)):
        if ends[i] or i == len(pieces) - 1:
            cuts.add(i)
            for k in range(low, i + 2 - substring_dedup.WINDOW):
                least = min(value[k : k + substring_dedup.WINDOW])
                cuts |= {j for j in range(k, k + substring_dedup.WINDOW) if value[j] == least}
            low = i + 1
    bounds = [0, *(i + 1 for i in sorted(cuts))]
    parts = list(zip(bounds[:-1], bounds[1:], strict=True))
    cut = ["".join(pieces[a:b]) for a, b in parts]
    if text and not pieces:
        return [(0, 0)], [], [text]
    if cut:
        cut[0] = text[: starts[0]] + cut[0]
    return parts, bare, cut


def plain_dedup(rows, span, least):
    spans, cut = defaultdict(list), {}
    for i, (doc_id, text) in enumerate(rows):
        parts, bare, pieces = plain_parts(text or "")
        cut[i], own = pieces, set()
        for a in range(len(parts)):
            for b in range(a + span, len(parts) + 1):
                if parts[b - 1][1] - parts[a][0] >= least:
                    own.add((a, b))
                    break
            for c in range(a + 1 - span, -1, -1):
                if parts[a][1] - parts[c][0] >= least:
                    own.add((c, a + 1))
                    break
        for a, b in own:
            spans[tuple(bare[parts[a][0] : parts[b - 1][1]])].append((-1 if doc_id is None else doc_id, i, a, b))
    gone = defaultdict(set)
    for places in spans.values():
        for _, i, a, b in sorted(places)[1:]:
            gone[i].update(range(a, b))
    return [(doc_id, len(cut[i]), sorted(gone[i]), None if text is None else "".join(p for k, p in enumerate(cut[i]) if k not in gone[i])) for i, (doc_id, text) in enumerate(rows)]


def random_texts(seed, n):
    r = np.random.default_rng(seed)
    passages = ["".join(f"{w}{'. ' if r.random() < 0.15 else '! ' if r.random() < 0.02 else ' '}" for w in words(seed + k, 60).split()) for k in range(4)] + ["字" * 3 + "。" + "かなカナ漢字" * 12]
    out = []
    for _ in range(n):
        parts = [words(int(r.integers(1000)), int(r.integers(1, 30))) for _ in range(3)] + [passages[int(r.integers(5))] for _ in range(int(r.integers(0, 3)))]
        r.shuffle(parts)
        out.append(" ".join(parts)[: int(r.integers(1, 900))])
    return out


def test_substring_dedup_is_the_plain_rule(spark):
    texts = random_texts(5, 80)
    rows = [*enumerate(texts), (200, texts[3]), (201, texts[3]), (202, None), (203, ""), (204, " \n "), (None, texts[5]), (None, texts[9]), (205, "same " * 80), (206, "a. b. c. d."), (206, texts[7])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "doc_id long, text string, key string, at int")
    got = sorted(((r.doc_id, r.n_sentences, list(r.removed), r.kept_text, r.n_removed) for r in substring_dedup.substring_dedup(df).collect()), key=str)
    want = sorted(((*w, len(w[2])) for w in plain_dedup(rows, 3, 20)), key=str)
    same_id = {None, 206}  # rows of one id come in the order of a hash of their texts
    assert [g for g in got if g[0] not in same_id] == [w for w in want if w[0] not in same_id] and len(got) == len(want)
    assert any(g[4] for g in got)


def test_substring_dedup_of_repeated_rows(spark):
    text = " ".join(f"{w}." for w in words(9, 60).split())
    df = spark.createDataFrame([(1, text)] * 5 + [(2, text), (None, None), (None, None)], "doc_id long, text string")
    got = Counter((r.doc_id, r.kept_text) for r in substring_dedup.substring_dedup(df).collect())
    assert got == {(1, text): 1, (1, ""): 4, (2, ""): 1, (None, None): 2}


def test_substring_dedup_does_not_depend_on_splits(spark, tmp_path):
    rows = [*enumerate(random_texts(6, 120))]
    path = str(tmp_path / "docs")
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)
    kept, old = [], spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for first, then in (("128m", "128m"), ("128m", "2k"), ("2k", "128m")):
            spark.conf.set("spark.sql.files.maxPartitionBytes", first)
            out = substring_dedup.substring_dedup(spark.read.parquet(path))
            spark.conf.set("spark.sql.files.maxPartitionBytes", then)
            kept.append(sorted((r.doc_id, r.kept_text) for r in out.collect()))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert kept[0] == kept[1] == kept[2] and kept[0] != rows


def test_substring_dedup_on_the_edges(docs, empty):
    rows = substring_dedup.substring_dedup(docs).collect()
    assert Counter(r.doc_id for r in rows) == Counter(r.doc_id for r in docs.select("doc_id").collect())
    assert all(r.kept_text == (TEXTS[r.doc_id] if not r.n_removed else r.kept_text) for r in rows if r.doc_id is not None)
    assert substring_dedup.substring_dedup(empty).count() == 0


@pytest.mark.parametrize("kind", ["short", "long", "same", "sentences", "japanese"])
def test_substring_dedup_finds_any_passage(spark, kind):
    """A passage of 50 words loses most of its later copies, whatever its sentences and wherever it starts."""
    w = words(40, 50).split()
    blank = "" if kind == "japanese" else " "
    if kind == "short":
        w = [f"{x}!!" for x in w]
    elif kind == "same":
        w = ["word"] * 50
    elif kind == "sentences":
        w = [x + "." * (i % 24 == 23) for i, x in enumerate(w)]
    elif kind == "japanese":
        w = [chr(c) + "。" * (i % 50 == 9) for i, c in enumerate(np.random.default_rng(41).integers(0x4E00, 0x9000, 100))]
    passage = blank.join(w)
    rows = [(i, blank.join([words(50 + i, 3 + i), passage, words(80 + i, 11 - i)])) for i in range(10)]
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_removed == 0 or kind == "same"
    for i, text in rows[1:]:
        assert len(text) - len(got[i].kept_text) >= 0.4 * len(passage)
        for c in (words(50 + i, 3 + i), words(80 + i, 11 - i)):
            assert c in got[i].kept_text


def test_parts_are_the_text():
    texts = ["", " ", "a", " a,b ..c!!\nd  e", words(7, 100), "字 字。\n字", "x" * 400_000]
    parts = substring_dedup.Parts(texts)
    assert ["".join(substring_dedup.sentences(t)) for t in texts] == texts
    assert np.diff(parts.first).tolist() == [len(substring_dedup.sentences(t)) for t in texts]


# 2


def laws(rows, shards):
    assert set(rows["law"]) <= {"bytes"} and rows["grown_shard"].isna().all() and set(rows["shard"]) <= set(range(shards))
    for _, own in rows.groupby("shard"):
        assert sorted(own["slot"]) == list(range(len(own)))


def test_sharding(docs, empty):
    rows = sharding.shard(docs, 3).toPandas()
    assert len(rows) == docs.count()
    laws(rows, 3)
    for r in rows.dropna(subset=["doc_id"]).itertuples():
        text = (TEXTS[int(r.doc_id)] or "").encode()
        assert r.size == len(text) + 16 and r.text_crc32 == zlib.crc32(text)
    assert sharding.shard(empty, 3).count() == 0


def test_shards_have_near_equal_bytes(spark):
    """A third of all rows share a text, whose range is overfull and subdivided."""
    r = np.random.default_rng(8)
    texts = [words(i, int(r.integers(1, 60))) for i in range(800)] + [BASE] * 400
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    rows = sharding.shard(df, 7).toPandas()
    laws(rows, 7)
    size = rows.groupby("shard")["size"].sum()
    assert len(size) == 7 and size.max() - size.min() <= 0.03 * size.mean()
    again = sharding.shard(df.repartition(5), 7).toPandas().groupby("shard")["size"].sum()
    assert again.max() - again.min() <= 0.03 * again.mean()
    texts = pd.Series(texts)
    held = rows.assign(text=rows["doc_id"].map(texts)).groupby("text")["shard"].nunique()
    assert held.drop(BASE).max() == 1 and held[BASE] > 1


# tokens, 3


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokens.tokenizer_path())
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids


ALPHABET = list("abcXYZ019 .,!?'-_|<>\n\t") + ["İ", "ı", "ß", "é", "e\u0301", "\u0301", "ﬁ", "²", "½", "Ⅳ", "字", "あ", "\xa0", "\u200b", "\u2028", "\u3000", "ǅ", "ſ", "\u212a", "<|startoftext|>", "<|endoftext|>", "'s", "'LL", "🙂", "\u0307", "ΑΣ", "Σ", "\x0b", "\x0c", "\x85", "ª", "ः", "ก", "٣", "\x1c", "\x00", "É", "É.", "à,"]


def test_ids_are_those_of_the_tokenizer(encode):
    r = np.random.default_rng(11)
    texts = ["".join(r.choice(ALPHABET, int(r.integers(0, 14)))) for _ in range(20_000)] + [None, "HADİ."]
    known = tokens.Ids(tokens.tokenizer_path())
    for low in range(0, len(texts), 1000):
        part = texts[low : low + 1000]
        ids, at = tokens.encoded(part, known)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [encode(t) for t in part]
        assert tokens.counts(part, known).tolist() == np.diff(at).tolist()


def test_packing(docs, empty, encode):
    rows = packing.pack(docs, tokens=64, documents=5, with_ids=True).toPandas()
    for _, own in rows.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 64 and len(own) <= 5
        assert own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    rows["values"] = rows["ids"].map(lambda b: np.frombuffer(b, "<u4").tolist())
    assert (rows["ids"].map(zlib.crc32) == rows["ids_crc32"]).all() and (rows["values"].map(len) == rows["length"]).all()
    for i, text in enumerate(TEXTS):
        own, want = rows[rows["doc_id"] == i].sort_values(["piece", "ids_crc32"]), [*encode(text), 0]
        times = 2 if i in (3, 7) else 1
        cut = [want[k : k + 64] for k in range(0, len(want), 64)]
        assert own["values"].tolist()[::times] == cut and own["piece"].tolist()[::times] == list(range(len(cut))) and own["start"].tolist()[::times] == [64 * k for k in range(len(cut))]
        assert len(own) == times * len(cut)
    assert rows["doc_id"].isna().sum() == 2
    assert packing.pack(empty).count() == 0


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_best_fit_is_near_the_bound(by):
    n = np.random.default_rng(3).integers(1, 1500, 3000)
    bins, _ = packing.best_fit(n, 2048, 2048, 2048**2, by=by)
    assert bins.max() + 1 <= 1.02 * n.sum() / 2048 + 1


@pytest.mark.parametrize("by", ["norm", "dot"])
def test_every_capacity_binds(by):
    n = np.random.default_rng(4).integers(1, 1500, 2000)
    for documents, attention in ((2048, 1_000_000), (3, 2048**2), (4, 1_500_000)):
        bins, at = packing.best_fit(n, 2048, documents, attention, by=by)
        df = pd.DataFrame({"bin": bins, "n": n, "cost": n.astype(np.int64) ** 2, "at": at})
        own = df.groupby("bin").agg(tokens=("n", "sum"), docs=("n", "size"), cost=("cost", "sum"))
        assert (own["tokens"] <= 2048).all() and (own["docs"] <= documents).all()
        assert (own["cost"][own["docs"] > 1] <= attention).all()
        bound = max(n.sum() / 2048, len(n) / documents, df["cost"][df["cost"] <= attention].sum() / attention)
        assert len(own) <= 1.25 * bound + (df["cost"] > attention).sum() and len(own) > n.sum() / 2048 * 1.02


# 9


def test_token_counts(docs, empty, encode):
    from tarnflow.llm.queries import edits

    out = token_counts.apply_edits(docs.withColumn("edits", edits(F.col("doc_id"), F.col("text"))), with_text=True).toPandas()
    assert len(out) == docs.count()
    for r in out.itertuples():
        assert r.tokens_after == len(encode(r.text)) == sum(r.leaf_tokens) and sum(r.leaf_chars) == len(r.text) and r.text_crc32 == zlib.crc32(r.text.encode())
    for r in out.dropna(subset=["doc_id"]).itertuples():
        assert r.tokens_before == len(encode(TEXTS[int(r.doc_id)]))
    assert token_counts.token_trees(empty).count() == 0
    assert token_counts.apply_edits(empty.withColumn("edits", F.lit(None))).count() == 0


def test_edits_start_from_stored_trees(spark, encode):
    r = np.random.default_rng(12)
    texts = {i: " ".join(r.choice(["one", "Two,", "three.", "vier\n", "HADİ", "e\u0301t", "don't"], 2000)) for i in range(12)} | {12: "", 13: None, 14: "x"}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    plan, after = [], {}
    for i, text in texts.items():
        text = text or ""
        for seq in range(int(r.integers(0, 9))):
            a, b = sorted(map(int, r.integers(-5, len(text) + 10, 2)))
            b = min(b, a + int(r.choice([0, 3, 900])))
            new = str(r.choice(["", "new ", "İ", " and some more words" * 30, "\u0301"]))
            plan.append((i, seq, a, b, new))
            low = min(max(a, 0), len(text))
            text = text[:low] + new + text[min(max(b, low), len(text)) :]
        after[i] = text
    trees = shared.save(token_counts.token_trees(docs, keep=True), "trees")
    edits = spark.createDataFrame(plan, "doc_id long, seq int, start long, stop long, text string")
    rows = token_counts.with_edits(trees, edits)
    out = token_counts.apply_edits(rows, trees=("leaf_chars", "leaf_tokens"), with_text=True).toPandas().set_index("doc_id")
    for i, text in after.items():
        assert out.text[i] == text and out.tokens_after[i] == len(encode(text)) and out.tokens_before[i] == len(encode(texts[i]))
    assert out["encoded_chars"].sum() < 0.5 * sum(map(len, after.values()))
    stale = rows.withColumn("leaf_chars", F.expr("transform(leaf_chars, c -> c + 1)"))
    again = token_counts.apply_edits(stale, trees=("leaf_chars", "leaf_tokens")).toPandas().set_index("doc_id")
    assert (again["tokens_after"] == out["tokens_after"]).all() and again["encoded_chars"].sum() > out["encoded_chars"].sum()


# 4


def test_language(spark, docs, empty):
    vocab = {"aa": "the and ing tion her", "bb": "und der sch keit ein", "cc": "que les ment eau oui"}
    rows = [(i, " ".join(np.random.default_rng(i).choice(vocab[k].split(), 30)), k) for i in range(60) for k in [list(vocab)[i % 3]]]
    labelled = spark.createDataFrame([*rows, rows[0], (None, rows[1][1], "bb"), (99, None, "aa"), (98, "123 !", None), (97, "the and " * 60_000, None)], "doc_id long, text string, lang string").withColumns({"gram": F.lit(1), "at": F.lit("x"), "score": F.lit("y")})
    model = language_id.fit(labelled)
    got = [(r.doc_id, r.lang_pred) for r in language_id.predict(labelled, model).collect()]
    assert len(got) == 65 and sorted(got, key=str) == sorted([*((i, k) for i, _, k in rows), (0, "aa"), (None, "bb"), (99, "und"), (98, "und"), (97, "aa")], key=str)
    assert language_id.predict(docs, language_id.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert language_id.predict(empty, model).count() == 0
    assert not spark.createDataFrame([(None,)], "i long").select(language_id.held_out(F.col("i"))).first()[0]


def test_any_label_is_a_language(spark):
    """Labels that differ by case, look like columns, or hold a backtick, a dot or nothing; more than six of them."""
    names = ["EN", "en", "gram", "total", "a`b", "a.b", "n", "", "lang", "x y"]
    rows = [(i, " ".join(words(1000 + i % 10, 40).split()[j] for j in np.random.default_rng(i).integers(0, 40, 80)), names[i % 10]) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = language_id.fit(df.where(~language_id.held_out(F.col("doc_id"))))
    assert learned[0] == sorted(names)
    pred = {r.doc_id: r.lang_pred for r in language_id.predict(df, learned).collect()}
    held = [r[0] for r in df.where(language_id.held_out(F.col("doc_id"))).select("doc_id").collect()]
    assert len(held) > 40 and np.mean([pred[i] == names[i % 10] for i in held]) >= 0.99


def test_mixture_keeps_a_small_second_language():
    ll = np.log(np.array([[0.9, 0.1, 0.01], [0.001, 0.9, 0.01]]))
    shares = language_id.mixtures(np.array([2, 1]), np.array([19_900.0, 100.0, 50.0]), np.concatenate([ll, ll[:1]]))
    assert shares[0, 0] == pytest.approx(0.995, abs=1e-3) and shares[0, 1] == pytest.approx(0.005, abs=1e-3)
    assert shares[1].tolist() == [1, 0, 0]


def test_mixture_starts_from_all_languages():
    ll = np.log(np.array([[0.9, 0.8, 0.8, 0.8, 0.8, 0.8, 0.8, 0.01], [0.001] * 7 + [0.9]]))
    shares = language_id.mixtures(np.array([2]), np.array([9_000.0, 900.0]), ll)
    assert shares[0].argmax() == 0 and shares[0, 7] == pytest.approx(1 / 11, abs=0.01)


def test_word_likelihoods(monkeypatch):
    rng = np.random.default_rng(4)
    own = [*dict.fromkeys("".join(rng.choice(list("abñ中"), n)) for n in rng.integers(1, 9, 400))]
    grams = {g: rng.normal(size=3) for g in sorted({g for w in own[:50] for g in language_id.grams_of(w)}) if "中" not in g or len(g) < 3}
    monkeypatch.setattr(language_id, "CHARACTERS", 100)
    known = language_id.Words(grams, 3)
    known.learn(own[:200])
    known.learn([*own[200:], "other", "x" * 500])
    for w, row in known.items():
        want = language_id.POWER * sum((grams.get(g, np.zeros(3)) for g in language_id.grams_of(w)), np.zeros(3))
        assert np.allclose(known.logs[row], want)
    assert len(known) == len(own) + 2


# 5


def groups_of(rows):
    by = defaultdict(list)
    for r in rows:
        by[hashlib.sha256((r.text or "").encode().lower()).digest()].append(r.doc_id)
    return by


def held_to(rows, by):
    for r in rows:
        own = by[bytes(r.digest)]
        assert r.group_size == len(own) and r.keep_id == max((i for i in own if i is not None), default=None)
    assert sum(r.kept for r in rows) == len(by) and len(rows) == sum(map(len, by.values()))


def test_exact_dedup(docs, empty):
    new, old = docs.where("doc_id > 4"), docs.where("doc_id <= 4 or doc_id is null")
    by = groups_of(docs.collect())
    held_to(exact_dedup.exact_dedup(new, old).collect(), by)
    stored = exact_dedup.snapshot(old)
    held_to(exact_dedup.exact_dedup(new, stored).collect(), by)
    held_to(exact_dedup.exact_dedup(empty, stored).collect(), groups_of(old.collect()))
    held_to(exact_dedup.exact_dedup(new, empty).collect(), groups_of(new.collect()))
    assert exact_dedup.exact_dedup(empty, empty).count() == 0


def test_exact_dedup_of_a_hot_text_and_a_large_batch(spark, monkeypatch):
    monkeypatch.setattr(shared, "PARTS", 10)
    monkeypatch.setattr(exact_dedup, "FILTER_KEYS", 3)
    df = spark.createDataFrame([(i, f"Text {i % 70}" if i % 3 else "HOT") for i in range(600)], "doc_id long, text string")
    held_to(exact_dedup.exact_dedup(df.where("doc_id >= 40"), df.where("doc_id < 40")).collect(), groups_of(df.collect()))


def test_texts_of_one_digest_stay_apart(spark):
    weak = lambda t: hashlib.sha256(t[:1]).digest()
    old, new = (spark.createDataFrame(rows, "doc_id long, text string") for rows in ([(1, "aX"), (2, "bX"), (5, "c")], [(3, "aY"), (4, "BX"), (6, "c")]))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(new, old, digest=weak).collect()}
    assert got == {1: (1, 1, True), 3: (3, 1, True), 2: (4, 2, False), 4: (4, 2, True), 5: (6, 2, False), 6: (6, 2, True)}


def test_fuse_filter():
    keys = np.random.default_rng(0).integers(0, 2**63, 5000).astype(np.uint64)
    f = exact_dedup.fuse_build(keys)
    assert exact_dedup.fuse_has(keys, *f).all()
    assert exact_dedup.fuse_has(keys + np.uint64(1), *f).mean() < 0.01


# 6


def plain_rake(tokens, codes, goals):
    w = tokens.astype(float)
    for _ in range(300):
        for code, goal in zip(codes, goals, strict=True):
            w = w * (goal / np.bincount(code, w))[code]
    return w


def test_mixing_meets_marginals(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(shared, "PARTS", 5)
    rows = [(i, f"s{i % 3}", "en" if i % 5 else "de", 10 + i % 7, "x", 1.5) for i in range(300)] + [(1000 + i, None, "en", 12, "x", 0.5) for i in range(20)] + [(301, "s1", None, 0, "x", 0.5), (1, "s1", "en", 11, "x", 1.5), (None, "s2", "en", 12, "x", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n long, dim string, weight double")
    given = {"source": {"s0": 0.2, "s1": 0.3, "*": 0.25}, "lang": {"en": 0.6, "de": 0.4}}
    out = mixing.mix(df, ["source", "lang"], F.col("n"), keep=0.1, given=given).toPandas()
    expected = out.mix_prob * out.mix_tokens
    source, lang = ((out[c].fillna("none"), expected) for c in ("source", "lang"))
    share = expected.groupby(source[0]).sum() / expected.sum()
    assert np.allclose([share["s0"], share["s1"], share["s2"], share["none"]], [0.2, 0.3, 0.25, 0.25], atol=1e-4)
    share = expected.groupby(lang[0]).sum() / expected.sum()
    assert np.allclose([share["en"], share["de"]], [0.6, 0.4], atol=1e-4) and (out["mix_gap"] <= mixing.TOLERANCE).all()
    assert expected.sum() == pytest.approx(0.1 * out.mix_tokens.sum(), rel=1e-6)
    lost = out[out["doc_id"] == 301].iloc[0]
    assert lost.mix_prob == lost.mix_weight == 0 and not lost.mix_keep and len(out) == len(rows)
    live = out[out["mix_tokens"] > 0].reset_index(drop=True)
    codes = [pd.factorize(live[c].fillna("none"), sort=True)[0] for c in ("source", "lang")]
    cell = live.groupby(codes).agg(tokens=("mix_tokens", "sum"))
    a, b = (cell.index.get_level_values(k).to_numpy() for k in (0, 1))
    w = plain_rake(cell["tokens"].to_numpy(), (a, b), (np.array([0.25, 0.2, 0.3, 0.25]), np.array([0.4, 0.6])))
    ratio = dict(zip(zip(a, b, strict=True), w / cell["tokens"].to_numpy(), strict=True))
    assert np.allclose(live["mix_weight"], [ratio[k] * live["mix_tokens"].sum() for k in zip(*codes, strict=True)], rtol=1e-4)
    spread = mixing.mix(df, ["source", "lang"], F.col("n"), keep=0.1, given=given, local=0).toPandas()
    both = [x.sort_values(["doc_id", "n", "source"])[["mix_weight", "mix_prob"]].to_numpy() for x in (out, spread)]
    assert np.allclose(*both, rtol=1e-4)
    assert mixing.mix(empty, ["source"], F.col("size")).count() == 0
    assert mixing.mix(docs, ["source", "lang"], F.col("size")).count() == docs.count()


def test_marginals_that_cells_cannot_meet(spark):
    df = spark.createDataFrame([(1, "a", "x", 10), (2, "b", "y", 10)], "doc_id long, p string, q string, n long")
    with pytest.warns(UserWarning, match="misses its target"):
        out = mixing.mix(df, ["p", "q"], F.col("n"), given={"p": {"a": 0.9, "b": 0.1}, "q": {"x": 0.1, "y": 0.9}})
    assert out.first().mix_gap == pytest.approx(0.8)


def test_profiles(spark, docs, empty, encode):
    model = mixing.fit_topics(docs, topics=3)
    got = mixing.profiled(docs, model, keep=["doc_id", "size"]).collect()
    assert sorted(got[0].asDict()) == ["doc_id", "mix_tokens", "mix_topic", "size"] and len(got) == docs.count()
    for r in got:
        if r.doc_id is not None:
            assert r.mix_tokens == len(encode(TEXTS[r.doc_id])) and (r.mix_topic is None) == (r.mix_tokens == 0)
    rows = [(i, kind * 40) for i in range(30) for kind in ("word, word. ", "| 1 | 2 |\n", "LOUD!! ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    topic = defaultdict(set)
    for r in mixing.profiled(df, mixing.fit_topics(df, topics=3), keep=["doc_id"]).collect():
        topic[r.mix_tokens].add(r.mix_topic)
    assert len(topic) == 3 and len(set.union(*topic.values())) == 3
    assert mixing.profiled(empty, mixing.fit_topics(empty)).count() == 0


# 7


def plain_verdict(url, rules, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([len(rest)] + [rest.index(c) for c in "/?#" if c in rest])
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([len(path)] + [path.index(c) for c in "?#" if c in path])]
    fit = [(len(h + p), h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    key = host
    for low in ("www.", "m."):
        if host.startswith(low):
            key = host[len(low) :]
            break
    page = path.rstrip("/")
    page = page[:-5] if page.endswith(".html") else page
    if fit:
        return host, path, *max(fit)[1:]
    return host, path, None, "block" if key + page in listed else "allow"


def test_url_filter(spark):
    from tarnflow.llm.queries import RULES, listed_urls

    urls = ["http://A.example.org/es/x?q", "https://example.org/en/12", "http://x.org", "http://x.org/", "ftp://b.com/fr/", None, "no scheme", "", "://", "http://bad.net/p.html", "http://www.bad.net/p/#f", "http://bad.net/p/q", "HTTP://WWW.BAD.NET/p", "http://bad.net:80/p", "http://u@bad.net/p", "a://b://bad.net/p", "http://xbad.net/p", "http://" + "a." * 3000 + "com/de/1", "http://x.com?/de/", "http://spam-farm.example.com/en/4", "http://spam-farm.example.net/en/3", "https://m.spam-farm.example.com/es/998.html?x", "http://www.spam-farm.example.com/es/9980", "http://m.www.bad.net/p", "http://b.com/de/\nx", "http://ÉX.org/"]
    listed = {"bad.net/p", *(r.key for r in listed_urls(spark).collect())}
    assert len(listed) == 1 + 666 * 3 * 2 * 4
    pages = spark.createDataFrame([*((i, u, "k") for i, u in enumerate(urls)), (None, urls[0], "k"), (1, urls[1], "k")], "page_id long, url string, key string").withColumns({"host": F.lit(1), "rule": F.lit(2), "block": F.lit(3)})
    rules, keys = spark.createDataFrame(RULES, "host string, path string, verdict string"), spark.createDataFrame([(k,) for k in listed], "key string")
    for mb in (32, 0.005):
        got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in url_filter.url_filter(pages, rules, keys, broadcast_mb=mb).collect()]
        want = [(r.page_id, *plain_verdict(r.url, RULES, listed)) for r in pages.collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert url_filter.url_filter(pages.limit(0), rules, keys).count() == 0
    assert url_filter.url_filter(pages, rules.limit(0), keys.limit(0)).where("verdict <> 'allow'").count() == 0


# 8


def plain_sets(rows):
    out = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def plain_near(rows):
    sets, inside = plain_sets(rows), defaultdict(list)
    links = []
    for i, own in sets.items():
        common = Counter(j for g in own for j in inside[g])
        links += [(i, j) for j, n in common.items() if 100 * n >= 80 * (len(own) + len(sets[j]) - n)]
        for g in own:
            inside[g].append(i)
    return sets, components(sets, links)


def test_near_duplicates(docs, empty):
    rows = ngram_join.near_duplicates(docs).toPandas()
    sets, want = plain_near([*enumerate(TEXTS)])
    for r in rows.dropna(subset=["doc_id"]).itertuples():
        assert r.n_shingles == len(sets[int(r.doc_id)]) and r.component_id == want[int(r.doc_id)]
    assert len(rows) == docs.count()
    assert ngram_join.near_duplicates(empty).count() == 0


def test_near_duplicates_of_large_groups(spark, monkeypatch):
    """Drifting chains and variants of templates, with small blocks, grids, ranges and hot keys, so that every path is taken."""
    for name, value in {"BLOCK": 8, "GRID": 4, "RANGE": 2_000, "CHUNK": 3_000, "TASK_ROWS": 256}.items():
        monkeypatch.setattr(ngram_join, name, value)
    monkeypatch.setattr(shared, "PARTS", 20)
    r, texts = np.random.default_rng(3), []
    for s in range(5):
        w = words(s, 110).split()
        for k in range(90):
            w[int(r.integers(len(w)))] = f"w{r.integers(10**6)}"
            texts.append(" ".join(w))
    for s in range(3):
        for k in range(120):
            w = words(10 + s, 90).split()
            for _ in range(int(r.integers(0, 5))):
                w[int(r.integers(len(w)))] = f"v{r.integers(10**6)}"
            texts.append(" ".join(w))
    texts += [texts[0]] * 150
    r.shuffle(texts)
    rows = [*((int(i), t) for i, t in enumerate(texts)), (5000, None), (5001, "a b")]
    got = {x.doc_id: x.component_id for x in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_near(rows)[1]


# 10


def plain_links(x):
    y = x / np.linalg.norm(x, axis=1, keepdims=True)
    return (y @ y.T >= 0.95) & ~np.eye(len(x), dtype=bool)


@pytest.mark.parametrize("width, lists, coarse, kind", [(16, 16, 1024, "float"), (32, 40, 8, "double"), (64, 20, 1024, "double")])
def test_near_vectors(spark, width, lists, coarse, kind, monkeypatch):
    """Recall of links with many lists, on one level and on two, and vectors of any scale."""
    monkeypatch.setattr(shared, "PARTS", 20)
    monkeypatch.setattr(vector_dedup, "BLOCK", 256)
    r = np.random.default_rng(width)
    b = r.normal(size=(900, width))
    x = np.concatenate([b, b + r.normal(size=b.shape) * r.uniform(0.02, 0.3, (900, 1)), b[:1] + r.normal(size=(150, width)) * 0.05, np.repeat(b[1:2], 60, 0)])
    x = x.astype(np.float32).astype(float) if kind == "float" else x * 10.0 ** r.uniform(-40, 60, (len(x), 1))
    bad = [(9000, None, "c"), (9001, [0.0] * width, "c"), (9002, [float("nan")] * width, "c"), (9003, [1.0] * (width - 1), "c"), (9004, [1.0, None] + [1.0] * (width - 2), "c"), (9005, [float("inf")] + [1.0] * (width - 1), "c"), (None, x[5].tolist(), "c")]
    df = spark.createDataFrame([*((i, v.tolist(), "c") for i, v in enumerate(x)), *bad], f"vec_id long, embedding array<{kind}>, cls string").withColumns({"label": F.lit(1), "home": F.lit(2), "vec": F.lit(3), "n": F.lit(4)})
    out = vector_dedup.near_vectors(df, list_size=-(-len(x) // lists), coarse=coarse).toPandas()
    known = out.dropna(subset=["vec_id"]).set_index("vec_id").sort_index()
    links = plain_links(np.concatenate([x, x[5:6]]))
    want, got = links[:-1].sum(axis=1), known.loc[range(len(x)), "n_links"].to_numpy()
    assert (got <= want).all() and got.sum() >= 0.98 * want.sum()
    full = components(range(len(x)), [p for p in np.argwhere(links[:-1, :-1]) if p[0] < p[1]])
    assert np.mean([known.component_id[i] == c for i, c in full.items()]) >= 0.98
    assert known.loc[9000:9005, "n_links"].sum() == 0 and known.loc[9000:9005, "kept"].all() and (known["kept"] == (known.index == known["component_id"])).all()
    assert len(out) == len(x) + len(bad)


def test_near_vectors_of_an_empty_table(spark):
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert [r.kept for r in vector_dedup.near_vectors(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [True]
