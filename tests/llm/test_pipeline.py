"""The queries against their SQL, and the pipeline and each of its stages against plain Python."""

import zlib
from collections import defaultdict

import compare
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from test_llm import plain_near

import corpus_pipeline
from tarnflow.llm import language_id, mixing, queries

SF = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
VOCAB = {"en": "the and ing tion her", "de": "und der sch keit ein", "fr": "que les ment eau oui"}


def text(seed, lang, n):
    return " ".join(np.random.default_rng(seed).choice(VOCAB[lang].split(), n)) + f" x{seed}."


@pytest.fixture(scope="module")
def rows():
    out = [(i, text(i, k, 40 + i % 50), k if i % 7 else None, f"s{i % 3}") for i in range(120) for k in [[*VOCAB][i % 3]]]
    out += [(200 + i, out[i][1], "en", "s9") for i in range(0, 30, 3)] + [(300, out[4][1].upper(), "de", None), (301, None, "en", "s1"), (302, "", None, None), (303, "12 34 !", "en", "s1")]
    out += [(310 + i, out[i][1] + " more", "en", "s1") for i in range(40, 60)] + [out[7], out[7], (None, text(900, "en", 50), "en", "s0"), (None, text(900, "en", 50), "en", "s0"), (400, text(5, "de", 9000), "de", "s2")]
    return [(*r, len(r[1] or "")) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


@pytest.mark.parametrize("name", queries.ORACLE_SQL)
def test_twin(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert compare.same(df.collect(), df.columns, queries.ORACLE_SQL[name], compare.tables(SF)) == ""


def test_stages_and_columns():
    assert list(STAGES) == ["language_id", "exact_dedup", "ngram_jaccard_join", "mixing", "best_fit_packing"]


def test_language_stage(spark, docs, rows):
    got = STAGES["language_id"](spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    model = language_id.fit(docs.where(~language_id.held_out(F.col("doc_id"))))
    kept = sorted(map(tuple, got.collect()), key=str)
    lost = [r for r in rows if not any(c.isalpha() for c in r[1] or "")]
    assert len(kept) == len(rows) - len(lost) == len(rows) - 3 and {r[0] for r in lost} == {301, 302, 303}
    pred = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert kept == sorted(((*r[:2], r[2] or pred[r[0]], *r[3:]) for r in rows if r not in lost), key=str)


def test_exact_stage(spark, docs, rows):
    got = STAGES["exact_dedup"](spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    best = {}
    for r in rows:
        key = (r[1] or "").encode().lower()
        best[key] = max(best.get(key, (-2, "")), (-1 if r[0] is None else r[0], r[1] or ""))
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in got.collect()) == sorted(best.values())


def test_near_stage(spark, docs, rows):
    got = STAGES["ngram_jaccard_join"](spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    component = plain_near([(r[0], r[1]) for r in rows if r[0] is not None])[1]
    want = [r for r in rows if r[0] is None or component[r[0]] == r[0]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) < len(rows) - 20


def test_mixing_stage(spark, docs, rows):
    got = STAGES["mixing"](spark, docs, "")
    assert got.columns == list(corpus_pipeline.COLUMNS)
    model = mixing.fit_topics(docs)
    profiles = mixing.profiled(docs, model, keep=list(corpus_pipeline.COLUMNS))
    own = profiles.toPandas()
    live = own[own["mix_tokens"] > 0].fillna({"source": "none", "lang": "none"})
    codes, goals = [], []
    for c, name in (("source", "source"), ("lang", "lang"), ("mix_topic", "mix_topic")):
        code, values = pd.factorize(live[c])
        wish = np.array([queries.WEIGHTS[name].get(v, queries.WEIGHTS[name]["*"]) for v in values])
        codes.append(code)
        goals.append(wish / wish.sum())
    w = live["mix_tokens"].to_numpy(float)
    for _ in range(mixing.ROUNDS):
        for code, goal in zip(codes, goals, strict=True):
            w = w * (goal / np.bincount(code, w))[code]
        if max(np.abs(np.bincount(c, w) - g).max() for c, g in zip(codes, goals, strict=True)) <= mixing.TOLERANCE:
            break
    mixed = mixing.mix(profiles, ["source", "lang", "mix_topic"], F.col("mix_tokens"), keep=0.9, given=queries.WEIGHTS)
    out = mixed.toPandas()
    weight = dict(zip(zip(*(live[c] for c in ("source", "lang", "mix_topic")), strict=True), w / live["mix_tokens"] * live["mix_tokens"].sum(), strict=True))
    mine = out[out["mix_tokens"] > 0].fillna({"source": "none", "lang": "none"})
    assert np.allclose(mine["mix_weight"], [weight[k] for k in zip(mine["source"], mine["lang"], mine["mix_topic"], strict=True)], rtol=1e-3)
    kept = mixed.where("mix_keep").select(*corpus_pipeline.COLUMNS)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, kept.collect()), key=str)
    assert 0.5 < mine.loc[mine["mix_keep"], "mix_tokens"].sum() / mine["mix_tokens"].sum() <= 1


def test_packing_stage(spark, docs, rows):
    from tokenizers import Tokenizer

    from tarnflow.llm.tokens import tokenizer_path

    encode = Tokenizer.from_file(tokenizer_path()).encode
    got = STAGES["best_fit_packing"](spark, docs, "").toPandas()
    want = defaultdict(int)
    for r in rows:
        ids = [*encode(r[1] or "", add_special_tokens=False).ids, 0]
        for k in range(0, len(ids), 2048):
            own = ids[k : k + 2048]
            want[r[0], k // 2048, k, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    have = defaultdict(int)
    for r in got.itertuples():
        have[None if pd.isna(r.doc_id) else int(r.doc_id), r.piece, r.start, r.length, r.ids_crc32] += 1
    assert have == want
    for _, own in got.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own["length"].sum() <= 2048 and own["offset"].tolist() == [0, *own["length"].cumsum().tolist()[:-1]]
    assert got["sequence_id"].nunique() <= 1.05 * got["length"].sum() / 2048 + 1


def test_run_is_its_stages(spark, docs, rows, tmp_path):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    step = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, step, "").write.parquet(str(tmp_path / f"stage{i}"))
        step = spark.read.parquet(str(tmp_path / f"stage{i}"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got = corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()
    assert got and sorted(map(tuple, got), key=str) == sorted(map(tuple, step.select(*columns).collect()), key=str)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


