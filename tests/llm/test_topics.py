"""Topics are fitted on all documents: more than a sample of them would hold."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tarnflow.llm import mixing, queries

N = 9_000
KINDS = (",.", "|1", "A!", "{;}")


def text(i):
    r = np.random.default_rng(i)
    return " ".join(["word", *r.choice([*KINDS[i % 4]], 6), *r.choice([*",.|1A!{;}-"], 4)])


def nearest(x, means):
    return ((x[:, None] - means[None]) ** 2).sum(2).argmin(1)


def seen(texts):
    return mixing.marks(pa.array(texts, pa.string())).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def texts():
    return [text(i) for i in range(N)] + ["", None, None]


@pytest.fixture(scope="module")
def docs(spark, texts, tmp_path_factory):
    rows = [(i, t, ("en", "de")[i % 2], f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    path = tmp_path_factory.mktemp("topics")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(path / "documents.parquet"))
    return spark.read.parquet(str(path / "documents.parquet")), str(path)


def test_centroids_are_means_of_all_documents(docs, texts):
    x = seen([t for t in texts if t is not None])
    got = mixing.fit_topics(docs[0], topics=4)
    own = nearest(x, got)
    assert len(got) == 4 and np.bincount(own).min() > N / 8
    assert max(np.abs(x[own == k].mean(0) - got[k]).max() for k in range(4)) < 2e-4
    assert np.array_equal(got, mixing.fit_topics(docs[0].repartition(7).orderBy(F.rand(1)), topics=4))


def test_one_pass_is_two(spark, docs):
    model = mixing.fit_topics(docs[0])
    two = {r.doc_id: (r.mix_tokens, r.mix_topic) for r in mixing.profiled(docs[0], model, keep=["doc_id"]).collect()}
    one = {r.doc_id: (r.tokens, r.topic) for r in queries.op6_raked_mixture(spark, docs[1]).collect()}
    assert one == two and len(one) == N + 3 and {one[N + i] for i in range(3)} == {(0, None)}
    few = docs[0].where("text is null")
    rows = mixing.profiled(few, None, keep=["doc_id"])
    assert mixing.fit_marks(rows).shape[0] == 0 and [r.mix_topic for r in mixing.topical(rows, mixing.fit_marks(rows)).collect()] == [None, None]


def test_pipeline_topics_are_of_all_documents(spark, docs, texts, monkeypatch):
    held, mix = {}, mixing.mix

    def spy(rows, *args, **more):
        held.update({r.doc_id: r.mix_topic for r in rows.select("doc_id", "mix_topic").collect()})
        return mix(rows, *args, **more)

    monkeypatch.setattr(mixing, "mix", spy)
    dict(corpus_pipeline.STAGES)["mixing"](spark, docs[0], "").count()
    x, own = seen(texts[:N]), np.array([int(held[i]) for i in range(N)])
    assert len(held) == N + 3 and len(set(own)) == mixing.TOPICS
    means = np.stack([x[own == k].mean(0) for k in range(mixing.TOPICS)])
    assert (nearest(x, means) == own).mean() > 0.999
