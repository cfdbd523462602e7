"""How many links the probed lists keep when there are many lists on two levels."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.llm import vector_dedup


def linked(width, n, cosine, seed):
    r = np.random.default_rng(seed)
    a, o = r.normal(size=(n, width)), r.normal(size=(n, width))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    o -= (o * a).sum(1)[:, None] * a
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    return a, cosine * a + np.sqrt(1 - cosine**2) * o


@pytest.mark.parametrize("lists, probes, least", [(4_000, "auto", 0.98), (60_000, "auto", 0.97), (4_000, None, 1.0)])
def test_recall_of_many_lists(lists, probes, least, monkeypatch):
    """Links just over the threshold, whose ends lie far apart; some pairs at exactly it for the exact way."""
    monkeypatch.setattr(vector_dedup, "ROUNDS", 2)
    index = vector_dedup.Index(linked(32, 8_000, 0.9, 1)[0], lists, 512, probes)
    a, b = linked(32, 400, 0.951, 2)
    (home_a, of_a), (home_b, of_b) = (index.probes(x, np.sqrt(0.1)) for x in (a, b))
    assert np.mean([home_b[i] in of_a[i] or home_a[i] in of_b[i] for i in range(len(a))]) >= least
    assert all(p[0] == h for p, h in zip(of_a, home_a, strict=True))
    if probes:
        assert max(map(len, of_a)) <= index.most < 60


def test_exact_probes_lose_no_link(spark):
    """Two levels of lists and probes without a limit: the links of brute force."""
    a, b = linked(24, 400, 0.955, 3)
    x = np.concatenate([a, b])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").withColumn("probes", F.lit(1))
    got = vector_dedup.near_vectors(df, list_size=10, coarse=8, probes=None).toPandas().set_index("vec_id").sort_index()
    want = ((x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)).sum(1)
    assert (got["n_links"].to_numpy() == want).all() and want.sum() >= 800
