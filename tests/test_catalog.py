"""Queries against their SQL twins on the smallest tables; properties where SQL has no twin."""

import compare
import pytest

from tarnflow.plans import catalog, fits, frames, networks  # noqa: F401
from tarnflow.session import checkpoints

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", catalog.ORACLE_SQL)
def test_twin(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert compare.same(df.collect(), df.columns, catalog.ORACLE_SQL[name], compare.tables(SF)) == ""


def test_hub_shares_sum_to_100(spark):
    rows = catalog.QUERIES["hub_share_exact"](spark, SF).groupBy("t").sum("share").collect()
    assert rows and all(abs(r[1] - 100) < 1e-3 for r in rows)


def test_hub_shares_count_the_whole_raster(spark):
    rows = catalog.QUERIES["hub_share_exact"](spark, SF).groupBy("t").sum("cells").collect()
    assert rows and all(r[1] == 200 * 200 for r in rows)


def test_hub_costs_reach_the_end_of_a_long_path(spark):
    from tarnflow.operators import spatial

    checkpoints(spark)
    edges = spark.createDataFrame([(0, i + 1, i, 1.0) for i in range(45)], "t long, src long, dst long, cost double").checkpoint()
    hubs = spark.createDataFrame([(0, 0)], "t long, zsid long")
    got = {r.zsid: r.cost for r in spatial.hub_costs(edges, hubs).collect()}
    assert got == {i: float(i) for i in range(46)}
    with pytest.raises(ValueError):
        spatial.hub_costs(edges, hubs, 3)


def test_dft_returns_half_of_all_bins(spark):
    import numpy as np

    from tarnflow.operators import spectral

    y = {"a": np.random.default_rng(1).normal(size=50), "b": np.sin(2 * np.pi * np.arange(24) / 3)}
    df = spark.createDataFrame([(k, i, float(v)) for k, x in y.items() for i, v in enumerate(x)], "series_id string, idx long, y double")
    got = spectral.dft(df).toPandas()
    for k, x in y.items():
        own = got[got["series_id"] == k].sort_values("k")
        assert np.allclose(own["amplitude"], np.abs(np.fft.fft(x))[: len(x) // 2], atol=1e-6)


def test_lomb_scargle_finds_any_period(spark):
    import numpy as np

    from tarnflow.operators import spectral

    t = np.sort(np.random.default_rng(2).choice(400, 121, replace=False))
    df = spark.createDataFrame([("a", int(i), float(np.sin(2 * np.pi * i / 17.3))) for i in t], "series_id string, idx long, y double")
    got = spectral.lomb_scargle(df).toPandas()
    span = t.max() - t.min()
    assert len(got) == 1 + round((2.5 * 121 / span - 0.1 / span) * 5 * span)
    best = got[got["period"] > 2].sort_values("power").iloc[-1]
    assert abs(best["period"] - 17.3) < 0.5 and best["power"] > 0.9
