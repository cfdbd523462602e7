"""Groups against the values that they don't have: plain counts, and rows that are read once."""

from __future__ import annotations

from math import sqrt

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnflow.functions.scalars import near
from tarnflow.operators import evaluation


def drawn() -> list[tuple]:
    """Three groups and a null one, with values of their own, shared ones and nulls."""
    r = np.random.default_rng(12)
    rows = [(g, float(v)) for g, shift, n in (("a", 0.0, 1500), ("b", 0.2, 900), ("c", -0.5, 40), (None, 0.1, 60)) for v in r.normal(shift, 1, n).round(2)]
    return rows + [("a", None), (None, None), ("d", None), ("b", -0.0), ("c", 0.0)]


def test_others_as_counted_plainly(spark):
    rows = drawn()
    got = {r.g: r for r in evaluation.mann_whitney_others(spark.createDataFrame(rows, "g string, v double"), "g", "v").collect()}
    assert set(got) == {"a", "b", "c", None}
    for g in got:
        mine = np.array([v for h, v in rows if h == g and v is not None])
        others = np.array([v for h, v in rows if v is not None and v not in set(mine)])
        u, m, k = float((mine[:, None] > others).sum()), len(mine), len(others)
        _, ties = np.unique(np.concatenate([mine, others]), return_counts=True)
        sd = sqrt(m * k / 12 * (m + k + 1 - float((ties**3 - ties).sum()) / ((m + k) * (m + k - 1))))
        assert got[g].u == u and got[g].z == pytest.approx((u + 0.5 - m * k / 2) / sd, rel=1e-12)


def test_rows_are_read_once(spark):
    rows = drawn()
    read = spark.sparkContext.accumulator(0)

    def seen(row: tuple) -> tuple:
        read.add(1)
        return row

    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3).map(seen), "g string, v double")
    assert {r.g for r in evaluation.significant(df, "g", "v").where("significant").collect()} >= {"c"}
    assert read.value == len(rows)


def test_cents(spark):
    values = [0.0, 0.005, 1.005, 2.675, 95.475, 104999.91, -3.456, 1e18, float("inf"), None]
    got = [r.v for r in spark.createDataFrame([(v,) for v in values], "v double").select(near(F.col("v"), 2).alias("v")).collect()]
    assert got == [duckdb.execute("SELECT round(CAST(? AS DOUBLE), 2)", [v]).fetchone()[0] for v in values]
