"""The stateful stream against the same model on the whole table."""

import datetime

import numpy as np
import pytest

from tarnflow.operators import models, series
from tarnflow.streaming import rolling

SCHEMA = "series_id string, at timestamp, y double"
START = datetime.datetime(2024, 1, 1)


def at(day, hour=0):
    return START + datetime.timedelta(days=day, hours=hour)


def test_a_stream_in_three_batches_with_a_restart(spark, tmp_path):
    """Rows arrive out of order inside of the watermark, some too late, one twice; the stream is stopped and starts again from its checkpoint."""
    r = np.random.default_rng(1)
    values = {k: 100 + np.cumsum(r.normal(size=60)) for k in ("a", "b", "c")}
    whole = spark.createDataFrame([(k, i, float(v)) for k, y in values.items() for i, v in enumerate(y)], "series_id string, idx long, y double")
    theta = models.ma1_coefficients(whole)
    want = {(x.series_id, x.idx): (x.d, x.d_hat) for x in models.rolling_ma1(whole).collect()}
    undone = {(x.series_id, x.idx): x.y_hat for x in series.undifference(models.rolling_ma1(whole)).collect()}
    source, out, kept = (str(tmp_path / n) for n in ("in", "out", "state"))

    def sent(rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        with rolling.state_store(spark):
            done = rolling.rolling_predictions(stream, theta, late="3 days").writeStream.format("parquet").option("path", out).option("checkpointLocation", kept).outputMode("append").trigger(availableNow=True).start()
        done.awaitTermination()

    days = r.permutation(22)  # inside of one batch the order is any
    sent([(k, at(int(i)), float(values[k][i])) for i in days for k in values] + [("a", at(4), -7.0), ("gone", at(1), 1.0), ("a", None, 1.0), (None, at(1), 1.0), ("b", at(2), None)][1:])
    run()
    first = spark.read.parquet(out).count()
    assert first == 3 * 18  # day 0 starts a series; days 19 to 21 wait
    sent([(k, at(i), float(values[k][i])) for i in range(22, 41) for k in values] + [("a", at(3, 5), -1e6), ("b", at(17, 1), 1e6)])
    run()
    sent([(k, at(i), float(values[k][i])) for i in range(41, 60) for k in values])
    run()
    got = spark.read.parquet(out).collect()
    seen = {(x.series_id, (x.at - START).days): (x.d, x.d_hat) for x in got}
    assert len(got) == len(seen) == 3 * 56 and set(seen) == {k for k in want if k[1] <= 56}
    for k, v in seen.items():
        assert v == pytest.approx(want[k], abs=1e-9)
    hats = {(x.series_id, (x.at - START).days): x.y_hat for x in got}
    assert all(hats[k] is undone[k] if undone[k] is None else hats[k] == pytest.approx(undone[k], abs=1e-9) for k in hats)
    assert spark.conf.get(rolling.STORE, "").find("Rocks") < 0


def test_streamed_query_is_the_batch_query(spark):
    from tarnflow.plans import catalog, fits  # noqa: F401

    sf = "/root/testdata/sf0.001"
    batch = {(r.series_id, r.idx): r for r in catalog.QUERIES["rolling_ma1"](spark, sf).collect()}
    got = catalog.QUERIES["streamed_ma1"](spark, sf).collect()
    last = max(i for _, i in batch)
    assert {(r.series_id, r.idx) for r in got} == {k for k in batch if k[1] < last}
    for r in got:
        want = batch[r.series_id, r.idx]
        assert r.y == want.y and (r.y_hat is None) == (want.y_hat is None) and (r.y_hat is None or abs(r.y_hat - want.y_hat) < 2e-6)
