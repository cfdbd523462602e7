"""One-step predictions of streamed series whose state takes in each new value."""

from __future__ import annotations

import math
from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The setting of the state store, and the store that transformWithStateInPandas needs.
STORE, ROCKS = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

OUT = "series_id string, at timestamp, y double, d double, d_hat double, y_hat double"


class RollingMa1(StatefulProcessor):
    """An MA(1) of first differences for each series.

    A new value waits until the watermark has passed its time, so that values that arrive out of order are taken in order; then it is
    predicted from the state (the last value and the last error) and taken into it. A value whose time the watermark has passed before
    it arrives, or that isn't later than the last one taken in, is late and left out; of values of one time that wait together the last stays. The first value of a series only starts it.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, y double, error double, hat double")
        self.waiting = handle.getListState("waiting", "at long, y double, theta double")
        self.next = handle.getValueState("next", "at long")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        """What isn't late waits; one timer stands for all of it, at its earliest time."""
        passed, last, due = timerValues.getCurrentWatermarkInMs(), self.last.get(), self.next.get()
        own = pd.concat(rows)
        own = own[own["ms"] > (passed if last is None else max(passed, last[0]))]
        if len(own):
            self.waiting.appendList(list(zip(own["ms"].tolist(), own["y"].tolist(), own["theta"].tolist(), strict=True)))
            first = int(own["ms"].min())
            if due is None or first < due[0]:
                if due is not None:
                    self.handle.deleteTimer(due[0])
                self._wait_for(first)
        return iter(())

    def _wait_for(self, at: int) -> None:
        self.handle.registerTimer(at)
        self.next.update((at,))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = sorted({at: (at, y, theta) for at, y, theta in self.waiting.get()}.values())
        left, last, out = [v for v in held if v[0] > passed], self.last.get(), []
        for at, y, theta in held[: len(held) - len(left)]:
            if last is None:
                last = (at, y, 0.0, math.nan)
                continue
            d, d_hat = y - last[1], theta * last[2]
            out.append((key[0], pd.Timestamp(at, unit="ms", tz="UTC"), y, d, d_hat, None if math.isnan(last[3]) else max(0.0, last[1] + last[3])))
            last = (at, y, d - d_hat, d_hat)
        if last is not None:
            self.last.update(last)
        self.next.clear()
        if left:
            self.waiting.put(left)
            self._wait_for(left[0][0])
        else:
            self.waiting.clear()
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in OUT.split(", ")])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Streams that start inside use the state store that they need; the session's own setting is put back."""
    before = spark.conf.get(STORE, None)
    spark.conf.set(STORE, ROCKS)
    try:
        yield
    finally:
        spark.conf.set(STORE, before) if before else spark.conf.unset(STORE)


def rolling_predictions(stream: DataFrame, coefficients: DataFrame, time: str = "at", late: str = "1 hour") -> DataFrame:
    """(series_id, at, y, d, d_hat, y_hat) of a stream of (series_id, time, y), each value once, when the watermark has passed it; append mode.

    coefficients: a static table (series_id, theta); series without one are left out. d_hat is theta times the
    last error, y_hat what series.undifference() makes of it. Start it inside of state_store(). State is a series' last value and error, and what waits for the watermark.
    Nulls in any column are left out.
    """
    rows = stream.select(F.col("series_id").cast("string").alias("series_id"), F.col(time).cast("timestamp").alias("at"), F.col("y").cast("double").alias("y")).where("series_id is not null and at is not null and y is not null")
    rows = rows.withWatermark("at", late).join(coefficients.select("series_id", "theta"), "series_id")
    rows = rows.select("series_id", "at", F.unix_millis("at").alias("ms"), "y", "theta")
    return rows.groupBy("series_id").transformWithStateInPandas(RollingMa1(), OUT, "append", "EventTime")
