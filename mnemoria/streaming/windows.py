"""Write rates, short-lived entries and micro-batches over streams.

Rows later than the watermark are dropped by Spark; the batch forms keep them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_rate(stream: DataFrame, most: int = 60, window: str = "60 seconds", late: str = "60 seconds") -> DataFrame:
    """Writes in each window and session of ``stream(ts timestamp, session_id, ...)``, with the alert they raise."""
    by = stream.withWatermark("ts", late).groupBy(F.window("ts", window), "session_id").agg(F.count("*").alias("n"))
    severity = F.when(F.col("n") > 3 * most, "Critical").when(F.col("n") > 2 * most, "High").when(F.col("n") > most, "Medium")
    return by.select(F.col("window.start").alias("window_start"), "session_id", "n", severity.alias("severity"))


def latest_entries(stream: DataFrame, ttl_seconds: int, late: str = "60 seconds") -> DataFrame:
    """``(key, value, accesses)`` of ``stream(key, value, ts timestamp)``: the last value of each key and how often it was set.

    A key is forgotten once the watermark is ``ttl_seconds`` past its last set: time is that of the events, so a replay gives the same.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: object) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, value, at = state.get if state.exists else (0, None, 0)
        for b in batches:
            n += len(b)
            last = b.sort_values(["ts", "value"]).iloc[-1]
            ms = int(last["ts"].timestamp() * 1000)
            if ms >= at:
                at, value = ms, float(last["value"])
        state.update((n, value, at))
        state.setTimeoutTimestamp(max(at + ttl_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": [key[0]], "value": [value], "accesses": [n]})

    return stream.withWatermark("ts", late).groupBy("key").applyInPandasWithState(update, "key long, value double, accesses long", "n long, value double, at long", "update", "EventTimeTimeout")


def micro_batches(stream: DataFrame, checkpoint: str, write: Callable[[DataFrame, int], None], every: str | None = "5 seconds"):  # noqa: ANN201
    """Start a query that hands each micro-batch to ``write``; without ``every`` it takes what is there and ends."""
    w = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(processingTime=every) if every else w.trigger(availableNow=True)).start()
