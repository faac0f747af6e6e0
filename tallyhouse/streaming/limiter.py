"""The fixed-window limiter as live state: one row of state a bucket, kept by Structured Streaming's transformWithState.

A bucket's window starts at its first hit; a hit a whole window later or more restarts it. A timer in event time drops what has been idle for `idle_days`. State lives in the
checkpoint, so a restarted query goes on where it stopped, and a lost executor's buckets are loaded elsewhere.

Within a batch a bucket's hits are taken in the order of time and id; a hit that comes in a later batch than its time would ask for counts in the window that is
open then, as it would at the counter of a live service. A bucket's hits of one batch are held by one task: bound batches by maxFilesPerTrigger where a bucket can be hot.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HITS = "bucket string, id bigint, ts timestamp"
COUNTED = T.StructType([T.StructField("bucket", T.StringType()), T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("n", T.LongType()), T.StructField("allowed", T.BooleanType())])
_WINDOW = T.StructType([T.StructField("began", T.LongType()), T.StructField("n", T.LongType())])


def count_hits(times: list[int], began: int | None, n: int, span: int) -> tuple[list[int], int, int]:
    """Each hit's number in its window, and the window that is open after them."""
    out = []
    for t in times:
        if began is None or t - began >= span:
            began, n = t, 0
        n += 1
        out.append(n)
    return out, began or 0, n


class Limiter(StatefulProcessor):
    def __init__(self, most: int, minutes: int, idle_days: int):
        self.most, self.span, self.idle = most, minutes * 60_000_000, idle_days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.window = handle.getValueState("window", _WINDOW)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows)).sort_values(["ts", "id"], kind="stable")
        times = hits["ts"].astype("datetime64[us]").astype("int64").tolist()
        state = self.window.get() if self.window.exists() else (None, 0)
        numbers, began, n = count_hits(times, state[0], state[1], self.span)
        self.window.update((began, n))
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old)
        self.handle.registerTimer(times[-1] // 1000 + self.idle)
        yield pd.DataFrame({"bucket": key[0], "id": hits["id"].to_numpy(), "ts": hits["ts"].to_numpy(), "n": numbers, "allowed": [x <= self.most for x in numbers]})

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        self.window.clear()
        yield from ()

    def close(self) -> None:
        pass


def limited(hits: DataFrame, most: int, minutes: int = 60, idle_days: int = 2, late: str = "1 hour") -> DataFrame:
    """COUNTED of a stream of HITS. The session's state store must be the RocksDB one."""
    watched = hits.select("bucket", "id", "ts").withWatermark("ts", late)
    return watched.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Limiter(most, minutes, idle_days), outputStructType=COUNTED, outputMode="Append", timeMode="EventTime")


def run_limiter(spark: SparkSession, hits: DataFrame, path: str, checkpoint: str, most: int, minutes: int = 60) -> None:
    """Take what is there, append COUNTED to a Parquet table at path, and stop; the session's state store is put back after."""
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, ROCKS)
    try:
        started = limited(hits, most, minutes).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    finally:
        spark.conf.set(STORE, before)
    started.awaitTermination()
