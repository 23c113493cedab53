"""Duplicate and late rows in event time: state that ends with a vehicle's silence, and rows too late for it as a table beside.

Rows carry the time they were made (ts) and received (recv). The watermark follows recv, so nothing that Spark drops
behind it is on time here. A row made too long before it was received never reaches the state. A vehicle silent for longer than
idle begins anew; that is told from the rows themselves, so answers don't depend on how rows fall into triggers. Timers only
clear the state of those who don't come back: it is as large as the vehicles heard of within idle and the watermark's delay.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..sources.scratch import folder
from .state import ROCKS, WINDOW, observe

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Seconds: from making to receiving, of silence, of the watermark's delay.
BOUND_S, IDLE_S, DELAY_S = 90 * 60, 12 * 3600, 24 * 3600
OUT = "vin long, seq long, n long, verdict string"


class TimedDedup(StatefulProcessor):
    """The window of numbers of each vehicle that isn't silent, and one timer for its end."""

    def __init__(self, idle_s: int):
        self.idle_ms = idle_s * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("window", "top LONG, seen BINARY, last_ms LONG, timer_ms LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, seen, last, timer = (self.state.get() if self.state.exists() else None) or (0, b"", None, None)
        seen = int.from_bytes(seen, "big")
        batch = pd.concat(list(rows)).sort_values("n")
        found = []
        for seq, ms in zip(batch["seq"].tolist(), batch["recv_ms"].tolist(), strict=True):
            if last is not None and ms - last > self.idle_ms:
                top, seen = 0, 0
            verdict, top, seen = observe(top, seen, seq)
            last = ms if last is None else max(last, ms)
            found.append(verdict)
        end = max(last + self.idle_ms + 1, timerValues.getCurrentWatermarkInMs() + 1)
        if timer is not None:
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(end)
        self.state.update((top, seen.to_bytes(WINDOW // 8, "big"), last, end))
        yield batch.assign(verdict=found)[["vin", "seq", "n", "verdict"]]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        return iter(())

    def close(self) -> None:
        pass


def too_late(bound_s: int = BOUND_S):
    """Whether a row was made longer before it was received than the bound."""
    return F.unix_micros(F.col("recv").cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) > bound_s * 1_000_000


def timed_dedup(arrivals: DataFrame, *, bound_s: int = BOUND_S, idle_s: int = IDLE_S, delay_s: int = DELAY_S) -> DataFrame:
    """vin, seq, n, verdict of a stream of (vin, ts, recv, seq, n) that are not too late."""
    rows = arrivals.where(~too_late(bound_s)).select(F.col("vin").cast("long").alias("vin"), F.col("recv").cast("timestamp").alias("recv"), F.unix_millis(F.col("recv").cast("timestamp")).alias("recv_ms"), "seq", "n")
    return rows.withWatermark("recv", f"{delay_s} seconds").groupBy("vin").transformWithStateInPandas(TimedDedup(idle_s), OUT, "Append", "EventTime")


def drain_with_late(arrivals: DataFrame, path: str | None = None, checkpoint: str | None = None, **options) -> tuple[DataFrame, DataFrame, list]:
    """Verdicts, the rows that came too late (vin, seq, n), and the progress of the first stream. Two streams over the same arrivals: Spark gives a stateful operator one output."""
    spark = arrivals.sparkSession
    path, checkpoint = path or folder(spark), checkpoint or folder(spark)
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        late = arrivals.where(too_late(options.get("bound_s", BOUND_S))).select(F.col("vin").cast("long").alias("vin"), F.col("seq").cast("long").alias("seq"), F.col("n").cast("long").alias("n"))
        done = None
        for name, stream in (("late", late), ("verdicts", timed_dedup(arrivals, **options))):
            done = stream.writeStream.format("parquet").option("checkpointLocation", f"{checkpoint}/{name}").trigger(availableNow=True).start(f"{path}/{name}")
            done.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return spark.read.schema(OUT).parquet(f"{path}/verdicts"), spark.read.schema("vin long, seq long, n long").parquet(f"{path}/late"), list(done.recentProgress)
