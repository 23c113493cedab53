"""Operators with state for each vehicle over streams. They give what the batch operators give on the same arrivals."""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.folds import ALERT_SCHEMA, Vehicle, alarm
from ..sources.scratch import folder

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 256


def observe(top: int, seen: int, seq: int) -> tuple[str, int, int]:
    """(verdict, highest number, bits of the numbers seen below it) after seq."""
    if seq == 0:
        return "stale", top, seen
    if seq > top:
        kept = seen << (seq - top) if seq - top < WINDOW else 0
        return "new", seq, (kept | 1) & ((1 << WINDOW) - 1)
    bit = 1 << (top - seq)
    if top - seq >= WINDOW:
        return "stale", top, seen
    return ("duplicate", top, seen) if seen & bit else ("late", top, seen | bit)


class Dedup(StatefulProcessor):
    """40 bytes a vehicle: the highest number and a window of bits. A trigger's rows of a vehicle are taken in order of arrival."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("window", "top LONG, seen BINARY")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        top, seen = (self.state.get() if self.state.exists() else None) or (0, b"")
        seen = int.from_bytes(seen, "big")
        batch = pd.concat(list(rows)).sort_values("n")
        found = []
        for seq in batch["seq"].tolist():
            verdict, top, seen = observe(top, seen, seq)
            found.append(verdict)
        self.state.update((top, seen.to_bytes(WINDOW // 8, "big")))
        yield batch.assign(verdict=found)[["vin", "seq", "n", "verdict"]]

    def close(self) -> None:
        pass


class RangeAlerts(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("vehicle", "odo DOUBLE, soc DOUBLE, rate DOUBLE, trained DOUBLE, level INT, pending INT, last_low LONG, last_critical LONG")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        v = Vehicle(*self.state.get()) if self.state.exists() else Vehicle()
        batch = pd.concat(list(rows)).sort_values(["epoch", "seq"])
        found = []
        for vin, epoch, seq, *rest in zip(*(batch[c].tolist() for c in ("vin", "epoch", "seq", "odo", "soc", "state", "catalogue", "distance"))):
            got = alarm(v, epoch, *rest)
            if got:
                found.append((vin, seq, *got))
        self.state.update(astuple(v))
        yield pd.DataFrame(found, columns=["vin", "seq", "rule", "window_start", "margin"])

    def close(self) -> None:
        pass


def dedup_stream(arrivals: DataFrame) -> DataFrame:
    """vin, seq, n, verdict of a stream of (vin, seq, n)."""
    return arrivals.select("vin", "seq", "n").groupBy("vin").transformWithStateInPandas(Dedup(), "vin long, seq long, n long, verdict string", "Append", "None")


def range_alert_stream(samples: DataFrame) -> DataFrame:
    cols = ["vin", "epoch", "seq", "odo", "soc", "state", "catalogue", "distance"]
    return samples.select(*cols).groupBy("vin").transformWithStateInPandas(RangeAlerts(), ALERT_SCHEMA, "Append", "None")


ROCKS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def rocks(spark: SparkSession) -> Iterator[None]:
    """The session's streams keep their state in RocksDB meanwhile."""
    before = {k: spark.conf.get(k, None) for k in ROCKS}
    for k, v in ROCKS.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def drain(stream: DataFrame, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Run a stream over all that has arrived, into a table, and read that. A second run with the same folders goes on where the first ended."""
    spark = stream.sparkSession
    path, checkpoint = path or folder(spark), checkpoint or folder(spark)
    with rocks(spark):
        stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def insert_new(batch: DataFrame, batch_id: int, path: str, keys: list[str], first: str) -> None:
    """For foreachBatch without state: add the rows of batch whose keys no earlier batch had, of a key the row with the smallest first.

    A batch has its own folder and overwrites it, so a batch that is run again changes nothing. Each batch reads the keys
    of all earlier ones: for a few large batches; many small ones are for upsert_stream."""
    rows = batch.groupBy(*keys).agg(F.min_by(F.struct(*batch.columns), first).alias("r")).select("r.*")
    if batch_id:
        earlier = batch.sparkSession.read.schema(batch.schema).parquet(*[f"{path}/{i}" for i in range(batch_id)])
        rows = rows.join(earlier.select(*keys), keys, "left_anti").select(*batch.columns)
    rows.write.mode("overwrite").parquet(f"{path}/{batch_id}")


def upsert_stream(stream: DataFrame, keys: list[str], first: str) -> DataFrame:
    """Insert rows whose key isn't there yet, of the trigger in which the key comes first the row with the smallest first; a key that is there changes nothing.

    An aggregate whose state is a row a key; all keys of a trigger are one join with that state in the JVM, no table is read again.
    A key is new in the one trigger whose time is both its first and its last. A trigger has its own folder, which it overwrites if it runs again."""
    spark, path, checkpoint = stream.sparkSession, folder(stream.sparkSession), folder(stream.sparkSession)
    order = F.struct("__at", F.col(first).isNull().alias("none"), F.col(first).alias("first"))
    rest = [c for c in stream.columns if c not in keys]
    kept = stream.withColumn("__at", F.current_timestamp()).groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__row"), F.min("__at").alias("__since"), F.max("__at").alias("__last"))
    new = kept.where("__since = __last").select(*[F.col("__row")[c].alias(c) if c in rest else F.col(c) for c in stream.columns])
    spark.createDataFrame([], stream.schema).write.parquet(f"{path}/none")  # a stream without rows has no trigger
    with rocks(spark):
        new.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda b, i: b.write.mode("overwrite").parquet(f"{path}/{i}")).start().awaitTermination()
    return spark.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(path)


def status_snapshot(stream: DataFrame, key: str, status: str, order: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """key, status: the last status of each key by order of arrival, of all that has arrived.

    State and snapshot grow with the keys, not with the rows. A trigger's snapshot has its own folder, which a repeated
    trigger overwrites; the last is read."""
    spark = stream.sparkSession
    path, checkpoint = path or folder(spark), checkpoint or folder(spark)
    last = stream.groupBy(key).agg(F.max_by(status, order).alias(status))
    stream_ = last.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True)
    done = stream_.foreachBatch(lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{path}/{i}")).start()
    done.awaitTermination()
    newest = (done.lastProgress or {"batchId": 0})["batchId"]
    return spark.read.schema(last.schema).parquet(f"{path}/{newest}")
