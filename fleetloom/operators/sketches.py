"""Sketches of bounded size, as aggregates that Spark combines before the shuffle."""

from __future__ import annotations

import hashlib
import math
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def slot(item: Column, row: Column | int, width: int) -> Column:
    """A hash of item below width, another for each row; the same in any engine that has md5."""
    salted = F.concat(item.cast("string"), F.lit("#"), (row if isinstance(row, Column) else F.lit(row)).cast("string"))
    return F.conv(F.substring(F.md5(salted), 1, 8), 16, 10).cast("long") % width


def count_min_size(eps: float, delta: float) -> tuple[int, int]:
    """(depth, width) for counts too high by at most eps of all rows with probability 1 - delta."""
    return math.ceil(math.log(1 / delta)), math.ceil(math.e / eps)


def count_min(rows: DataFrame, item: str, *, depth: int, width: int) -> DataFrame:
    """row, slot, n: at most depth times width cells. Null items aren't counted."""
    cells = rows.where(F.col(item).isNotNull()).select(item, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row"))
    return cells.groupBy("row", slot(F.col(item), F.col("row"), width).alias("slot")).agg(F.count(F.lit(1)).alias("n"))


def estimate(items: DataFrame, item: str, sketch: DataFrame, *, depth: int, width: int) -> DataFrame:
    """item, estimate: the least of the item's cells."""
    wanted = items.select(item).distinct().select(item, F.explode(F.sequence(F.lit(0), F.lit(depth - 1))).alias("row")).withColumn("slot", slot(F.col(item), F.col("row"), width))
    return wanted.join(sketch, ["row", "slot"], "left").groupBy(item).agg(F.min(F.coalesce("n", F.lit(0))).alias("estimate"))


def bloom_rate(p: float) -> tuple[float, int]:
    """(bits an item, hashes) at a false positive rate of p."""
    bits = -math.log(p) / math.log(2) ** 2
    return bits, max(1, round(bits * math.log(2)))


def bloom_size(n: int, p: float) -> tuple[int, int]:
    """(bits, hashes) for n items at a false positive rate of p."""
    bits, hashes = bloom_rate(p)
    return max(1, math.ceil(n * bits)), hashes


def bloom(rows: DataFrame, item: str, *, bits: int, hashes: int) -> DataFrame:
    """word, mask: the set bits, 32 in a word."""
    set_ = rows.where(F.col(item).isNotNull()).select(F.explode(F.array(*[slot(F.col(item), i, bits) for i in range(hashes)])).alias("b"))
    return set_.groupBy(F.floor(F.col("b") / 32).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("b") % 32).cast("int"))).alias("mask"))


def maybe_members(items: DataFrame, item: str, filter_: DataFrame, *, bits: int, hashes: int) -> DataFrame:
    """The items all of whose bits are set: every member, and few others."""
    b = items.select(item).distinct().select(item, F.explode(F.array(*[slot(F.col(item), i, bits) for i in range(hashes)])).alias("b"))
    b = b.withColumn("word", F.floor(F.col("b") / 32)).join(filter_, "word", "left")
    hit = F.coalesce(F.expr("shiftright(mask, CAST(b % 32 AS INT)) & 1"), F.lit(0))
    return b.groupBy(item).agg(F.min(hit).alias("all")).where("all = 1").select(item)


class Rotating:
    """Two generations of a Bloom filter, each of n items at a false positive rate of p: memory is bounded, the oldest items are forgotten.

    For a fold over arrivals, whose results depend on what came before."""

    def __init__(self, n: int, p: float):
        self.n, (self.bits, self.hashes) = n, bloom_size(n, p)
        self.now, self.before, self.items = bytearray(self.bits // 8 + 1), None, 0

    def _places(self, item: str) -> list[int]:
        h = hashlib.shake_128(item.encode()).digest(4 * self.hashes)
        return [int.from_bytes(h[i : i + 4], "big") % self.bits for i in range(0, len(h), 4)]

    def seen(self, item: str) -> bool:
        """Whether item may have come before; if not, it is added."""
        places = self._places(item)
        if any(g is not None and all(g[x >> 3] >> (x & 7) & 1 for x in places) for g in (self.now, self.before)):
            return True
        if self.items >= self.n:
            self.before, self.now, self.items = self.now, bytearray(self.bits // 8 + 1), 0
        for x in places:
            self.now[x >> 3] |= 1 << (x & 7)
        self.items += 1
        return False


#: Rows that a task counts before its summary is cut again.
HELD = 1 << 16


def frequent(rows: DataFrame, key: str, counters: int) -> DataFrame:
    """key, low: a summary of at most so many keys (Misra and Gries): low is at most the key's rows, and less by at most a (counters + 1)th of all rows.

    So every key with more than a (counters + 1)th of the rows is in it. A task holds that many counters and some batches; summaries are
    merged by adding, and cut once more by the count that comes after the largest."""
    kind = rows.schema[key].dataType.simpleString()

    def cut(counts: pd.Series) -> pd.Series:
        if len(counts) <= counters:
            return counts
        over = counts.nlargest(counters + 1).iloc[-1]
        return (counts[counts > over]) - over

    def summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = pd.Series(dtype="int64")
        for batch in batches:
            held = held.add(batch[key].value_counts(), fill_value=0).astype("int64")
            if len(held) > counters + HELD:
                held = cut(held)
        held = cut(held)
        yield pd.DataFrame({key: held.index.to_numpy(), "low": held.to_numpy()})

    merged = stored(rows.select(key).where(F.col(key).isNotNull()).mapInPandas(summary, f"{key} {kind}, low long").groupBy(key).agg(F.sum("low").alias("low")))
    # The largest counters + 1 of each partition meet in one task.
    after = merged.orderBy(F.col("low").desc(), key).limit(counters + 1).agg(F.count(F.lit(1)).alias("n"), F.min("low").alias("over")).select(F.when(F.col("n") > counters, F.col("over")).otherwise(0).alias("over"))
    return merged.join(F.broadcast(after)).where(F.col("low") > F.col("over")).select(key, (F.col("low") - F.col("over")).alias("low"))


def frequent_counts(rows: DataFrame, key: str, counters: int) -> DataFrame:
    """key, n of exactly the keys with more than a (counters + 1)th of the rows that have one: the summary names them, a second pass counts them."""
    rows = rows.where(F.col(key).isNotNull())
    few = stored(frequent(rows, key, counters).select(key))
    # At most counters rows are broadcast.
    counted = rows.join(F.broadcast(few), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counted.join(F.broadcast(rows.agg(F.count(F.lit(1)).alias("all")))).where(F.col("n") * (counters + 1) > F.col("all")).select(key, "n")
