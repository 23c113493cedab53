"""Operators over ordered rows of a key, as window functions: no row leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..sources.scratch import stored


def dedup_verdicts(arrivals: DataFrame, *, key: str = "vin", seq: str = "seq", order: str = "n", window: int = 256) -> DataFrame:
    """Add verdict: new, late, duplicate or stale against the window of sequence numbers below the highest seen."""
    before = F.max(seq).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    again = F.row_number().over(Window.partitionBy(key, seq).orderBy(order)) > 1
    s = F.col(seq)
    verdict = (
        F.when(s == 0, "stale").when(F.col("__before").isNull() | (F.col("__before") == 0) | (s > F.col("__before")), "new")
        .when(F.col("__before") - s >= window, "stale").when(F.col("__again"), "duplicate").otherwise("late")
    )
    return arrivals.withColumns({"__before": before, "__again": again}).withColumn("verdict", verdict).drop("__before", "__again")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order, by one partial aggregate: no sort."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def first_per(rows: DataFrame, key: str, *order: Column) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("__n = 1").drop("__n")


def trips(samples: DataFrame, *, key: str = "vin", dwell_s: int = 90, moving_c: int = 300, least_km_c: int = 20) -> DataFrame:
    """key, start, end, km_c, n of trips: moving samples, split where a stop lasts dwell_s or charging begins."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    s = samples.withColumn("charging", F.col("state") == "CHARGING")
    s = s.withColumn("moving", (F.col("speed_c") > moving_c) & ~F.col("charging"))
    s = s.withColumn("g", F.sum(F.col("moving").cast("int")).over(w)).where("g > 0")
    rest = ~F.col("moving")
    stop = s.groupBy(key, "g").agg(
        F.coalesce((F.unix_micros(F.max(F.when(rest, F.col("ts")).cast("timestamp"))) - F.unix_micros(F.min(F.when(rest, F.col("ts")).cast("timestamp"))) >= dwell_s * 1_000_000) | F.bool_or("charging"), F.bool_or("charging")).cast("int").alias("brk"),
        F.min(F.when(F.col("moving"), F.struct("ts", "seq", "odo_c"))).alias("m"),
    )
    trip = F.coalesce(F.sum("brk").over(Window.partitionBy(key).orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = stop.withColumn("trip", trip).groupBy(key, "trip").agg(F.min("m").alias("a"), F.max("m").alias("b"), F.count(F.lit(1)).alias("n"))
    return ends.select(key, F.col("a.ts").alias("start"), F.col("b.ts").alias("end"), (F.col("b.odo_c") - F.col("a.odo_c")).alias("km_c"), "n").where(F.col("km_c") >= least_km_c)


def charge_sessions(samples: DataFrame, *, key: str = "vin", gap_s: int = 30) -> DataFrame:
    """key, start, end, n, rise, energy (of integer power times seconds) of runs of charging samples at most gap_s apart."""
    w = Window.partitionBy(key).orderBy("ts", "seq")
    dt = F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp"))
    s = samples.withColumn("dt", dt).withColumn("on", F.col("state") == "CHARGING").withColumn("was", F.coalesce(F.lag("on").over(w), F.lit(False)))
    s = s.where("on").withColumn("new", (~F.col("was") | (F.col("dt") > gap_s)).cast("int"))
    s = s.withColumn("id", F.sum("new").over(w))
    used = F.when((F.col("new") == 0) & (F.col("dt") > 0), F.col("step_c") * F.col("dt")).otherwise(0)
    return s.groupBy(key, "id").agg(F.min("ts").alias("start"), F.max("ts").alias("end"), F.count(F.lit(1)).alias("n"), (F.max_by("soc", F.struct("ts", "seq")) - F.min_by("soc", F.struct("ts", "seq"))).alias("rise"), F.sum(used).alias("energy")).drop("id")


def running_totals(rows: DataFrame, key: str, order: list[str], counts: list[str]) -> DataFrame:
    """Add, for each of counts, its sum over earlier rows of the key by order (count_before) and over all of them (count_total).

    Order and key tell rows apart. Rows are range-partitioned by key and order, so a large key takes many partitions; each
    is summed on its own, and the sums of a key's earlier partitions are added: a row for each key and each partition it
    touches, about as many as keys and partitions together."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, key, *order).withColumn("__part", F.spark_partition_id()))
    of, whole = Window.partitionBy("__key"), Window.partitionBy(key, "__part").orderBy(*order)
    earlier = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(*[F.sum(c).alias(f"__{c}") for c in counts])
    sums = sums.select("__key", "__of", *[earlier(f"__{c}", of.orderBy("__of")).alias(f"__{c}_before") for c in counts], *[F.sum(f"__{c}").over(of).alias(f"{c}_total") for c in counts])
    met = placed.withColumns({f"{c}_here": earlier(c, whole) for c in counts}).join(sums, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    return met.select(*rows.columns, *[(F.col(f"{c}_here") + F.col(f"__{c}_before")).alias(f"{c}_before") for c in counts], *[f"{c}_total" for c in counts])


def running_total(rows: DataFrame, key: str, order: list[str], count: str) -> DataFrame:
    """The same of one count, as before and total."""
    return running_totals(rows, key, order, [count]).withColumnsRenamed({f"{count}_before": "before", f"{count}_total": "total"})


def running_max(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Add before: the largest value (of any type that has an order, structs too) of the earlier rows of the key by order; null where there is none.

    Ranges as in running_totals, so a large key takes many partitions. Order and key tell rows apart."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(rows.repartitionByRange(parts, key, *order).withColumn("__part", F.spark_partition_id()))
    so_far = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    tops = placed.groupBy(F.col(key).alias("__key"), F.col("__part").alias("__of")).agg(F.max(value).alias("__top"))
    tops = tops.select("__key", "__of", F.max("__top").over(so_far(Window.partitionBy("__key").orderBy("__of"))).alias("__earlier"))
    here = placed.withColumn("__here", F.max(value).over(so_far(Window.partitionBy(key, "__part").orderBy(*order))))
    met = here.join(tops, F.col(key).eqNullSafe(F.col("__key")) & (F.col("__part") == F.col("__of")))
    larger = F.col("__here").isNull() | (F.col("__earlier") > F.col("__here"))
    return met.select(*rows.columns, F.when(larger, F.col("__earlier")).otherwise(F.col("__here")).alias("before"))


def covered(intervals: DataFrame, key: str) -> DataFrame:
    """intervals (key, id, a, b; from a to before b) that begin before some other of the key, which began no later (by a, then id), has ended.

    The largest end so far decides, so an interval that spans several later ones is seen by all of them."""
    real = intervals.where("a < b")
    return running_max(real, key, ["a", "id"], "b").where(F.col("before") > F.col("a")).select(*intervals.columns)


def as_of(rows: DataFrame, states: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """rows with value: that of the last of states (key, at, value) of the key at or before the row; null where there is none. Of states at one time the largest value counts.

    One running maximum over both, so a key with many rows and states takes many partitions. rows have a column id that tells those of a key and time apart."""
    own = rows.select(F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(1).alias("__kind"), F.col("id").cast("string").alias("__id"), F.struct(*rows.columns).alias("__row"), F.lit(None).cast(T.StructType([states.schema[at], states.schema[value]])).alias("__state"))
    known = states.groupBy(key, at).agg(F.max(value).alias(value))
    theirs = known.select(F.col(key).alias("__k"), F.col(at).alias("__at"), F.lit(0).alias("__kind"), F.lit("").alias("__id"), F.lit(None).cast(own.schema["__row"].dataType).alias("__row"), F.struct(at, value).alias("__state"))
    met = running_max(own.unionByName(theirs), "__k", ["__at", "__kind", "__id"], "__state")
    return met.where("__kind = 1").select("__row.*", F.col("before").getField(value).alias(value))


def sequence_digest(lines: DataFrame, *, width: int = 64, last: int = 1024, levels: int | None = None) -> DataFrame:
    """lines, digest: one SHA-256 of all lines (line) in their order, with their counts, whatever the partitions.

    Equal lines are counted first. The sorted lines are cut after each whose own digest says so, about every width; each stretch has a
    digest, and these are cut and digested again until there are at most last. No key and no order is one task's work before that.
    levels: cut at most so often; with one, a last task joins a digest for each width of different lines, 65 bytes each."""
    counted = lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))
    now = stored(counted.select(F.col("line").alias("at"), F.sha2(F.concat_ws("|", "line", F.col("n").cast("string")), 256).alias("digest"), "n"))
    total = now.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lines"))
    now = now.select("at", "digest")
    while levels != 0 and now.count() > last:
        levels = levels and levels - 1
        ends = (F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % width == 0).cast("long")
        stretch = running_total(now.withColumn("all", F.lit(0)).withColumn("end", ends), "all", ["at"], "end")
        now = stored(stretch.groupBy("before").agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("digest")).select(F.col("before").alias("at"), "digest"))
    whole = now.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "digest"))), lambda x: x["digest"]), "\n"), 256).alias("digest"))
    return total.join(whole)


def quantile_by_index(rows: DataFrame, key: str, value: str, p: float) -> DataFrame:
    """key, q, n: the value at index int(p * (n - 1)) of the sorted values of a key, of n that aren't null.

    Equal values are counted before the shuffle, and what is left is numbered in ranges, so no key is one task's work."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count(F.lit(1)).alias("here"))
    ranked = running_total(counts, key, [value], "here")
    index = F.floor((F.col("total") - 1) * F.lit(p))
    return ranked.where((F.col("before") <= index) & (index < F.col("before") + F.col("here"))).select(key, F.col(value).alias("q"), F.col("total").alias("n"))
