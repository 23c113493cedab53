"""Text files of records, sources that Spark makes up, and tables in parts by month."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def write_records(rows: DataFrame, path: str, kind: str) -> None:
    """Write rows as text, a record a line. kind: csv (with a header) or json."""
    if kind not in ("csv", "json"):
        raise ValueError("kind is csv or json")
    out = rows.write.mode("overwrite").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    out.option("header", True).csv(path) if kind == "csv" else out.json(path)


def read_records(spark: SparkSession, path: str, kind: str, schema: StructType | str) -> DataFrame:
    """Read them with a schema, never a guessed one; a record that doesn't fit fails the read."""
    if kind not in ("csv", "json"):
        raise ValueError("kind is csv or json")
    read = spark.read.schema(schema).option("mode", "FAILFAST").option("timestampNTZFormat", "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")
    return read.option("header", True).csv(path) if kind == "csv" else read.json(path)


def series(rows: DataFrame, name: str, first: int, last: int) -> DataFrame:
    """rows, each once for every whole number from first to last, in the column name: no join."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(first).cast("long"), F.lit(last).cast("long"))))


def made_up_history(spark: SparkSession, vehicles: int, samples: int, *, every_s: int = 61, tenants: int = 50, start: str = "2025-01-01 00:00:00") -> DataFrame:
    """tenant, vin, ts, seq, soc, speed, odo, event_date: smooth telemetry of vehicles, samples each, for measurements. A tenant's vehicles are neighbours."""
    n = F.col("id")
    vin, seq = F.floor(n / samples), n % samples
    ts = F.timestamp_seconds(F.unix_timestamp(F.lit(start)) + seq * every_s)
    soc = F.lit(95.0) - (seq % 280) * 0.3 + (vin % 7) * 0.5
    speed = F.greatest(F.lit(0.0), F.sin(seq / 20.0 + vin % 13) * 60 + 25)
    return spark.range(vehicles * samples).select(
        F.floor(vin * tenants / vehicles).cast("int").alias("tenant"), vin.alias("vin"), ts.alias("ts"), (seq + 1).alias("seq"), soc.cast("float").alias("soc"),
        speed.cast("float").alias("speed"), (seq * 0.4 + vin % 1000).cast("float").alias("odo"), F.to_date(ts).alias("event_date"),
    )


def store_history(rows: DataFrame, path: str, parts: int) -> None:
    """Telemetry in parts by day, sorted by tenant, vehicle and time, so that filters on these skip parts, row groups and pages."""
    placed = rows.repartitionByRange(parts, "event_date", "tenant", "vin").sortWithinPartitions("event_date", "tenant", "vin", "ts", "seq")
    placed.write.mode("overwrite").partitionBy("event_date").option("parquet.block.size", 16 << 20).option("compression", "zstd").parquet(path)


def store_by_month(rows: DataFrame, at: str, path: str) -> None:
    """rows in a part a month, in the column month (2024-05); a month with many rows takes many files."""
    month = F.date_format(F.col(at).cast("timestamp"), "yyyy-MM")
    rows.withColumn("month", month).write.mode("overwrite").partitionBy("month").parquet(path)


def months(spark: SparkSession, path: str, condition: Column) -> DataFrame:
    """The rows of such a table in the months that fit; the files of others aren't read."""
    return spark.read.parquet(path).where(condition)


def refresh_months(rows: DataFrame, at: str, path: str) -> None:
    """Replace the months that rows have in such a table; other months stay as they are."""
    month = F.date_format(F.col(at).cast("timestamp"), "yyyy-MM")
    rows.withColumn("month", month).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)


def load(tables: dict[str, DataFrame], path: str, *, reset: bool = False) -> None:
    """Write tables below path, a folder each; with reset in place of what is there, else beside it."""
    for name, rows in tables.items():
        rows.write.mode("overwrite" if reset else "append").parquet(f"{path}/{name}")
