"""Tables in the shared folder, written to cut lineage."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


PACKED = "spark.sql.sources.fileCompressionFactor"


def _base(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}"


def folder(spark: SparkSession) -> str:
    """A new folder of this application below ``spark.checkpoint.dir``; where that is unset, on one machine only, below the warehouse."""
    return f"{_base(spark)}/{uuid.uuid4().hex}"


def stored(rows: DataFrame, path: str | None = None) -> DataFrame:
    """Write rows and read them again, so that lost executors cost a read and no recomputation.

    The optimiser takes the size of files for that of rows. Numbers that are packed well are many times as large in memory, so where the
    session has no factor of its own it gets one: else tables that don't fit the driver would be broadcast."""
    spark = rows.sparkSession
    path = path or folder(spark)
    if float(spark.conf.get(PACKED, "1.0")) == 1.0:
        spark.conf.set(PACKED, "4.0")
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Delete all that this application has stored here; call it when no result that reads these tables is needed any more."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_base(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
