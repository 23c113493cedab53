"""Checks of a hash chain, without a fold: each row is compared with the one before."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def broken_links(sealed: DataFrame) -> DataFrame:
    """tenant, id of rows (tenant, id, line, prev, hash) whose hash doesn't cover its line, or that don't follow the row before."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("tenant").orderBy("id")), F.lit(""))
    right = (F.sha2(F.concat("prev", F.coalesce("line", F.lit(""))), 256) == F.col("hash")) & (F.col("prev") == F.col("__before"))
    return sealed.withColumn("__before", before).where(~F.coalesce(right, F.lit(False))).select("tenant", "id")
