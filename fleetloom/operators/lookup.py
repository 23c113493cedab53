"""Joins by range and nearness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

def range_lookup(rows: DataFrame, bands: DataFrame, at: Column, *, low: str, high: str, value: str, default) -> DataFrame:
    """Add value of the band with low <= at < high. Bands become one row for each whole number, so the join is an equality."""
    points = bands.select(F.explode(F.sequence(F.col(low), F.col(high) - 1)).alias("__at"), F.col(value)).groupBy("__at").agg(F.first(value).alias(value))
    return rows.withColumn("__at", at).join(points, "__at", "left").drop("__at").withColumn(value, F.coalesce(value, F.lit(default)))


def nearest_of(rows: DataFrame, centres: list[tuple[str, float, float]], *, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Add city, the first centre at the least squared distance in degrees. Few centres: an expression, no join."""
    ways = [F.struct((F.pow(F.col(lat) - a, 2) + F.pow(F.col(lon) - b, 2)).alias("d"), F.lit(i).alias("i"), F.lit(name).alias("city")) for i, (name, a, b) in enumerate(centres)]
    return rows.withColumn("city", F.least(*ways)["city"])


def overlaps(left: DataFrame, right: DataFrame, key: str, width: int) -> DataFrame:
    """key, id, rid, overlap of intervals of left (key, id, a, b) and right (the same columns) that overlap, each pair once.

    Intervals are sent to the stretches of width that they touch, so the join is an equality of key and stretch: a key with
    a long history isn't squared. width: about the usual length of an interval."""
    first = lambda c: F.floor(F.col(c) / width)
    spread = lambda df: df.where("a < b").select(key, "id", "a", "b", F.explode(F.sequence(first("a"), F.floor((F.col("b") - 1) / width))).alias("__at"))
    r = spread(right).select(key, "__at", F.col("id").alias("rid"), F.col("a").alias("ra"), F.col("b").alias("rb"))
    met = spread(left).join(r, [key, "__at"]).where((F.col("a") < F.col("rb")) & (F.col("ra") < F.col("b")) & (F.col("__at") == F.greatest(first("a"), first("ra"))))
    return met.select(key, "id", "rid", "a", "b", (F.least("b", "rb") - F.greatest("a", "ra")).alias("overlap"))
