"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import folder as scratch_dir
from ..sources.scratch import stored as saved

__all__ = ["LOWER", "UPPER", "WORD", "fresh", "join_by_key", "lower_ascii", "numbered", "read", "saved", "scratch_dir", "translated"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: A word, and the space between words, in the contracts of the operators.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def lower_ascii(c: Column) -> Column:
    """Lower-case A-Z only, whatever the locale. Of plain ASCII, lower() says the same and is sooner done."""
    return F.when(F.octet_length(c) == F.length(c), F.lower(c)).otherwise(translated(c))


def translated(c: Column) -> Column:
    """The same for short strings."""
    return F.translate(c, UPPER, LOWER)


def fresh(docs: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of docs has it."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(df: DataFrame, name: str) -> DataFrame:
    """df as a written table with a number of each row in column name: numbers made anew in each scan would follow the splits of that scan."""
    return saved(df.withColumn(name, F.monotonically_increasing_id()))


def join_by_key(left: DataFrame, right: DataFrame, key: str, how: str = "inner", share: int = 1000) -> DataFrame:
    """left with the columns of right, which has one row a key; left is a stored table. how: inner or left.

    Keys with more than one in share of the rows of left would fill a task of a shuffled join. There are fewer than share
    of them, so their rows of right are broadcast."""
    least = left.count() / share
    often = saved(left.groupBy(key).count().where(F.col("count") > least).select(key))
    if often.isEmpty():
        return left.join(right, key, how)
    few = saved(right.join(F.broadcast(often), key, "left_semi"))
    seldom = left.join(F.broadcast(often), key, "left_anti").join(right, key, how)
    return seldom.unionByName(left.join(F.broadcast(often), key, "left_semi").join(F.broadcast(few), key, how))
