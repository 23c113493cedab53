"""Exact dedup by a content sort, in DataFrame functions only.

Rows are range-partitioned by normalised content: Spark samples splitters of a short sort key (the first characters,
then a hash of both ends and the size, so that a common opening doesn't fill one range), equal texts get equal keys and
so one range, and external sorting by key and whole text places them next to each other. Neighbours are compared in
full, as groups of the window over the sorted rows; no further shuffle is needed. Whole texts are lower-cased and
digested once, after the shuffle; the sampling pass sees the short key only.

A key with more than 1/hot_share of all rows would fill one range. There are fewer than hot_share of those whatever the
input, so they are broadcast. Of their rows the whole text is digested (SHA-256): texts that are that frequent
themselves are aggregated before the shuffle instead of sorted, the others are told apart by one more part of the key.

Defined cases: a null text is an empty one; of equal texts the smallest (or largest) id stays, ids that are null come
last in either order; ids may be of any type that sorts. Of repeated rows with that id all say the same keep_id and one
is kept. Extra columns are not read by exact_dedup and kept by drop_exact_copies, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii, read, saved, translated

#: Keys and texts with more than one in so many rows (or in so many as there are partitions) count as hot.
HOT_SHARE = 1000
KEY_CHARS = 24


def _norm(text: Column) -> Column:
    return lower_ascii(F.coalesce(text, F.lit("")))


def _keyed(docs: DataFrame, id_col: str, text: str, keep_columns: bool) -> DataFrame:
    """doc_id, text and doc (a struct of the columns of docs, if wanted) with the sort key k1, k2; equal for texts equal but for case."""
    doc = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")] if keep_columns else []
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"), *doc)
    head, tail = (translated(F.substring("text", at, KEY_CHARS)) for at in (1, -KEY_CHARS))
    return rows.withColumns({"k1": head, "k2": F.xxhash64(head, tail, F.octet_length("text"))})


def _parts(docs: DataFrame, id_col: str, text: str, hot_share: int, keep_columns: bool) -> tuple[DataFrame, DataFrame | None]:
    """Rows to sort, with k1, k2, k3; and rows of hot texts, with text_sha256, if there are any."""
    spark = docs.sparkSession
    rows = _keyed(docs, id_col, text, keep_columns)
    least = docs.count() / max(hot_share, int(spark.conf.get("spark.sql.shuffle.partitions")))
    keys = saved(rows.groupBy("k2").count().where(F.col("count") > least).select("k2"))
    if keys.isEmpty():
        return rows.withColumn("k3", F.lit(0).cast("long")), None
    sha = F.sha2(_norm(F.col("text")), 256)
    known = F.broadcast(keys.withColumn("known", F.lit(True)))
    often = saved(rows.join(known, "k2").groupBy(sha.alias("text_sha256")).count().where(F.col("count") > least).select("text_sha256"))
    marked = rows.join(known, "k2", "left").withColumn("text_sha256", F.when(F.col("known"), sha)).drop("known")
    cold = marked.join(F.broadcast(often), "text_sha256", "left_anti").withColumn("k3", F.when(F.col("text_sha256").isNull(), 0).otherwise(F.xxhash64("text_sha256"))).drop("text_sha256")
    return cold, None if often.isEmpty() else rows.join(known, "k2").drop("known").withColumn("text_sha256", sha).join(F.broadcast(often), "text_sha256", "left_semi")


def _sorted(cold: DataFrame, keep: str, columns: list[str]) -> DataFrame:
    """columns of the rows, with keep_id, nth (from 1, the one that stays first), group_size and text_sha256."""
    parts = int(cold.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = cold.repartitionByRange(parts, "k1", "k2", "k3").withColumn("norm", _norm(F.col("text"))).drop("text")
    by = F.col("doc_id").asc_nulls_last() if keep == "min" else F.col("doc_id").desc_nulls_last()
    same = Window.partitionBy("k1", "k2", "k3", "norm").orderBy(by)
    whole = same.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    found = placed.withColumns({"nth": F.row_number().over(same), "keep_id": F.first("doc_id").over(whole), "group_size": F.count(F.lit(1)).over(whole)})
    return found.select(*columns, "keep_id", "nth", "group_size", F.sha2("norm", 256).alias("text_sha256"))


def _first(value: Column, keep: str, *ties: str) -> Column:
    """The value of the row that stays; null ids come last."""
    if keep == "min":
        return F.min_by(value, F.struct(F.col("doc_id").isNull(), "doc_id", *ties))
    return F.max_by(value, F.struct(F.col("doc_id").isNotNull(), "doc_id", *ties))


def exact_dedup(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: str = "min", hot_share: int = HOT_SHARE) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs. keep: min or max."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    cold, hot = _parts(docs, id_col, text, hot_share, False)
    names = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    done = _sorted(cold, keep, ["doc_id"]).withColumn("kept", F.col("nth") == 1).select(*names)
    if hot is None:
        return done
    # The number of a row is stored, so both sides of the join see the same.
    own = saved(hot.select("doc_id", "text_sha256", F.monotonically_increasing_id().alias("row")))
    groups = own.groupBy("text_sha256").agg(_first(F.col("doc_id"), keep).alias("keep_id"), _first(F.col("row"), keep, "row").alias("keep_row"), F.count(F.lit(1)).alias("group_size"))
    return done.unionByName(own.join(F.broadcast(saved(groups)), "text_sha256").withColumn("kept", F.col("row") == F.col("keep_row")).select(*names))


def drop_exact_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", keep: str = "min", hot_share: int = HOT_SHARE) -> DataFrame:
    """The rows of docs that stay, one of each group, with all their columns."""
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    cold, hot = _parts(docs, id_col, text, hot_share, True)
    stay = _sorted(cold, keep, ["doc"]).where("nth = 1").select("doc")
    if hot is not None:
        stay = stay.unionByName(hot.groupBy("text_sha256").agg(_first(F.col("doc"), keep).alias("doc")).select("doc"))
    return stay.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(read(spark, sf_dir, "documents"), keep="max")


OP5_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
