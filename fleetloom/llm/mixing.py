"""Mixing sources to target weights.

Words are summed by source, sources get targets by weight, none above a multiple of its size (the excess goes to the
others by weight until none is above), and a source's rate is target over size. A document is emitted floor(rate)
times plus one more with probability equal to the fraction, by a coin that a hash of seed, source, id and size throws:
reruns agree, and rows that are equal in all four share a coin.

The targets solve a water level: sources in order of (limit / weight) are full up to some point, the rest share what is
left by weight. All sums are of whole numbers, so every engine gets the same doubles.

Defined cases: a null text has no words; a null source is a source of its own, after all others; a null id hashes as
an empty string; sources without words have target 0 and rate 0. Extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_totals
from .common import WORD, read, saved

WEIGHTS = (5, 2, 1)
SEED = 17


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, limit: int = 2) -> DataFrame:
    """source, source_size, target of sizes (source, size). Sources may be as many as hosts: no task orders all of them."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.select("source", "source_size", F.lit(0).alias("all"), F.col("source").isNull().alias("none"), F.lit(1).cast("long").alias("one"))
    n = F.col("one_before") + 1
    ws = F.array(*[F.lit(w).cast("long") for w in weights])
    ranked = running_totals(per, "all", ["none", "source"], ["one"]).select("source", "source_size", "all", n.alias("n"), F.element_at(ws, F.pmod(n - 1, F.lit(len(weights))).cast("int") + 1).alias("w"))
    # Order of limit * size / w, made whole by all weights' product.
    product = math.prod(weights)
    leveled = ranked.withColumn("level", F.col("source_size") * F.lit(product) / F.col("w"))
    full = running_totals(leveled, "all", ["level", "n"], ["source_size", "w"])
    # Were this the first source that isn't full, it would get left * w / rest; the sums are in hundredths of words.
    left = F.col("source_size_total") * share_pct - F.col("source_size_before") * (limit * 100)
    rest = F.col("w_total") - F.col("w_before")
    fits = left * F.col("w") <= F.col("source_size") * (limit * 100) * rest
    first = full.agg(F.min(F.when(fits, F.struct("level", "n", left.alias("left"), rest.alias("rest")))).alias("f")).first()["f"]
    target = (F.col("source_size") * limit).cast("double")
    if first is not None:
        full_up = (F.col("level") < first["level"]) | ((F.col("level") == first["level"]) & (F.col("n") < first["n"]))
        shared = (F.lit(first["left"]) * F.col("w")).cast("double") / F.lit(first["rest"] * 100).cast("double")
        target = F.when(full_up, target).otherwise(shared)
    return full.select("source", "source_size", F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def coin(source: Column, doc_id: Column, size: Column, seed: int) -> Column:
    """A number from 0 to 1 from 52 bits of a hash."""
    key = F.concat_ws(":", F.lit(str(seed)), F.coalesce(source, F.lit("")), F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("long") / F.lit(float(2**52))


def mix_sources(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, share_pct: int = 150, limit: int = 2, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies of every row of docs."""
    sizes = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    targets = saved(source_targets(sizes, weights=weights, share_pct=share_pct, limit=limit)).withColumnRenamed("source", "of")
    joined = sizes.join(targets, F.col("source").eqNullSafe(F.col("of"))).drop("of")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor("rate").cast("long")
    extra = (coin(F.col("source"), F.col("doc_id"), F.col("size"), seed) < F.col("rate") - whole).cast("long")
    return joined.withColumn("rate", rate).select("doc_id", "source", "size", "source_size", "target", (whole + extra).alias("copies"))


def emit_copies(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", source: str = "source", seed: int = SEED, **options) -> DataFrame:
    """docs with each row repeated as the mix says, and the column copy, from 1, which replaces one of that name."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("own"), F.col(f"`{source}`").alias("source"), F.col(f"`{id_col}`").alias("doc_id"), word_count(F.col(f"`{text}`")).alias("size"))
    # A stored table, so that Spark knows its size when it plans: few sources are broadcast and no text is shuffled.
    rates = saved(source_targets(own.select("source", "size"), **options)).withColumnRenamed("source", "of")
    own = own.join(rates, F.col("source").eqNullSafe(F.col("of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    own = own.withColumn("rate", rate)
    own = own.withColumn("n", F.floor("rate").cast("int") + (coin(F.col("source"), F.col("doc_id"), F.col("size"), seed) < F.col("rate") - F.floor("rate")).cast("int"))
    kept = [F.col("own").getField(c).alias(c) for c in docs.columns if c.lower() != "copy"]
    return own.where("n > 0").select(*kept, F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix_sources(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP8_SQL = f"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS n FROM d GROUP BY source),
w AS (SELECT *, CASE (n - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(w) OVER () AS all_w, row_number() OVER q AS k,
  coalesce(sum(source_size) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS size_before,
  coalesce(sum(w) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS w_before
  FROM w WINDOW q AS (ORDER BY source_size * 10.0 / w, n)),
l AS (SELECT *, total * 150 - size_before * 200 AS lft, all_w - w_before AS rest FROM o),
f AS (SELECT k, lft, rest FROM l WHERE lft * w <= source_size * 200 * rest ORDER BY k LIMIT 1),
t AS (SELECT l.source, l.source_size, CASE WHEN l.source_size = 0 THEN 0.0 WHEN f.k IS NULL OR l.k < f.k THEN CAST(l.source_size * 2 AS DOUBLE)
  ELSE CAST(f.lft * l.w AS DOUBLE) / CAST(f.rest * 100 AS DOUBLE) END AS target FROM l LEFT JOIN f ON true),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(d.source, '') || ':' || coalesce(CAST(d.doc_id AS VARCHAR), '') || ':' || CAST(d.size AS VARCHAR)), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, CAST(target AS DOUBLE) AS target, CAST(size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM r
"""
