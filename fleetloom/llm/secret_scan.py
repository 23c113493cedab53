"""Secret scans by an incremental blob ledger, in DataFrame functions only.

Each version of each path is addressed by the SHA-256 of its text. The ledger, a table in a shared folder, holds one
row for every blob and rule version that was scanned, with the spans found. A scan takes only pairs that the ledger
lacks, one copy of each blob, appends them, and joins the spans back to all paths. What is appended depends on blob and
rule version alone, so a pair that is there twice (a job that was run again, two scans at once) is read as one.

Defined cases: a null text is an empty one. A null path or repeated rows are kept as they are. A text without findings
has an empty list of spans. Extra columns of the input are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import join_by_key, read, saved, scratch_dir


@dataclass(frozen=True)
class Kind:
    name: str
    regex: str
    #: The group whose length counts (0: the match), and the least length.
    group: int
    least: int


#: Kinds of the contract, and those that this scanner adds.
ASSIGN = r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Kind("assign", ASSIGN, 2, 6), Kind("access", r"AKIA[A-Z0-9]+", 0, 20), Kind("hex", r"[0-9a-f]+", 0, 24))
ADDED = (Kind("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1), Kind("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40))
KINDS = BASE + ADDED
RULE_VERSION = "2"

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("rank", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("end", T.LongType())])


def _pieces(text: Column, kind: Kind) -> Column:
    """For each match: length of the text since the match before, of the match, and of what counts.

    The arrays are arguments of zip_with, not captured in its lambda, so each regular expression runs once a text.
    """
    m = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(0))
    g = F.regexp_extract_all(text, F.lit(kind.regex), F.lit(kind.group))
    sizes = F.zip_with(m, g, lambda a, b: F.struct(F.length(a).alias("len"), F.length(b).alias("counts")))
    return F.zip_with(F.split(text, kind.regex, -1), sizes, lambda gap, s: F.struct(F.length(gap).alias("gap"), s["len"].alias("len"), s["counts"].alias("counts")))


def scan_blobs(blobs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """sha, spans of the rows (sha, text) of blobs, of which each sha has one."""
    # A run shorter than least can't pass, so hex runs that short need no pieces at all.
    quick = {k.name: (f"{k.regex[:-1]}{{{k.least},}}" if k.name == "hex" else k.regex) for k in kinds}
    none = F.array().cast("array<struct<gap:int,len:int,counts:int>>")
    each = F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(k.name).alias("kind"), F.lit(k.least).alias("least"), F.when(F.col("text").rlike(quick[k.name]), _pieces(F.col("text"), k)).otherwise(none).alias("pieces")) for i, k in enumerate(kinds)])
    matches = (
        blobs.select("sha", F.explode(each).alias("k"))
        .where(F.size("k.pieces") > 0)
        .select("sha", "k.rank", "k.kind", "k.least", F.posexplode("k.pieces").alias("pos", "piece"))
    )
    so_far = Window.partitionBy("sha", "rank").orderBy("pos")
    spans = (
        matches.where("piece.len is not null")
        .withColumn("end", F.sum((F.col("piece.gap") + F.col("piece.len")).cast("long")).over(so_far))
        .where(F.col("piece.counts") >= F.col("least"))
        .select("sha", F.struct((F.col("end") - F.col("piece.len")).alias("start"), "rank", "kind", "end").alias("span"))
    )
    return spans.groupBy("sha").agg(F.array_sort(F.collect_list("span")).cast(T.ArrayType(SPAN)).alias("spans"))


def scan_versions(versions: DataFrame, ledger: str, *, path: str = "path", text: str = "text", kinds: tuple[Kind, ...] = KINDS, rule_version: str = RULE_VERSION) -> DataFrame:
    """path, sha, spans of every row of versions; the ledger gets the blobs it had not seen under this rule version."""
    spark = versions.sparkSession
    own = versions.select(F.col(path).alias("path"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    schema = T.StructType([T.StructField("sha", T.StringType()), T.StructField("rule_version", T.StringType()), T.StructField("spans", T.ArrayType(SPAN))])
    hashed = own.withColumn("sha", F.sha2(F.col("text"), 256))
    index = saved(hashed.select("path", "sha"))
    spark.createDataFrame([], schema).write.mode("append").parquet(ledger)  # so that it can be read
    known = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == rule_version).select("sha")
    # The files of the ledger as they are now: what another scan appends meanwhile is not seen, and does no harm.
    # One copy of each unseen blob; the partial aggregate keeps one of each before the shuffle.
    unseen = hashed.join(known, "sha", "left_anti").groupBy("sha").agg(F.first("text").alias("text"))
    found = scan_blobs(unseen, kinds)
    pending = scratch_dir(spark)
    found.write.parquet(pending)
    found = spark.read.schema(found.schema).parquet(pending)
    new = index.select("sha").distinct().join(known, "sha", "left_anti").join(found, "sha", "left")
    new.select("sha", F.lit(rule_version).alias("rule_version"), F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans")).write.mode("append").parquet(ledger)
    spans = spark.read.schema(schema).parquet(ledger).where(F.col("rule_version") == rule_version).select("sha", "spans").dropDuplicates(["sha"])
    return join_by_key(index, spans, "sha").select("path", "sha", "spans")


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_versions(read(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"), scratch_dir(spark) + "/ledger")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))
    return found.select(
        F.col("path").alias("doc_id"), count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(spans_text(base), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"),
    )


def _sql() -> str:
    parts = []
    for i, k in enumerate(KINDS):
        regex = k.regex.replace("'", "''")
        parts.append(f"""SELECT rid, {i} AS rank, '{k.name}' AS kind, {k.least} AS least, unnest(range(0, len(m))) AS pos, unnest(g) AS g, unnest(m) AS m, unnest(p[1:len(m)]) AS gap
        FROM (SELECT rid, regexp_extract_all(text, '{regex}', 0) AS m, regexp_extract_all(text, '{regex}', {k.group}) AS g, string_split_regex(text, '{regex}') AS p FROM d) WHERE len(m) > 0""")
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
x AS ({' UNION ALL '.join(parts)}),
e AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, rank ORDER BY pos) AS e FROM x),
s AS (SELECT rid, rank, kind, e - length(m) AS b, e, kind || ':' || CAST(e - length(m) AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS t FROM e WHERE length(g) >= least),
a AS (SELECT rid, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access, count(*) FILTER (WHERE rank = 2) AS n_hex,
  string_agg(t, ',' ORDER BY b, rank) FILTER (WHERE rank < 3) AS base, string_agg(t, ',' ORDER BY b, rank) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


OP3_SQL = _sql()
