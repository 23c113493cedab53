"""Personal data by bootstrapped contextual extraction, in DataFrame functions only.

Base kinds (email, ip, card, phone) are found by regular expressions and checks; they are the seeds. Each seed, and each other token
with a digit in it, occurs between words: the two before it make one lexical pattern, the two after it another. Patterns and
instances (the strings) form a graph, an edge for each pair however often it occurs, so copies of a text add nothing. Scores, in
thousandths, start at 1000 for seeds and 0 for all others; each round a pattern gets the mean of its instances, if enough of them
are known, else 0, and an instance that is no seed the mean of its patterns. Instances that reach the least score are identifiers
the regular expressions don't know: each of their occurrences is a span of kind found. Whole numbers throughout, so reruns agree.

Regular expressions are written so that they neither recurse nor go back over what they have read: a text of one long
run of digits or letters costs its length.

Defined cases: a null text is an empty one. Null and repeated ids are kept, each row by itself. A context ends at the match of the same
kind before or after, at 40 characters, or where the text does; without two words it is no pattern. Strings over 64 characters
and tokens of under 5 are spans if a base kind says so, but no instances. Extra columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import join_by_key, read, saved, translated

#: Digits of a card or phone number, and how far contexts and instances go.
CARD, PHONE, CONTEXT, LEAST_TOKEN, MOST_TOKEN = (14, 19), (10, 15), 40, 5, 64
#: Rounds of scores; known instances that a pattern needs; the score from which an instance is known.
ROUNDS, SUPPORT, KNOWN = 3, 3, 600

BYTE = "0*([0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])"
SPACE = r"[\x20\x09-\x0D]"
WORDS = r"[^\x20\x09-\x0D]+"
TOKEN = "A-Za-z0-9@._%+-"


@dataclass(frozen=True)
class Kind:
    name: str
    #: As the contract has it, and the same matches without going back.
    plain: str
    quick: str
    #: What a text has that has a match.
    needs: str


KINDS = (
    Kind("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    Kind("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "[0-9][.][0-9]"),
    Kind("card", r"[0-9]([\x20-]?[0-9])+", r"[0-9]++(?:[\x20-][0-9]++)*+", r"[0-9](?:[\x20-]?[0-9]){13}"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]", "[+]"),
    Kind("found", r"[A-Za-z@._%+-]*[0-9][A-Za-z0-9@._%+-]*", rf"(?<![{TOKEN}])[A-Za-z@._%+-]*+[0-9][{TOKEN}]*+", "[0-9]"),
)
FOUND = len(KINDS) - 1


def luhn(digits: Column) -> Column:
    """Whether digits, of bounded length, pass Luhn's check."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + v) % 10 == 0


def _passes(kind: Kind, m: Column) -> Column:
    if kind.name == "email":
        return F.lit(True)
    if kind.name == "ip":
        return m.rlike(rf"\A{BYTE}(\.{BYTE}){{3}}\z")
    if kind.name == "found":
        return F.length(m).between(LEAST_TOKEN, MOST_TOKEN)
    digits = F.regexp_replace(m, "[^0-9]", "")
    if kind.name == "phone":
        return F.length(digits).between(*PHONE)
    return F.when(F.length(m) < 2 * CARD[1], F.length(digits).between(*CARD) & luhn(digits)).otherwise(False)


def _context(text: Column, before: bool) -> Column:
    """The two words next to a match, in the text before or after it."""
    two = f"{WORDS}{SPACE}+{WORDS}"
    return F.regexp_extract(text, rf"({two}){SPACE}*\z" if before else rf"\A{SPACE}*({two})", 1)


def occurrences(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """row, doc_id, rank, start, end, string, left, right of every match that passes; a stored table, with a row of null rank for each row of docs."""
    t = F.col("t")
    none = F.array().cast("array<struct<gap:int,len:int,ok:boolean,string:string,left:string,right:string>>")

    def pieces(kind: Kind) -> Column:
        gaps, found = F.split(t, kind.quick, -1), F.regexp_extract_all(t, F.lit(kind.quick), F.lit(0))
        around = F.zip_with(gaps, F.slice(F.split(t, kind.quick, -1), 2, 2**31 - 1), lambda g, after: F.struct(F.length(g).alias("gap"), F.right(g, F.lit(CONTEXT)).alias("before"), F.left(after, F.lit(CONTEXT)).alias("after")))
        each = F.zip_with(around, found, lambda a, m: F.struct(a["gap"].alias("gap"), F.length(m).alias("len"), F.coalesce(_passes(kind, m), F.lit(False)).alias("ok"), F.when(F.length(m) <= MOST_TOKEN, m).alias("string"), a["before"].alias("left"), a["after"].alias("right")))
        return F.when(t.rlike(kind.needs), F.filter(each, lambda p: p["len"].isNotNull())).otherwise(none)

    kinds = F.array(F.struct(F.lit(None).cast("int").alias("rank"), F.array(F.struct(*[F.lit(None).cast(c).alias(n) for n, c in (("gap", "int"), ("len", "int"), ("ok", "boolean"), ("string", "string"), ("left", "string"), ("right", "string"))])).alias("pieces")), *[F.struct(F.lit(i).alias("rank"), pieces(k).alias("pieces")) for i, k in enumerate(KINDS)])
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    matches = saved(rows.select("row", "doc_id", F.explode(kinds).alias("k")).where(F.size("k.pieces") > 0).select("row", "doc_id", "k.rank", F.posexplode("k.pieces").alias("pos", "p")).select("row", "doc_id", "rank", "pos", "p.*"))
    end = F.sum((F.col("gap") + F.col("len")).cast("long")).over(Window.partitionBy("row", "rank").orderBy("pos"))
    spans = matches.where("rank IS NOT NULL").withColumn("end", end).where("ok")
    spans = spans.select("row", "doc_id", "rank", (F.col("end") - F.col("len")).alias("start"), "end", "string", _context(F.col("left"), True).alias("left"), _context(F.col("right"), False).alias("right"))
    ids = matches.where("rank IS NULL").select("row", "doc_id", *[F.lit(None).cast(c).alias(n) for n, c in (("rank", "int"), ("start", "long"), ("end", "long"), ("string", "string"), ("left", "string"), ("right", "string"))])
    # A token that a base span touches is not another instance.
    by = Window.partitionBy("row").orderBy("start", "rank")
    base = F.col("rank") < FOUND
    reached = F.max(F.when(base, F.col("end"))).over(by.rowsBetween(Window.unboundedPreceding, -1))
    # From the end, as a frame to the end of the rows would be read anew for each row.
    following = F.min(F.when(base, F.col("start"))).over(Window.partitionBy("row").orderBy(F.col("start").desc(), F.col("rank").desc()).rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumns({"reached": reached, "following": following})
    return saved(spans.where(base | (F.coalesce(F.col("reached") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("following") >= F.col("end"), F.lit(True)))).drop("reached", "following").unionByName(ids))


def instance_scores(found: DataFrame, *, rounds: int = ROUNDS, support: int = SUPPORT, known: int = KNOWN) -> DataFrame:
    """string, score of the instances that are no seeds and share a pattern with one; found: rank, string, left, right."""
    sides = F.array(F.struct(F.lit("<").alias("side"), F.col("left").alias("words")), F.struct(F.lit(">").alias("side"), F.col("right").alias("words")))
    edges = found.where("rank IS NOT NULL AND string IS NOT NULL").select(translated(F.col("string")).alias("string"), (F.col("rank") < FOUND).alias("seed"), F.explode(sides).alias("p")).where("p.words <> ''")
    edges = edges.groupBy("string", F.concat("p.side", translated(F.col("p.words"))).alias("pattern")).agg(F.max("seed").alias("seed"))
    seeds = edges.groupBy("string").agg(F.max("seed").alias("seed"))
    edges = saved(join_by_key(saved(edges.drop("seed")), seeds, "string"))
    # Other instances reach a pattern only through seeds: without support by them it is 0 in the first round.
    scores = saved(seeds.select("string", "seed", F.when(F.col("seed"), 1000).otherwise(0).cast("long").alias("score")))
    for _ in range(rounds):
        patterns = join_by_key(edges.select("string", "pattern"), scores.select("string", "score"), "string").groupBy("pattern").agg(F.sum("score").alias("sum"), F.count(F.lit(1)).alias("n"), F.sum((F.col("score") >= known).cast("long")).alias("known"))
        patterns = saved(patterns.select("pattern", F.when(F.col("known") >= support, F.expr("sum div n")).otherwise(0).cast("long").alias("of")))
        means = join_by_key(edges, patterns, "pattern").groupBy("string").agg(F.max("seed").alias("seed"), F.sum("of").alias("sum"), F.count(F.lit(1)).alias("n"))
        scores = saved(means.select("string", "seed", F.when(F.col("seed"), 1000).otherwise(F.expr("sum div n")).cast("long").alias("score")))
    return scores.where("NOT seed AND score > 0").select("string", "score")


def find_private(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", known: int = KNOWN, **options) -> DataFrame:
    """doc_id, spans (start, rank, kind, end; sorted) of every row of docs, the kinds as in KINDS."""
    found = occurrences(docs, id_col=id_col, text=text)
    new = saved(instance_scores(found, known=known, **options).where(F.col("score") >= known).select("string").withColumn("is_new", F.lit(True)))
    others = saved(found.where(F.col("rank") == FOUND).withColumn("string", translated(F.col("string"))))
    added = join_by_key(others, new, "string").select("row", "doc_id", "rank", "start", "end")
    spans = found.where(F.col("rank").isNull() | (F.col("rank") < FOUND)).select("row", "doc_id", "rank", "start", "end").unionByName(added)
    names = F.array(*[F.lit(k.name) for k in KINDS])
    span = F.when(F.col("rank").isNotNull(), F.struct("start", "rank", F.element_at(names, F.col("rank") + 1).alias("kind"), "end"))
    return spans.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.array_sort(F.collect_list(span)).alias("spans")).select("doc_id", "spans")


def op13_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_private(read(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["rank"] < FOUND)
    return found.select("doc_id", *[count(k.name).alias(f"n_{k.name}") for k in KINDS[:FOUND]], F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))


def _sql() -> str:
    lower = lambda x: f"translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = f"""list_sum(list_transform(string_split(reverse({digits}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INT) ELSE CAST(c AS INT) * 2 - CASE WHEN CAST(c AS INT) > 4 THEN 9 ELSE 0 END END)) % 10 = 0"""
    passes = {
        "email": "true", "ip": rf"regexp_matches(m, '\A{BYTE}(\.{BYTE}){{3}}\z')", "card": f"length({digits}) BETWEEN {CARD[0]} AND {CARD[1]} AND {luhn}",
        "phone": f"length({digits}) BETWEEN {PHONE[0]} AND {PHONE[1]}", "found": f"length(m) BETWEEN {LEAST_TOKEN} AND {MOST_TOKEN}",
    }
    two = f"{WORDS}{SPACE}+{WORDS}"
    parts = " UNION ALL ".join(
        f"""SELECT rid, {i} AS rank, pos, m, gap, after, {passes[k.name]} AS ok FROM (SELECT rid, unnest(range(0, len(m))) AS pos, unnest(m) AS m, unnest(p[1:len(m)]) AS gap, unnest(p[2:]) AS after
        FROM (SELECT rid, regexp_extract_all(t, '{k.plain}', 0) AS m, string_split_regex(t, '{k.plain}') AS p FROM d) WHERE len(m) > 0)""" for i, k in enumerate(KINDS)
    )
    rounds = ""
    for r in range(ROUNDS):
        rounds += f"""
p{r} AS MATERIALIZED (SELECT pattern, CASE WHEN count(*) FILTER (WHERE score >= {KNOWN}) >= {SUPPORT} THEN sum(score) // count(*) ELSE 0 END AS c FROM e JOIN s{r} USING (string) GROUP BY pattern),
s{r + 1} AS MATERIALIZED (SELECT string, seed, CASE WHEN seed THEN 1000 ELSE sum(c) // count(*) END AS score FROM e JOIN p{r} USING (pattern) JOIN s{r} USING (string) GROUP BY string, seed),"""
    return rf"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
x AS ({parts}),
y AS (SELECT *, sum(length(gap) + length(m)) OVER (PARTITION BY rid, rank ORDER BY pos) AS e FROM x),
z AS (SELECT rid, rank, e - length(m) AS b, e, m, regexp_extract(right(gap, {CONTEXT}), '({two}){SPACE}*\z', 1) AS l, regexp_extract(left(after, {CONTEXT}), '\A{SPACE}*({two})', 1) AS r FROM y WHERE ok),
w AS (SELECT *, max(CASE WHEN rank < {FOUND} THEN e END) OVER (PARTITION BY rid ORDER BY b, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached, min(CASE WHEN rank < {FOUND} THEN b END) OVER (PARTITION BY rid ORDER BY b, rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS nxt FROM z),
o AS MATERIALIZED (SELECT rid, rank, b, e, {lower('m')} AS string, length(m) <= {MOST_TOKEN} AS fits, l, r FROM w WHERE rank < {FOUND} OR (coalesce(reached <= b, true) AND coalesce(nxt >= e, true))),
g AS (SELECT string, rank < {FOUND} AS seed, '<' || {lower('l')} AS pattern FROM o WHERE fits AND l <> '' UNION ALL SELECT string, rank < {FOUND}, '>' || {lower('r')} FROM o WHERE fits AND r <> ''),
e AS MATERIALIZED (SELECT DISTINCT string, pattern FROM g),
s0 AS MATERIALIZED (SELECT string, bool_or(seed) AS seed, CASE WHEN bool_or(seed) THEN 1000 ELSE 0 END AS score FROM g GROUP BY string),{rounds}
k AS (SELECT rid, b, rank, e, ['{"', '".join(k.name for k in KINDS)}'][rank + 1] || ':' || CAST(b AS VARCHAR) || ':' || CAST(e AS VARCHAR) AS t FROM o WHERE rank < {FOUND} OR string IN (SELECT string FROM s{ROUNDS} WHERE NOT seed AND score >= {KNOWN})),
a AS (SELECT rid, {', '.join(f"count(*) FILTER (WHERE rank = {i}) AS n_{k.name}" for i, k in enumerate(KINDS[:FOUND]))},
  string_agg(t, ',' ORDER BY b, rank) FILTER (WHERE rank < {FOUND}) AS base, string_agg(t, ',' ORDER BY b, rank) AS spans FROM k GROUP BY rid)
SELECT doc_id, {', '.join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS[:FOUND])}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN a USING (rid)
"""


OP13_SQL = _sql()
