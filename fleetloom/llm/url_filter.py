"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a host-and-path rule ("example.com/en/7": the host and its subdomains, paths that start so; the longest
fitting rule wins) or a pattern in the usual filter-list style (``||`` label of a host, ``|`` end of the URL, ``*``
anything, ``^`` a separator). Each rule is stored under that of its whole literal tokens which the fewest URLs hold;
a URL's own tokens fetch candidates, and only their regular expressions run. Rules without a whole token are
candidates of every URL.

Defined cases: a null URL or one without "://" has empty host and path, fits no rule and gets the default verdict.
Repeated rows give repeated results; of rules of equal rank and name the first decides. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lower_ascii, read, saved

TOKEN = r"[a-z0-9]+"
#: At most so many rules are broadcast at once (about 0.5 KB a rule).
MAX_BROADCAST_RULES = 100_000
RANKED = "struct<host_rule: long, first: long, second: long, name: string, verdict: string>"


@dataclass(frozen=True)
class Rule:
    name: str
    verdict: str
    #: Larger wins. Rules on a host and path come before patterns, and the longest before shorter ones.
    rank: tuple
    regex: str
    tokens: tuple

    @property
    def is_host(self) -> bool:
        return self.rank[0] == 1


def whole_tokens(literal: str, open_left: bool, open_right: bool) -> list[str]:
    """Tokens of a literal that are a whole token of each URL that holds it."""
    low = re.sub("[A-Z]", lambda m: m[0].lower(), literal)
    return [m[0] for m in re.finditer(TOKEN, low) if not (open_left and m.start() == 0) and not (open_right and m.end() == len(low))]


def host_rule(host: str, path: str, verdict: str) -> Rule:
    """A rule without a path is for the whole host, whatever follows it."""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    name, end = host + path, "" if path else r"(?=[/?#]|\Z)"
    return Rule(name, verdict, (1, len(name), len(host), name), rf"^(?:[^/?#]*\.)?{re.escape(host)}{re.escape(path)}{end}", tuple(whole_tokens(name, False, bool(path))))


def pattern_rule(pattern: str, verdict: str) -> Rule:
    body, regex, tokens = pattern, "", []
    label, end = body.startswith("||"), body.endswith("|")
    body = body[2:] if label else body
    body = body[:-1] if end else body
    pieces = re.split(r"([*^])", body)
    for i, piece in enumerate(pieces):
        if piece == "*":
            regex += ".*"
        elif piece == "^":
            regex += r"(?:[^A-Za-z0-9_.%-]|\Z)"
        elif piece:
            left = pieces[i - 1] if i else "||" if label else "*"
            right = pieces[i + 1] if i + 1 < len(pieces) else "|" if end else "*"
            regex += re.escape(piece)
            tokens += whole_tokens(piece, left == "*", right == "*")
    regex = (r"^[^/?#]*?(?<![^.])" if label else "") + regex + (r"\Z" if end else "")
    return Rule(pattern, verdict, (0, int(verdict == "allow"), len(pattern), pattern), regex, tuple(tokens))


#: The contract's rules, as (host, path, verdict).
HOST_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Patterns for URLs that no host rule fits. An allowing pattern comes before a blocking one.
PATTERNS = [("||spam-farm.", "block"), ("||cheap-pills.", "block"), ("/fr/6*.html", "block"), ("^ref=x|", "block"), ("||m.", "allow")]


def default_rules() -> list[Rule]:
    return [host_rule(*r) for r in HOST_RULES] + [pattern_rule(*p) for p in PATTERNS]


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and the subject that rules are matched with: all after the first "://", its host in lower case."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substr({0}, instr({0}, '://') + 3)".format("__url"))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.concat(host, F.regexp_extract(rest, r"(?s)^[^/?#]*(.*)", 1))


def tokens_of(subject: Column) -> Column:
    return F.regexp_extract_all(lower_ascii(subject), F.lit(f"({TOKEN})"), F.lit(1))


def index_rules(subjects: DataFrame, rules: list[Rule]) -> dict[str | None, list[int]]:
    """Rule numbers by their rarest token, by counts over all URLs. What comes to the driver is bounded by the rules."""
    spark = subjects.sparkSession
    names = sorted({t for r in rules for t in r.tokens})
    counts: dict[str, int] = {}
    if names:
        wanted = spark.createDataFrame([(t,) for t in names], "token string")
        found = subjects.select(F.explode(F.array_distinct(tokens_of(F.col("subject")))).alias("token")).groupBy("token").count()
        counts = {r["token"]: r["count"] for r in found.join(wanted, "token", "left_semi").collect()}
    index: dict[str | None, list[int]] = {}
    for i, r in enumerate(rules):
        index.setdefault(min(r.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)) if r.tokens else None, []).append(i)
    return index


def _judge(rules: list[Rule], index: dict, subject: str, compiled: dict) -> tuple:
    """Rank (three numbers), name and verdict of the rule that decides, nulls if none fits."""
    wanted = set(re.findall(TOKEN, re.sub("[A-Z]", lambda m: m[0].lower(), subject)))
    best = None
    for token in (None, *wanted):
        for i in index.get(token, ()):
            if best is None or rules[i].rank > best.rank:
                if i not in compiled:
                    compiled[i] = re.compile(rules[i].regex, re.S)
                if compiled[i].search(subject):
                    best = rules[i]
    return (None,) * 5 if best is None else (*best.rank, best.verdict)


def _judged(parts: DataFrame, rules: list[Rule], index: dict) -> DataFrame:
    """parts with the better of its best rule so far and of that of a block of rules."""
    shared = parts.sparkSession.sparkContext.broadcast((rules, index))

    @F.pandas_udf(RANKED)
    def judge(subjects: pd.Series) -> pd.DataFrame:
        compiled: dict = {}
        found = [_judge(*shared.value, s, compiled) for s in subjects]
        return pd.DataFrame(found, columns=["host_rule", "first", "second", "name", "verdict"]).astype({c: "Int64" for c in ("host_rule", "first", "second")})

    rank = lambda c: F.struct(*[F.col(f"{c}.{f}") for f in ("host_rule", "first", "second", "name")])
    now = parts.withColumn("now", judge("subject"))
    better = F.col("best.name").isNull() | (F.col("now.name").isNotNull() & (rank("now") > rank("best")))
    return now.withColumn("best", F.when(better, F.col("now")).otherwise(F.col("best"))).drop("now")


def filter_urls(pages: DataFrame, rules: Iterable[Rule] | None = None, *, url: str = "url", default: str = "allow", max_broadcast: int = MAX_BROADCAST_RULES) -> DataFrame:
    """Add host, path, rule (of the host rule that decides, else null), pattern (likewise) and verdict to pages.

    Columns of pages with these names, in either case, are replaced. Rules are broadcast in blocks of max_broadcast; each block is judged
    by the same function, and the best rule of all blocks decides, so the blocks don't show in the result."""
    rules = list(default_rules() if rules is None else rules)
    own = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("own"), F.col(f"`{url}`").alias("__url"))
    host, path, subject = url_parts(F.col("__url"))
    parts = own.select("own", host.alias("host"), path.alias("path"), subject.alias("subject"), F.lit(None).cast(RANKED).alias("best"))
    index = index_rules(parts.select("subject"), rules)
    step = max(1, max_broadcast)
    for at in range(0, len(rules), step):
        block = rules[at : at + step]
        mine = {t: [i - at for i in ids if at <= i < at + len(block)] for t, ids in index.items()}
        parts = _judged(parts if not at else saved(parts), block, {t: ids for t, ids in mine.items() if ids})
    is_host = F.col("best.host_rule") == 1
    return parts.select(
        *[F.col("own").getField(c).alias(c) for c in pages.columns if c.lower() not in ("host", "path", "rule", "pattern", "verdict")],
        "host", "path", F.when(is_host, F.col("best.name")).alias("rule"), F.when(~is_host, F.col("best.name")).alias("pattern"),
        F.coalesce(F.col("best.verdict"), F.lit(default)).alias("verdict"),
    )


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(read(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


OP2_SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
         regexp_extract(rest, '^[^/?#]*(.*)', 1, 's') AS tail FROM u
), r AS (
  SELECT *, CASE
    WHEN regexp_matches(host, '(^|\.)example\.com$') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN regexp_matches(host, '(^|\.)example\.net$') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN regexp_matches(host, '(^|\.)com$') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN regexp_matches(host, '(^|\.)net$') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN regexp_matches(host, '(^|\.)org$') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
  CASE
    WHEN regexp_matches(host, '(^|\.)m\.') THEN '||m.'
    WHEN regexp_matches(host, '(^|\.)cheap-pills\.') THEN '||cheap-pills.'
    WHEN regexp_matches(host, '(^|\.)spam-farm\.') THEN '||spam-farm.'
    WHEN regexp_matches(host || tail, '/fr/6.*\.html', 's') THEN '/fr/6*.html'
    WHEN regexp_matches(host || tail, '[^A-Za-z0-9_.%-]ref=x$') THEN '^ref=x|' END AS hit FROM p
)
SELECT page_id, host, path, rule, CASE WHEN rule IS NULL THEN hit END AS pattern,
       CASE WHEN rule IN ('com/en/', 'example.net/de/8', 'org/es/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN hit = '||m.' OR hit IS NULL THEN 'allow' ELSE 'block' END AS verdict FROM r
"""
