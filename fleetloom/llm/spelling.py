"""Spelling variants by reduced-alphabet generation.

Letters are hashed to a few symbols, so a word of the vocabulary becomes a reduced word, and many words may share one. Each
distinct reduced word generates its full one-edit neighbourhood; the neighbourhood is joined to the reduced vocabulary.
Words one edit apart have reduced words that are equal or one edit apart, so no pair is lost; what is joined is verified on the
words themselves. Symbols are as many as give the shortest words about as many reduced words as there are words, so
what a reduced word meets by chance doesn't grow with the vocabulary.

A neighbourhood is given out as hashes of its members: polynomial, so those of all edits of a word follow from its prefixes and
suffixes, in a time that grows with the word's length and not with its square. A clash of hashes costs a comparison. Both
neighbourhood and edit are symmetric: only members with hashes above the word's own are shuffled.

Defined cases: a null text has no words, a null id is written as an empty one. Repeated rows count again. Extra columns are not
read. Words of any length are handled alike.
"""

from __future__ import annotations

import math
import sys
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_by_key, lower_ascii, read, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A letter of a word once A-Z are lower-cased, and all of them.
LETTER = "[a-zÀ-ÿ]"
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xC0, 0x100))]
LEAST_SYMBOLS, MOST_SYMBOLS = 4, 32
#: Multiplier of the polynomial hash, modulo 2^64; any odd number with well mixed bits.
BASE = np.uint64(0x9E3779B97F4A7C15)
#: Hashes that are given out at once.
HELD = 1 << 18


def words(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", least: int = 7, every: int = 31) -> DataFrame:
    """word, n: the words of at least so many code points, with one code point left out of those runs that every divides."""
    run = F.col("run")
    runs = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(lower_ascii(F.col(text)), F.lit(f"{LETTER}{{{least},}}"), F.lit(0))).alias("run"))
    h = F.crc32(F.concat("id", F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    word = F.when(F.col("h") % every == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.length(run)))).otherwise(run)
    found = runs.select("run", h.alias("h")).select(word.alias("word"))
    return found.where(F.length("word") >= least).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def symbols_for(words: int, least: int) -> int:
    return min(MOST_SYMBOLS, max(LEAST_SYMBOLS, math.ceil(max(1, words) ** (1 / least))))


def reduced(word: Column, symbols: int) -> Column:
    """word with each letter as one of so many symbols, from the letter "A" on."""
    return F.translate(word, "".join(LETTERS), "".join(chr(65 + zlib.crc32(c.encode()) % symbols) for c in LETTERS))


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(n, BASE, np.uint64), dtype=np.uint64)])


def neighbourhood(word: str, symbols: int) -> tuple[int, np.ndarray]:
    """Hash of a reduced word; hashes of it and of all words one edit away over its alphabet, each once, as signed numbers."""
    d = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.uint64) - np.uint64(64)  # 1 and up, so that lengths tell apart
    n = len(d)
    power = _powers(n + 1)
    with np.errstate(over="ignore"):
        weighted = d * power[:n][::-1]
        after = np.concatenate([np.cumsum(weighted[::-1], dtype=np.uint64)[::-1], np.zeros(1, np.uint64)])  # hash of each suffix
        whole = after[0]
        before = whole - after  # of each prefix, in its place
        some = np.arange(1, symbols + 1, dtype=np.uint64)[:, None]
        replaced = whole - weighted + some * power[:n][::-1]
        # A prefix moves down by one place if a letter goes, and up if one comes.
        left_out = _moved(d, power, n) + after[1:]
        put_in = before * BASE + some * power[: n + 1][::-1] + after
    keys = np.unique(np.concatenate([replaced.reshape(-1), left_out, put_in.reshape(-1), [whole]]).view(np.int64))
    return int(np.array([whole], np.uint64).view(np.int64)[0]), keys


def _moved(d: np.ndarray, power: np.ndarray, n: int) -> np.ndarray:
    """For each i, the hash of the letters before i in a word that has lost letter i."""
    with np.errstate(over="ignore"):
        lower = d[: n - 1] * power[: max(0, n - 1)][::-1]
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(lower, dtype=np.uint64)])[:n]


def near_words(vocabulary: DataFrame, *, least: int = 7) -> DataFrame:
    """a, an, b, bn: each pair of vocabulary (word, n) one inserted, deleted or replaced code point apart, once."""
    vocabulary = saved(vocabulary.select("word", "n"))
    symbols = symbols_for(vocabulary.count(), least)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, keys, held = [], [], 0
            for word in batch.column(0).to_pylist():
                h, found = neighbourhood(word, symbols)
                found = found[found >= h]
                own.append(np.full(len(found), h))
                keys.append(found)
                held += len(found)
                if held > HELD:
                    yield pa.record_batch([pa.array(np.concatenate(own)), pa.array(np.concatenate(keys))], names=["own", "key"])
                    own, keys, held = [], [], 0
            if held:
                yield pa.record_batch([pa.array(np.concatenate(own)), pa.array(np.concatenate(keys))], names=["own", "key"])

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [neighbourhood_hash(w) for w in batch.column(2).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.int64())], names=["word", "n", "own"])

    coded = vocabulary.select("word", "n", reduced(F.col("word"), symbols).alias("r"))
    hashed = saved(coded.mapInArrow(hashes, "word string, n long, own long"))
    # Few bytes in and many out, so the partitions are not left to be made fewer.
    parts = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    generated = coded.select("r").repartition(parts, "r").distinct().mapInArrow(generate, "own long, key long")
    pairs = generated.join(hashed.select(F.col("own").alias("key")).distinct(), "key", "left_semi")
    left = pairs.join(hashed.select("own", F.col("word").alias("a"), F.col("n").alias("an")), "own")
    both = left.join(hashed.select(F.col("own").alias("key"), F.col("word").alias("b"), F.col("n").alias("bn")), "key")
    both = both.where((F.col("own") < F.col("key")) | (F.col("a") < F.col("b")))
    return both.where(F.levenshtein("a", "b", 1) == 1).select("a", "an", "b", "bn")


def neighbourhood_hash(word: str) -> int:
    d = np.frombuffer(word.encode("latin-1"), np.uint8).astype(np.uint64) - np.uint64(64)
    with np.errstate(over="ignore"):
        return int(np.array([(d * _powers(len(d))[: len(d)][::-1]).sum(dtype=np.uint64)], np.uint64).view(np.int64)[0])


def variants(vocabulary: DataFrame, *, least: int = 7, times: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of vocabulary (word, n); form: the near word of largest n, if that is times the word's."""
    vocabulary = saved(vocabulary)
    pairs = near_words(vocabulary, least=least)
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("m"), F.col("b").alias("w")).alias("best")), F.struct(F.col("b").alias("word"), F.struct((-F.col("an")).alias("m"), F.col("a").alias("w")).alias("best")))).alias("e")).select("e.*")
    near = ends.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("best").alias("best"))
    own = vocabulary.join(near, "word", "left")
    has = -F.col("best.m") >= times * F.col("n")
    own = saved(own.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.w")).alias("form"), F.when(has, -F.col("best.m")).alias("form_n")))
    # A form is times as frequent as its word, so chains are short; each round makes the way to the root half as long.
    step = saved(own.where("form IS NOT NULL").select("word", F.col("form").alias("to")))
    while True:
        onward = step.select(F.col("word").alias("to"), F.col("to").alias("next"))
        if step.select("to").distinct().join(onward, "to", "left_semi").isEmpty():
            break
        step = saved(join_by_key(step, onward, "to", "left").select("word", F.coalesce("next", "to").alias("to")))
    return own.join(step, "word", "left").select("word", "form", F.coalesce("to", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(words(read(spark, sf_dir, "documents")).where("n >= 2"))


#: The 256 entries of the table of CRC-32, and the sum over the bytes of a string in UTF-8 (here one or two a code point).
_TABLE = "(SELECT list(t ORDER BY i) FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS t FROM range(256) r(i)))"
OP12_SQL = f"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT {_TABLE} AS t),
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run FROM documents),
each AS (SELECT id, run, count(*) AS k FROM runs WHERE length(run) >= 7 GROUP BY 1, 2),
bytes AS (SELECT run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [CAST(unicode(c) AS BIGINT)] ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS b FROM each),
hashed AS (SELECT run, k, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, crc),
edited AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word, k FROM hashed),
v AS MATERIALIZED (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM edited WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, CAST(i AS INT)) || substr(word, CAST(i AS INT) + 2) AS d FROM (SELECT word, n, unnest(range(length(word))) AS i FROM v)),
near AS MATERIALIZED (
  SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.d = b.d AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.d = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.d = b.word),
best AS (SELECT a AS word, count(*) AS n_near, min({{'m': -n, 'w': b}}) AS best FROM near GROUP BY a),
own AS MATERIALIZED (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.m >= 10 * v.n THEN best.w END AS form, CASE WHEN -best.m >= 10 * v.n THEN -best.m END AS form_n FROM v LEFT JOIN best USING (word)),
up(word, root) AS (SELECT word, form FROM own WHERE form IS NOT NULL UNION ALL SELECT up.word, own.form FROM up JOIN own ON own.word = up.root WHERE own.form IS NOT NULL),
last AS (SELECT up.word, up.root FROM up JOIN own ON own.word = up.root WHERE own.form IS NULL)
SELECT own.word, own.form, coalesce(last.root, own.word) AS root, own.n, own.n_near, own.form_n FROM own LEFT JOIN last USING (word)
"""
