"""Toxicity scores of deobfuscated text.

Noisy-channel decoding: a token that may be disguised (digits or signs between letters, letters repeated three times or
more, single letters or pairs set apart by anything that is no letter, a word cut in two) is a lattice of characters, each
with what it may stand for and what that costs. Before that, widths and ligatures are folded (NFKC), characters without a
width go, and look-alikes of other alphabets become Latin letters where they stand among such. Viterbi decoding under a character trigram model, counted over all documents, restores the likeliest word.
The words of a document, as they stand and restored, are then looked up in a word list learnt from labels; a logistic
regression of the strongest word's weight and of the sum of the others', fitted on the same labels, gives the score.

Passes: 1. character trigrams of all texts, added up in each task, then by Spark; the table is bounded by the alphabet.
2. document frequencies of words in a bounded sample of labelled rows. 3. the evidence in the same rows, for the
regression. 4. scores of all texts.

Defined cases: null and empty texts have no words and get the score of texts without listed words; a null id counts as an empty
string in the choice of held-out rows; repeated rows get equal scores; without labels of both kinds all scores are the
base rate (0.5 without labels). Extra columns are not read; labels, language and source are no input of a score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, saved

#: At most so many labelled rows are learnt from, those with the smallest hash of their id (about 16 bytes each are broadcast).
MAX_LABELS = 30_000
#: Least log-likelihood ratio (G squared) of a listed word; chance alone passes one word in 16,000, which the regression makes up for.
LEAST_EVIDENCE = 16.0
#: Least weight (log of the ratio of rates) of a listed word.
LEAST_WEIGHT = 2.0
#: Beginnings of words, of these lengths, are words of the list too, so that a word's inflections are known together.
STEMS = (4, 6)
THRESHOLD = 0.7

#: The alphabet: 0 is no letter, 1-26 a-z, 27-58 the Latin letters from U+00E0 to U+00FF, 59 any other letter.
SYMBOLS = 60
#: What signs may stand for.
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
#: Look-alikes of Latin letters, and what they look like: Cyrillic, then Greek.
LOOK_ALIKES = str.maketrans("аеорсухіјѕԁһӏкмт" + "οαινρυκτ", "aeopcyxijsdhlkmt" + "oaivpukt")
COST_LEET, COST_REPEAT, COST_SEPARATOR, COST_STRAY = 0.7, 1.0, 0.5, 9.0

#: Characters that are counted at once.
PIECE = 1 << 20

#: Three pieces or more of one or two letters, set apart by anything else.
SPACED = re.compile(r"(?<![^\W_])[^\W_]{1,2}(?![^\W_])(?:[\W_]+[^\W_]{1,2}(?![^\W_])){2,}")
SINGLE = re.compile(r"(?<![^\W_])[^\W_](?![^\W_])")
#: Neighbours of up to four letters may be one word.
HALVES = re.compile(r"(?<![^\W_])([^\W\d_]{1,4})(?=[\W_]+([^\W\d_]{1,4})(?![^\W_]))")
WIDTHLESS = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufeff]")
WORD_RUN = re.compile(r"[^\W\d_]+")
LATIN = re.compile("[a-z]")
ANY_ALIKE = re.compile("[" + "".join(map(chr, LOOK_ALIKES)) + "]")
REPEATED = re.compile(r"(.)\1\1")
TRIPLE = re.compile(r"(.)\1\1+")
DISGUISED = re.compile(r"(.)\1\1|[^\W\d_][\d@$!|+(€£._*-]+[^\W\d_]|[\d@$!|+(€£]+[^\W\d_]{2}|[^\W\d_]{2}[\d@$!|+€£]")
EDGES = "\"'`.,;:!?()[]{}<>#%&*$-_=~|/\\"
#: Edges that are no sign for a letter.
OPENING = "\"'`.,;:?[]{}<>#%&*-_=~/\\"


def alike(text: str) -> str:
    """text with its look-alikes as Latin letters, if it has Latin letters."""
    return text.translate(LOOK_ALIKES) if LATIN.search(text) else text


def folded(text: str) -> str:
    """Lower case without widths, ligatures, invisible characters, and look-alikes in Latin words."""
    low = text.lower()
    if low.isascii():
        return low
    low = unicodedata.normalize("NFKC", WIDTHLESS.sub("", low)).lower()
    if not ANY_ALIKE.search(low):
        return low
    return WORD_RUN.sub(lambda m: m[0] if m[0].isascii() else alike(m[0]), low)


def codes(text: str) -> np.ndarray:
    """Alphabet numbers of the characters of a text in lower case."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    return TABLE[np.minimum(points, len(TABLE) - 1)]


def _table() -> np.ndarray:
    table = np.zeros(0x3000, np.uint8)
    for p in range(len(table)):
        c = chr(p)
        if "a" <= c <= "z":
            table[p] = p - 96
        elif 0xE0 <= p <= 0xFF and c.isalpha():
            table[p] = p - 0xE0 + 27
        elif c.isalpha():
            table[p] = 59
    table[-1] = 59
    return table


TABLE = _table()


def trigrams(text: str) -> np.ndarray:
    """Numbers of the trigrams of the words of a text; a word begins after two and ends with one 0."""
    c = np.concatenate(([0, 0], codes(text), [0])).astype(np.int32)
    b = c[1:-1]
    a = np.where(b > 0, c[:-2], 0)
    c = c[2:]
    return ((a * SYMBOLS + b) * SYMBOLS + c)[(b > 0) | (c > 0)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(SYMBOLS**3, np.int64)
    held: list[str] = []
    size = 0

    def flush(held: list[str], size: int) -> int:
        text = "\n".join(held)
        held.clear()
        for at in range(0, len(text), PIECE):
            total[:] += np.bincount(trigrams(text[at : at + PIECE]), minlength=len(total))
        return 0

    for batch in batches:
        for t in batch.column(0):
            if t.is_valid:
                # Short texts together, long ones in pieces: memory is bounded by a piece.
                held.append(t.as_py())
                if (size := size + len(held[-1])) >= PIECE:
                    size = flush(held, size)
        size = flush(held, size)
    at = np.flatnonzero(total)
    yield pa.record_batch([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["gram", "n"])


class Model:
    """Log probabilities of a symbol after two others, interpolated with shorter histories."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray, weight: float = 5.0):
        n = np.zeros(SYMBOLS**3)
        n[grams] = counts
        n = n.reshape(SYMBOLS, SYMBOLS, SYMBOLS)
        one = (n.sum((0, 1)) + 0.1) / (n.sum() + 0.1 * SYMBOLS)
        pairs = n.sum(0)
        two = (pairs + weight * one) / (pairs.sum(1, keepdims=True) + weight)
        self.logp = np.log((n + weight * two) / (n.sum(2, keepdims=True) + weight)).astype(np.float32)


def lattice(token: str) -> Iterator[list[tuple[str, float]]]:
    """What each run of a character in a token may stand for, and what that costs."""
    for c, run in groupby(token):
        k = len(list(run))
        if c.isalpha():
            ways = [(c, (0.0, 3 * COST_REPEAT, COST_REPEAT)[min(k, 3) - 1])] + ([(c * 2, 0.0 if k == 2 else COST_REPEAT)] if k > 1 else [])
        elif c in LEET:
            ways = [(x * min(j, k), COST_LEET * (1 + (j < k))) for x in LEET[c] for j in ({1, k} if k < 3 else {1, 2})] + [("", COST_STRAY)] * (c in "!|$+(")
        else:
            ways = [("", COST_SEPARATOR), (" ", COST_SEPARATOR)]
        yield ways


def decode(token: str, logp: np.ndarray) -> str:
    """The likeliest words for a disguised token, by Viterbi over its lattice; states are the last two symbols.

    Where one state is left, all that is likeliest so far is settled and set down, so long tokens are decoded whole in little memory."""
    out: list[str] = []
    best: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
    number = {c: int(TABLE[min(ord(c), len(TABLE) - 1)]) for c in set(token) | set("abcdefghijklmnopqrstuvwxyz")}

    def extend(emitted: list[tuple[str, float]]) -> None:
        nonlocal best
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
        for (a, b), (score, path) in best.items():
            for letters, cost in emitted:
                x, y, s, p = a, b, score - cost, path
                for c in letters:
                    z = 0 if c == " " else number[c]
                    if z or y:
                        s += float(logp[x, y, z])
                    x, y, p = (y, z, (p, c)) if z else (0, 0, (p, c))
                if (x, y) not in after or after[x, y][0] < s:
                    after[x, y] = (s, p)
        best = after

    def settle(path: tuple | None) -> None:
        part = []
        while path is not None:
            path, c = path
            part.append(c)
        out.extend(reversed(part))

    for ways in lattice(token):
        extend(ways)
        if len(best) == 1:
            ((state, (score, path)),) = best.items()
            settle(path)
            best = {state: (score, None)}
    (_, path) = max(((s + (float(logp[a, b, 0]) if b else 0.0), p) for (a, b), (s, p) in best.items()), key=lambda x: x[0])
    settle(path)
    return "".join(out)


class Restorer:
    """The words of a text, as they stand and restored; only listed ones if there is a list. Keeps what tokens gave, up to a bound."""

    def __init__(self, logp: np.ndarray, listed: set[str] | None = None, bound: int = 200_000):
        self.logp, self.listed, self.bound, self.known, self.stretches = logp, listed, bound, {}, {}

    def decoded(self, t: str) -> frozenset[str]:
        """Words of a disguised stretch."""
        got = self.stretches.get(t)
        if got is None:
            got = frozenset(decode(t, self.logp).split())
            if len(t) <= 64:  # what may come again
                if len(self.stretches) >= self.bound:
                    self.stretches.clear()
                self.stretches[t] = got
        return got

    def restored(self, t: str) -> set[str]:
        return self.decoded(t) | ({TRIPLE.sub(r"\1", t), TRIPLE.sub(r"\1\1", t)} if REPEATED.search(t) else set())

    def of(self, token: str) -> tuple[str, ...]:
        core = token.strip(EDGES)
        if core.isalpha():
            words = {core, *self.restored(core)} if REPEATED.search(core) else {core}
        else:
            words = {core, *re.findall(r"[^\W\d_]+", core)} - {""}
            for t in {core, token.rstrip(EDGES).lstrip(OPENING)}:
                if DISGUISED.search(t):
                    words |= self.restored(t)
        words |= {w[:n] + "^" for w in words for n in STEMS if len(w) > n}
        if self.listed is not None:
            words &= self.listed
        if len(self.known) >= self.bound:
            self.known.clear()
        self.known[token] = got = tuple(words)
        return got

    def places(self, text: str) -> Iterator[tuple[str, int]]:
        """Each word with a hash of the token and the one that follows, where the token stands last; each stem with a hash of the token."""
        tokens = folded(text).split()
        for token, after in dict(zip(tokens, [*tokens[1:], ""], strict=False)).items():
            got = self.known.get(token)
            place = zlib.crc32(f"{token} {after}".encode("utf-8", "surrogatepass"))
            own = zlib.crc32(token.strip(EDGES).encode("utf-8", "surrogatepass"))
            for w in self.of(token) if got is None else got:
                yield w, own if w[-1] == "^" else place

    def words(self, text: str) -> set[str]:
        low = folded(text)
        out: set[str] = set()
        get = self.known.get
        for token in set(low.split()):
            got = get(token)
            if got is None:
                got = self.of(token)
            if got:
                out.update(got)
        for m in SPACED.finditer(low):
            # One letter over and over is no word, and pairs alone are words of their own.
            if len(set(filter(str.isalpha, m[0]))) > 1 and SINGLE.search(m[0]):
                out |= self.decoded(alike(m[0]))
        if self.listed is not None:
            # A word of the list that is cut in two is one if the model reads it as one.
            cut = {f"{a} {b}" for a, b in set(HALVES.findall(low)) if a + b in self.listed}
            out.update(w for c in cut for w in self.decoded(c))
        return out if self.listed is None else out & self.listed


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def character_model(docs: DataFrame, text: str = "text") -> Model:
    """Counted over all documents; what comes to the driver is bounded by the alphabet (216,000 numbers)."""
    grams = docs.select(text).mapInArrow(_count, "gram int, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()
    return Model(grams["gram"].to_numpy(), grams["n"].to_numpy())


def word_list(docs: DataFrame, labels: DataFrame, model: Model, *, id_col: str = "doc_id", text: str = "text", label: str = "toxic", max_labels: int = MAX_LABELS, least: float = LEAST_EVIDENCE) -> tuple[dict[str, float], float, DataFrame]:
    """Weights of listed words, the log odds of the base rate and the labels learnt from (id, y), from labels (id_col, label).

    The list has no cap: each of its words stands in several toxic places of the bounded sample."""
    spark = docs.sparkSession
    marks = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max(label).cast("int").alias("y"))
    marks = saved(marks.orderBy(F.xxhash64("id"), "id").limit(max_labels))
    shared = spark.sparkContext.broadcast(model.logp)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        restorer, found, seen = Restorer(shared.value), set(), Counter()

        def out() -> pa.RecordBatch:
            rows = [*found, *(("", y, i) for y, n in seen.items() for i in [-n])]
            found.clear()
            seen.clear()
            cols = list(zip(*rows, strict=True)) or [[], [], []]
            return pa.record_batch([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.int32(), pa.int64()), strict=True)], names=["word", "y", "place"])

        for batch in batches:
            for y, t in zip(batch.column("y"), batch.column("text"), strict=True):
                y = y.as_py()
                found.update((w, y, place) for w, place in restorer.places(t.as_py() or ""))
                seen[y] += 1
                if len(found) > 200_000:
                    yield out()
        yield out()

    # Copies of a document have a word in one place; a place counts once, however many copies there are.
    learnt = docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")).join(F.broadcast(marks), "id").select("y", "text").mapInArrow(run, "word string, y int, place long")
    learnt = saved(learnt)
    sums = learnt.where("word = ''").groupBy("y").agg(F.sum(-F.col("place")).alias("n")).collect()
    toxic, clean = (sum(r["n"] for r in sums if r["y"] == y) for y in (1, 0))
    prior = math.log((toxic + 0.5) / (clean + 0.5))
    if not toxic or not clean:
        return {}, prior, marks
    places = learnt.where("word <> ''").groupBy("word", "place").agg(F.min("y").alias("y"))
    counts = places.groupBy("word").agg(F.sum(F.when(F.col("y") == 1, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("y") == 0, 1).otherwise(0)).alias("c"))
    rate = toxic / (toxic + clean)
    n, t, c = F.col("t") + F.col("c"), F.col("t"), F.col("c")
    part = lambda x, expected: F.when(x > 0, x * F.log(x / expected)).otherwise(0.0)
    evidence = 2 * (part(t, n * rate) + part(c, n * (1 - rate)))
    weight = F.log((t + 0.5) / (toxic + 1)) - F.log((c + 0.5) / (clean + 1))
    listed = counts.withColumns({"g": evidence, "w": weight}).where((F.col("g") >= least) & (F.col("w") >= LEAST_WEIGHT)).select("word", "w").collect()
    return {r["word"]: r["w"] for r in listed}, prior, marks


def evidence_of(weights: dict[str, float], words: set[str]) -> tuple[float, float]:
    """The weight of the strongest word, and the logarithm of one more than the sum of the others'."""
    found = sorted((weights[w] for w in words), reverse=True)
    return (found[0], math.log1p(sum(found[1:]))) if found else (0.0, 0.0)


def evidence_udf(spark: SparkSession, model: Model, weights: dict[str, float]):
    shared = spark.sparkContext.broadcast((model.logp, weights))

    @F.pandas_udf("top double, rest double")
    def evidence(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        logp, weights = shared.value
        restorer = Restorer(logp, set(weights))
        for texts in batches:
            yield pd.DataFrame([evidence_of(weights, restorer.words(t)) for t in texts], columns=["top", "rest"], dtype=float)

    return evidence


def calibrated(cells: Iterable[tuple[float, float, int, int]], ridge: float = 1.0) -> np.ndarray:
    """Weights of a logistic regression of (top, rest, label, count) by Newton's method; more evidence never lowers a score."""
    data = np.array([tuple(c) for c in cells], float).reshape(-1, 4)
    use = [0, 1, 2]
    while True:
        x = np.column_stack([np.ones(len(data)), data[:, 0], data[:, 1]])[:, use]
        y, n, beta = data[:, 2], data[:, 3], np.zeros(len(use))
        prior = ridge * np.array([0.0, 1.0, 1.0])[use]
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            step = np.linalg.solve((x * (n * p * (1 - p))[:, None]).T @ x + np.diag(prior + 1e-9), x.T @ (n * (y - p)) - prior * beta)
            beta = beta + np.clip(step, -5, 5)
            if np.abs(step).max() < 1e-9:
                break
        wrong = [k for k, b in zip(use, beta, strict=True) if k and b < 0]
        if not wrong:
            break
        use.remove(wrong[-1])
    out = np.zeros(3)
    out[use] = beta
    return out


def score_toxicity(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, **options) -> DataFrame:
    """docs with toxic_score (0 to 1) and toxic_predicted (0 or 1), which replace columns of these names, learnt from all of labels that aren't held out."""
    spark = docs.sparkSession
    model = character_model(docs, text)
    weights, prior, marks = word_list(docs, labels.where(~held_out(F.col(id_col))), model, id_col=id_col, text=text, **options)
    if weights:
        evidence = evidence_udf(spark, model, weights)
        seen = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(marks), "id").select("y", evidence("text").alias("e"))
        # Cells of a grid, so what comes to the driver doesn't grow with the rows.
        cells = seen.groupBy(F.round("e.top", 1).alias("top"), F.round("e.rest", 1).alias("rest"), "y").count().collect()
        bias, top, rest = (float(b) for b in calibrated((r["top"], r["rest"], r["y"], r["count"]) for r in cells))
        e = evidence(F.coalesce(F.col(text), F.lit("")))
        logit = F.lit(bias) + F.lit(top) * F.col("toxic_score.top") + F.lit(rest) * F.col("toxic_score.rest")
        scored = docs.withColumn("toxic_score", e).withColumn("toxic_score", 1 / (1 + F.exp(-logit)))
    else:
        scored = docs.withColumn("toxic_score", F.lit(1 / (1 + math.exp(-prior))))
    return scored.withColumn("toxic_predicted", (F.col("toxic_score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that aren't predicted toxic, with the columns of docs."""
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()])
    kept = score_toxicity(own, labels.withColumnRenamed("doc_id", names["doc_id"]), id_col=names["doc_id"], text=names["text"], **options).where("toxic_predicted = 0")
    return kept.select(*[F.col(n).alias(c) for c, n in names.items()])


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))
