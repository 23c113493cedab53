"""SimHash near-duplicates by Golay-code fuzzy hashing.

The binary Golay code of length 23 is perfect: every 23-bit word lies within 3 bits of one codeword. A word that is 3
bits from its codeword lies 4 bits from five others; these six codewords (one, if it is nearer) are its keys, and words
that differ in at most one bit share a key. A 64-bit fingerprint is cut into segments of 23, 23 and 18 bits (zeros
added). Of 3 differing bits at least two segments get at most one each, so fingerprints within 3 bits share a key of
some pair of segments: 24 bits, at most 36 keys a pair. Buckets of a key are verified by the distance itself.

Equal fingerprints are one row before keys are made. A bucket gives a spanning forest of its links, not all of them;
buckets over BLOCK rows get finer keys, with one of four pieces of the third segment, and what is still over BLOCK goes to
a further step, where each pair of blocks is a task's work, so no bucket is held whole.

``near_duplicates`` finds documents alike in shingles (5 words, Jaccard 0.8) by the same code: 128-bit fingerprints, keys
from Golay segments of fixed random bits, as many as the wanted recall needs, then exact similarity of the shingle sets.
What buckets link, directly or through others, is a family; within it all texts are compared exactly, in blocks, by matrix products
of their shingles (see family_links), so near copies of near copies are found however unlike most of the family is.

Defined cases: null and empty texts have no words; with fewer words than a shingle the whole sequence is one. A
fingerprint without words is 0 and linked like any other (for near_duplicates, texts without words are alike). Null ids
are passed over in component ids. Repeated rows are copies. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ordered import running_total
from .common import LOWER, UPPER, fresh, join_by_key, numbered, read, saved
from .components import components

TO_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Rows of a bucket that one step compares; larger buckets are cut into blocks of so many.
BLOCK = 4096
#: Buckets up to this size are compared all at once over a batch.
SMALL = 8
#: One in so many tables gathers families first.
FIRST = 6
#: Shingles of a block of a family, each row counted as so many besides its own.
MEETING, ROW = 1 << 19, 512
#: A shingle in more rows of a meeting than this is counted by a matrix product, so many of them at once.
COMMON, COLUMNS = 32, 2048

GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1


def _syndromes(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    for i in range(22, 10, -1):
        x ^= ((x >> i) & 1) * (GENERATOR << (i - 11))
    return x


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Syndromes of the high 11 and the low 12 bits, and for each syndrome up to six error patterns (the nearest first; -1: none)."""
    patterns = [np.array([sum(1 << b for b in c) for c in combinations(range(23), w)], np.int64) for w in range(5)]
    near = np.full((2048, 6), -1, np.int64)
    least = np.zeros(2048, np.int64)
    for w in range(4):
        s = _syndromes(patterns[w])
        near[s, 0], least[s] = patterns[w], w
    s = _syndromes(patterns[4])
    order = np.argsort(s, kind="stable")
    far, s = patterns[4][order], s[order]
    nth = np.arange(len(s)) - np.searchsorted(s, s)
    use = least[s] == 3
    near[s[use], nth[use] + 1] = far[use]
    return _syndromes(np.arange(2048) << 12), _syndromes(np.arange(4096)), near


HIGH, LOW, NEAR = _tables()


def codeword_indices(words: np.ndarray) -> np.ndarray:
    """The 12-bit indices of the codewords near 23-bit words: six columns, the nearest first, -1 where there are fewer."""
    words = words.astype(np.int64)
    near = NEAR[HIGH[words >> 12] ^ LOW[words & 4095]]
    return np.where(near >= 0, (words[:, None] ^ near) >> 11, -1)


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the shingles of a text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(TO_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = max(1, len(words) - shingle + 1)
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(42)), np.uint64, n)


def majority_bits(hashes: np.ndarray) -> np.ndarray:
    """Of n hashes, the bits that over half have, lowest first."""
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        part = hashes[at : at + (1 << 15)]
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return count * 2 > len(hashes)


def _packed(bits: np.ndarray) -> int:
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def mixed(h: np.ndarray) -> np.ndarray:
    """A second hash of hashes."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def fingerprints(shingle: int):
    @F.pandas_udf("long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([_packed(majority_bits(shingle_hashes(t, shingle))) for t in texts], dtype="int64")

    return fingerprint


def wide_fingerprints(shingle: int):
    """128 bits of the set of shingles: a repeated one counts once, as in the similarity that is verified."""

    @F.pandas_udf("lo long, hi long")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = [(_packed(majority_bits(h)), _packed(majority_bits(mixed(h)))) for h in (np.unique(shingle_hashes(t, shingle)) for t in texts)]
            yield pd.DataFrame(rows, columns=["lo", "hi"], dtype="int64")

    return fingerprint


def segment_keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and keys of 64-bit fingerprints: all pairs of near codewords of each pair of segments."""
    u = fps.view(np.uint64)
    segments = [codeword_indices((u >> np.uint64(at)) & np.uint64((1 << n) - 1)) for at, n in ((0, 23), (23, 23), (46, 18))]
    rows, keys = [], []
    for k, (i, j) in enumerate(combinations(range(3), 2)):
        a, b = segments[i][:, :, None], segments[j][:, None, :]
        there = (a >= 0) & (b >= 0)
        key = (k << 24) | (a << 12) | b
        rows.append(np.nonzero(there)[0])
        keys.append(key[there])
    return np.concatenate(rows), np.concatenate(keys).astype(np.int32)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Differing bits of fingerprints, in the last axis 64 bits each. Counted without a sign: of a negative number numpy counts the absolute value."""
    return np.bitwise_count((x ^ y).view(np.uint64)).sum(-1, dtype=np.int64)


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links, within most bits, that span what is linked in one bucket; the nearest first (Prim's algorithm)."""
    n = len(fp)
    left = np.arange(1, n)
    best = distances(fp[1:], fp[:1])
    link = np.zeros(n - 1, np.int64)
    a, b = [], []
    while len(left):
        k = int(best.argmin())
        node = left[k]
        if best[k] <= most:
            a.append(link[k])
            b.append(node)
        keep = np.arange(len(left)) != k
        left, best, link = left[keep], best[keep], link[keep]
        d = distances(fp[left], fp[node : node + 1])
        nearer = d < best
        best, link = np.where(nearer, d, best), np.where(nearer, node, link)
    return np.array(a, np.int64), np.array(b, np.int64)


def linker(columns: list[str], fp_columns: list[str], most: int, whole: bool, labelled: bool = False) -> Callable:
    """For rows sorted by columns (the key): links (a, b) of buckets; of buckets over BLOCK, unless whole, the members (key, id, fp..., block) with b null.

    labelled: the last of fp_columns is no fingerprint but the group that a row is known to be of; links within a group are left out."""
    bits = slice(0, len(fp_columns) - labelled)

    def news(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a[:, -1] != b[:, -1] if labelled else np.ones(len(a), bool)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        open_block, open_key = 0, None

        def members(key: int, ids: np.ndarray, fp: np.ndarray, block: int) -> pa.RecordBatch:
            n = len(ids)
            return _out(np.full(n, key), ids, None, fp.reshape(n, -1), np.full(n, block))

        def ends(a: list[np.ndarray], b: list[np.ndarray]) -> pa.RecordBatch:
            pairs = np.stack([np.concatenate(a or [np.zeros(0, np.int64)]), np.concatenate(b or [np.zeros(0, np.int64)])], 1)
            pairs = np.unique(np.sort(pairs, 1), axis=0)
            return _out(None, pairs[:, 0], pairs[:, 1], None, None)

        def work(key: np.ndarray, ids: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
            """Whole buckets."""
            starts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]).any(1)]) if len(key) else np.zeros(0, np.int64)
            sizes = np.diff(np.r_[starts, len(key)])
            size = np.repeat(sizes, sizes)
            number = np.repeat(np.arange(len(sizes)), sizes)
            a, b = [], []
            few = np.flatnonzero((size > 1) & (size <= SMALL))
            kf, idf, ff = number[few], ids[few], fp[few]
            for lag in range(1, SMALL):
                same = np.flatnonzero(kf[lag:] == kf[:-lag])
                if not len(same):
                    break
                ok = same[(distances(ff[same][:, bits], ff[same + lag][:, bits]) <= most) & news(ff[same], ff[same + lag])]
                a.append(idf[ok])
                b.append(idf[ok + lag])
            for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
                i, j = forest(fp[s : s + n, bits], most)
                ok = news(fp[s + i], fp[s + j])
                a.append(ids[s + i[ok]])
                b.append(ids[s + j[ok]])
            yield ends(a, b)

        for batch in batches:
            key = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns], 1)
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            fp = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in fp_columns], 1)
            if held:
                key, ids, fp = (np.concatenate([h, x]) for h, x in zip(held.pop(), (key, ids, fp), strict=True))
            if not len(key):
                continue
            last = int(np.flatnonzero((key == key[-1]).all(1))[0])
            if open_key is not None and (key[0] != open_key).any():
                open_key = None
            if open_key is not None:  # more of a bucket that is given out in blocks
                end = int((key == open_key).all(1).argmin()) if not (key == open_key).all() else len(key)
                for at in range(0, end, BLOCK):
                    yield members(open_key[0], ids[at : min(end, at + BLOCK)], fp[at : min(end, at + BLOCK)], open_block)
                    open_block += 1
                key, ids, fp, last = key[end:], ids[end:], fp[end:], max(0, last - end)
                if not len(key):
                    continue
                open_key = None
            yield from work(key[:last], ids[:last], fp[:last])
            key, ids, fp = key[last:], ids[last:], fp[last:]
            if len(key) > BLOCK and not whole:
                open_key, open_block = key[0], 0
                for at in range(0, len(key), BLOCK):
                    yield members(open_key[0], ids[at : at + BLOCK], fp[at : at + BLOCK], open_block)
                    open_block += 1
            else:
                held.append((key, ids, fp))
        if held:
            yield from work(*held.pop())

    def _out(key, a, b, fp, block) -> pa.RecordBatch:
        n = len(a)
        none = pa.nulls(n, pa.int64())
        fps = [pa.array(fp[:, i]) for i in range(len(fp_columns))] if fp is not None else [none] * len(fp_columns)
        arrays = [pa.array(key, pa.int64()) if key is not None else none, pa.array(a, pa.int64()), pa.array(b, pa.int64()) if b is not None else none, *fps, pa.array(block, pa.int64()) if block is not None else none]
        return pa.record_batch(arrays, names=["key", "a", "b", *fp_columns, "block"])

    return run


def finer_keys(members: DataFrame) -> DataFrame:
    """Four rows (key, id, fp) for each row of a large bucket of 64-bit fingerprints.

    The segment that isn't in the key has at most 3 differing bits, so of its four pieces one is unchanged: it joins the key."""
    pair = F.shiftright("key", 24)
    rows = None
    for k, (at, sizes) in enumerate(((46, (5, 5, 4, 4)), (23, (6, 6, 6, 5)), (0, (6, 6, 6, 5)))):
        pieces = []
        for i, n in enumerate(sizes):
            piece = F.shiftrightunsigned("fp", at + sum(sizes[:i])).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
            pieces.append(F.shiftleft("key", 8).bitwiseOR(F.lit(i << 6).cast("long")).bitwiseOR(piece))
        part = members.where(pair == k).select(F.explode(F.array(*pieces)).alias("key"), "id", "fp")
        rows = part if rows is None else rows.unionByName(part)
    return rows


def links(keyed: DataFrame, fp_columns: list[str], most: int, finer: Callable[[DataFrame], DataFrame] | None = None, labelled: bool = False) -> DataFrame:
    """a, b: links that span what rows (key, id, fp...) of equal key link within most bits; labelled as for linker.

    finer: gives the rows of buckets over BLOCK keys that part them further and miss no link."""
    schema = f"key long, a long, b long, {', '.join(f'{c} long' for c in fp_columns)}, block long"
    found = saved(keyed.repartition("key").sortWithinPartitions("key", *fp_columns).mapInArrow(linker(["key"], fp_columns, most, False, labelled), schema))
    members = found.where("b is null").withColumnRenamed("a", "id")
    if finer is not None:
        return found.where("b is not null").select("a", "b").unionByName(links(finer(members.select("key", "id", *fp_columns)), fp_columns, most))
    blocks = members.groupBy("key").agg((F.max("block") + 1).alias("n"))
    # Each block meets each block of its bucket, itself included, in a group of its own.
    pairs = members.join(blocks, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    pairs = pairs.select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "id", *fp_columns)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    more = pairs.repartition(parts, "key", "i", "j").sortWithinPartitions("key", "i", "j", *fp_columns).mapInArrow(linker(["key", "i", "j"], fp_columns, most, True, labelled), schema)
    return found.where("b is not null").select("a", "b").unionByName(more.select("a", "b"))


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits), component_id of every row of docs. most: at most 3 bits."""
    if most > 3:
        raise ValueError("keys of 64-bit fingerprints find up to 3 differing bits")
    prints = saved(docs.select(F.col(id_col).alias("doc_id"), fingerprints(shingle)(F.col(text)).alias("fp")))
    distinct = saved(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 4096):
                part = fps[at : at + 4096]
                rows, found = segment_keys(part)
                yield pa.record_batch([pa.array(found), pa.array(part[rows]), pa.array(part[rows])], names=["key", "id", "fp"])

    keyed = distinct.select("fp").repartition("fp").mapInArrow(keys, "key int, id long, fp long")
    of = components(links(keyed.select(F.col("key").cast("long").alias("key"), "id", F.col("id").alias("fp")), ["fp"], most, finer=finer_keys))
    rooted = distinct.join(of, distinct["fp"] == of["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = saved(rooted)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    labels = saved(rooted.join(least, "root").select("fp", "component_id"))
    return join_by_key(prints, labels, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def error_rate(similarity: float) -> float:
    """Share of fingerprint bits in which sets of a Jaccard similarity differ."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def most_bits(similarity: float) -> int:
    """Of 128 bits, as many as differ in all but some 0.3 % of pairs at the similarity."""
    p = error_rate(similarity)
    return math.floor(128 * p + 3 * math.sqrt(128 * p * (1 - p)))


def tables_for(rows: int, similarity: float, recall: float) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bits of each table: 23 for a Golay segment, and some more so that a key has about as many values as there are rows.

    Tables are as many as pairs at the similarity need on average: those that happen to differ in more bits than most
    do are found less often, so the count can't be taken from the mean of the bits."""
    p, most = error_rate(similarity), most_bits(similarity)
    more = max(0, math.ceil(math.log2(max(2, rows))) - 12)
    share = np.array([math.comb(128, n) * p**n * (1 - p) ** (128 - n) for n in range(most + 1)])
    if share.sum() <= recall:
        raise ValueError("pairs of more differing bits than are compared set a limit to the recall")
    # Two words have one nearest codeword about as often as 12.8 sampled bits agree.
    miss = 1 - (1 - np.arange(most + 1) / 128) ** (12.8 + more)
    count = 1
    while (share * (1 - miss**count)).sum() < recall:
        count += 1
    rng = np.random.default_rng(23)
    return [(bits[:23], bits[23 : 23 + more]) for bits in (rng.permutation(128) for _ in range(count))]


def table_keys(lo: np.ndarray, hi: np.ndarray, tables: list) -> np.ndarray:
    """A key a row and table of 128-bit fingerprints."""
    bits = np.unpackbits(np.stack([lo, hi], 1).view(np.uint8).reshape(len(lo), 16), axis=1, bitorder="little").astype(np.float64)
    weights = np.zeros((128, 2 * len(tables)))
    for t, (segment, more) in enumerate(tables):
        weights[segment, 2 * t] = 2.0 ** np.arange(len(segment))
        weights[more, 2 * t + 1] = 2.0 ** np.arange(len(more))
    words = (bits @ weights).astype(np.int64)
    code = codeword_indices(words[:, ::2].reshape(-1))[:, 0].reshape(len(lo), -1)
    size = len(tables[0][1])
    return (np.arange(len(tables)) << (12 + size)) | (code << size) | words[:, 1::2]


def common_shingles(sets: list[np.ndarray], n: int) -> np.ndarray:
    """How many shingles each of the first n sets shares with each of the others; if there are no others, with each of the n after it."""
    rows = len(sets)
    others = rows - n or n
    row = np.repeat(np.arange(rows), [len(x) for x in sets])
    flat = np.concatenate([np.zeros(0, np.int64), *sets])
    order = np.argsort(flat, kind="stable")  # of equal shingles, the rows in order
    flat, row = flat[order], row[order]
    starts = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]]) if len(flat) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(flat)])
    often = np.repeat(sizes > COMMON, sizes)
    met = np.zeros((n, others), np.float32)
    r, of = row[often], np.repeat(np.arange((sizes > COMMON).sum()), sizes[sizes > COMMON])
    for at in range(0, int((sizes > COMMON).sum()), COLUMNS):
        part = slice(*np.searchsorted(of, (at, at + COLUMNS)))
        has = np.zeros((rows, COLUMNS), np.float32)
        has[r[part], of[part] - at] = 1
        met += has[:n] @ has[rows - others :].T
    flat, row = flat[~often], row[~often]
    for lag in range(1, COMMON):
        same = np.flatnonzero(flat[lag:] == flat[:-lag])
        if not len(same):
            break
        x, y = row[same], row[same + lag] - (rows - others)
        if rows > n:
            x, y = x[(x < n) & (y >= 0)], y[(x < n) & (y >= 0)]
        met += np.bincount(x * others + y, minlength=n * others).reshape(n, others)
    return met


def meeting_links(sets: list[np.ndarray], n: int, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers (a, b) that join what is alike of the first n sets and the others, or among the n if there are no others."""
    rows = len(sets)
    size = np.array([len(x) for x in sets], float)
    other = slice(n, rows) if rows > n else slice(0, n)
    both = common_shingles(sets, n).astype(float)
    alike = both >= similarity * (size[:n, None] + size[None, other] - both)
    if rows == n:
        alike = np.triu(alike, 1)
    label = np.arange(rows)
    while True:
        before = label.copy()
        label[:n] = np.minimum(label[:n], np.where(alike, label[None, other], rows).min(1, initial=rows))
        label[other] = np.minimum(label[other], np.where(alike, label[:n, None], rows).min(0, initial=rows))
        label = label[label]
        if (label == before).all():
            break
    joined = np.flatnonzero(label != np.arange(rows))
    return joined, label[joined]


def meetings(blocks: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: what joins the rows that are alike of each meeting; blocks (around, i, j, side, row), sets (row, shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, side, rows, sets = None, [], [], []

        def met() -> pa.RecordBatch:
            a, b = meeting_links(sets, sum(s == 0 for s in side), similarity)
            ids = np.array(rows, np.int64)
            return pa.record_batch([pa.array(ids[a]), pa.array(ids[b])], names=["a", "b"])

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("around", "i", "j", "side", "row")]
            shingles = batch.column("shingles")
            for n, (*now, s, row) in enumerate(zip(*columns, strict=True)):
                if now != key:
                    if rows:
                        yield met()
                    key, side, rows, sets = now, [], [], []
                side.append(s)
                rows.append(row)
                sets.append(shingles[n].values.to_numpy())
        if rows:
            yield met()

    parts = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return blocks.join(sets, "row").repartition(parts, "around", "i", "j").sortWithinPartitions("around", "i", "j", "side", "row").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows (around, size, ...) with block: stretches of a family in the given order of about MEETING shingles."""
    placed = running_total(rows.withColumn("weight", F.col("size") + ROW), "around", order, "weight")
    return saved(placed.select(*rows.columns, F.floor(F.col("before") / MEETING).cast("int").alias("block")))


def family_links(rows: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: edges that join all rows (row, around) alike another of their family, by the sets (row, shingles).

    A family is cut into blocks. Rows of a block and of the next meet first, which leaves little of a family of very alike rows to do;
    a family of one block is then settled. Others are ordered by the groups found and cut again, and each two blocks meet, unless
    they are of one group or too different in size. In a meeting all pairs are compared at once by their counts of common shingles;
    what goes out is at most an edge a row."""
    sized = saved(rows.select("row", "around").join(sets.select("row", F.size("shingles").cast("long").alias("size")), "row"))
    blocks = in_blocks(sized, ["size", "row"])
    last = blocks.groupBy("around").agg(F.max("block").alias("last"))
    blocks = blocks.join(last, "around")
    first = F.array(F.struct(F.col("block").alias("i"), F.col("block").alias("j"), F.lit(0).alias("side")), F.struct(F.col("block").alias("i"), (F.col("block") + 1).alias("j"), F.lit(0).alias("side")), F.struct((F.col("block") - 1).alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    near = blocks.select("around", "row", "last", F.explode(first).alias("m")).where("m.i >= 0 AND m.j <= last").select("around", "m.i", "m.j", "m.side", "row")
    edges = saved(meetings(near, sets, similarity))
    of = saved(components(edges))
    many = blocks.where("last > 0").select("row", "around", "size").join(of, F.col("row") == F.col("node"), "left").select("row", "around", "size", F.coalesce("root", "row").alias("own"))
    apart = many.groupBy("around").agg(F.min("own").alias("x"), F.max("own").alias("y")).where("x <> y").select("around")
    rest = saved(many.join(saved(apart), "around", "left_semi"))
    if rest.isEmpty():
        return edges
    rest = in_blocks(rest, ["own", "size", "row"])
    ends = saved(rest.groupBy("around", "block").agg(F.min("size").alias("least"), F.max("size").alias("most"), F.min("own").alias("x"), F.max("own").alias("y")))
    x, y = ends.select("around", *[F.col(c).alias(f"{c}_i") for c in ends.columns[1:]]), ends.select("around", *[F.col(c).alias(f"{c}_j") for c in ends.columns[1:]])
    fits = (F.col("most_i") + 1e-9 >= similarity * F.col("least_j")) & (F.col("most_j") + 1e-9 >= similarity * F.col("least_i"))
    one = (F.col("x_i") == F.col("y_i")) & (F.col("x_j") == F.col("y_j")) & (F.col("x_i") == F.col("x_j"))
    pairs = saved(x.join(y, "around").where((F.col("block_i") <= F.col("block_j")) & fits & ~one).select("around", F.col("block_i").alias("i"), F.col("block_j").alias("j")))
    left = rest.join(pairs, (rest["around"] == pairs["around"]) & (rest["block"] == pairs["i"])).select(pairs["around"], "i", "j", F.lit(0).alias("side"), "row")
    right = rest.join(pairs.where("i < j"), (rest["around"] == pairs["around"]) & (rest["block"] == pairs["j"])).select(pairs["around"], "i", "j", F.lit(1).alias("side"), "row")
    return edges.unionByName(saved(meetings(left.unionByName(right), sets, similarity)))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text: str = "text", shingle: int = 5, similarity: float = 0.8, recall: float = 0.95, row: str | None = None) -> DataFrame:
    """row, doc_id, component (smallest row number of those alike, directly or through others) of every row of docs.

    row: a stored column that numbers the rows; without one a numbered table is written. recall: the share of pairs just at the
    similarity that share a family; more alike pairs do so more surely. Rows of a family are compared exactly, all with all."""
    if row is None:
        docs, row = numbered(docs.select(F.col(id_col).alias("id"), F.col(text).alias("text")), "row"), "row"
        id_col, text = "id", "text"
    own = docs.select(F.col(row).alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    prints = saved(own.select("row", "doc_id", wide_fingerprints(shingle)(F.col("text")).alias("p")).select("row", "doc_id", "p.*"))
    distinct = saved(prints.groupBy("lo", "hi").agg(F.min("row").alias("id")))
    most = most_bits(similarity)
    tables = tables_for(distinct.count(), similarity, recall)

    def keyed(rows: DataFrame, tables: list) -> DataFrame:
        """A row with a key for each row and table."""

        def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                names = batch.schema.names
                cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
                for at in range(0, batch.num_rows, 4096):
                    part = dict(zip(names, (c[at : at + 4096] for c in cols), strict=True))
                    found = table_keys(part["lo"], part["hi"], tables)
                    n = found.shape[1]
                    yield pa.record_batch([pa.array(found.reshape(-1)), *(pa.array(np.repeat(c, n)) for c in part.values())], names=["key", *names])

        return rows.repartition("id").mapInArrow(keys, ", ".join(f"{c} long" for c in ("key", *rows.columns)))

    same = prints.join(distinct, ["lo", "hi"]).where("row <> id").select(F.col("row").alias("a"), F.col("id").alias("b"))
    # What candidates link, alike or not, is a family: it holds every pair of a bucket within most bits. The first tables
    # gather most of it, so the others only give links between what is still apart, not the same family's links again.
    first = tables[: -(-len(tables) // FIRST)]
    begun = components(saved(links(keyed(distinct.select("id", "lo", "hi"), first), ["lo", "hi"], most).distinct()))
    grouped = saved(distinct.join(begun, F.col("id") == F.col("node"), "left").select("id", "lo", "hi", F.coalesce("root", "id").alias("own")))
    rest = tables[len(first) :]
    more = links(keyed(grouped, rest), ["lo", "hi", "own"], most, labelled=True) if rest else same
    known = grouped.where("id <> own").select(F.col("id").alias("a"), F.col("own").alias("b"))
    around = components(saved(known.unionByName(more).unionByName(same).distinct()))
    rows = saved(around.select(F.col("node").alias("row"), F.col("root").alias("around")))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, t in zip(batch.column(0), batch.column(1), strict=True):
                found = np.unique(shingle_hashes(t.as_py(), shingle)).view(np.int64)
                yield pa.record_batch([pa.array([row.as_py()], pa.int64()), pa.array([found], pa.list_(pa.int64()))], names=["row", "shingles"])

    shingles = saved(own.select("row", "text").join(rows.select("row"), "row", "left_semi").mapInArrow(sets, "row long, shingles array<long>"))
    of = saved(components(family_links(rows, shingles, similarity)))
    return prints.join(of, prints["row"] == of["node"], "left").select("row", "doc_id", F.coalesce("root", "row").alias("component"))


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near-duplicates, that with the smallest id, with the columns of docs."""
    number = fresh(docs, "row")
    own = numbered(docs, number)
    groups = saved(near_duplicates(own, row=number, **options))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    goes = groups.join(groups.groupBy("component").agg(F.min_by("row", order).alias("keep")), "component").where("row <> keep").select(F.col("row").alias(number))
    return own.join(saved(goes), number, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))
