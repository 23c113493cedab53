"""Benchmark decontamination by pigeonhole edit matching.

An item of m characters (lower case, runs of white space made one space) may occur in a text with up to k = rate * m
edits. It is split into k + 1 pieces: whatever the k edits, one piece is there unchanged. An Aho-Corasick automaton finds
all exact piece hits in one pass over each whole text; hits are verified with Myers' bit-parallel distance. The pieces
are the leaves of a tree of halves (of a node with budget k one half has at most half of k - 1 errors, and so on), and
verification climbs it, so a hit by chance ends at the first small node that differs too much.

Items are the stated query set; they are broadcast in blocks of bounded size, and texts are read once for each block.

Defined cases: null and empty texts hold no item; null and empty items are in no text; an item shorter than 1 / rate must
occur exactly; equal items and repeated rows are all reported. Ids may be null and of any type (those of items whole
numbers or strings). Extra columns are not read, and kept by drop_contaminated, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, numbered, read, saved

RATE = 0.1
#: Characters of items that are broadcast at once (an automaton of about 100 bytes for each).
BLOCK_CHARS = 1_000_000


def normal(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def myers(pattern: str, text: str, masks: dict[str, int], anchored: int | None = None) -> tuple[int, int]:
    """Least edit distance of a pattern to any stretch of a text, and the first end of one, by bit vectors of any length.

    With anchored, stretches begin where the text begins, and the first with that distance is taken."""
    m = len(pattern)
    full, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best, end = full, 0, m, m, 0
    get, first = masks.get, int(anchored is not None)
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
            if score < best:
                best, end = score, j + 1
                if anchored is not None and score <= anchored:
                    break
        ph = (ph << 1 | first) & full
        mh = (mh << 1) & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


class Node:
    """A stretch lo..hi of an item with its error budget."""

    __slots__ = ("beside", "budget", "hi", "lo", "masks", "parent", "text")

    def __init__(self, item: str, lo: int, hi: int, budget: int, parent: Node | None):
        self.lo, self.hi, self.budget, self.parent, self.text, self.masks = lo, hi, budget, parent, item[lo:hi], None
        self.beside: list[tuple[str, int, int]] = []

    def leaves(self, item: str) -> Iterator[Node]:
        if not self.budget:
            if self.parent is not None:
                # The rest of the parent has at most its budget of errors, so one of budget + 1 parts of it is
                # unchanged, moved by at most the budget: what to look for, from where and up to where.
                k, a, b = self.parent.budget, *((self.hi, self.parent.hi) if self.lo == self.parent.lo else (self.parent.lo, self.lo))
                cuts = [a + (b - a) * i // (k + 1) for i in range(k + 2)]
                self.beside = [(item[x:y], x - self.lo - k, y - self.lo + k) for x, y in zip(cuts, cuts[1:], strict=False)]
            yield self
            return
        left = (self.budget - 1) // 2
        right = self.budget - 1 - left
        cut = self.lo + (self.hi - self.lo) * (left + 1) // (self.budget + 1)
        for lo, hi, k in ((self.lo, cut, left), (cut, self.hi, right)):
            yield from Node(item, lo, hi, k, self).leaves(item)

    def distance(self, text: str) -> tuple[int, int]:
        if self.masks is None:
            self.masks = masks_of(self.text)
        return myers(self.text, text, self.masks)


class Matcher:
    """Finds items (id, text) in texts."""

    def __init__(self, items: list[tuple[int, str]], rate: float = RATE):
        self.automaton = ahocorasick.Automaton()
        self.items = []
        pieces: dict[str, list[tuple[int, Node]]] = {}
        for item_id, text in items:
            if item := normal(text):
                for leaf in Node(item, 0, len(item), math.floor(rate * len(item)), None).leaves(item):
                    pieces.setdefault(leaf.text, []).append((len(self.items), leaf))
                self.items.append((item_id, item))
        for piece, at in pieces.items():
            self.automaton.add_word(piece, at)
        if pieces:
            self.automaton.make_automaton()

    def find(self, text: str) -> list[tuple[int, int, int, int]]:
        """item id, least distance, start and end in the normalised text of every item that occurs."""
        found: dict[int, tuple[int, int, int]] = {}
        if not self.items or not text:
            return []
        for last, at in self.automaton.iter(text):
            for n, leaf in at:
                begin = last + 1 - (leaf.hi - leaf.lo)
                if n in found and (not found[n][0] or found[n][1] <= begin and last < found[n][2]):
                    continue  # part of what is found, or nothing could be nearer
                node = leaf.parent
                distance, end = 0, last + 1
                if node is None:
                    found[n] = (0, begin, end)
                    continue
                for part, a, b in leaf.beside:
                    if text.find(part, max(0, begin + a), max(0, begin + b)) >= 0:
                        break
                else:
                    continue
                while node is not None:
                    a = max(0, begin - (leaf.lo - node.lo) - node.budget)
                    b = begin + (node.hi - leaf.lo) + node.budget
                    distance, end = node.distance(text[a:b])
                    if distance > node.budget:
                        break
                    end += a
                    if node.parent is None and (n not in found or distance < found[n][0]):
                        found[n] = (distance, self._start(n, text, end, distance), end)
                    node = node.parent
        return [(self.items[n][0], d, a, b) for n, (d, a, b) in sorted(found.items())]

    def _start(self, n: int, text: str, end: int, distance: int) -> int:
        """The latest start of a stretch with that distance that ends there."""
        item = self.items[n][1][::-1]
        part = text[max(0, end - len(item) - distance) : end][::-1]
        return end - (myers(item, part, masks_of(item), distance)[1] if distance else len(item))


def find_items(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", rate: float = RATE, block_chars: int = BLOCK_CHARS, row: str | None = None) -> DataFrame:
    """row (number of the row of docs, or its column row), doc_id, item_id, distance, start, end: for each row of docs and item in it, the nearest occurrence."""
    spark = docs.sparkSession
    words = isinstance(items.schema[item_id].dataType, T.StringType)
    own = items.select(F.col(item_id).cast("string" if words else "long").alias("id"), F.col(item_text).alias("text")).where("text is not null")
    size = own.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(size / block_chars))
    rows = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(id_col).alias("doc_id"), F.col(text).alias("text"))
    schema = f"row long, doc_id {rows.schema['doc_id'].dataType.simpleString()}, item_id {'string' if words else 'long'}, distance int, start long, end long"
    types = [pa.string() if words else pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    found = None
    for block in range(blocks):
        part = own.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        shared = spark.sparkContext.broadcast([(r["id"], r["text"]) for r in part])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(shared.value, rate)
            for batch in batches:
                out = [(i, *hit) for i, t in enumerate(batch.column("text")) for hit in matcher.find(normal(t.as_py()))]
                at, *cols = list(zip(*out, strict=True)) or [[]] * 5
                at = pa.array(at, pa.int64())
                arrays = [batch.column("row").take(at), batch.column("doc_id").take(at), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))]
                yield pa.record_batch(arrays, names=["row", "doc_id", "item_id", "distance", "start", "end"])

        hits = rows.mapInArrow(run, schema)
        if blocks > 1:  # a block's items are let go before the next are broadcast
            hits = saved(hits)
            shared.unpersist()
        found = hits if found is None else found.unionByName(hits)
    return found


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """The documents that hold no item, with the columns of docs."""
    row = fresh(docs, "row")
    own = numbered(docs, row)
    hit = saved(find_items(own, items, row=row, **options).select(F.col("row").alias(row)).distinct())
    return own.join(hit, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_items(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("row")
