"""Nearest vectors by cosine: exact, by matrix products over blocks of queries, and by an index of cells.

Queries come in blocks of bounded size, each broadcast by itself; vectors stay where they are. A task keeps the k best of
each query of the block and gives them out at its end, so what is shuffled is k rows a query and task.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.scratch import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Queries that are broadcast at once; cosines that a task makes at once; candidates that it holds beside the best so far.
BLOCK, CELLS, HELD = 4096, 1 << 18, 1 << 18
#: Cosines are compared in so many digits, so that equal vectors tie whatever the order of a sum.
DIGITS = 12


def unit_rows(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows that have a direction, and these as a matrix of unit vectors. Null and zero vectors have none."""
    at = np.flatnonzero(vectors.is_valid().to_numpy(zero_copy_only=False))
    if not len(at):
        return at, np.zeros((0, 0))
    flat = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(float)
    rows = flat.reshape(len(at), -1)
    size = np.sqrt((rows * rows).sum(1))
    there = size > 0
    return at[there], rows[there] / size[there, None]


class Best:
    """The k best ids of each query, the smaller id first among equals."""

    def __init__(self, queries: int, k: int):
        self.k, self.least, self.size = k, np.full(queries, -np.inf), 0
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.kept = 0

    def add(self, query: np.ndarray, cosine: np.ndarray, ids: np.ndarray) -> None:
        self.held.append((query, cosine, ids))
        self.size += len(query)
        if self.size > HELD + self.kept:
            self.cut()

    def cut(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, c, i = (np.concatenate([h[n] for h in self.held] or [np.zeros(0, t)]) for n, t in enumerate((np.int64, float, np.int64)))
        order = np.lexsort((i, -c, q))
        q, c, i = q[order], c[order], i[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        full = nth == self.k - 1
        self.least[q[full]] = c[full]
        keep = nth < self.k
        self.held, self.size = [(q[keep], c[keep], i[keep])], int(keep.sum())
        self.kept = self.size
        return self.held[0]


def _searcher(shared, k: int) -> Callable:
    """For rows (cell, id, v): qid, id, cosine of the best of the task. A query meets the cells that it names; with null cells, all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, q, cells = shared.value
        best = Best(len(qids), k)
        of_cell: dict[int, np.ndarray] = {}
        if cells is not None:
            flat = cells.reshape(-1)
            order = np.argsort(flat, kind="stable")
            starts = np.flatnonzero(np.r_[True, np.diff(flat[order]) > 0])
            of_cell = {int(flat[order[s]]): np.sort(part // cells.shape[1]) for s, part in zip(starts, np.split(order, starts[1:]), strict=True)}
        every = np.arange(len(qids))
        for batch in batches:
            at, v = unit_rows(batch.column("v"))
            ids = batch.column("id").to_numpy(zero_copy_only=False)[at]
            cell = batch.column("cell").to_numpy(zero_copy_only=False)[at] if cells is not None else np.zeros(len(at), np.int64)
            for c in np.unique(cell):
                mine, use = np.flatnonzero(cell == c), of_cell.get(int(c)) if cells is not None else every
                if use is None:
                    continue
                step = max(1, CELLS // len(use))
                for s in range(0, len(mine), step):
                    rows = mine[s : s + step]
                    cosine = np.round(v[rows] @ q[use].T, DIGITS)
                    r, n = np.nonzero((cosine >= best.least[use]) & (ids[rows][:, None] != qids[use]))
                    best.add(use[n], cosine[r, n], ids[rows][r])
        n, cosine, found = best.cut()
        yield pa.record_batch([pa.array(qids[n]), pa.array(found), pa.array(cosine)], names=["qid", "id", "cosine"])

    return run


def _search(queries: DataFrame, rows: DataFrame, k: int, block: int, probes: Callable[[np.ndarray], np.ndarray] | None) -> DataFrame:
    spark = queries.sparkSession
    q = stored(queries.where("qid IS NOT NULL AND q IS NOT NULL").select(F.col("qid").cast("long").alias("qid"), F.col("q").cast("array<double>").alias("q")))
    blocks = max(1, math.ceil(q.count() / block))
    found = None
    for b in range(blocks):
        part = q.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == b).toArrow()
        at, m = unit_rows(part.column("q").combine_chunks())
        shared = spark.sparkContext.broadcast((part.column("qid").to_numpy()[at], m, probes(m) if probes and len(m) else None))
        best = rows.mapInArrow(_searcher(shared, k), "qid long, id long, cosine double") if len(m) else rows.select(F.col("id").alias("qid"), "id", F.lit(0.0).alias("cosine")).where("false")
        if blocks > 1:  # a block is let go before the next is broadcast
            best = stored(best)
            shared.unpersist()
        found = best if found is None else found.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.col("cosine").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_neighbours(queries: DataFrame, vectors: DataFrame, k: int, *, block: int = BLOCK) -> DataFrame:
    """qid, id, cosine, rank of the k nearest of vectors (id, v) to each of queries (qid, q), itself left out. Ids are whole numbers.

    Every query meets every vector, block by block: a scan of the vectors for each block of queries."""
    return _search(queries, vectors.select(F.lit(None).cast("long").alias("cell"), F.col("id").cast("long").alias("id"), "v"), k, block, None)


def fit_cells(vectors: DataFrame, cells: int, *, sample: int = 20_000, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Unit centres of cells, by spherical k-means over a bounded sample: the rows with the smallest hash of their id."""
    part = vectors.where("v IS NOT NULL").select(F.col("id"), F.col("v").cast("array<double>").alias("v")).orderBy(F.xxhash64("id"), "id").limit(sample).toArrow()
    _, rows = unit_rows(part.column("v").combine_chunks())
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:cells]]
    for _ in range(rounds):
        near = (rows @ centres.T).argmax(1) if len(centres) else np.zeros(0, int)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, rows)
        size = np.sqrt((sums * sums).sum(1))
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1e-300)[:, None], centres)
    return centres


def indexed(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """cell, id, v of every row that has a direction, stored in order of cells: a search reads a cell's rows together."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, v = unit_rows(batch.column("v"))
            rows = pa.array(at)
            cell = (v @ shared.value.T).argmax(1) if len(at) else at
            yield pa.record_batch([pa.array(cell, pa.int64()), batch.column("id").take(rows), batch.column("v").take(rows)], names=["cell", "id", "v"])

    kept = vectors.select(F.col("id").cast("long").alias("id"), F.col("v").cast("array<double>").alias("v")).mapInArrow(run, "cell long, id long, v array<double>")
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # A full cell is spread over partitions by the second part of the key.
    return stored(kept.repartitionByRange(parts, "cell", F.xxhash64("id")).sortWithinPartitions("cell"))


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, *, probes: int = 16, block: int = BLOCK) -> DataFrame:
    """As top_neighbours, but among the rows of the probes cells nearest to a query: some neighbours may be missed."""
    return _search(queries, index, k, block, lambda m: np.argsort(-(m @ centres.T), axis=1, kind="stable")[:, :probes])
