"""Hard-negative mining by threshold joins over an inverted index with suffix-norm bounds.

Anchors come in blocks of bounded size, each broadcast; vectors stay where they are. Dimensions are ordered by their energy
over all rows and cut into slices. In a task each batch of vectors is an index: for a slice, the rows whose dimensions from it on
could still lift some score to the threshold, by the norms of both suffixes. Those that couldn't are omitted from it and from
all later slices. Partial scores are accumulated slice by slice; a pair is dropped when what is left of both norms can't bring it
to the anchor's threshold, or can't bring it down to its window. What remains is scored in whole numbers.

A window (scores from lo to hi, the k best of them) is at first looked at from a threshold just under its upper end, where by the
means and variances of all rows some times k scores are expected. Windows that don't fill get lower thresholds and another pass,
until they are full or the threshold is lo. So results are exact, whatever the estimate.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take no part. Vectors of other lengths count
as if zeros followed. A row with the anchor's own id is never its positive; of anchors that repeat an id, the least (label,
vector) is taken; other repeated rows count as often as they are there. Empty tables give no rows. Extra columns are not read.
Scores are exact up to 2^53.
"""

from __future__ import annotations

import math
import sys
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.vectors import Best
from .common import read, saved

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules[Best.__module__])

#: Anchors that are broadcast at once, rows of an index, slices of dimensions.
BLOCK, ROWS, SLICES = 2048, 512, 8
#: Below this share of pairs that are left, the rest is scored pair by pair.
FEW = 1 / 16
#: Scores expected above a first threshold, for each that is wanted; how much wider a pass looks than the one before; passes before all is looked at.
MARGIN, WIDER, PASSES = 8, 4, 6


def prepared(vectors: DataFrame, *, id_col: str = "vec_id", label: str = "label", vector: str = "embedding", scale: int = 256) -> DataFrame:
    """id, label, v (whole numbers) of the rows that take part."""
    x = F.col("x")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label).alias("label"), F.col(vector).cast("array<double>").alias("x"))
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return rows.where(F.col("id").isNotNull() & F.col("label").isNotNull() & x.isNotNull() & ~bad).select("id", "label", F.transform(x, lambda c: F.floor(c * scale).cast("long")).alias("v"))


def matrix(v: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of whole numbers, with zeros after the shorter ones."""
    sizes = np.diff(v.offsets.to_numpy())
    out = np.zeros((len(sizes), max(width, sizes.max(initial=0))), np.int64)
    flat = v.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


def moments(rows: DataFrame) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Rows, about how many labels, mean and mean square of each dimension: two numbers a dimension come to the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, 0))
        for batch in batches:
            m = matrix(batch.column(0)).astype(float)
            if m.shape[1] > total.shape[1]:
                total = np.pad(total, ((0, 0), (0, m.shape[1] - total.shape[1])))
            total[:, : m.shape[1]] += [m.sum(0), (m * m).sum(0)]
        yield pa.record_batch([pa.array(np.arange(total.shape[1])), pa.array(total[0]), pa.array(total[1])], names=["at", "x", "xx"])

    n, labels = rows.agg(F.count(F.lit(1)), F.approx_count_distinct("label")).first()
    by = rows.select("v").mapInArrow(sums, "at long, x double, xx double").groupBy("at").agg(F.sum("x").alias("x"), F.sum("xx").alias("xx")).toPandas().sort_values("at")
    return n, labels, by["x"].to_numpy() / max(1, n), by["xx"].to_numpy() / max(1, n)


class Slices:
    """Vectors in an order of dimensions, and the norms of what follows each slice's start."""

    def __init__(self, whole: np.ndarray, order: np.ndarray):
        self.whole = np.pad(whole, ((0, 0), (0, max(0, len(order) - whole.shape[1]))))[:, order]
        self.x = self.whole.astype(float)
        self.edges = np.unique(np.linspace(0, len(order), SLICES + 1).astype(int))
        squares = np.concatenate([np.zeros((len(whole), 1)), np.cumsum((self.x * self.x)[:, ::-1], axis=1)], 1)[:, ::-1]
        self.left = np.sqrt(squares[:, self.edges])

    def part(self, s: int) -> slice:
        return slice(self.edges[s], self.edges[s + 1])


def candidates(a: Slices, x: Slices, allowed: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchors, rows and scores of the allowed pairs with a score from least to most (of the anchor), and some outside."""
    score, alive = np.zeros(allowed.shape), allowed.copy()
    slack = 1e-9 * (1 + a.left[:, :1] * x.left[:, 0])
    indexed = np.ones(len(x.x), bool)
    for s in range(len(x.edges) - 1):
        with np.errstate(divide="ignore", invalid="ignore"):
            # What the suffix of a row must measure for some anchor to reach its threshold by this suffix alone.
            reach = np.where(least > 0, np.where(a.left[:, s] > 0, least / a.left[:, s], np.inf), 0).min(initial=np.inf)
        indexed &= x.left[:, s] >= reach * (1 - 1e-9)
        on = np.flatnonzero(indexed)
        if s == 0:
            alive[:, ~indexed] = False
        if not len(on):
            break
        score[:, on] += a.x[:, x.part(s)] @ x.x[on, x.part(s)].T
        rest = a.left[:, s + 1 : s + 2] * x.left[on, s + 1] + slack[:, on]
        alive[:, on] &= (score[:, on] + rest >= least[:, None]) & (score[:, on] - rest <= most[:, None])
        if alive.mean() < FEW:
            break
    q, r = np.nonzero(alive)
    found = np.concatenate([np.zeros(0, np.int64), *[(a.whole[q[i : i + 8192]] * x.whole[r[i : i + 8192]]).sum(1) for i in range(0, len(q), 8192)]])
    return q, r, found


def _joiner(shared, k: int, same: bool) -> Callable:
    """For rows (id, label, v): anchor, no, id, score of the k best of each window of the block, of the task's rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, labels, v, wins, order = shared.value
        a = Slices(v, order)
        code = {x: i for i, x in enumerate(dict.fromkeys(labels))}
        own = np.array([code[x] for x in labels])
        # Windows of an anchor side by side; where there are fewer, some that hold no score.
        count = max(map(len, wins))
        at = np.array([[w["at"] for w in ws] + [math.inf] * (count - len(ws)) for ws in wins])
        hi = np.array([[w["hi"] for w in ws] + [-math.inf] * (count - len(ws)) for ws in wins])
        best = Best(len(ids) * count, k)
        for batch in batches:
            row_ids = batch.column("id").to_numpy()
            of = np.array([code.get(x, -1) for x in batch.column("label").to_pylist()])
            m = matrix(batch.column("v"), len(order))
            for s in range(0, len(row_ids), ROWS):
                part = slice(s, s + ROWS)
                # A window that is full in this task takes only scores that reach its last.
                now = np.maximum(at, best.least.reshape(len(ids), count))
                allowed = (own[:, None] == of[part]) == same
                if same:
                    allowed &= ids[:, None] != row_ids[part]
                q, r, score = candidates(a, Slices(m[part], order), allowed, now.min(1), hi.max(1))
                for w in range(count):
                    ok = (score >= now[q, w]) & (score <= hi[q, w])
                    best.add(q[ok] * count + w, score[ok], row_ids[part][r[ok]])
        w, score, found = best.cut()
        no = np.array([x["no"] for ws in wins for x in [*ws, *[{"no": 0}] * (count - len(ws))]])
        yield pa.record_batch([pa.array(ids[w // count]), pa.array(no[w], pa.int32()), pa.array(found), pa.array(score.astype(np.int64))], names=["anchor", "no", "id", "score"])

    return run


def windows_best(windows: DataFrame, rows: DataFrame, k: int, same: bool, order: np.ndarray, *, block: int = BLOCK) -> DataFrame:
    """anchor, no, id, score, rank: of each window (anchor, label, v, no, at, hi), the k best rows (id, label, v) of the same label, or of others, with a score from at to hi."""
    spark = rows.sparkSession
    by = saved(windows.groupBy("anchor").agg(F.first("label").alias("label"), F.first("v").alias("v"), F.collect_list(F.struct("no", "at", "hi")).alias("wins")))
    blocks = max(1, math.ceil(by.count() / block))
    found = None
    for b in range(blocks):
        part = by.where(F.pmod(F.xxhash64("anchor"), F.lit(blocks)) == b).toArrow()
        if not part.num_rows:
            continue
        shared = spark.sparkContext.broadcast((part.column("anchor").to_numpy(), part.column("label").to_pylist(), matrix(part.column("v").combine_chunks(), len(order)), part.column("wins").to_pylist(), order))
        best = rows.mapInArrow(_joiner(shared, k, same), "anchor long, no int, id long, score long")
        if blocks > 1:  # a block is let go before the next is broadcast
            best = saved(best)
            shared.unpersist()
        found = best if found is None else found.unionByName(best)
    rank = F.row_number().over(Window.partitionBy("anchor", "no").orderBy(F.col("score").desc(), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def filled(windows: DataFrame, rows: DataFrame, k: int, same: bool, stats: tuple, *, block: int = BLOCK) -> DataFrame:
    """As windows_best of windows (anchor, label, v, no, lo, hi; a null bound is none), with thresholds that start near hi and are lowered until a window is full."""
    n, labels, mean, square = stats
    among = max(1.0, n / max(1, labels) if same else float(n))
    want = min(0.5, MARGIN * k / among)
    z = NormalDist().inv_cdf(1 - want)
    order = np.argsort(-square, kind="stable")
    spread = np.maximum(0, square - mean * mean)

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            m = matrix(batch.column("v"), len(mean)).astype(float)
            yield batch.append_column("mean", pa.array(m @ mean)).append_column("std", pa.array(np.sqrt((m * m) @ spread)))

    kind = windows.schema["label"].dataType.simpleString()
    todo = windows.select("anchor", "label", "v", "no", F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"))
    todo = todo.select("anchor", "label", "v", "no", F.coalesce("lo", F.lit(-math.inf)).alias("lo"), F.coalesce("hi", F.lit(math.inf)).alias("hi"))
    todo = todo.mapInArrow(expected, f"anchor long, label {kind}, v array<long>, no int, lo double, hi double, mean double, std double")
    top, high = F.least("hi", F.col("mean") + (z + 1) * F.col("std")), (F.col("hi") - F.col("mean")) / F.greatest("std", F.lit(1e-9))
    # Scores as near as a normal distribution has them.
    width = MARGIN * k * F.col("std") * math.sqrt(2 * math.pi) / among * F.exp(F.least(high * high, F.lit(80.0)) / 2)
    todo = saved(todo.withColumn("at", F.greatest("lo", F.least(F.when(F.col("hi") < math.inf, F.col("hi") - width).otherwise(math.inf), F.col("mean") + z * F.col("std")))))
    done = None
    for n_pass in range(PASSES):
        if todo.isEmpty():
            break
        found = saved(windows_best(todo, rows, k, same, order, block=block))
        full = found.groupBy("anchor", "no").agg(F.count(F.lit(1)).alias("held"))
        met = todo.join(full, ["anchor", "no"], "left").withColumn("over", (F.coalesce("held", F.lit(0)) >= k) | (F.col("at") <= F.col("lo")))
        met = saved(met.drop("held"))
        kept = found.join(met.where("over").select("anchor", "no"), ["anchor", "no"], "left_semi")
        done = kept if done is None else done.unionByName(kept)
        wider = F.lit(-math.inf) if n_pass == PASSES - 2 else top - F.greatest(WIDER * (top - F.col("at")), F.col("std") / 4, F.lit(1.0))
        todo = saved(met.where("NOT over").withColumn("at", F.greatest("lo", wider)).drop("over"))
    return done if done is not None else rows.sparkSession.createDataFrame([], "anchor long, no int, id long, score long, rank int")


def mine(rows: DataFrame, anchors: DataFrame, *, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score; rows and anchors are as prepared gives them.

    Negatives score from least to most hundredths of the positive's score."""
    rows = saved(rows)
    stats = moments(rows)
    own = saved(anchors.groupBy(F.col("id").alias("anchor")).agg(F.min(F.struct("label", "v")).alias("r")).select("anchor", "r.label", "r.v"))
    none = F.lit(None).cast("long")
    good = saved(filled(own.select("*", F.lit(0).alias("no"), none.alias("lo"), none.alias("hi")), rows, positives, True, stats, block=block))
    p = F.col("positive_score")
    good = good.select("anchor", F.col("rank").cast("int").alias("no"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    # The whole numbers from least * p to most * p hundredths.
    bounds = good.select("anchor", "no", (-(-p * least - F.pmod(-p * least, F.lit(100))) / 100).cast("long").alias("lo"), ((p * most - F.pmod(p * most, F.lit(100))) / 100).cast("long").alias("hi"))
    windows = own.join(bounds.where("lo <= hi"), "anchor").select("anchor", "label", "v", "no", "lo", "hi")
    found = filled(windows, rows, negatives, False, stats, block=block)
    return found.join(good, ["anchor", "no"]).select(F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = prepared(read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding"))
    return mine(rows, rows.where(F.col("id") % 50 == 0))


OP11_SQL = """
WITH e AS MATERIALIZED (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
a AS (SELECT vec_id, r.label AS label, r.v AS v FROM (SELECT vec_id, min({'label': label, 'v': v}) AS r FROM e WHERE vec_id % 50 = 0 GROUP BY vec_id)),
s AS MATERIALIZED (SELECT a.vec_id AS anchor_id, e.vec_id AS id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score FROM a CROSS JOIN e WHERE len(a.v) = len(e.v)),
p AS MATERIALIZED (SELECT anchor_id, id AS positive_id, score AS positive_score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS n FROM s WHERE same AND anchor_id <> id QUALIFY n <= 5),
n AS (SELECT p.anchor_id, positive_id, p.n, s.id AS negative_id, positive_score, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, p.n ORDER BY s.score DESC, s.id) AS r
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score QUALIFY r <= 3)
SELECT anchor_id, positive_id, CAST(r AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n
"""
