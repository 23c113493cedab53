"""Running maxima, digests, frequent keys, policies and search within tenants against brute force."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.functions import columns as C
from fleetloom.operators import ordered, policies, quantise, sketches


@pytest.mark.parametrize("span", [3, 400])
def test_covered_intervals_nested_and_spanning(spark, span):
    """Half of all rows have one key; some intervals span hundreds of others."""
    rng = random.Random(span)
    rows = []
    for i in range(900):
        a = rng.randrange(2000)
        rows.append(("hot" if i % 2 else rng.choice("abc"), i, a, a + (rng.randrange(span) if i % 90 else 900)))
    want = {i for k, i, a, b in rows if a < b and any(q == k and (c, j) < (a, i) and d > a and c < d for q, j, c, d in rows)}
    found = ordered.covered(spark.createDataFrame([*rows, ("nil", 5000, 5, 5)], "key string, id long, a long, b long").repartition(7), "key")
    assert {r.id for r in found.collect()} == want and len(want) > 50


def test_states_as_of(spark):
    rng = random.Random(2)
    states = [("hot" if rng.random() < 0.7 else rng.choice("ab"), rng.randrange(300), rng.choice([None, rng.randrange(9)])) for _ in range(300)]
    rows = [(rng.choice(["hot", "a", "b", "none"]), rng.randrange(-5, 310), i) for i in range(500)]

    def brute(k, t):
        best = max(((at, -1 if v is None else v) for q, at, v in states if q == k and at <= t), default=(0, -1))
        return None if best[1] < 0 else best[1]

    found = ordered.as_of(spark.createDataFrame(rows, "key string, at long, id long"), spark.createDataFrame(states, "key string, at long, v long"), "key", "at", "v")
    assert found.columns == ["key", "at", "id", "v"]
    assert {r.id: r.v for r in found.collect()} == {i: brute(k, t) for k, t, i in rows}


def test_digest_does_not_depend_on_partitions(spark):
    lines = [(f"line {i % 700}",) for i in range(1500)] + [("same",)] * 4000
    df = spark.createDataFrame(lines, "line string")
    digests = {(r.lines, r.digest) for n in (1, 3, 17) for last in (10,) for r in ordered.sequence_digest(df.repartition(n), width=8, last=last).collect()}
    assert len(digests) == 1 and next(iter(digests))[0] == 5500
    other = ordered.sequence_digest(spark.createDataFrame(lines[1:], "line string"), width=8, last=10).first()
    assert other.lines == 5499 and other.digest not in {d for _, d in digests}
    empty = ordered.sequence_digest(df.limit(0)).first()
    assert empty.lines == 0 and len(empty.digest) == 64


@pytest.mark.parametrize("counters", [4, 40, 1000])
def test_frequent_keys_keep_their_bound(spark, counters, monkeypatch):
    monkeypatch.setattr(sketches, "HELD", 8)
    rng = random.Random(counters)
    keys = [int(rng.paretovariate(0.7)) % 3000 for _ in range(20_000)] + [None] * 50
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(6)
    true = Counter(k for k in keys if k is not None)
    bound = sum(true.values()) / (counters + 1)
    low = {r.k: r.low for r in sketches.frequent(df, "k", counters).collect()}
    assert len(low) <= counters and {k for k, n in true.items() if n > bound} <= set(low)
    assert all(true[k] - bound <= n <= true[k] for k, n in low.items())
    assert {r.k: r.n for r in sketches.frequent_counts(df, "k", counters).collect()} == {k: n for k, n in true.items() if n > bound}
    assert sketches.frequent_counts(df.limit(0), "k", counters).count() == 0


def test_views_show_a_session_only_what_it_may_read(spark):
    rows = spark.createDataFrame([(1, 1), (2, 2), (3, None)], "id long, tenant long")
    policies.declare(spark)
    view = policies.secure(rows, "charger", "tenant")
    seen = lambda: {r.id for r in spark.sql(f"SELECT id FROM {view}").collect()}
    assert seen() == set()  # nobody
    policies.act_as(spark, "app", None)
    assert seen() == set()  # no tenant
    policies.act_as(spark, "app", 1)
    assert seen() == {1, 3} and policies.may(spark, "SELECT", "charger") == "own_or_public" and policies.may(spark, "DELETE", "charger") == "none"
    policies.act_as(spark, "batch", None)
    assert seen() == {1, 2, 3}
    policies.act_as(spark, "x' OR '1' = '1", 1)
    assert seen() == set()
    policies.act_as(spark, None, None)
    assert seen() == set()


def test_sql_functions_say_what_the_column_functions_say(spark):
    policies.functions(spark)
    rows = spark.createDataFrame([("1HGCM82633A004352",), ("1HGCM82633A004353",), ("IHGCM82633A004352",), ("",), ("short",), (None,)], "vin string")
    assert all(r.a == r.b for r in rows.select(F.expr("vin_valid(vin)").alias("a"), C.vin_valid(F.col("vin")).alias("b")).collect())
    assert rows.where("vin_valid(vin)").count() == 1
    rng = random.Random(1)
    places = spark.createDataFrame([(rng.uniform(-89, 89), rng.uniform(-179, 179)) for _ in range(200)], "lat double, lon double")
    for n in (1, 6, 7):
        assert all(r.a == r.b for r in places.select(F.expr(f"geohash(lat, lon, {n})").alias("a"), C.geohash(F.col("lat"), F.col("lon"), n).alias("b")).collect())


def test_search_within_tenants(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(30, 24))
    rows = [("hot" if i % 2 else "abc"[i % 3], i, (centres[i % 30] + 0.3 * rng.normal(size=24)).tolist()) for i in range(1200)]
    rows += [("hot", 5000 + i, rows[1][2]) for i in range(8)] + [("a", 6000, None), ("a", 6001, [0.0] * 24), (None, 6002, rows[0][2]), ("alone", 6003, rows[0][2])]
    df = spark.createDataFrame(rows, "tenant string, id long, v array<double>")
    q = df.where("id % 20 = 0 OR id >= 5000").select(F.col("id").alias("qid"), "tenant", F.col("v").alias("q"))
    unit = {i: np.array(v) / np.linalg.norm(v) for t, i, v in rows if v and any(v)}
    tenant = {i: t for t, i, _ in rows}
    want = {}
    for i in [i for i in unit if tenant[i] and (i % 20 == 0 or i >= 5000)]:
        near = sorted((-round(float(unit[i] @ unit[j]), 12), j) for j in unit if j != i and tenant[j] == tenant[i])[:5]
        want[i] = [-c for c, _ in near]
    books = quantise.fit_books(df, cells=8, parts=12)
    index = quantise.tenant_index(df, books)
    got = {}
    for r in quantise.tenant_search(q, index, books, 5, block=50).collect():
        assert tenant[r.id] == tenant[r.qid] and r.id != r.qid
        got.setdefault(r.qid, []).append(r.cosine)
    assert {i: sorted(c, reverse=True) for i, c in got.items()} == {i: pytest.approx(c, abs=1e-9) for i, c in want.items() if c}
    found = quantise.tenant_search(q, index, books, 5, probes=4, rerank=30, block=50).collect()
    hits = sum(r.cosine >= want[r.qid][-1] - 1e-9 for r in found)
    assert all(tenant[r.id] == tenant[r.qid] and r.compared <= 30 for r in found) and hits >= 0.95 * sum(map(len, want.values()))
    none = df.limit(0)
    assert quantise.fit_books(none, cells=4, parts=4) is None and quantise.tenant_search(q, quantise.tenant_index(none, None), None, 5).count() == 0


def test_landmarks_direct_a_search(spark):
    """Ways are those without landmarks, over a third of the opened rows at most; parts that don't hang together and pairs without a way are no trouble."""
    from fleetloom.operators import graph, routes
    from fleetloom.sources.scratch import stored

    rng = random.Random(6)
    n = 8
    edges = [(x * n + y, (x + dx) * n + y + dy, rng.randint(1, 100)) for x in range(n) for y in range(n) for dx, dy in ((0, 1), (1, 0)) if x + dx < n and y + dy < n] + [(9000, 9001, 4)]
    e = stored(spark.createDataFrame(edges, "a long, b long, len long"))
    pairs = spark.createDataFrame([(i, rng.randrange(n * n), rng.randrange(n * n)) for i in range(10)] + [(100, 9000, 9001), (101, 5, 9001), (102, 7, 7)], "id long, a long, b long")
    marks = routes.landmarks(e)
    plain, led = (sorted(map(tuple, routes.shortest_ways(e, pairs, marks=m).collect())) for m in (None, marks))
    assert plain == led and len({r[0] for r in led}) == 12
    ends = stored(pairs.select("id", "a", F.col("b").alias("goal")))
    both = graph.both_ways(e)
    few, all_ = routes.explored(both, ends, marks=marks).count(), routes.explored(both, ends).count()
    assert few * 3 <= all_, (few, all_)
