"""Operators of endpoints, raw batches, vectors, overlays and files, against plain Python."""

import heapq
import random
import uuid
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from oracle import DATA
from pyspark.sql import functions as F

from fleetloom.functions import columns as C
from fleetloom.operators import governance, graph, normalise, ordered, paging, routes, sketches, vectors, wire
from fleetloom.plans import evaluation, ingest
from fleetloom.sources import files, scratch
from fleetloom.sources.adapters import table_stream
from fleetloom.streaming import state


def test_cursors_come_back(spark):
    for at, i in ((datetime(2024, 5, 1, 12, 0, 0, 1), 7), (datetime(1969, 12, 31, 23, 59, 59, 999999), "a|b"), (datetime(1970, 1, 1), 0)):
        assert paging.decode_cursor(paging.encode_cursor(at, i)) == (at, str(i))
    for bad in ("", "x", "!!!!", "MTIz", paging.encode_cursor(datetime(2024, 1, 1), "")):
        with pytest.raises(ValueError):
            paging.decode_cursor(bad)
    at = datetime(2024, 5, 1, 12, 0, 0, 123456)
    rows = spark.createDataFrame([(at, i) for i in range(5)], "at timestamp_ntz, id long").withColumn("cursor", paging.cursor(F.col("at"), F.col("id")))
    assert {r.id: r.cursor for r in rows.collect()} == {i: paging.encode_cursor(at, i) for i in range(5)}
    seen, after = [], None
    while page := paging.page_before(rows, "at", "id", 2, after).collect():
        seen, after = seen + [r.id for r in page], page[-1].cursor
    assert seen == [4, 3, 2, 1, 0]
    with pytest.raises(ValueError):
        paging.size(201)


def test_arguments_are_checked(spark):
    for typed in ("a%", "_", "a\\", "x" * 18):
        with pytest.raises(ValueError):
            paging.starts_with("vin", typed)
    rows = spark.createDataFrame([("AB1", "open"), ("ab2", "open"), ("AB3", None)], "vin string, status string")
    assert [r.vin for r in rows.where(paging.starts_with("vin", " ab ")).collect()] == ["AB1", "AB3"]
    assert rows.where(paging.chosen({"status": ["open"]}, status="")).count() == 3 and rows.where(paging.chosen({"status": ["open"]}, status="open")).count() == 2
    for given in ({"status": "shut"}, {"vin": "AB1"}):
        with pytest.raises(ValueError):
            paging.chosen({"status": ["open"]}, **given)
    j = spark.createDataFrame([('{"k": 7, "s": "x", "b": true}',), ('{"k": 7.0}',), ("[]",), ("no json",), (None,)], "j string")
    assert [r.h for r in j.select(paging.holds("j", {"k": 7}).alias("h")).collect()] == [True, True, False, False, False]
    assert j.where(paging.holds("j", {"k": 7, "s": "x", "b": True})).count() == 1


def test_masks_and_changes(spark):
    e = spark.createDataFrame([('{"lat": 12.3456, "lon": -80.125, "route": [[1, 2]], "soc": 4}',), ('{"soc": "x"}',), ("broken",), (None,)], "e string")
    seen = [r.m for r in e.select(governance.mask_evidence(F.col("e"), False).alias("m")).collect()]
    assert "route" not in seen[0] and '"lat":12.35' in seen[0] and '"lon":-80.13' in seen[0] and '"soc":4' in seen[0] and seen[1] == '{"soc":"x"}' and seen[3] is None
    assert [r.m for r in e.select(governance.mask_evidence(F.col("e"), True).alias("m")).collect()] == [r.e for r in e.collect()]
    rows = spark.createDataFrame([(1, "proposed"), (2, "rejected"), (3, "proposed"), (4, None)], "plan long, status string")
    asked = spark.createDataFrame([(1,), (1,), (2,), (4,), (9,), (None,)], "plan long")
    done = {r.plan: (r.status, r.changed) for r in governance.transition(rows, asked, "plan", "proposed", "approved").collect()}
    assert done == {1: ("approved", True), 2: ("rejected", False), 3: ("proposed", False), 4: (None, False)}
    assert governance.transition(rows, asked, "plan", "approved", "approved").where("changed").count() == 0
    key = F.unhex(F.sha2(F.lit("k"), 256))
    s = spark.createDataFrame([("é",), ("",), (None,)], "t string").select("t", governance.sealed(F.col("t"), key).alias("s")).select("t", governance.opened(F.col("s"), key).alias("o"))
    assert all(r.t == r.o for r in s.collect())


def test_names_and_cells(spark):
    names = ["a", "", "é" * 30]
    ids = spark.createDataFrame([(n,) for n in names], "n string").select(C.uuid5(str(uuid.NAMESPACE_DNS), F.col("n")).alias("u")).collect()
    assert [r.u for r in ids] == [str(uuid.uuid5(uuid.NAMESPACE_DNS, n)) for n in names]
    rng = random.Random(2)
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(50)] + [(89.99, 0.0), (-89.99, 179.99), (0.0, -180.0)]
    rows = spark.createDataFrame(points, "lat double, lon double").withColumn("h", C.geohash(F.col("lat"), F.col("lon"), 5))
    rows = rows.select("*", C.geohash_bounds(F.col("h"), 5).alias("b"), C.geohash_centre(F.col("h"), 5).alias("c"), C.geohash_neighbours(F.col("h"), 5).alias("near")).collect()
    for r in rows:
        assert r.b.south <= r.lat <= r.b.north and r.b.west <= r.lon <= r.b.east
        assert r.c.lat == pytest.approx((r.b.south + r.b.north) / 2) and len(r.near) == len(set(r.near)) == (8 if abs(r.lat) < 89.9 else 5)
    around = [(r.c.lat + i * (r.b.north - r.b.south), (r.c.lon + j * (r.b.east - r.b.west) + 180) % 360 - 180) for r in rows[:50] for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]
    want = [r.h for r in spark.createDataFrame(around, "lat double, lon double").select(C.geohash(F.col("lat"), F.col("lon"), 5).alias("h")).collect()]
    assert [h for r in rows[:50] for h in r.near] == want
    odd = spark.createDataFrame([("u4pr",), ("u4pra",), (None,)], "h string").select(C.geohash_neighbours(F.col("h"), 5).alias("n"), C.geohash_centre(F.col("h"), 5).alias("c")).collect()
    assert all(r.n is None and r.c is None for r in odd)


def test_batches_spare_neighbours(spark):
    good, bad, cut = b"\x0a\x01a\x10\x96\x01", b"\xff\xff", b"\x12\x50ab"
    framed = lambda m: b"\x12" + bytes([len(m)]) + m
    batches = [(1, framed(good) + b"\x08\x05" + framed(bad) + framed(good)), (2, framed(good) + cut), (3, b""), (4, None), (5, framed(b""))]
    found = wire.decode(wire.split_batches(spark.createDataFrame(batches, "key int, payload binary"), "key", "payload", 2), "message", {1: ("vin", "string"), 2: ("seq", "long")}).collect()
    assert sorted((r.key, r.pos, r.ok, r.vin, r.seq) for r in found if r.ok) == [(1, 0, True, "a", 150), (1, 2, True, "a", 150), (5, 0, True, "", 0)]
    assert sorted((r.key, r.pos) for r in found if not r.ok) == [(1, 1), (2, -1)]
    lines = wire.split_lines(spark.createDataFrame([(1, " a \r\n\n  \nb"), (2, None), (3, "\t\n")], "key int, body string"), "key", "body").collect()
    assert [(r.key, r.pos, r.line) for r in lines] == [(1, 0, "a"), (1, 3, "b")]


def test_the_sink_counts_what_it_skips(spark):
    good = str(uuid.uuid4())
    rows = spark.createDataFrame([(good, "x" * 17), ("no", "x" * 17), (good, "short"), (None, None), (good, None)], "tenant_id string, vin string")
    marked, seen = ingest.storable(rows, "test")
    assert marked.where("reason IS NULL").count() == 1
    marked, seen = ingest.storable(rows, "again")
    marked.collect()
    assert seen.get == {"seen": 5, "bad_tenant": 2, "bad_vin": 2}


def test_dead_letters_keep_bytes(spark):
    rows = spark.createDataFrame([("a", "é" * 40_000, "MALFORMED", datetime(2024, 1, 1))], "oem string, payload string, error_class string, recv_ts timestamp")
    assert len(normalise.dead_letters(rows).first().original) == 65536


def test_running_totals_of_a_large_key(spark):
    rng = random.Random(4)
    rows = [("hot", i, rng.randrange(5)) for i in range(3000)] + [("b", 1, 4), ("b", 2, 0), (None, 1, 2), (None, 2, 3)]
    rng.shuffle(rows)
    found = ordered.running_total(spark.createDataFrame(rows, "k string, i int, n long").repartition(5), "k", ["i"], "n").collect()
    want, total = {}, Counter()
    for k, i, n in sorted(rows, key=lambda r: (r[0] is None, str(r[0]), r[1])):
        want[k, i] = total[k]
        total[k] += n
    assert {(r.k, r.i): (r.before, r.total) for r in found} == {(k, i): (b, total[k]) for (k, i), b in want.items()}
    q = ordered.quantile_by_index(spark.createDataFrame(rows, "k string, i int, n long"), "k", "n", 0.5).collect()
    for k in ("hot", "b", None):
        values = sorted(n for x, _, n in rows if x == k)
        assert [(r.q, r.n) for r in q if r.k == k] == [(values[int(0.5 * (len(values) - 1))], len(values))]


def test_neighbours_in_blocks_and_by_index(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(12, 16)) * 3
    v = (centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16))).astype(np.float32)
    v[5] = v[6] = v[700]
    rows = [(i, v[i].tolist()) for i in range(900)] + [(900, [0.0] * 16), (901, None)]
    df = spark.createDataFrame(rows, "id long, v array<float>").repartition(4)
    q = df.where("id % 20 = 0 OR id = 5 OR id > 899").select(F.col("id").alias("qid"), F.col("v").alias("q"))
    unit = v.astype(float) / np.sqrt((v.astype(float) ** 2).sum(1))[:, None]
    want = set()
    for i in [*range(0, 900, 20), 5]:
        c = np.round(unit @ unit[i], 12)
        want |= {(i, j, n) for n, j in enumerate([j for j in sorted(range(900), key=lambda j: (-c[j], j)) if j != i][:4], 1)}
    for block in (7, 4096):
        assert {(r.qid, r.id, r.rank) for r in vectors.top_neighbours(q, df, 4, block=block).collect()} == want
    middle = vectors.fit_cells(df, 24)
    index = vectors.indexed(df, middle)
    assert index.count() == 900
    for block in (7, 4096):
        found = {(r.qid, r.id) for r in vectors.search(q, index, middle, 4, probes=8, block=block).collect()}
        assert len(found & {x[:2] for x in want}) >= 0.9 * len(want)
    assert {(r.qid, r.id, r.rank) for r in vectors.search(q, index, middle, 4, probes=24).collect()} == want
    assert vectors.top_neighbours(q.limit(0), df, 4).count() == 0


def test_overlays_kept_up_equal_new_ones(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(40), rng.randrange(40), rng.randrange(1, 5)) for _ in range(70)]
    df = spark.createDataFrame(edges, "a long, b long, len long")
    nodes = lambda s: spark.createDataFrame([(n,) for n in s], "node long")
    rows = lambda o: {(r.node, r.dist, r.source) for r in o.collect()}
    opened = {3, 11}
    overlay = graph.nearest_source(df, nodes(opened))
    for step in range(4):
        if step % 2:
            gone = set(rng.sample(sorted(opened), 2))
            overlay, opened = graph.remove_sources(df, overlay, nodes(gone | {39})), opened - gone - {39}
        else:
            new = {rng.randrange(40) for _ in range(4)}
            overlay, opened = graph.add_sources(df, overlay, nodes(new)), opened | new
        overlay = scratch.stored(overlay)
        assert rows(overlay) == rows(graph.nearest_source(df, nodes(opened)))


def test_ways_between_any_two_nodes(spark):
    rng = random.Random(8)
    at = {n: (rng.uniform(0, 100), rng.uniform(0, 100)) for n in range(60)}
    length = lambda a, b: int(((at[a][0] - at[b][0]) ** 2 + (at[a][1] - at[b][1]) ** 2) ** 0.5) + 1
    edges = {(a, b): length(a, b) for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(150)) if a != b}
    near = {}
    for (a, b), n in edges.items():
        near.setdefault(a, []).append((b, n))
        near.setdefault(b, []).append((a, n))

    def dist(a, b):
        best, todo = {}, [(0, a)]
        while todo:
            d, n = heapq.heappop(todo)
            if n not in best:
                best[n] = d
                for m, k in near.get(n, []):
                    heapq.heappush(todo, (d + k, m))
        return best.get(b)

    pairs = [(i, rng.randrange(60), rng.randrange(60)) for i in range(15)] + [(20, 4, 4), (21, 4, 999), (22, None, 3)]
    df = spark.createDataFrame([(a, b, n) for (a, b), n in edges.items()], "a long, b long, len long")
    p = spark.createDataFrame(pairs, "id long, a long, b long")
    places = spark.createDataFrame([(n, x, y) for n, (x, y) in at.items()], "node long, x double, y double")
    for where in (None, places):
        ways = {}
        for r in routes.shortest_ways(df, p, where).collect():
            ways.setdefault(r.id, []).append((r.step, r.node, r.dist))
        for i, a, b in pairs:
            d = dist(a, b) if a is not None and b != 999 else None
            if d is None:
                assert i not in ways
                continue
            way = sorted(ways[i])
            assert [s for s, _, _ in way] == list(range(len(way))) and way[0][1:] == (a, 0) and way[-1][1:] == (b, d)
            assert all(min(k for m, k in near[x[1]] if m == y[1]) == y[2] - x[2] for x, y in zip(way, way[1:], strict=False))


def test_a_rotating_filter_forgets(spark):
    r = sketches.Rotating(10, 1e-6)
    assert not any(r.seen(str(i)) for i in range(10)) and all(r.seen(str(i)) for i in range(10))
    assert not any(r.seen(str(i)) for i in range(10, 20)) and all(r.seen(str(i)) for i in range(20))
    assert not r.seen("x") and not r.seen("0") and r.seen("x")


def test_streams_in_many_triggers(spark, tmp_path):
    """One file a trigger, twice over the same folders: the last status of each charger, and each key once."""
    rows = [(i % 7, f"s{i}", i) for i in range(60)]
    for n in range(3):
        spark.createDataFrame(rows[n * 20 : n * 20 + 20], "charger long, status string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("charger long, status string, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    want = {c: s for c, s, _ in rows}
    assert {r.charger: r.status for r in state.status_snapshot(stream(), "charger", "status", "n", out, check).collect()} == want
    spark.createDataFrame([(3, "later", 99), (50, "new", 100)], "charger long, status string, n long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    assert {r.charger: r.status for r in state.status_snapshot(stream(), "charger", "status", "n", out, check).collect()} == want | {3: "later", 50: "new"}
    once = [(r.charger, r.n) for r in state.upsert_stream(stream(), ["charger"], "n").collect()]
    assert len(once) == len({c for c, _ in once}) == 8
    assert table_stream(spark, f"{DATA}/sf0.001", "events", max_files=1).isStreaming


def test_records_and_months(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a,"b\n', 1.5, datetime(2024, 1, 31, 23, 59, 59, 7)), (2, None, None, datetime(2024, 2, 1)), (3, "é", -0.0, datetime(2024, 2, 29))], "id long, t string, x double, at timestamp_ntz")
    files.write_records(rows, str(tmp_path / "json"), "json")
    assert sorted(files.read_records(spark, str(tmp_path / "json"), "json", rows.schema).collect()) == sorted(rows.collect())
    plain = rows.withColumn("t", F.regexp_replace("t", "[\n\"]", ""))
    files.write_records(plain, str(tmp_path / "csv"), "csv")
    assert sorted(files.read_records(spark, str(tmp_path / "csv"), "csv", plain.schema).collect()) == sorted(plain.collect())
    with pytest.raises(ValueError):
        files.write_records(rows, str(tmp_path / "x"), "xml")
    files.store_by_month(rows, "at", str(tmp_path / "months"))
    found = files.months(spark, str(tmp_path / "months"), F.col("month") == "2024-02")
    assert {r.id for r in found.collect()} == {2, 3} and "PartitionFilters: [isnotnull(month" in found._jdf.queryExecution().toString()
    h = files.made_up_history(spark, 20, 30, tenants=4)
    files.store_history(h, str(tmp_path / "h"), 2)
    assert spark.read.parquet(str(tmp_path / "h")).groupBy("vin").count().where("count = 30").count() == 20 and h.select("tenant").distinct().count() == 4


def test_bootstrap_intervals(spark):
    rng = random.Random(3)
    rows = [(v, int(1000 * rng.gauss(5, 2))) for v in range(80) for _ in range(rng.randint(1, 6))]
    means = sorted(r["mean"] for r in evaluation.bootstrap(spark.createDataFrame(rows, "k int, d long"), "k", "d", 400).collect())
    mean = sum(d for _, d in rows) / len(rows)
    assert len(means) == 400 and means[10] < mean < means[390] and 200 < means[390] - means[10] < 1500


def test_scratch_folders(spark):
    a = scratch.stored(spark.range(3))
    assert a.count() == 3 and spark.sparkContext.applicationId in a.inputFiles()[0]

    class Cluster:
        conf = type("Conf", (), {"get": staticmethod(lambda k, d=None: d)})
        sparkContext = type("Context", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError):
        scratch.folder(Cluster)
