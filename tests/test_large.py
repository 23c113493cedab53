"""What larger tables bring: more rows of a key, of a place, of a message. Each test failed before the finding that it names was mended."""


def test_nodes_that_lie_thick_meet_few_points(spark):  # F4
    import random

    from fleetloom.operators import routes

    rng = random.Random(5)
    nodes = [(i, rng.choice([rng.random(), rng.random() * 0.01]), rng.choice([0.0, rng.random() * 0.01])) for i in range(3000)] + [(i, 0.5, 0.5) for i in range(3000, 6000)] + [(6000, -0.9, 0.9)]
    places = [(i, rng.random() * 0.02, rng.random() * 0.02) for i in range(100)] + [(i, rng.random(), rng.random()) for i in range(100, 200)] + [(200, 9.0, 9.0), (201, None, 0.0), (202, -0.8, 0.8)]
    sizes, real = [], routes._nearest
    routes._nearest = lambda p, n, w, many: sizes.append((p.count(), n.count(), w)) or real(p, n, w, many)
    try:
        got = {r.id: (r.node, r.d2) for r in routes.snap(spark.createDataFrame(places, "id long, x double, y double"), spark.createDataFrame(nodes, "node long, nx double, ny double"), 1.0).collect()}
    finally:
        routes._nearest = real
    near = lambda x, y: min(((x - a) * (x - a) + (y - b) * (y - b), n) for n, a, b in nodes)
    assert got == {i: (None, None) if x is None or x > 5 else near(x, y)[::-1] for i, x, y in places}
    # One row a place, finer cells first, and few points in the widest ones.
    assert all(n <= 3002 for _, n, _ in sizes) and sizes[0][2] < 0.1 and sizes[-1][2] == 1.0 and sizes[-1][0] < 60


def test_heavy_hitters_among_many_vehicles(spark, tmp_path):  # F7
    from oracle import same
    from pyspark.sql import functions as F

    from fleetloom.plans.fleet import ORACLES, QUERIES

    e = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    e.withColumn("user_id", F.col("user_id") * 60 + F.col("event_id") % 60).coalesce(1).write.parquet(str(tmp_path / "dir"))
    next((tmp_path / "dir").glob("*.parquet")).rename(tmp_path / "events.parquet")
    assert same(QUERIES["heavy_hitters"](spark, str(tmp_path)), ORACLES["heavy_hitters"], str(tmp_path)) == 10


def test_a_digest_of_one_level(spark):  # F8
    import hashlib

    from fleetloom.operators import ordered

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = [f"line {i * 7919 % 3000}" for i in range(3000)]
    stretches, now = [], []
    for d in (sha(f"{x}|1") for x in sorted(lines)):
        now.append(d)
        if int(d[:8], 16) % 4 == 0:
            stretches.append(now)
            now = []
    whole = sha("\n".join(sha("\n".join(s)) for s in [*stretches, *([now] if now else [])]))
    df = spark.createDataFrame([(x,) for x in lines], "line string")
    assert tuple(ordered.sequence_digest(df, width=4, last=50, levels=1).first()) == (3000, whole)
    assert ordered.sequence_digest(df, width=4, last=50).first().digest != whole


def test_a_message_is_parsed_once(spark):  # F3, F10
    from fleetloom.plans.fleet import QUERIES

    spark.conf.set("spark.sql.maxPlanStringLength", 10_000_000)
    for name in ("normalise_dialects", "dlq_by_class"):
        plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert 2 <= plan.count("from_json(") <= 4
    spark.conf.unset("spark.sql.maxPlanStringLength")


def test_upserts_take_no_python_step_a_key(spark, tmp_path):  # F5
    import time

    from fleetloom.streaming import state

    src = str(tmp_path / "in")
    spark.range(30_000).selectExpr("id % 15000 AS k", "30000 - id AS n", "id AS was").coalesce(1).write.parquet(src)
    time.sleep(1.1)
    spark.createDataFrame([(5, -1, 0), (20_000, None, 1), (20_000, 7, 2), (20_000, 9, 3), (None, 1, 4)], "k long, n long, was long").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("k long, n long, was long").option("maxFilesPerTrigger", 1).parquet(src)
    began = time.monotonic()
    got = sorted(tuple(r) for r in state.upsert_stream(stream, ["k"], "n").where("k IS NOT NULL").collect())
    # What comes later changes nothing, also with a smaller number; of one trigger the smallest stays.
    assert got == [(k, 15_000 - k, 15_000 + k) for k in range(15_000)] + [(20_000, 7, 2)]
    assert time.monotonic() - began < 30
    assert state.upsert_stream(stream.where("k = -1"), ["k"], "n").count() == 0


def test_plans_are_dealt_to_many_tasks(spark):  # F12 to F16
    from fleetloom.operators import charging

    v = spark.range(800).selectExpr("id AS vin", "id % 200 AS charger", "11D AS power", "50D AS capacity", "CAST(30 + id % 40 AS DOUBLE) AS soc")
    plans = charging.charge_plan(v, [5.0, 7.0] * 8)
    # Rows of a few bytes are put into one task by their bytes; the plans of each take milliseconds.
    from pyspark.sql import functions as F

    assert plans.withColumn("task", F.spark_partition_id()).select("task").distinct().count() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_chargers_at_one_place_dont_all_meet_a_vehicle(spark, tmp_path):  # F20
    from oracle import same
    from pyspark.sql import functions as F

    from fleetloom.plans.fleet import ORACLES, QUERIES

    for name, rows in (("events", spark.read.parquet("/root/testdata/sf0.01/events.parquet")), ("supplier", spark.range(3000).select(F.col("id").alias("s_suppkey")))):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
        next((tmp_path / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = QUERIES["nearest_chargers_box"](spark, str(tmp_path))
    assert same(got, ORACLES["nearest_chargers_box"], str(tmp_path)) > 0
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("row_number()") >= 2  # at each place of chargers, then about each place of vehicles


def test_edges_are_turned_both_ways_once(spark):  # F1, F18
    from fleetloom.operators import graph

    e = graph.both_ways(spark.createDataFrame([(1, 2, 5), (2, 1, 3), (1, 2, 4), (3, 3, 1), (None, 1, 1), (4, 1, None)], "a long, b long, len long"))
    assert sorted(tuple(r) for r in e.collect()) == [(1, 2, 3), (2, 1, 3), (3, 3, 1)]
    assert graph.both_ways(e) is e


def test_tables_that_pack_well_are_not_broadcast(spark):  # F6, F2
    from pyspark.sql import functions as F

    from fleetloom.operators import routes
    from fleetloom.sources.scratch import stored

    few = stored(spark.range(400_000).select((F.col("id") * 7919 % 400_000).alias("id"), F.lit(1.0).alias("x"), F.lit(1.0).alias("y")))
    size = lambda df: int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    files = sum(f.getLen() for f in spark._jvm.org.apache.hadoop.fs.Path(few.inputFiles()[0]).getParent().getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(spark._jvm.org.apache.hadoop.fs.Path(few.inputFiles()[0]).getParent()))
    assert size(few) > 3 * files
    nodes = spark.range(10).selectExpr("id AS node", "1D AS nx", "CAST(id AS DOUBLE) AS ny")
    joins = lambda many: routes._nearest(few.limit(5), nodes, 1.0, many)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in joins(True) and "BroadcastHashJoin" not in joins(True)


def test_a_stream_of_samples_turns_its_road_once(spark, tmp_path, monkeypatch):  # F2
    from fleetloom.operators import graph
    from fleetloom.streaming import overlay

    made, real = [], graph.both_ways
    monkeypatch.setattr(graph, "both_ways", lambda e: made.append(getattr(e, "_both_ways", False)) or real(e))
    rows = "n long, node long, open boolean"
    spark.createDataFrame([(1, 2, None)], rows).write.parquet(str(tmp_path / "in"))
    edges, chargers = spark.createDataFrame([(1, 2, 5)], "a long, b long, len long"), spark.createDataFrame([(1, True)], "node long, open boolean")
    overlay.place_samples(spark.readStream.schema(rows).parquet(str(tmp_path / "in")), edges, chargers, str(tmp_path / "kept"), str(tmp_path / "checkpoint"))
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "kept/met/0")).select("n", "node", "dist", "source").collect()] == [(1, 2, 5, 1)]
    assert made.count(False) == 1


def test_words_of_texts_are_hashed_once(spark, monkeypatch):  # F17
    import hashlib
    import random
    from collections import Counter

    import pyarrow as pa

    from fleetloom.operators import text_vectors

    rng = random.Random(2)
    vocabulary = ["ab", "abc", "größe", "naïveté", "x1", "東京都庁", *("".join(rng.choices("abcdé", k=rng.randrange(2, 9))) for _ in range(60))]
    texts = [[rng.choice(vocabulary) for _ in range(n)] for n in (0, 1, 2, 700, 3, 40, 0, 5, 250)]
    want = Counter()
    for i, t in enumerate(texts):
        for f, weight in [(f"w:{w}", 20) for w in t] + [(f"c:{w[j:j + 3]}", 5) for w in t for j in range(len(w) - 2)] + [(f"b:{x}_{y}", 14) for x, y in zip(t, t[1:], strict=False)]:
            h = hashlib.md5(f.encode()).hexdigest()
            want[i, int(h[:8], 16) % 384] += -weight if h[8] >= "8" else weight
    want = {k: v for k, v in want.items() if v}
    rows = pa.record_batch([pa.array(range(len(texts)), pa.int64()), pa.array(texts, pa.list_(pa.string()))], names=["id", "t"])
    asked, real = [], text_vectors._hashed
    monkeypatch.setattr(text_vectors, "_hashed", lambda f, *a: asked.extend(f) or real(f, *a))
    for words, lines in ((1 << 18, 4096), (100, 4096), (1, 4096), (1 << 18, 1)):
        monkeypatch.setattr(text_vectors, "TOKENS", words)
        monkeypatch.setattr(text_vectors, "ROWS", lines)
        got, asked[:] = Counter(), []
        for b in text_vectors._summed(384)(iter([rows, rows.slice(0, 0)])):
            for r in b.to_pylist():
                got[r["id"], r["slot"]] += r["value"]
        assert {k: v for k, v in got.items() if v} == want
        assert words < 1000 or lines == 1 or len(asked) == len(set(asked))
    df = spark.createDataFrame([(1, "The Cats, cats & dogs"), (1, "Dogs"), (2, None), (3, "the"), (None, "İstanbul ab")], "id long, text string")
    found = text_vectors.text_vectors(df).collect()
    assert {r.id for r in found} == {1, None} and sum(r.value for r in found if r.id == 1) % 1 == 0 and all(r.value for r in found)


def test_a_search_holds_few_cosines(spark):  # F22
    import tracemalloc
    from types import SimpleNamespace

    import numpy as np
    import pyarrow as pa

    from fleetloom.operators import vectors

    rng = np.random.default_rng(3)
    v = rng.integers(-9, 9, (1500, 8)).astype(float)
    v[700:] = v[:800]  # ties
    ids = rng.permutation(1500)
    rows = pa.record_batch([pa.array(ids), pa.array(list(v))], names=["id", "v"])
    _, unit = vectors.unit_rows(rows.column("v"))
    qids, q = ids[:1024], unit[:1024]
    shared = SimpleNamespace(value=(np.tile(qids, 4), np.tile(q, (4, 1)), None))
    tracemalloc.start()
    (got,) = vectors._searcher(shared, 5)(iter([rows]))
    _, peak = tracemalloc.get_traced_memory()
    tracemalloc.stop()
    assert peak < 60e6 and got.num_rows == 5 * 4096
    cosine = np.round(q @ unit.T, 12)
    want = {(int(i), int(ids[r])) for i, c in zip(qids, cosine, strict=True) for r in [r for r in np.lexsort((ids, -c)) if ids[r] != i][:5]}
    assert {(r["qid"], r["id"]) for r in got.to_pylist()} == want


def test_short_lines_take_no_rounds(spark, monkeypatch):  # F21
    import random

    from test_ways import recursive

    from fleetloom.operators import routes

    rng = random.Random(7)
    lines = {k: [(i, float(rng.randrange(9)), float(rng.randrange(60))) for i in range(n)] for k, n in enumerate([1, 2, 3, 300, 5, 700, 2, *[40] * 30, 12])}
    df = spark.createDataFrame([(k, *p) for k, line in lines.items() for p in line], "key long, i long, x double, y double").repartition(3)
    want = sorted((k, *p) for k, line in lines.items() for p in recursive(line, 9.0))
    written, real = [], routes.stored
    monkeypatch.setattr(routes, "stored", lambda rows: written.append(1) or real(rows))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)  # lines go on in later batches
    try:
        assert sorted(tuple(r) for r in routes.simplified(df, 9.0).collect()) == want and len(written) == 2
        monkeypatch.setattr(routes, "WHOLE", 100)
        assert sorted(tuple(r) for r in routes.simplified(df, 9.0).collect()) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_ends_of_a_road_go_at_once(spark, monkeypatch):  # F11
    import random

    from test_ways import dijkstra

    from fleetloom.operators import graph

    rng = random.Random(12)
    edges = [(i, i + 1, rng.randrange(1, 9)) for i in range(200)] + [(i % 201, 1000 + i, rng.randrange(1, 9)) for i in range(1500)] + [(3000, 3001, 2), (3003, 3002, 4), (3004, 3004, 1), (3005, 3004, 6), (3006, 3005, 1)]
    sources = [5, 150, 1007, 3001]
    met, real = [], graph.contracted
    monkeypatch.setattr(graph, "contracted", lambda e, *given, **options: met.append(e.count()) or real(e, *given, **options))
    df, s = spark.createDataFrame(edges, "a long, b long, len long"), spark.createDataFrame([(x,) for x in sources], "node long")
    got = sorted((r.node, r.dist, r.source) for r in graph.nearest_by_shortcuts(df, s).collect())
    assert got == sorted((n, *at) for n, at in dijkstra(edges, sources).items())
    # The road both ways, the source beside it, and what is left of the two ends' own edges.
    assert met[0] <= 2 * 203


def test_training_rows_are_dealt_by_their_number(spark, monkeypatch):  # F19
    import pytest

    from fleetloom.plans import stateful

    class Seen(Exception):
        pass

    def fit(self, train):
        raise Seen(train.rdd.getNumPartitions())

    monkeypatch.setattr(stateful.GBTRegressor, "fit", fit)
    monkeypatch.setattr(stateful, "TASK_ROWS", 100, raising=False)
    with pytest.raises(Seen) as seen:
        stateful.range_model(spark, "/root/testdata/sf0.001")
    assert seen.value.args[0] >= 50


def test_codes_find_the_nearest_of_many_alike(spark):  # F3
    """In families of alike vectors the fifth nearest is hardly nearer than the fiftieth: one level of words mistakes them, three don't."""
    import numpy as np
    from pyspark.sql import functions as F

    from fleetloom.operators import quantise

    rng = np.random.default_rng(11)
    v = np.abs(rng.normal(size=(6, 96)))[np.arange(4000) % 6] * 3 + rng.normal(size=(4000, 96)) ** 3 * 0.3
    df = spark.createDataFrame([("t", i, x.tolist()) for i, x in enumerate(v)], "tenant string, id long, v array<double>")
    v /= np.linalg.norm(v, axis=1)[:, None]
    c = v[::40] @ v.T
    c[np.arange(100), np.arange(0, 4000, 40)] = -1
    fifth = {i * 40: x for i, x in enumerate(np.sort(c, 1)[:, -5])}
    hits = {}
    for levels in (1, 3):
        books = quantise.fit_books(df, cells=4, parts=24, **({} if levels == 1 else {"levels": levels}))
        found = quantise.tenant_search(df.where("id % 40 = 0").select(F.col("id").alias("qid"), "tenant", F.col("v").alias("q")), quantise.tenant_index(df, books), books, 5, probes=4, rerank=50).collect()
        assert all(r.compared == 50 for r in found)
        hits[levels] = sum(r.cosine >= fifth[r.qid] - 1e-9 for r in found)
    assert hits[1] < 475 <= hits[3]


def test_the_audit_sees_all_plans_at_a_charger(spark, monkeypatch):  # F5
    """All but the first vehicle of each charger are said to have no way to the target, though slots are free."""
    import numpy as np

    from fleetloom.operators import charging
    from fleetloom.plans import evaluation

    def none_if_late(capacity, start, target, power, price):
        return None if np.isinf(price).any() else charging.cheapest(capacity, start, target, power, price)

    real = charging.charge_plan
    dealt = lambda v, prices, **more: real(v, prices, **({"way": none_if_late} | more))
    honest = evaluation.charge_plan_audit(spark, "/root/testdata/sf0.01").first()
    monkeypatch.setattr(charging, "charge_plan", dealt)
    got = evaluation.charge_plan_audit(spark, "/root/testdata/sf0.01").first()
    assert honest.dearer == 0 and (got.vehicles, got.wrong_energy, got.double_booked) == (honest.vehicles, 0, 0) and got.dearer > 0


def test_the_road_is_cut_to_what_lies_about_the_ends(spark):  # F1
    """Parts that don't hang together, loops, parallel edges: ways in the cut are as short as in the whole, and most of the rest is gone."""
    import heapq
    import random

    from fleetloom.operators import routes

    rng = random.Random(8)
    edges = [(rng.randrange(200), rng.randrange(200), rng.randrange(1, 9)) for _ in range(1200)] + [(i, i + 1, 20) for i in range(400, 403)] + [(7, None, 1), (3, 4, None), (600, 600, 2)]
    pairs = [(1, 2), (30, 170), (5, 5), (400, 403), (3, 400), (600, 1), (999, 1), (None, 1)]

    def far(rows, a, b):
        seen, heap = set(), [(0, a)]
        while heap:
            d, n = heapq.heappop(heap)
            if n == b:
                return d
            if n not in seen:
                seen.add(n)
                for x, y, w in rows:
                    if None not in (x, y, w) and n in (x, y):
                        heapq.heappush(heap, (d + w, y if n == x else x))

    cut = [tuple(r) for r in routes.within_reach(spark.createDataFrame(edges, "a long, b long, len long"), spark.createDataFrame(pairs, "a long, b long")).collect()]
    assert not set(cut) - set(edges) and len(cut) < 100
    assert [far(cut, *p) for p in pairs[:-1]] == [far(edges, *p) for p in pairs[:-1]]


def test_vectors_are_coded_once(spark):  # F4
    """Sampling the ranges of an index must not make its rows a second time."""
    from pyspark.sql import functions as F

    from fleetloom.operators import quantise

    made = spark.sparkContext.accumulator(0)

    @F.udf("array<double>")
    def v(i):
        made.add(1)
        return [float(i % 7 + 1), float(i % 11), float(i % 13)]

    df = spark.range(500).select((F.col("id") % 3).alias("tenant"), "id", v("id").alias("v"))
    books = quantise.fit_books(df, cells=2, parts=3)
    before = made.value
    assert quantise.tenant_index(df, books).count() == 500 and made.value - before == 500
