"""Logs with offsets, overlays that statuses move on while samples come, and state that ends with silence."""

import json
import random

import pytest
from pyspark.sql import functions as F

from fleetloom.operators import graph
from fleetloom.sources import log
from fleetloom.sources.scratch import folder, stored
from fleetloom.streaming import event_time, overlay, state


def numbers(spark, first, end):
    return spark.range(first, end).select("id", (F.col("id") % 17).alias("k"))


def put(df, path):
    log.append(df, path, F.col("k"), F.col("id").cast("string"), F.col("id"))


def values(df):
    return sorted(int(r.value) for r in df.select("value").collect())


def test_log_offsets_and_starts(spark):
    path = folder(spark)
    log.create(path, 3)
    assert values(log.read_log(spark, path)) == []
    put(numbers(spark, 0, 100), path)
    put(numbers(spark, 100, 100), path)  # nothing
    first = log.ends(log.segments(path), 3)
    put(numbers(spark, 100, 250), path)
    rows = log.read_log(spark, path).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.offset):
        by.setdefault(r.partition, []).append((r.offset, int(r.value)))
    for got in by.values():  # offsets without gaps, in order of arrival
        assert [o for o, _ in got] == list(range(len(got))) and [v for _, v in got] == sorted(v for _, v in got)
    assert len({(r.partition, r.key) for r in rows}) == 17
    assert values(log.read_log(spark, path, ending=json.dumps(first))) == list(range(100))
    assert values(log.read_log(spark, path, starting=json.dumps(first))) == list(range(100, 250))
    assert values(log.read_log(spark, path, starting="latest")) == []
    out, checkpoint = folder(spark), folder(spark)
    stream = log.stream_log(spark, path, starting="latest")
    assert values(state.drain(stream, out, checkpoint)) == []
    put(numbers(spark, 250, 260), path)
    assert values(state.drain(log.stream_log(spark, path, starting="latest"), out, checkpoint)) == list(range(250, 260))
    spark.range(1).select(F.lit(None).cast("long").alias("k"), F.lit(260).alias("id")).transform(lambda d: put(d, path) or d)
    assert [(r.key, r.value) for r in log.read_log(spark, path, starting=json.dumps(log.ends([s for s in log.segments(path) if s["last"] < 10**9][:-1], 3))).where("key IS NULL").collect()] == [(None, "260")]


def test_append_that_fails_leaves_nothing(spark, monkeypatch):
    path = folder(spark)
    log.create(path, 2)
    put(numbers(spark, 0, 10), path)
    with monkeypatch.context() as m:
        m.setattr(log, "_put", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            put(numbers(spark, 10, 20), path)
    assert values(log.read_log(spark, path)) == list(range(10))
    put(numbers(spark, 10, 20), path)
    assert values(log.read_log(spark, path)) == list(range(20))


def test_bounded_triggers_and_a_stream_that_is_killed(spark):
    path, out, checkpoint, progress = (folder(spark) for _ in range(4))
    log.create(path, 2)
    put(numbers(spark, 0, 100), path)
    failing = {"left": 2}

    def write(rows, batch):
        failing["left"] -= 1
        if failing["left"] == 0:
            raise RuntimeError("lost")
        rows.write.mode("overwrite").parquet(f"{out}/{batch}")

    sizes = []
    for _ in range(20):
        stream = log.stream_log(spark, path, per_trigger="20", progress=progress)
        q = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        try:
            q.awaitTermination()
        except Exception:
            assert failing["left"] == 0
        sizes += [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        if (found := values(spark.read.schema(log.SCHEMA).option("recursiveFileLookup", "true").parquet(out)) if sizes else []) == list(range(100)):
            break
    assert found == list(range(100)) and max(sizes) <= 40


def brute_overlay(edges, sources):
    best = {s: (0, s) for s in sources}
    moved = True
    while moved:
        moved = False
        for a, b, n in edges:
            for x, y in ((a, b), (b, a)):
                if x in best and (at := (best[x][0] + n, best[x][1])) < best.get(y, (10**9, 0)):
                    best[y], moved = at, True
    return best


def test_versions_of_an_overlay_are_those_made_anew(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randint(1, 9)) for _ in range(90)] + [(100, 101, 3), (0, 0, 1)]
    base = {3, 9, 14, 100}
    e = graph.both_ways(spark.createDataFrame(edges, "a long, b long, len long"))
    at = graph.nearest_source(spark.createDataFrame(edges, "a long, b long, len long"), spark.createDataFrame([(s,) for s in base], "node long"))
    versions = {1: base - {3}, 2: (base - {3, 9}) | {20, 21}, 3: set(), 4: base | {40, 101}, 5: {100}}
    changes = [(v, n, n in s) for v, s in versions.items() for n in s ^ base]
    changed = stored(graph.overlay_versions(e, stored(at), spark.createDataFrame(changes, "version int, node long, open boolean")))
    for v, s in versions.items():
        now = graph.moved_on(at, changed.where(F.col("version") == v)).collect()
        assert {r.node: (r.dist, r.source) for r in now} == brute_overlay(edges, s)
    rows = {(r.version, r.node): (r.dist, r.source) for r in changed.collect()}
    was = brute_overlay(edges, base)
    assert all(was.get(n) != (d if d[0] is not None else None) for (_, n), d in rows.items())  # only what differs


def test_samples_see_the_statuses_before_them_and_a_trigger_that_dies_changes_nothing(spark, monkeypatch):
    rng = random.Random(8)
    edges = [(i, i + 1, rng.randint(1, 9)) for i in range(30)]
    chargers = {0: True, 15: True, 30: False}
    rows, n = [], 0
    for _ in range(120):
        n += 1
        rows.append((n, rng.choice([0, 15, 30, 77]), rng.random() < 0.5) if rng.random() < 0.2 else (n, rng.choice([*range(31), 99]), None))
    open_, want = dict(chargers), {}
    for i, node, status in rows:
        if status is None:
            want[i] = brute_overlay(edges, {c for c, o in open_.items() if o}).get(node, (None, None))
        elif node in open_:
            open_[node] = status
    source, path, checkpoint = (folder(spark) for _ in range(3))
    e, c = spark.createDataFrame(edges, "a long, b long, len long"), spark.createDataFrame(list(chargers.items()), "node long, open boolean")
    schema = "n long, node long, open boolean"
    dies = {"in": 1}
    publish = overlay._publish

    def failing(df, to):
        if "/met/" in to:
            dies["in"] -= 1
            if dies["in"] == 0:
                raise OSError("lost")
        publish(df, to)

    monkeypatch.setattr(overlay, "_publish", failing)
    for part in range(3):
        spark.createDataFrame(rows[part * 40 : part * 40 + 40], schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        if part == 1:
            dies["in"] = 1
        if part in (0, 1):
            with pytest.raises(Exception, match="lost"):
                overlay.place_samples(stream, e, c, path, checkpoint)
        overlay.place_samples(stream, e, c, path, checkpoint)
    met = spark.read.schema("n long, node long, dist long, source long").option("recursiveFileLookup", "true").parquet(f"{path}/met").collect()
    assert len(met) == len(want) and {r.n: (r.dist, r.source) for r in met} == want
    # A trigger that had ended and runs again gives nothing twice.
    overlay.OverlayTrigger(e, e, c, path)(spark.createDataFrame(rows[:40], schema), 0)
    assert len(spark.read.option("recursiveFileLookup", "true").parquet(f"{path}/met").collect()) == len(want)


def test_state_of_silent_vehicles_ends(spark):
    """Of 60 vehicles heard of in turn, each for a day, the state holds the last few; verdicts don't depend on triggers."""
    day = 86_400
    rows = [(v, v * day + i * 60, s, v * 100 + i) for v in range(60) for i, s in enumerate((1, 2, 3, 2))] + [(0, 59 * day, 2, 9000), (1, 59 * day - 7200, 9, 9001)]
    arrivals = [(v, t, t + (5400 + 1 if n == 9001 else 10), s, n) for v, t, s, n in rows]
    schema = "vin long, t long, r long, seq long, n long"
    source, path, checkpoint = (folder(spark) for _ in range(3))
    held, late = [], None
    for part in range(6):
        mine = [a for a in arrivals if a[0] // 10 == part and a[4] < 9000] + [a for a in arrivals if part == 5 and a[4] >= 9000]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).select("vin", F.timestamp_seconds("t").alias("ts"), F.timestamp_seconds("r").alias("recv"), "seq", "n")
        verdicts, late, progress = event_time.drain_with_late(stream, path, checkpoint, delay_s=day)
        held.append(progress[-1]["stateOperators"][0]["numRowsTotal"])
    by = {r.n: r.verdict for r in verdicts.collect()}
    assert all([by[v * 100 + i] for i in range(4)] == ["new"] * 3 + ["duplicate"] for v in range(60)) and by[9000] == "new"  # number 2 again, after days of silence
    assert [r.n for r in late.collect()] == [9001] and 9001 not in by
    print("rows of state", held)
    assert len(held) == 6 and max(held[1:]) <= 3 * 14 and held[-1] < 3 * 60  # value, timer and its index for each vehicle heard of lately
