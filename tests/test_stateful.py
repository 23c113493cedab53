import itertools
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from fleetloom.functions import columns as C
from fleetloom.operators import chain, charging, folds, graph, normalise, sketches
from fleetloom.plans import stateful
from fleetloom.streaming import state


def test_broken_links_are_found(spark):
    rows = spark.createDataFrame([(t, i, f"line {t} {i}") for t in range(3) for i in range(20)], "tenant long, id long, line string")
    sealed = folds.seal(rows)
    assert chain.broken_links(sealed).count() == 0
    changed = sealed.withColumn("line", F.when((F.col("tenant") == 1) & (F.col("id") == 7), "x").otherwise(F.col("line")))
    assert chain.broken_links(changed).collect() == [(1, 7)]
    assert chain.broken_links(sealed.where("NOT (tenant = 2 AND id = 4)")).collect() == [(2, 5)]


def test_range_alerts_of_known_runs(spark):
    def run(rows):
        cols = "vin long, epoch long, seq long, odo double, soc double, state string, catalogue double, distance double"
        return [(r.seq, r.rule) for r in folds.range_alerts(spark.createDataFrame(rows, cols)).orderBy("seq").collect()]

    still = lambda i, soc, d, s="NONE": (1, 10_000 + i, i, 5.0, soc, s, 1.0, d)
    assert run([still(1, 10.0, 50.0)]) == []  # one sample doesn't confirm
    assert run([still(i, 10.0, 50.0) for i in (1, 2, 3)]) == [(2, "RANGE_CRITICAL")]
    assert run([still(i, 50.0, 40.0) for i in (1, 2, 3)]) == [(2, "RANGE_LOW")]
    assert run([still(i, 10.0, 50.0, "CHARGING") for i in (1, 2, 3)]) == []
    assert run([(1, 900 * i, i, 5.0, 10.0, "NONE", 1.0, 50.0) for i in (1, 2, 3)]) == [(2, "RANGE_CRITICAL"), (3, "RANGE_CRITICAL")]


def brute(capacity, start, target, power, price):
    top = min(int(np.ceil((target - start) / 0.25 - 1e-9)), int((capacity - start) / 0.25 + 1e-9))
    best = None
    for steps in itertools.product(range(top + 1), repeat=len(price)):
        if sum(steps) != top:
            continue
        e, cost, fits = start, 0.0, True
        for k, p in zip(steps, price):
            fits &= k * 0.25 <= power * 0.25 * 0.93 * float(charging.taper(np.array(e / capacity))) + 1e-9 and not (k and np.isinf(p))
            cost, e = cost + (p * k * 0.25 / 0.93 if k else 0), e + k * 0.25
        if fits and (best is None or cost < best):
            best = cost
    return best


def test_charge_plans_are_the_cheapest():
    rng = random.Random(1)
    for _ in range(60):
        capacity, power = rng.uniform(3, 5), rng.choice([2.0, 4.0, 7.0])
        start = rng.uniform(0.4, 0.8) * capacity
        price = np.array([rng.choice([4.5, 7.0, 12.0, np.inf]) for _ in range(4)])
        got, want = charging.cheapest(capacity, start, min(capacity, start + 1.2), power, price), brute(capacity, start, min(capacity, start + 1.2), power, price)
        assert (got is None) == (want is None) and (got is None or got[0] == pytest.approx(want))


def test_no_charger_serves_two_at_once(spark):
    v = spark.createDataFrame([(i, i % 2, 22.0 if i % 2 else 11.0, 40.0, float(i)) for i in range(12)], "vin long, charger long, power double, capacity double, soc double")
    plans = charging.charge_plan(v, stateful.slot_prices()).collect()
    assert any(p.feasible for p in plans)
    for charger in (0, 1):
        used = sum((np.array(p.slots.split(","), int) > 0).astype(int) for p in plans if p.charger == charger and p.feasible)
        assert used.max() == 1


def test_components_and_nearest_sources(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(60), rng.randrange(60), rng.randrange(1, 9)) for _ in range(50)] + [(i, i + 1, 1) for i in range(100, 130)]
    label = {n: n for e in edges for n in e[:2]}
    for _ in label:
        for a, b, _n in edges:
            label[a] = label[b] = min(label[a], label[b])
    df = spark.createDataFrame(edges, "a long, b long, len long")
    assert dict(graph.components(df).collect()) == label
    at = {3: (0, 3), 110: (0, 110), 120: (0, 120)}
    for _ in range(len(label)):
        for a, b, n in edges:
            for x, y in ((a, b), (b, a)):
                if x in at and (y not in at or (at[x][0] + n, at[x][1]) < at[y]):
                    at[y] = (at[x][0] + n, at[x][1])
    got = graph.nearest_source(df, spark.createDataFrame([(3,), (110,), (120,)], "node long")).collect()
    assert {r.node: (r.dist, r.source) for r in got} == at
    assert graph.components(df.where("a < 0")).count() == 0


def test_sketch_bounds(spark):
    rows = spark.range(3000).select((F.col("id") % 700).alias("x"))
    exact = dict(rows.groupBy("x").count().collect())
    d, w = sketches.count_min_size(0.01, 0.01)
    got = dict(sketches.estimate(rows, "x", sketches.count_min(rows, "x", depth=d, width=w), depth=d, width=w).collect())
    assert got.keys() == exact.keys() and all(got[k] >= exact[k] for k in exact) and sum(got[k] > exact[k] + 30 for k in exact) <= 14
    bits, hashes = sketches.bloom_size(700, 0.01)
    seen = {r.x for r in sketches.maybe_members(spark.range(10000).select(F.col("id").alias("x")), "x", sketches.bloom(rows, "x", bits=bits, hashes=hashes), bits=bits, hashes=hashes).collect()}
    assert seen >= set(range(700)) and len(seen) - 700 < 0.02 * 9300


A = {"vehicle": {"vin": "1HGCM82633A004352"}, "ts": "2026-10-01T06:00:00Z", "pos": {"lat": 12.5, "lon": 80.1, "hdg": 10}, "spd": {"kmh": 40.0}, "batt": {"soc": 0.5, "odo_km": 9}, "diag": {"dtc": ["P0301"], "evt": ""}, "chg": {"state": "NONE"}, "seq": 5, "schema": 1}
B = {"VIN": "1HGCM82633A004352", "time": 1790834400000, "latitude": 12.5, "longitude": 80.1, "heading": 10, "speedKmH": 40.0, "socPct": 50, "odometerKm": 9, "dtcRaw": "0301", "event": "", "plug": 0, "seq": 5, "v": 1}
CASES = [
    ("a", A, None), ("a", A | {"schema": 2, "spd": {"kph": 40.0}}, None), ("a", A | {"schema": 2}, "SCHEMA_INVALID"), ("a", A | {"schema": 3}, "SCHEMA_INVALID"), ("a", "{", "MALFORMED"), ("a", "", "MALFORMED"), ("a", None, "MALFORMED"),
    ("a", A | {"seq": "x"}, "MALFORMED"), ("a", A | {"seq": 0}, "SCHEMA_INVALID"), ("a", A | {"ts": "yesterday"}, "SCHEMA_INVALID"), ("a", A | {"chg": {"state": "FLYING"}}, "SCHEMA_INVALID"), ("a", A | {"diag": {"dtc": ["X9"]}}, "SCHEMA_INVALID"),
    ("a", A | {"vehicle": {"vin": "1HGCM82633A004353"}}, "VIN_INVALID"), ("a", A | {"vehicle": {}}, "SCHEMA_INVALID"), ("a", A | {"ts": "2026-09-01T06:00:00Z"}, "TOO_LATE"), ("a", A | {"ts": "2026-10-01T06:10:00Z"}, "SCHEMA_INVALID"),
    ("b", B, None), ("b", B | {"plug": 3}, "SCHEMA_INVALID"), ("b", B | {"dtcRaw": "03"}, "SCHEMA_INVALID"), ("b", B | {"event": "??"}, "SCHEMA_INVALID"), ("b", B | {"socPct": 101}, "SCHEMA_INVALID"), ("b", B | {"v": 2}, "SCHEMA_INVALID"), ("c", B, "MALFORMED"),
]


def test_messages_of_both_dialects(spark):
    rows = [(i, oem, p if p is None or isinstance(p, str) else json.dumps(p)) for i, (oem, p, _) in enumerate(CASES)]
    raw = spark.createDataFrame(rows, "i int, oem string, payload string").withColumn("recv_ts", F.timestamp_millis(F.lit(1790834400000)))
    makers = spark.createDataFrame([("a", "A"), ("b", "B")], "oem string, dialect string")
    owners = spark.createDataFrame([("1HGCM82633A004352", 7)], "vin string, tenant int")
    got = normalise.normalise(raw, makers, owners)
    assert {r.i: r.error_class for r in got.collect()} == {i: c for i, (_, _, c) in enumerate(CASES)}
    events = {r.i: r.e for r in got.where("error_class IS NULL").collect()}
    a, b = events[0].asDict(), events[16].asDict()
    assert a == b and a["soc"] == 50.0
    nobody = normalise.normalise(raw, makers, owners.where("tenant = 0"))
    assert nobody.where("error_class = 'UNAUTHORIZED_VIN'").count() == 3 and normalise.dead_letters(got).count() == sum(c is not None for _, _, c in CASES)


def test_every_trouble_code_comes_back(spark):
    codes = spark.range(65536).select(F.lpad(F.hex("id"), 4, "0").alias("raw")).withColumn("back", C.dtc_encode(C.dtc_decode(F.col("raw"))))
    assert codes.where("back IS NULL OR back <> raw").count() == 0


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    rng = random.Random(2)
    rows = [(n % 3, max(0, n // 3 + rng.choice([0, 0, 1, -1, -2, -300])), n) for n in range(2400)]
    df = spark.createDataFrame(rows, "vin long, seq long, n long")
    src, out, ck = (str(tmp_path / x) for x in ("src", "out", "ck"))
    for half in ("n < 1000", "n >= 1000"):
        df.where(half).coalesce(1).write.mode("append").parquet(src)
        got = state.drain(state.dedup_stream(spark.readStream.schema(df.schema).parquet(src)), out, ck)
    from fleetloom.operators import ordered

    want = ordered.dedup_verdicts(df).select("vin", "seq", "n", "verdict")
    assert sorted(got.collect()) == sorted(want.collect())


def test_a_batch_run_twice_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "alerts")
    one = spark.createDataFrame([(1, 5), (1, 3), (2, 9)], "k int, id int")
    two = spark.createDataFrame([(1, 1), (3, 7), (3, 8)], "k int, id int")
    for batch, i in ((one, 0), (two, 1), (two, 1)):
        state.insert_new(batch, i, path, ["k"], "id")
    assert sorted(tuple(r) for r in spark.read.schema(one.schema).parquet(f"{path}/*").collect()) == [(1, 3), (2, 9), (3, 7)]
