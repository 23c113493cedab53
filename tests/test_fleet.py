import hashlib
import random

import pytest
from oracle import DATA, same
from pyspark.sql import functions as F

from fleetloom.functions import columns as C
from fleetloom.operators import folds, lookup, ordered
from fleetloom.plans import fleet


@pytest.mark.parametrize("name", sorted(fleet.QUERIES))
def test_query_equals_oracle(spark, name):
    sf = f"{DATA}/sf0.001"
    if name == "offset_page":
        sf = f"{DATA}/sf0.01"
    got = fleet.QUERIES[name](spark, sf)
    if name in fleet.ORACLES:
        same(got, fleet.ORACLES[name], sf)
    else:
        assert got.count() > 0


def test_dedup_against_a_state_machine(spark):
    rng = random.Random(3)
    rows, want = [], {}
    for vin in range(6):
        top, seen = 0, set()
        for n in range(1500):
            seq = max(0, n + rng.choice([0, 0, 0, 1, -1, -3, -200, -255, -256, -257, -400]))
            if seq == 0:
                v = "stale"
            elif seq > top:
                v, top = "new", seq
            elif top - seq >= 256:
                v = "stale"
            else:
                v = "duplicate" if seq in seen else "late"
            seen.add(seq)
            rows.append((vin, seq, n))
            want[vin, n] = v
    got = ordered.dedup_verdicts(spark.createDataFrame(rows, "vin int, seq long, n int")).collect()
    assert {(r.vin, r.n): r.verdict for r in got} == want


def test_vin_and_codes(spark):
    vins = spark.createDataFrame([("1HGCM82633A004352", True), ("1HGCM82633A004353", False), ("1HGCM82633A00435I", False), ("", False), (None, False)], "v string, ok boolean")
    assert all(r.got == r.ok for r in vins.withColumn("got", C.vin_valid(F.col("v"))).collect())
    codes = spark.createDataFrame([("0301", "P0301"), ("0A7F", "P0A7F"), ("C123", "U0123"), ("zz", None), (None, None)], "raw string, code string")
    assert all(r.got == r.code for r in codes.withColumn("got", C.dtc_decode(F.col("raw"))).collect())


def test_geohash(spark):
    df = spark.createDataFrame([(57.64911, 10.40744)], "a double, b double")
    assert df.select(C.geohash(F.col("a"), F.col("b"), 11)).first()[0] == "u4pruydqqvj"


def test_digests_hold_no_list_of_lines(spark):
    rows = spark.createDataFrame([(1, "b"), (2, "z"), (1, "a"), (1, "a"), (None, "n")], "vin int, line string")
    got = folds.digests(rows, "vin", "line")
    plan = got._jdf.queryExecution().toString()
    assert "collect_list" not in plan
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert {(r.vin, r.links, r.digest) for r in got.collect()} == {(1, 3, sha("a\na\nb")), (2, 1, sha("z")), (None, 1, sha("n"))}
    assert "collect_list" not in fleet.QUERIES["audit_digest"](spark, f"{DATA}/sf0.001")._jdf.queryExecution().toString()


def test_empty_inputs(spark):
    t = spark.createDataFrame([], "vin long, ts timestamp_ntz, seq long, speed_c long, state string, odo_c long, soc int, step_c long")
    assert ordered.trips(t).count() == 0 and ordered.charge_sessions(t).count() == 0
    assert lookup.nearest_of(spark.createDataFrame([], "lat double, lon double"), fleet.CITIES).count() == 0
