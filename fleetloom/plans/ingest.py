"""Queries of raw batches, sinks, statuses of chargers, text files, late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import folds, ordered, sketches, wire
from ..sources import files
from ..sources.adapters import TEL, arrivals, table, table_stream, telemetry
from ..sources.scratch import folder
from ..streaming import state
from .endpoints import DNS, LAST_STATUS, charger_status
from .fleet import VERDICTS, query
from .stateful import RISK, risk_samples, whole_metres

# Raw batches

#: Number, name and type of the fields of a message here, and of the field that holds messages in a batch.
LAYOUT, MESSAGES = {1: ("vin", "string"), 2: ("seq", "long")}, 2


def proto_batches(t: DataFrame) -> DataFrame:
    """key, payload: up to 50 messages of a vehicle as one protobuf batch; every 23rd message is garbage."""
    text = F.hex(F.encode(F.col("vin").cast("string"), "UTF-8"))
    body = F.concat(F.lit("0A"), wire.varint_hex((F.length(text) / 2).cast("long")), text, F.lit("10"), wire.varint_hex(F.col("seq")))
    body = F.when(F.col("seq") % 23 == 0, F.repeat(F.lit("FF"), (F.length(body) / 2).cast("int"))).otherwise(body)
    framed = F.concat(F.lit("12"), wire.varint_hex((F.length(body) / 2).cast("long")), body)
    own = t.select("vin", "seq", F.floor(F.col("seq") / 50).alias("part"), framed.alias("framed"))
    whole = own.groupBy("vin", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "framed"))), lambda s: s["framed"]), "").alias("h"))
    return whole.select(F.concat_ws("-", F.col("vin").cast("string"), F.col("part").cast("string")).alias("key"), F.unhex(F.concat(F.lit("0801"), F.col("h"))).alias("payload"))


@query(f"WITH {TEL} SELECT vin || '-' || CAST(floor(seq / 50) AS BIGINT) AS key, count(*) FILTER (WHERE seq % 23 <> 0) AS good, count(*) FILTER (WHERE seq % 23 = 0) AS bad, CAST(coalesce(sum(seq) FILTER (WHERE seq % 23 <> 0), 0) AS BIGINT) AS seqs FROM tel GROUP BY 1")
def proto_batch_split(spark, sf_dir):
    """Batches are split without decoding, so garbage among messages costs itself only."""
    found = wire.decode(wire.split_batches(proto_batches(telemetry(spark, sf_dir)), "key", "payload", MESSAGES), "message", LAYOUT)
    return found.groupBy("key").agg(F.count_if("ok").alias("good"), F.count_if(~F.col("ok")).alias("bad"), F.coalesce(F.sum("seq"), F.lit(0)).alias("seqs"))


@query(f"WITH {TEL} SELECT vin, seq, soc FROM tel")
def ndjson_lines(spark, sf_dir):
    """Newline-delimited JSON with blank lines and stray spaces, to records."""
    line = F.concat(F.lit(" "), F.to_json(F.struct("vin", "seq", "soc")), F.lit("\r"))
    t = telemetry(spark, sf_dir).select("vin", F.floor(F.col("seq") / 50).alias("part"), line.alias("line"))
    bodies = t.groupBy("vin", "part").agg(F.array_join(F.collect_list("line"), "\n\n \n").alias("body")).select(F.concat_ws("-", "vin", "part").alias("key"), "body")
    return wire.split_lines(bodies, "key", "body").select(F.from_json("line", "vin BIGINT, seq BIGINT, soc INT").alias("e")).select("e.*")


UUID = "^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"


def storable(rows: DataFrame, name: str = "sink") -> tuple[DataFrame, Observation]:
    """Rows that the store takes, with reason (null: taken), and counts that Spark gathers as they pass: seen, bad_tenant, bad_vin."""
    reason = F.when(~F.coalesce(F.col("tenant_id").rlike(UUID), F.lit(False)), "bad_tenant").when(F.coalesce(F.length("vin"), F.lit(0)) != 17, "bad_vin")
    seen = Observation(name)
    marked = rows.withColumn("reason", reason)
    return marked.observe(seen, F.count(F.lit(1)).alias("seen"), *[F.count_if(F.col("reason") == r).alias(r) for r in ("bad_tenant", "bad_vin")]), seen


@query(f"WITH {TEL} SELECT CASE WHEN seq % 41 = 0 THEN 'bad_tenant' WHEN seq % 43 = 0 THEN 'bad_vin' ELSE 'stored' END AS outcome, count(*) AS n FROM tel GROUP BY 1")
def sink_decode_filter(spark, sf_dir):
    tenant = F.when(F.col("seq") % 41 == 0, "none").otherwise(C.uuid5(DNS, F.col("tenant").cast("string")))
    vin = F.substring(F.concat(F.lit("1HGCM82603A"), F.lpad((F.col("vin") % 1000000).cast("string"), 6, "0")), F.lit(1), F.when(F.col("seq") % 43 == 0, 16).otherwise(17))
    rows, _ = storable(telemetry(spark, sf_dir).select(tenant.alias("tenant_id"), vin.alias("vin")))
    return rows.groupBy(F.coalesce("reason", F.lit("stored")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


# Statuses of chargers


@query(f"WITH {LAST_STATUS} SELECT charger, status FROM ls")
def charger_status_latest(spark, sf_dir):
    """The last status by order of arrival, whatever its time."""
    return charger_status(spark, sf_dir).groupBy("charger").agg(F.max_by("status", "n").alias("status"))


@query(f"WITH {LAST_STATUS} SELECT charger, status FROM ls")
def stream_charger_status(spark, sf_dir):
    """The same of a stream: a snapshot for each trigger, which an overlay of the trigger is made of."""
    l = table_stream(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linestatus") == "O", "OUT_OF_SERVICE").otherwise("OCCUPIED")
    return state.status_snapshot(l.select(F.col("l_suppkey").alias("charger"), status.alias("status"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus").alias("n")), "charger", "status", "n")


# Files and series


@query("""WITH t AS (SELECT count(*) AS trips, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS energy_c, min(o_orderdate) AS first_at FROM orders) SELECT 'csv' AS kind, * FROM t UNION ALL SELECT 'json', * FROM t""")
def records_round_trip(spark, sf_dir):
    """Trips written as text and read with a schema."""
    trips = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.floor(F.col("o_totalprice") * 100 + 0.5).alias("energy_c"), F.col("o_orderdate").alias("at"))
    found = None
    for kind in ("csv", "json"):
        path = folder(spark)
        files.write_records(trips, path, kind)
        back = files.read_records(spark, path, kind, trips.schema)
        one = back.agg(F.count(F.lit(1)).alias("trips"), F.sum("energy_c").alias("energy_c"), F.min("at").alias("first_at")).select(F.lit(kind).alias("kind"), "*")
        found = one if found is None else found.unionByName(one)
    return found


@query("SELECT c_custkey AS vin, d AS day, (c_custkey * 31 + d * 17) % 400 AS km FROM customer, range(0, 7) AS r(d)")
def vehicle_days(spark, sf_dir):
    """Every vehicle on every day of a week."""
    v = files.series(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vin")), "day", 0, 6)
    return v.withColumn("km", (F.col("vin") * 31 + F.col("day") * 17) % 400)


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS trips, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS energy_c FROM orders WHERE o_orderdate >= '1999-07-01' GROUP BY 1")
def months_of_trips(spark, sf_dir):
    """A table in parts by month, of which only those from July 1999 on are read."""
    path = folder(spark)
    files.store_by_month(table(spark, sf_dir, "orders").select("o_orderdate", F.floor(F.col("o_totalprice") * 100 + 0.5).alias("energy_c")), "o_orderdate", path)
    return files.months(spark, path, F.col("month") >= "1999-07").groupBy("month").agg(F.count(F.lit(1)).alias("trips"), F.sum("energy_c").alias("energy_c"))


ROLLUP_SQL = "SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS trips, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS energy_c FROM orders GROUP BY 1"


@query(ROLLUP_SQL)
def rollup_refresh(spark, sf_dir):
    """A stored rollup, of which only the months with new trips (status P stands for these) are made again."""
    o = table(spark, sf_dir, "orders")
    rollup = lambda t: t.groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("trips"), F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias("energy_c"))
    path = folder(spark)
    files.store_by_month(rollup(o.where("o_orderstatus <> 'P'")), "day", path)
    month = F.date_trunc("month", "o_orderdate")
    changed = o.where("o_orderstatus = 'P'").select(month.alias("changed")).distinct()
    files.refresh_months(rollup(o.join(changed, month == F.col("changed"), "left_semi")), "day", path)
    return spark.read.parquet(path).drop("month")


@query("SELECT 'orders' AS name, 2 * count(*) AS n FROM orders UNION ALL SELECT 'customer', 2 * count(*) FROM customer")
def bulk_load(spark, sf_dir):
    """Tables loaded in place of older ones, then once more beside them."""
    path, tables = folder(spark), {n: table(spark, sf_dir, n) for n in ("orders", "customer")}
    files.load({n: t.limit(1) for n, t in tables.items()}, path)
    files.load(tables, path, reset=True)
    files.load(tables, path)
    count = lambda n: spark.read.parquet(f"{path}/{n}").agg(F.lit(n).alias("name"), F.count(F.lit(1)).alias("n"))
    return count("orders").unionByName(count("customer"))


# Codes and repeats

CODE_SQL = "substr('PCBU', ({n} >> 14) + 1, 1) || CAST(({n} >> 12) & 3 AS VARCHAR) || printf('%03X', {n} & 4095)"


@query(f"""WITH {TEL}, c AS (SELECT unnest([CAST(vin * 7919 % 65536 AS INTEGER), CAST(seq % 97 * 641 % 65536 AS INTEGER)]) AS n FROM tel WHERE evt = 'error')
SELECT {CODE_SQL.format(n='n')} AS code, count(*) AS n FROM c GROUP BY 1 ORDER BY n DESC, code LIMIT 10""")
def dtc_code_topk(spark, sf_dir):
    """The ten commonest trouble codes of all arrays of codes."""
    raw = lambda n: C.dtc_decode(F.lpad(F.hex(n % 65536), 4, "0"))
    codes = F.array(raw(F.col("vin") * 7919), raw(F.col("seq") % 97 * 641))
    t = telemetry(spark, sf_dir).where("evt = 'error'").select(F.explode(codes).alias("code"))
    return t.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "code").limit(10)


@query(f"""WITH {TEL}, c AS (SELECT unnest([CAST(vin * 7919 % 65536 AS INTEGER), CAST(seq % 97 * 641 % 65536 AS INTEGER)]) AS n FROM tel WHERE evt = 'error')
SELECT count(*) AS n FROM c GROUP BY c.n ORDER BY n DESC LIMIT 10""")
def dtc_topk_sketch(spark, sf_dir):
    """The counts of the ten commonest codes by a sketch of at most 10,000 codes; exact while there are fewer."""
    raw = lambda n: C.dtc_decode(F.lpad(F.hex(n % 65536), 4, "0"))
    t = telemetry(spark, sf_dir).where("evt = 'error'").select(F.explode(F.array(raw(F.col("vin") * 7919), raw(F.col("seq") % 97 * 641))).alias("code"))
    return t.select(F.expr("approx_top_k(code, 10, 10000)").alias("top")).select(F.explode("top").alias("t")).select(F.col("t.count").alias("n"))


@query("""WITH a AS (SELECT user_id % 8 AS worker, user_id AS vin, event_id AS seq, CASE WHEN event_id % 33 = 0 THEN event_id * 2 + 101 ELSE event_id * 2 END AS n FROM events
  UNION ALL SELECT user_id % 8, user_id, event_id, event_id * 2 + 81 FROM events WHERE event_id % 20 = 0), k AS (SELECT *, row_number() OVER (PARTITION BY vin, seq ORDER BY n) AS k FROM a)
SELECT worker, count(*) FILTER (WHERE k = 1) AS fresh, count(*) FILTER (WHERE k > 1) AS seen FROM k GROUP BY worker""")
def rotating_filter(spark, sf_dir):
    """Repeats told by two generations of a Bloom filter of bounded size, in order of arrival at each worker.

    A generation holds 256 keys, and repeats come within 64, so none is forgotten; a false positive rate of 10^-9 leaves none."""
    a = arrivals(spark, sf_dir).select((F.col("vin") % 8).alias("worker"), "n", F.concat_ws(":", F.col("vin").cast("string"), F.col("seq").cast("string")).alias("item"))
    found = folds.fold_sorted(a, "worker", ["n"], lambda: sketches.Rotating(256, 1e-9), lambda r, row: (row[0], r.seen(row[2])), "worker long, seen boolean")
    return found.groupBy("worker").agg(F.count_if(~F.col("seen")).alias("fresh"), F.count_if("seen").alias("seen"))


# Late rows

NEW_RISK = RISK.replace("AS i FROM tel)", "AS i FROM fresh)", 1).replace(TEL, f"{TEL}, {VERDICTS}, fresh AS (SELECT tel.* FROM tel JOIN v ON v.vin = tel.vin AND v.seq = tel.seq WHERE v.verdict = 'new')", 1)


@query(f"WITH RECURSIVE {NEW_RISK} SELECT vin, seq, rule, win AS window_start, CAST(floor(margin * 1000 + 0.5::DOUBLE) AS BIGINT) AS margin_m FROM f WHERE rule IS NOT NULL")
def alerts_of_new_rows(spark, sf_dir):
    """Late, repeated and stale rows never reach the logic of alerts."""
    fresh = ordered.dedup_verdicts(arrivals(spark, sf_dir)).where("verdict = 'new'").select("vin", "seq")
    return whole_metres(folds.range_alerts(risk_samples(telemetry(spark, sf_dir).join(fresh, ["vin", "seq"]))))
