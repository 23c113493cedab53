"""More named queries: messages, sketches, texts, governance and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import normalise, ordered, sketches, text_vectors, vectors
from ..sources.adapters import ALERT, TEL, alerts, table, telemetry
from .fleet import ORACLES, query

# Messages

#: Event of each type, its short code, and its name.
CODES = [("click", "HB", "HARSH_BRAKE"), ("view", "", "EVENT_UNSPECIFIED"), ("signup", "PLUGIN", "PLUG_IN"), ("purchase", "CHGDONE", "CHARGE_COMPLETE"), ("error", "THERM", "THERMAL_WARNING")]


def messages(spark, sf_dir) -> DataFrame:
    """oem, payload, recv_ts: events as two makers send them; some are cut, of a wrong schema, vehicle, place or time."""
    t = telemetry(spark, sf_dir)
    good = C.vin_build(F.concat(F.lit("1HGCM82603A"), F.lpad((F.col("vin") % 1000000).cast("string"), 6, "0")))
    vin = F.when(F.col("seq") % 23 == 0, F.concat(F.substring(good, 1, 16), F.lit("I"))).otherwise(good)
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    pick = lambda i: F.element_at(F.create_map(*[F.lit(x) for c in CODES for x in (c[0], c[i])]), F.col("evt"))
    lat = F.when(F.col("seq") % 31 == 0, 95.0).otherwise(F.col("lat"))
    version = F.when(F.col("seq") % 19 == 0, 9).otherwise(1)
    at = F.to_timestamp(stamp)
    a = F.to_json(F.struct(
        F.struct(vin.alias("vin")).alias("vehicle"), stamp.alias("ts"), F.struct(lat.alias("lat"), F.col("lon")).alias("pos"), F.struct((F.col("speed_c") / 100.0).alias("kmh")).alias("spd"),
        F.struct((F.col("soc") / 100.0).alias("soc")).alias("batt"), F.struct(F.array(F.lit("P0301")).alias("dtc"), pick(2).alias("evt")).alias("diag"), F.struct(F.col("state")).alias("chg"), "seq", version.alias("schema"),
    ))
    b = F.to_json(F.struct(
        vin.alias("VIN"), F.unix_millis(at).alias("time"), lat.alias("latitude"), F.col("lon").alias("longitude"), (F.col("speed_c") / 100.0).alias("speedKmH"), F.col("soc").cast("double").alias("socPct"), F.lit("0301C123").alias("dtcRaw"),
        pick(1).alias("event"), (F.array_position(F.array(*map(F.lit, normalise.STATES)), F.col("state")) - 1).alias("plug"), "seq", version.alias("v"),
    ))
    payload = F.when(F.col("seq") % 2 == 0, a).otherwise(b)
    payload = F.when(F.col("seq") % 17 == 0, F.substring(payload, 1, 40)).otherwise(payload)
    recv = F.when(F.col("seq") % 29 == 0, at + F.expr("INTERVAL 8 DAYS")).otherwise(at)
    return t.select(F.when(F.col("seq") % 2 == 0, "alpha").otherwise("beta").alias("oem"), payload.alias("payload"), recv.alias("recv_ts"))


def normalised(spark, sf_dir) -> DataFrame:
    makers = spark.createDataFrame([("alpha", "A"), ("beta", "B")], "oem string, dialect string")
    known = telemetry(spark, sf_dir).where("vin % 37 <> 0").select("vin", "tenant").distinct()
    known = known.select(C.vin_build(F.concat(F.lit("1HGCM82603A"), F.lpad((F.col("vin") % 1000000).cast("string"), 6, "0"))).alias("vin"), "tenant")
    return normalise.normalise(messages(spark, sf_dir), makers, known)


CLASS = "CASE WHEN seq % 17 = 0 THEN 'MALFORMED' WHEN seq % 19 = 0 THEN 'SCHEMA_INVALID' WHEN seq % 23 = 0 THEN 'VIN_INVALID' WHEN seq % 29 = 0 THEN 'TOO_LATE' WHEN seq % 31 = 0 THEN 'SCHEMA_INVALID' WHEN vin % 37 = 0 THEN 'UNAUTHORIZED_VIN' END"
NAMES_SQL = " ".join(f"WHEN '{a}' THEN '{c}'" for a, _, c in CODES)


@query(f"""WITH {TEL} SELECT seq, tenant, CAST(floor(epoch_us(ts) / 1000) AS BIGINT) AS ts_ms, CAST(soc * 100 AS BIGINT) AS soc_c, speed_c, state, CASE evt {NAMES_SQL} END AS evt,
CASE WHEN seq % 2 = 0 THEN 'P0301' ELSE 'P0301,U0123' END AS dtc FROM tel WHERE {CLASS} IS NULL""")
def normalise_dialects(spark, sf_dir):
    e = normalise.accepted(normalised(spark, sf_dir))
    return e.select("seq", "tenant", F.floor(F.unix_micros("ts") / 1000).alias("ts_ms"), F.floor(F.col("soc") * 100 + 0.5).alias("soc_c"), F.floor(F.col("speed") * 100 + 0.5).alias("speed_c"), "state", "evt", F.array_join("dtc", ",").alias("dtc"))


@query(f"WITH {TEL} SELECT {CLASS} AS error_class, count(*) AS n FROM tel WHERE {CLASS} IS NOT NULL GROUP BY 1")
def dlq_by_class(spark, sf_dir):
    return normalise.dead_letters(normalised(spark, sf_dir)).groupBy("error_class").agg(F.count(F.lit(1)).alias("n"))


# Sketches

DEPTH, WIDTH = sketches.count_min_size(0.01, 0.01)
PER_ITEM, HASHES = sketches.bloom_rate(0.01)


def slot_sql(item: str, row: str, width: int) -> str:
    return f"CAST('0x' || substr(md5(CAST({item} AS VARCHAR) || '#' || CAST({row} AS VARCHAR)), 1, 8) AS BIGINT) % {width}"


@query(f"""WITH {TEL}, c AS (SELECT row, {slot_sql('vin', 'row', WIDTH)} AS slot, count(*) AS n FROM tel, range({DEPTH}) AS d(row) GROUP BY 1, 2),
i AS (SELECT DISTINCT vin FROM tel) SELECT vin, min(n) AS estimate FROM i, range({DEPTH}) AS d(row) JOIN c ON c.row = d.row AND c.slot = {slot_sql('vin', 'd.row', WIDTH)} GROUP BY vin""")
def count_min(spark, sf_dir):
    t = telemetry(spark, sf_dir)
    sketch = sketches.count_min(t, "vin", depth=DEPTH, width=WIDTH)
    return sketches.estimate(t, "vin", sketch, depth=DEPTH, width=WIDTH)


@query(f"""WITH m AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'), z AS (SELECT greatest(1, CAST(ceil(count(DISTINCT o_custkey) * {PER_ITEM!r}::DOUBLE) AS BIGINT)) AS bits FROM m),
b AS (SELECT DISTINCT {slot_sql('o_custkey', 'h', 'bits')} AS bit FROM m, z, range({HASHES}) AS d(h))
SELECT c_custkey AS id FROM (SELECT c_custkey, h, {slot_sql('c_custkey', 'h', 'bits')} AS bit FROM customer, z, range({HASHES}) AS d(h)) WHERE bit IN (SELECT bit FROM b) GROUP BY c_custkey HAVING count(*) = {HASHES}""")
def bloom_members(spark, sf_dir):
    """Sized for the members there are."""
    members = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select("o_custkey").distinct()
    bits, hashes = sketches.bloom_size(members.count(), 0.01)
    f = sketches.bloom(members, "o_custkey", bits=bits, hashes=hashes)
    return sketches.maybe_members(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")), "id", f, bits=bits, hashes=hashes)


# Texts

STOP_SQL = ", ".join(f"'{w}'" for w in text_vectors.STOP)
STEM_SQL = "CASE " + " ".join(f"WHEN length(w) > {len(e) + 3} AND w LIKE '%{e}' THEN left(w, length(w) - {len(e)})" for e in text_vectors.ENDINGS) + " ELSE w END"
VECTORS = f"""w AS (SELECT doc_id AS id, unnest(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' ')) AS w, generate_subscripts(string_split(regexp_replace(lower(text), '[^\\p{{L}}\\p{{Nd}}]+', ' ', 'g'), ' '), 1) AS i FROM documents),
t AS (SELECT id, i, {STEM_SQL} AS w FROM w WHERE length(w) > 1 AND w NOT IN ({STOP_SQL})), n AS (SELECT *, lead(w) OVER (PARTITION BY id ORDER BY i) AS next FROM t),
feat AS (SELECT id, 'w:' || w AS feature, 20 AS weight FROM n UNION ALL SELECT id, 'b:' || w || '_' || next, 14 FROM n WHERE next IS NOT NULL
  UNION ALL SELECT id, 'c:' || substr(w, j, 3), 5 FROM (SELECT id, w, unnest(range(1, length(w) - 1)) AS j FROM n WHERE length(w) >= 3)),
vec AS (SELECT id, CAST('0x' || substr(md5(feature), 1, 8) AS BIGINT) % 384 AS slot, CAST(sum(weight * CASE WHEN substr(md5(feature), 9, 1) >= '8' THEN -1 ELSE 1 END) AS BIGINT) AS value FROM feat GROUP BY 1, 2 HAVING value <> 0)"""


@query(f"WITH {VECTORS} SELECT id, count(*) AS slots, CAST(sum(abs(value)) AS BIGINT) AS mass, CAST(sum(value * (slot + 1)) AS BIGINT) AS moment FROM vec GROUP BY id")
def text_vectors_digest(spark, sf_dir):
    v = text_vectors.text_vectors(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))
    return v.groupBy("id").agg(F.count(F.lit(1)).alias("slots"), F.sum(F.abs("value")).alias("mass"), F.sum(F.col("value") * (F.col("slot") + 1)).alias("moment"))


@query("""WITH q AS (SELECT vec_id AS qid, label AS ql, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT qid, ql, vec_id AS id, label, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS c FROM q, embeddings WHERE vec_id <> qid),
k AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS rank FROM p QUALIFY rank <= 5) SELECT ql AS label, count(*) AS found, count(*) FILTER (WHERE label = ql) AS same FROM k GROUP BY 1""")
def recall_at_k(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    q = v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q"), F.col("label").alias("ql"))
    top = vectors.top_neighbours(q.drop("ql"), v.drop("label"), 5)
    named = top.join(F.broadcast(q.select("qid", "ql")), "qid").join(v.select("id", "label"), "id")
    return named.groupBy(F.col("ql").alias("label")).agg(F.count(F.lit(1)).alias("found"), F.count_if(F.col("label") == F.col("ql")).alias("same"))


# Reports


@query("SELECT o_orderkey AS plan, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS items FROM orders")
def plans_item_count(spark, sf_dir):
    n = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("plan")).agg(F.count(F.lit(1)).alias("items"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan")).join(n, "plan", "left").select("plan", F.coalesce("items", F.lit(0)).alias("items"))


CHARGERS = "ch AS (SELECT s_suppkey AS charger, (s_suppkey * 7 % 100 + 1200) / 100.0::DOUBLE AS clat, (s_suppkey * 13 % 50 + 8000) / 100.0::DOUBLE AS clon FROM supplier)"
DIST = "CAST(floor(12742.0176::DOUBLE * asin(sqrt(power(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * power(sin(radians(clon - lon) / 2), 2))) * 1000 + 0.5::DOUBLE) AS BIGINT)"


@query(f"""WITH {TEL}, {CHARGERS}, l AS (SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1),
d AS (SELECT vin, charger, soc, {DIST} AS m FROM l JOIN ch ON clat BETWEEN lat - 0.1::DOUBLE AND lat + 0.1::DOUBLE AND clon BETWEEN lon - 0.1::DOUBLE AND lon + 0.1::DOUBLE)
SELECT vin, charger, m, m * 13 <= soc * 20000 AS reachable FROM d QUALIFY row_number() OVER (PARTITION BY vin ORDER BY m, charger) <= 3""")
def nearest_chargers_box(spark, sf_dir):
    """The box join is an equality of cells as wide as half the box: a charger is sent to the nine cells about its own.

    Of chargers at one place only the first three can be among the three nearest, and vehicles at one place have the same three: places meet, not rows."""
    l = ordered.latest(telemetry(spark, sf_dir), "vin", "seq").select("vin", "soc", "lat", "lon", F.floor(F.col("lat") / 0.1).alias("y"), F.floor(F.col("lon") / 0.1).alias("x"))
    ch = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("charger"), ((F.col("s_suppkey") * 7 % 100 + 1200) / F.lit(100.0)).alias("clat"), ((F.col("s_suppkey") * 13 % 50 + 8000) / F.lit(100.0)).alias("clon"))
    own = Window.partitionBy("clat", "clon").orderBy("charger")
    ch = ch.withColumn("rank", F.row_number().over(own)).where("rank <= 3").drop("rank")
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    ch = ch.select("*", F.explode(F.transform(near, lambda i: F.floor(F.col("clat") / 0.1) + i)).alias("y")).select("*", F.explode(F.transform(near, lambda i: F.floor(F.col("clon") / 0.1) + i)).alias("x"))
    met = l.select("lat", "lon", "y", "x").distinct().join(ch, ["y", "x"]).where("clat BETWEEN lat - 0.1D AND lat + 0.1D AND clon BETWEEN lon - 0.1D AND lon + 0.1D")
    met = met.withColumn("m", F.floor(C.haversine_km(F.col("lat"), F.col("lon"), F.col("clat"), F.col("clon")) * 1000 + 0.5))
    rank = F.row_number().over(Window.partitionBy("lat", "lon").orderBy("m", "charger"))
    met = met.withColumn("rank", rank).where("rank <= 3").select("lat", "lon", "charger", "m")
    return l.join(met, ["lat", "lon"]).select("vin", "charger", "m", (F.col("m") * 13 <= F.col("soc") * 20000).alias("reachable"))


@query(f"""WITH {ALERT}, f AS (SELECT vin, min(detected_at) AS first_at FROM alert WHERE severity = 'CRITICAL' GROUP BY 1), s AS (SELECT o_custkey AS vin, min(o_orderdate) AS stranded FROM orders WHERE o_totalprice > 300000 GROUP BY 1),
j AS (SELECT f.vin AS a, s.vin AS b, coalesce(first_at <= stranded AND stranded - first_at <= INTERVAL 200 DAY, false) AS good FROM f FULL JOIN s ON f.vin = s.vin)
SELECT count(a) AS alerted, count(b) AS stranded, count(*) FILTER (WHERE good) AS caught FROM j""")
def alert_eval(spark, sf_dir):
    f = alerts(spark, sf_dir).where("severity = 'CRITICAL'").groupBy("vin").agg(F.min("detected_at").alias("first_at"))
    s = table(spark, sf_dir, "orders").where("o_totalprice > 300000").groupBy(F.col("o_custkey").alias("vin")).agg(F.min("o_orderdate").alias("stranded"))
    j = f.join(s, "vin", "full")
    return j.agg(F.count("first_at").alias("alerted"), F.count("stranded").alias("stranded"), F.count_if(F.expr("first_at <= stranded AND stranded - first_at <= INTERVAL 200 DAYS")).alias("caught"))


@query(f"WITH s AS ({ORACLES['charge_sessions']}) SELECT vin, count(*) AS sessions, median(CAST(93 * energy // rise AS BIGINT)) AS capacity FROM s WHERE rise >= 15 AND energy > 0 GROUP BY vin")
def soh_capacity_median(spark, sf_dir):
    s = ordered.charge_sessions(telemetry(spark, sf_dir), gap_s=12 * 3600).where("rise >= 15 AND energy > 0")
    return s.groupBy("vin").agg(F.count(F.lit(1)).alias("sessions"), F.median(F.expr("93 * energy div rise")).alias("capacity"))


@query(f"WITH {TEL} SELECT seq, vin, evt FROM tel WHERE seq < 900 AND evt = 'error' ORDER BY seq DESC LIMIT 50")
def keyset_audit(spark, sf_dir):
    return telemetry(spark, sf_dir).where("seq < 900 AND evt = 'error'").orderBy(F.col("seq").desc()).limit(50).select("seq", "vin", "evt")


@query(f"WITH {TEL} SELECT vin, count(*) AS n FROM tel WHERE tenant = 3 GROUP BY vin")
def tenant_rls(spark, sf_dir):
    """A tenant's own rows, by a bound parameter: a null tenant sees none."""
    return spark.sql("SELECT vin, count(*) AS n FROM {t} WHERE tenant = :tenant GROUP BY vin", args={"tenant": 3}, t=telemetry(spark, sf_dir))


@query(f"""WITH {ALERT}, h AS (SELECT vin, date_trunc('year', detected_at)::TIMESTAMP AS as_of, severity AS method, id FROM alert) SELECT vin, as_of, method, max(id) AS id FROM h GROUP BY 1, 2, 3""")
def soh_upsert(spark, sf_dir):
    """Insert or replace by key: of old and new rows the newest stays."""
    h = alerts(spark, sf_dir).select("vin", F.date_trunc("year", "detected_at").cast("timestamp_ntz").alias("as_of"), F.col("severity").alias("method"), "id")
    return h.where("id % 2 = 0").unionByName(h.where("id % 2 = 1")).groupBy("vin", "as_of", "method").agg(F.max("id").alias("id"))


@query("""SELECT o_orderkey AS trip, o_orderdate AS started, 'old' AS origin FROM orders WHERE o_orderdate < '1998-01-01' UNION ALL SELECT o_orderkey, o_orderdate, 'new' FROM orders WHERE o_orderdate >= '1998-01-01' AND o_orderstatus <> 'P'""")
def replace_window(spark, sf_dir):
    """Rows from a time on are replaced by a new run's rows."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip"), F.col("o_orderdate").alias("started"), "o_orderstatus")
    cut = F.col("started") >= F.lit("1998-01-01").cast("timestamp_ntz")
    kept, new = o.where(~cut).withColumn("origin", F.lit("old")), o.where(cut & (F.col("o_orderstatus") != "P")).withColumn("origin", F.lit("new"))
    return kept.unionByName(new).drop("o_orderstatus")


ERASED = "c_custkey % 13 = 0"


@query(f"""WITH asked AS (SELECT c_custkey AS subject FROM customer WHERE {ERASED}) SELECT count(*) AS erased, 0 AS names_left, (SELECT count(*) FROM embeddings WHERE vec_id NOT IN (SELECT subject FROM asked)) AS vectors,
(SELECT count(*) FROM orders WHERE o_custkey IN (SELECT subject FROM asked)) AS anonymous_trips FROM asked""")
def erasure_check(spark, sf_dir):
    """People who asked are erased: names nulled, pseudonyms replaced, their vectors deleted, their trips kept; then what is left is counted."""
    asked = table(spark, sf_dir, "customer").where(ERASED).select(F.col("c_custkey").alias("subject"))
    c = table(spark, sf_dir, "customer").join(asked, F.col("subject") == F.col("c_custkey"), "left")
    c = c.select("c_custkey", F.when(F.col("subject").isNull(), F.col("c_name")).alias("c_name"), F.when(F.col("subject").isNotNull(), F.concat(F.lit("erased-"), F.substring(F.sha2(F.col("subject").cast("string"), 256), 1, 8))).alias("pseudonym"))
    v = table(spark, sf_dir, "embeddings").join(asked, F.col("subject") == F.col("vec_id"), "left_anti")
    o = table(spark, sf_dir, "orders").join(asked, F.col("subject") == F.col("o_custkey"), "left_semi")
    done = c.agg(F.count("pseudonym").alias("erased"), F.count_if(F.col("pseudonym").isNotNull() & F.col("c_name").isNotNull()).alias("names_left"))
    return done.crossJoin(v.agg(F.count(F.lit(1)).alias("vectors"))).crossJoin(o.agg(F.count(F.lit(1)).alias("anonymous_trips")))


@query(f"WITH {ALERT} SELECT vin, arg_max(status, (detected_at, id)) AS status, count(*) AS changes FROM alert GROUP BY vin")
def alert_state(spark, sf_dir):
    """The last of each vehicle's status changes."""
    return alerts(spark, sf_dir).groupBy("vin").agg(F.max_by("status", F.struct("detected_at", "id")).alias("status"), F.count(F.lit(1)).alias("changes"))
