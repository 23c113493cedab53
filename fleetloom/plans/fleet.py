"""Named fleet queries, each with the SQL that an independent engine can run on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import columns as C
from ..operators import folds, lookup, ordered, vectors
from ..sources.adapters import ALERT, ARR, TEL, alerts, arrivals, table, telemetry
from ..sources.scratch import stored

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Centres of the three cities, as the fleet world has them.
CITIES = [("north", 12.3, 80.1), ("middle", 12.5, 80.25), ("south", 12.8, 80.4)]
BANDS = [(0, 6, 450), (6, 10, 700), (10, 17, 850), (17, 22, 1200)]
HOUR, DAY = "date_trunc('hour', ts)", "date_trunc('day', ts)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Telemetry with the running odometer of each vehicle."""
    return telemetry(spark, sf_dir).withColumn("odo_c", F.sum("step_c").over(Window.partitionBy("vin").orderBy("ts", "seq")))


SMP = f"{TEL}, smp AS (SELECT *, CAST(sum(step_c) OVER (PARTITION BY vin ORDER BY ts, seq) AS BIGINT) AS odo_c FROM tel)"


# Aggregates over history


@query(f"WITH {TEL} SELECT time_bucket(INTERVAL '6 hours', ts) AS bucket, avg(soc) AS avg_soc, avg(speed_c) AS avg_speed_c, count(*) AS n FROM tel WHERE vin = 7 AND ts >= '2024-01-05' AND ts < '2024-01-20' GROUP BY 1 ORDER BY 1 LIMIT 5000")
def telemetry_bucket_avg(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("vin = 7 AND ts >= timestamp_ntz'2024-01-05' AND ts < timestamp_ntz'2024-01-20'")
    return t.groupBy(F.window("ts", "6 hours").start.alias("bucket")).agg(F.avg("soc").alias("avg_soc"), F.avg("speed_c").alias("avg_speed_c"), F.count(F.lit(1)).alias("n")).orderBy("bucket").limit(5000)


@query(f"WITH {TEL} SELECT tenant, {HOUR} AS hour, avg(soc) AS avg_soc, min(soc) AS min_soc FROM tel GROUP BY 1, 2")
def hourly_soc(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("tenant", F.expr(HOUR).alias("hour")).agg(F.avg("soc").alias("avg_soc"), F.min("soc").alias("min_soc"))


@query(f"WITH {TEL} SELECT {HOUR} AS hour, count(DISTINCT vin) AS vehicles FROM tel WHERE soc < 20 GROUP BY 1")
def low_soc_vehicles(spark, sf_dir):
    return telemetry(spark, sf_dir).where("soc < 20").groupBy(F.expr(HOUR).alias("hour")).agg(F.countDistinct("vin").alias("vehicles"))


@query(f"WITH {SMP} SELECT vin, max(odo_c) - min(odo_c) AS km_c FROM smp GROUP BY vin ORDER BY km_c DESC, vin LIMIT 10")
def km_per_vehicle_top10(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("vin").agg((F.max("odo_c") - F.min("odo_c")).alias("km_c")).orderBy(F.col("km_c").desc(), "vin").limit(10)


@query(f"WITH {TEL} SELECT count(*) AS n, avg(soc) AS avg_soc, count(DISTINCT vin) AS vehicles FROM tel")
def full_scan_stats(spark, sf_dir):
    return telemetry(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.avg("soc").alias("avg_soc"), F.countDistinct("vin").alias("vehicles"))


@query(f"WITH {SMP} SELECT tenant, count(*) AS n, avg(soc) AS avg_soc, min(soc) AS min_soc, max(soc) AS max_soc, count(DISTINCT vin) AS vehicles, CASE WHEN count(DISTINCT vin) = 1 THEN max(odo_c) - min(odo_c) ELSE 0 END AS span_c FROM smp GROUP BY tenant")
def telemetry_summary(spark, sf_dir):
    one = F.countDistinct("vin") == 1
    return samples(spark, sf_dir).groupBy("tenant").agg(F.count(F.lit(1)).alias("n"), F.avg("soc").alias("avg_soc"), F.min("soc").alias("min_soc"), F.max("soc").alias("max_soc"), F.countDistinct("vin").alias("vehicles"), F.when(one, F.max("odo_c") - F.min("odo_c")).otherwise(0).alias("span_c"))


@query("SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS trips, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT)) AS BIGINT) AS energy_c FROM orders GROUP BY 1")
def trip_daily(spark, sf_dir):
    return table(spark, sf_dir, "orders").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("day")).agg(F.count(F.lit(1)).alias("trips"), F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias("energy_c"))


@query("SELECT CASE GROUPING(day) WHEN 1 THEN NULL ELSE day END AS day, count(*) AS plans, CAST(sum(cost_c) AS BIGINT) AS cost_c FROM (SELECT date_trunc('month', l_shipdate)::TIMESTAMP AS day, CAST(floor(l_extendedprice * 100 + 0.5::DOUBLE) AS BIGINT) AS cost_c FROM lineitem) GROUP BY ROLLUP (day)")
def plan_cost_by_month(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem").select(F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("day"), F.floor(F.col("l_extendedprice") * 100 + 0.5).alias("cost_c"))
    return l.rollup("day").agg(F.count(F.lit(1)).alias("plans"), F.sum("cost_c").alias("cost_c"))


@query(f"WITH {TEL}, l AS (SELECT * FROM tel QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1) SELECT tenant, count(*) AS vehicles, count(*) FILTER (WHERE speed_c > 300) AS moving, count(*) FILTER (WHERE state IN ('CHARGING', 'PLUGGED')) AS charging, count(*) FILTER (WHERE soc < 20) AS low, avg(soc) AS avg_soc FROM l GROUP BY tenant")
def fleet_live_summary(spark, sf_dir):
    l = ordered.latest(telemetry(spark, sf_dir), "vin", "seq")
    return l.groupBy("tenant").agg(F.count(F.lit(1)).alias("vehicles"), F.count_if(F.col("speed_c") > 300).alias("moving"), F.count_if(F.col("state").isin("CHARGING", "PLUGGED")).alias("charging"), F.count_if(F.col("soc") < 20).alias("low"), F.avg("soc").alias("avg_soc"))


@query(f"WITH {TEL} SELECT CAST(floor(lat / 0.05::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / 0.05::DOUBLE) AS BIGINT) AS x, count(*) AS n, avg(soc) AS avg_soc, count(*) FILTER (WHERE soc < 20) AS low FROM tel GROUP BY 1, 2")
def map_cells(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(F.floor(F.col("lat") / 0.05).alias("y"), F.floor(F.col("lon") / 0.05).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.avg("soc").alias("avg_soc"), F.count_if(F.col("soc") < 20).alias("low"))


@query("WITH s AS (SELECT p_partkey, p_size * 2 AS soh FROM part) SELECT CASE WHEN soh < 70 THEN '<70' WHEN soh < 80 THEN '70-80' WHEN soh < 90 THEN '80-90' ELSE '>=90' END AS band, count(*) AS n, avg(soh) AS mean FROM s GROUP BY 1")
def soh_distribution(spark, sf_dir):
    soh = F.col("p_size") * 2
    band = F.when(soh < 70, "<70").when(soh < 80, "70-80").when(soh < 90, "80-90").otherwise(">=90")
    return table(spark, sf_dir, "part").groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), F.avg(soh).alias("mean"))


@query(f"WITH {TEL}, r AS (SELECT tenant, speed_c, row_number() OVER (PARTITION BY tenant ORDER BY speed_c) - 1 AS i, count(*) OVER (PARTITION BY tenant) AS n FROM tel) SELECT tenant, speed_c AS q, n FROM r WHERE i = CAST(floor(0.95::DOUBLE * (n - 1)) AS BIGINT)")
def quantile_by_index(spark, sf_dir):
    return ordered.quantile_by_index(telemetry(spark, sf_dir), "tenant", "speed_c", 0.95)


@query(f"WITH {TEL} SELECT evt, state, count(*) AS n FROM tel GROUP BY 1, 2 ORDER BY n DESC, evt, state LIMIT 10")
def dtc_topk(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy("evt", "state").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "evt", "state").limit(10)


# Alerts, joins and paging


@query(f"WITH {ALERT} SELECT severity, status, count(*) AS n FROM alert GROUP BY 1, 2")
def alerts_by_severity_status(spark, sf_dir):
    return alerts(spark, sf_dir).groupBy("severity", "status").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {ALERT} SELECT c_custkey AS vin, count(id) AS n, count(id) FILTER (WHERE status = 'open') AS open, max(detected_at) AS last FROM customer LEFT JOIN alert ON vin = c_custkey GROUP BY 1")
def vehicle_alert_summary(spark, sf_dir):
    a = alerts(spark, sf_dir).groupBy("vin").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "open").alias("open"), F.max("detected_at").alias("last"))
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vin"))
    return v.join(a, "vin", "left").select("vin", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("open", F.lit(0)).alias("open"), "last")


@query(f"WITH {ALERT} SELECT c_custkey AS vin, n_name AS fleet, r_name AS tenant, (SELECT count(*) FROM alert WHERE vin = c_custkey AND status = 'open') AS open FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey WHERE c_custkey > 20 ORDER BY c_custkey LIMIT 51")
def vehicle_list(spark, sf_dir):
    v = table(spark, sf_dir, "customer").where("c_custkey > 20").orderBy("c_custkey").limit(51)
    v = v.join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(table(spark, sf_dir, "region"), F.col("r_regionkey") == F.col("n_regionkey"))
    a = alerts(spark, sf_dir).where("status = 'open'").groupBy("vin").agg(F.count(F.lit(1)).alias("open"))
    return v.join(a, F.col("vin") == F.col("c_custkey"), "left").select(F.col("c_custkey").alias("vin"), F.col("n_name").alias("fleet"), F.col("r_name").alias("tenant"), F.coalesce("open", F.lit(0)).alias("open"))


@query(f"WITH {ALERT} SELECT c_custkey AS vin FROM customer WHERE NOT EXISTS (SELECT 1 FROM alert WHERE vin = c_custkey AND severity = 'CRITICAL' AND status = 'open')")
def vehicles_without_alerts(spark, sf_dir):
    a = alerts(spark, sf_dir).where("severity = 'CRITICAL' AND status = 'open'")
    v = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vin"))
    return v.join(a, "vin", "left_anti")


@query("SELECT r_regionkey AS tenant, r_name AS name FROM region WHERE EXISTS (SELECT 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE n_regionkey = r_regionkey AND s_acctbal > 5000)")
def entitled_tenants(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 5000").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return table(spark, sf_dir, "region").join(s, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select(F.col("r_regionkey").alias("tenant"), F.col("r_name").alias("name"))


ORDERED_ALERT = "severity = 'CRITICAL' DESC, detected_at DESC, id"


@query(f"WITH {ALERT} SELECT vin, id, severity, detected_at FROM alert WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY vin ORDER BY {ORDERED_ALERT}) = 1")
def open_risk(spark, sf_dir):
    a = alerts(spark, sf_dir).where("status = 'open'")
    return ordered.first_per(a, "vin", (F.col("severity") == "CRITICAL").desc(), F.col("detected_at").desc(), F.col("id")).select("vin", "id", "severity", "detected_at")


@query(f"WITH {ALERT}, l AS (SELECT * FROM alert WHERE status = 'open' QUALIFY row_number() OVER (PARTITION BY vin ORDER BY detected_at DESC, id) = 1) SELECT vin, id, severity, detected_at FROM l ORDER BY {ORDERED_ALERT} LIMIT 20")
def at_risk_topn(spark, sf_dir):
    a = ordered.first_per(alerts(spark, sf_dir).where("status = 'open'"), "vin", F.col("detected_at").desc(), F.col("id"))
    return a.orderBy((F.col("severity") == "CRITICAL").desc(), F.col("detected_at").desc(), "id").limit(20).select("vin", "id", "severity", "detected_at")


@query(f"WITH {ALERT} SELECT id, vin, detected_at FROM alert WHERE detected_at < '1998-01-01' OR (detected_at = '1998-01-01' AND id < 5000) ORDER BY detected_at DESC, id DESC LIMIT 50")
def keyset_alerts(spark, sf_dir):
    a = alerts(spark, sf_dir).where("struct(detected_at, id) < struct(timestamp_ntz'1998-01-01', 5000L)")
    return a.orderBy(F.col("detected_at").desc(), F.col("id").desc()).limit(50).select("id", "vin", "detected_at")


@query(f"WITH {ALERT} SELECT id, vin, detected_at FROM alert ORDER BY detected_at DESC, id DESC LIMIT 50 OFFSET 100")
def offset_page(spark, sf_dir):
    return alerts(spark, sf_dir).orderBy(F.col("detected_at").desc(), F.col("id").desc()).offset(100).limit(50).select("id", "vin", "detected_at")


@query("SELECT s_suppkey AS charger, CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE s_nationkey % 5 END AS tenant FROM supplier WHERE s_suppkey % 3 = 0 OR s_nationkey % 5 = 2")
def visible_chargers(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("charger"), F.when(F.col("s_suppkey") % 3 != 0, F.col("s_nationkey") % 5).alias("tenant"))
    return s.where("tenant IS NULL OR tenant = 2")


@query(f"WITH {TEL} SELECT seq, sign(lat) * floor(abs(lat) * 10 + 0.5::DOUBLE) / 10 AS lat, sign(lon) * floor(abs(lon) * 10 + 0.5::DOUBLE) / 10 AS lon FROM tel WHERE tenant = 3")
def masked_locations(spark, sf_dir):
    return telemetry(spark, sf_dir).where("tenant = 3").select("seq", C.round_half_away(F.col("lat"), 1).alias("lat"), C.round_half_away(F.col("lon"), 1).alias("lon"))


BANDS_SQL = ", ".join(f"({a}, {b}, {c})" for a, b, c in BANDS)


@query(f"WITH {TEL} SELECT seq, coalesce(price_c, 800) AS price_c FROM tel LEFT JOIN (VALUES {BANDS_SQL}) AS b(lo, hi, price_c) ON hour(ts) >= lo AND hour(ts) < hi WHERE state = 'CHARGING'")
def tariff_price_range_join(spark, sf_dir):
    bands = spark.createDataFrame(BANDS, "lo int, hi int, price_c int")
    t = telemetry(spark, sf_dir).where("state = 'CHARGING'")
    return lookup.range_lookup(t, bands, F.hour("ts"), low="lo", high="hi", value="price_c", default=800).select("seq", "price_c")


CITY_SQL = ", ".join(f"({i}, '{n}', {a}::DOUBLE, {b}::DOUBLE)" for i, (n, a, b) in enumerate(CITIES))


@query(f"WITH {TEL}, c AS (SELECT * FROM (VALUES {CITY_SQL}) AS c(i, city, a, b)) SELECT seq, city FROM tel, c QUALIFY row_number() OVER (PARTITION BY seq ORDER BY power(lat - a, 2) + power(lon - b, 2), i) = 1")
def nearest_city(spark, sf_dir):
    return lookup.nearest_of(telemetry(spark, sf_dir), CITIES).select("seq", "city")


@query(f"""WITH {SMP}, s AS (SELECT vin, soc FROM smp QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1)
SELECT c_custkey AS vin, soc FROM customer LEFT JOIN s ON s.vin = c_custkey""")
def latest_soc_of_vehicles(spark, sf_dir):
    s = telemetry(spark, sf_dir).groupBy("vin").agg(F.max_by("soc", "seq").alias("soc"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("vin")).join(s, "vin", "left")


@query("""WITH i AS (SELECT l_orderkey AS vin, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS id, epoch(l_shipdate)::BIGINT AS a, epoch(l_shipdate)::BIGINT + CAST(l_quantity AS BIGINT) * 86400 AS b FROM lineitem)
SELECT vin, count(*) AS n, CAST(sum(o) AS BIGINT) AS overlap FROM (SELECT x.vin, x.id, max(least(x.b, y.b) - greatest(x.a, y.a)) AS o, any_value(x.b - x.a) AS len FROM i x JOIN i y ON x.vin = y.vin AND x.id <> y.id AND x.a < y.b AND y.a < x.b GROUP BY 1, 2) WHERE o * 2 >= len GROUP BY vin""")
def trip_overlap_match(spark, sf_dir):
    l = table(spark, sf_dir, "lineitem")
    start = F.unix_seconds(F.col("l_shipdate").cast("timestamp"))
    # Numbered once, in a stored table: both sides of the join see the same numbers.
    i = stored(l.select(F.col("l_orderkey").alias("vin"), F.monotonically_increasing_id().alias("id"), start.alias("a"), (start + F.col("l_quantity").cast("long") * 86400).alias("b")))
    met = lookup.overlaps(i, i, "vin", 30 * 86400).where("id <> rid")
    best = met.groupBy("vin", "id", "a", "b").agg(F.max("overlap").alias("o")).where("o * 2 >= b - a")
    return best.groupBy("vin").agg(F.count(F.lit(1)).alias("n"), F.sum("o").alias("overlap"))


@query("""WITH v AS (SELECT o_custkey AS driver, o_orderkey AS id, o_orderdate AS a, o_orderdate + INTERVAL 20 DAY AS b FROM orders)
SELECT driver, id FROM (SELECT *, lead(a) OVER (PARTITION BY driver ORDER BY a, id) AS next FROM v) WHERE next < b""")
def assignment_overlaps(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("driver"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("a"), F.expr("o_orderdate + INTERVAL 20 DAY").alias("b"))
    return o.withColumn("next", F.lead("a").over(Window.partitionBy("driver").orderBy("a", "id"))).where("next < b").select("driver", "id")


@query(f"WITH {ALERT}, w AS (SELECT vin, severity, date_trunc('month', detected_at)::TIMESTAMP AS win, min(id) AS id, count(*) AS n FROM alert GROUP BY 1, 2, 3) SELECT id, vin, severity, win, n - 1 AS duplicates FROM w")
def alert_upsert(spark, sf_dir):
    a = alerts(spark, sf_dir).groupBy("vin", "severity", F.date_trunc("month", "detected_at").cast("timestamp_ntz").alias("win")).agg(F.min("id").alias("id"), (F.count(F.lit(1)) - 1).alias("duplicates"))
    return a.select("id", "vin", "severity", "win", "duplicates")


# Ordered rows

VERDICTS = f"""{ARR}, b AS (SELECT *, max(seq) OVER (PARTITION BY vin ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pm, row_number() OVER (PARTITION BY vin, seq ORDER BY n) AS k FROM arr),
v AS (SELECT vin, ts, seq, n, CASE WHEN seq = 0 THEN 'stale' WHEN pm IS NULL OR pm = 0 OR seq > pm THEN 'new' WHEN pm - seq >= 256 THEN 'stale' WHEN k > 1 THEN 'duplicate' ELSE 'late' END AS verdict FROM b)"""


@query(f"WITH {VERDICTS} SELECT vin, seq, n, verdict FROM v")
def dedup_verdicts(spark, sf_dir):
    return ordered.dedup_verdicts(arrivals(spark, sf_dir)).select("vin", "seq", "n", "verdict")


@query(f"WITH {VERDICTS} SELECT verdict, count(*) AS n FROM v GROUP BY 1")
def dedup_verdict_counts(spark, sf_dir):
    return ordered.dedup_verdicts(arrivals(spark, sf_dir)).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {VERDICTS} SELECT count(*) AS sent, count(*) FILTER (WHERE verdict IN ('new', 'late')) AS kept, count(*) FILTER (WHERE verdict = 'duplicate') AS duplicates, count(*) FILTER (WHERE verdict = 'stale') AS stale, (SELECT count(*) FROM (SELECT DISTINCT vin, ts, seq FROM arr)) AS stored FROM v")
def recon_report(spark, sf_dir):
    a = arrivals(spark, sf_dir)
    is_ = lambda *v: F.count_if(F.col("verdict").isin(*v))
    report = ordered.dedup_verdicts(a).agg(F.count(F.lit(1)).alias("sent"), is_("new", "late").alias("kept"), is_("duplicate").alias("duplicates"), is_("stale").alias("stale"))
    return report.crossJoin(F.broadcast(a.select("vin", "ts", "seq").distinct().agg(F.count(F.lit(1)).alias("stored"))))


@query(f"WITH {ARR} SELECT vin, ts, seq, max(n) AS n FROM arr GROUP BY 1, 2, 3")
def final_dedup(spark, sf_dir):
    return arrivals(spark, sf_dir).groupBy("vin", "ts", "seq").agg(F.max("n").alias("n"))


@query(f"WITH {TEL} SELECT vin, ts, seq, soc, speed_c, state FROM tel QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1")
def latest_state(spark, sf_dir):
    return ordered.latest(telemetry(spark, sf_dir).select("vin", "ts", "seq", "soc", "speed_c", "state"), "vin", "seq")


@query(f"""WITH {SMP}, m AS (SELECT *, CASE WHEN speed_c > 300 AND state <> 'CHARGING' THEN 1 ELSE 0 END AS mv FROM smp), g AS (SELECT *, sum(mv) OVER (PARTITION BY vin ORDER BY ts, seq) AS g FROM m),
k AS (SELECT vin, g, CASE WHEN coalesce(epoch_us(max(ts) FILTER (WHERE mv = 0)) - epoch_us(min(ts) FILTER (WHERE mv = 0)) >= 21600000000, false) OR bool_or(state = 'CHARGING') THEN 1 ELSE 0 END AS brk,
  min(ts) FILTER (WHERE mv = 1) AS t, min(odo_c) FILTER (WHERE mv = 1) AS o FROM g WHERE g > 0 GROUP BY 1, 2),
t AS (SELECT *, coalesce(sum(brk) OVER (PARTITION BY vin ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS trip FROM k)
SELECT vin, min(t) AS start, max(t) AS "end", max(o) - min(o) AS km_c, count(*) AS n FROM t GROUP BY vin, trip HAVING max(o) - min(o) >= 20""")
def trips(spark, sf_dir):
    return ordered.trips(samples(spark, sf_dir), dwell_s=6 * 3600)


@query(f"""WITH {TEL}, d AS (SELECT *, floor(epoch_us(ts) / 1000000)::BIGINT AS e, lag(state) OVER w AS was, floor(epoch_us(lag(ts) OVER w) / 1000000)::BIGINT AS pe FROM tel WINDOW w AS (PARTITION BY vin ORDER BY ts, seq)),
n AS (SELECT *, CASE WHEN was IS DISTINCT FROM 'CHARGING' OR e - pe > 43200 THEN 1 ELSE 0 END AS new FROM d WHERE state = 'CHARGING'),
s AS (SELECT *, sum(new) OVER (PARTITION BY vin ORDER BY ts, seq) AS id FROM n)
SELECT vin, min(ts) AS start, max(ts) AS "end", count(*) AS n, arg_max(soc, (ts, seq)) - arg_min(soc, (ts, seq)) AS rise, CAST(sum(CASE WHEN new = 0 AND e > pe THEN step_c * (e - pe) ELSE 0 END) AS BIGINT) AS energy FROM s GROUP BY vin, id""")
def charge_sessions(spark, sf_dir):
    return ordered.charge_sessions(telemetry(spark, sf_dir), gap_s=12 * 3600)


@query("""SELECT o_orderkey AS trip, avg(cents) OVER w AS prior_mean, last_value(cents) OVER w AS prior_last, count(*) OVER w AS n_prior FROM (SELECT *, CAST(floor(o_totalprice * 100 + 0.5::DOUBLE) AS BIGINT) AS cents FROM orders)
WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def prior_trip_features(spark, sf_dir):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, -1)
    o = table(spark, sf_dir, "orders").withColumn("cents", F.floor(F.col("o_totalprice") * 100 + 0.5))
    return o.select(F.col("o_orderkey").alias("trip"), F.avg("cents").over(w).alias("prior_mean"), F.last("cents").over(w).alias("prior_last"), F.count(F.lit(1)).over(w).alias("n_prior"))


@query(f"""WITH {TEL}, l AS (SELECT vin, seq, sha256(CAST(vin AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || evt) AS h FROM tel)
SELECT vin, count(*) AS links, sha256(string_agg(h, chr(10) ORDER BY h)) AS digest FROM l GROUP BY vin""")
def audit_digest(spark, sf_dir):
    line = F.sha2(F.concat_ws("|", F.col("vin").cast("string"), F.col("seq").cast("string"), "evt"), 256)
    return folds.digests(telemetry(spark, sf_dir).select("vin", line.alias("line")), "vin", "line")


# Scalars


@query("""WITH v AS (SELECT c_custkey AS id, '1HGCM826' || chr(48 + CAST(c_custkey % 10 AS INTEGER)) || '3A' || lpad(CAST(c_custkey % 1000000 AS VARCHAR), 6, '0') AS vin FROM customer),
t AS (SELECT id, vin, list_sum(list_transform(range(1, 18), lambda i: CAST(substr(translate(vin, 'ABCDEFGHJKLMNPRSTUVWXYZ', '12345678123457923456789'), i, 1) AS INTEGER) * [8, 7, 6, 5, 4, 3, 2, 10, 0, 9, 8, 7, 6, 5, 4, 3, 2][i])) % 11 AS c FROM v)
SELECT id, vin, substr(vin, 9, 1) = CASE c WHEN 10 THEN 'X' ELSE CAST(c AS VARCHAR) END AS valid FROM t""")
def vin_valid(spark, sf_dir):
    vin = F.concat(F.lit("1HGCM826"), F.char(F.col("c_custkey") % 10 + 48), F.lit("3A"), F.lpad((F.col("c_custkey") % 1000000).cast("string"), 6, "0"))
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), vin.alias("vin")).withColumn("valid", C.vin_valid(F.col("vin")))


@query("""WITH r AS (SELECT p_partkey AS id, CAST((p_partkey * 7919) % 65536 AS INTEGER) AS n FROM part)
SELECT id, printf('%04X', n) AS raw, substr('PCBU', (n >> 14) + 1, 1) || CAST((n >> 12) & 3 AS VARCHAR) || printf('%03X', n & 4095) AS code FROM r""")
def dtc_decode(spark, sf_dir):
    raw = F.lpad(F.hex(F.col("p_partkey") * 7919 % 65536), 4, "0")
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), raw.alias("raw")).withColumn("code", C.dtc_decode(F.col("raw")))


@query(f"""WITH {TEL}, b AS (SELECT *, CAST(floor((lon + 180) / 360 * 32768::DOUBLE) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 32768::DOUBLE) AS BIGINT) AS y FROM tel)
SELECT geohash, count(*) AS n FROM (SELECT list_aggregate(list_transform(range(0, 6), lambda c: substr('0123456789bcdefghjkmnpqrstuvwxyz', CAST(list_sum(list_transform(range(0, 5), lambda j: (CASE WHEN (5 * c + j) % 2 = 0 THEN (x >> CAST(14 - (5 * c + j) // 2 AS BIGINT)) & 1 ELSE (y >> CAST(14 - (5 * c + j) // 2 AS BIGINT)) & 1 END) << CAST(4 - j AS BIGINT))) AS BIGINT) + 1, 1)), 'string_agg', '') AS geohash FROM b) GROUP BY 1""")
def geohash_cells(spark, sf_dir):
    return telemetry(spark, sf_dir).groupBy(C.geohash(F.col("lat"), F.col("lon"), 6).alias("geohash")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {TEL} SELECT vin, max(floor(12742.0176::DOUBLE * asin(sqrt(power(sin(radians(lat - 12.5::DOUBLE) / 2), 2) + cos(radians(lat)) * cos(radians(12.5::DOUBLE)) * power(sin(radians(lon - 80.25::DOUBLE) / 2), 2))) * 1000 + 0.5::DOUBLE))::BIGINT AS far_m FROM tel GROUP BY vin")
def haversine(spark, sf_dir):
    km = C.haversine_km(F.lit(12.5), F.lit(80.25), F.col("lat"), F.col("lon"))
    return telemetry(spark, sf_dir).groupBy("vin").agg(F.max(F.floor(km * 1000 + 0.5)).alias("far_m"))


@query("""WITH q AS (SELECT vec_id AS qid, embedding AS q FROM embeddings WHERE vec_id % 20 = 0),
p AS (SELECT qid, vec_id AS id, list_sum(list_transform(range(1, len(q) + 1), lambda i: q[i]::DOUBLE * embedding[i]::DOUBLE)) / sqrt(list_sum(list_transform(q, lambda x: x::DOUBLE * x::DOUBLE)) * list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))) AS c FROM q, embeddings WHERE vec_id <> qid)
SELECT qid, id, row_number() OVER (PARTITION BY qid ORDER BY c DESC, id) AS rank FROM p QUALIFY rank <= 5""")
def vector_topk(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return vectors.top_neighbours(v.where("id % 20 = 0").select(F.col("id").alias("qid"), F.col("v").alias("q")), v, 5).select("qid", "id", "rank")
