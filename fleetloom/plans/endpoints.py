"""Queries of list endpoints: search, filters, pages, lookups with defaults, guarded changes, masks, audit, identities."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import governance, paging
from ..sources.adapters import ALERT, TEL, alerts, table, telemetry
from ..sources.scratch import folder
from .fleet import query

# Filters


@query("SELECT p_partkey AS model, p_type AS type FROM part WHERE p_type LIKE 'ECO%'")
def models_by_prefix(spark, sf_dir):
    """What a user typed, as a prefix that the scan filters by."""
    return table(spark, sf_dir, "part").where(paging.starts_with("p_type", " eco ")).select(F.col("p_partkey").alias("model"), F.col("p_type").alias("type"))


@query("SELECT o_orderkey AS trip, o_custkey AS vin FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'FURNITURE') AND o_orderpriority IN ('1-URGENT', '2-HIGH')")
def trips_of_vehicles(spark, sf_dir):
    """Membership in a short list is a pushed filter, in a table a semi join."""
    wanted = table(spark, sf_dir, "customer").where("c_mktsegment = 'FURNITURE'").select(F.col("c_custkey").alias("vin"))
    o = table(spark, sf_dir, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))
    return o.select(F.col("o_orderkey").alias("trip"), F.col("o_custkey").alias("vin")).join(wanted, "vin", "left_semi").select("trip", "vin")


@query(f"WITH {TEL} SELECT seq, vin, state FROM tel WHERE evt = 'error'")
def audit_search(spark, sf_dir):
    """Filters that are left empty don't count."""
    given = paging.chosen({"evt": ["error", "view", "click", "signup", "purchase"], "state": None}, evt="error", state="")
    return telemetry(spark, sf_dir).where(given).select("seq", "vin", "state")


@query("SELECT event_id AS seq, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) = 93 AS held FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) BETWEEN 90 AND 95")
def evidence_search(spark, sf_dir):
    """A number within JSON, and whether the JSON holds an object."""
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "bigint")
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), k.alias("k"), paging.holds("props", {"k": 93}).alias("held")).where("k BETWEEN 90 AND 95")


@query("WITH s AS (SELECT o_orderkey AS subscription, o_custkey AS tenant, o_orderdate AS valid_from, CASE WHEN o_orderkey % 5 > 0 THEN o_orderdate + to_days(CAST(o_orderkey % 400 AS INTEGER)) END AS valid_to FROM orders) SELECT subscription, tenant FROM s WHERE valid_from <= '1998-06-01' AND (valid_to IS NULL OR valid_to > '1998-06-01')")
def active_subscriptions(spark, sf_dir):
    end = F.when(F.col("o_orderkey") % 5 > 0, F.expr("o_orderdate + make_dt_interval(CAST(o_orderkey % 400 AS INT))"))
    s = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("subscription"), F.col("o_custkey").alias("tenant"), F.col("o_orderdate").alias("valid_from"), end.alias("valid_to"))
    return s.where(paging.valid_at(F.lit("1998-06-01").cast("timestamp_ntz"), "valid_from", "valid_to")).select("subscription", "tenant")


CURSOR_SQL = "translate(rtrim(to_base64(encode(CAST(epoch_us(detected_at) AS VARCHAR) || '|' || CAST(id AS VARCHAR))), '='), '+/', '-_')"


@query(f"WITH {ALERT} SELECT id, vin, detected_at, {CURSOR_SQL} AS cursor FROM alert ORDER BY detected_at DESC, id DESC LIMIT 50 OFFSET 50")
def alerts_after_cursor(spark, sf_dir):
    """The second page, by the cursor of the first page's last row."""
    a = alerts(spark, sf_dir).withColumn("cursor", paging.cursor(F.col("detected_at"), F.col("id")))
    last = paging.page_before(a, "detected_at", "id", 50).orderBy("detected_at", "id").first()
    return paging.page_before(a, "detected_at", "id", 50, last and last["cursor"]).select("id", "vin", "detected_at", "cursor")


# Lookups

GRANTS = "g AS (SELECT n_regionkey AS tenant, CASE WHEN n_nationkey % 3 = 0 THEN 'basic' WHEN n_nationkey % 3 = 1 THEN 'fleet' ELSE 'energy' END AS plan, n_nationkey AS fleet FROM nation)"


@query(f"WITH {GRANTS} SELECT fleet, tenant, feature FROM g JOIN (SELECT DISTINCT p_brand AS feature, CASE p_size % 3 WHEN 0 THEN 'basic' WHEN 1 THEN 'fleet' ELSE 'energy' END AS plan FROM part) USING (plan)")
def tenant_features(spark, sf_dir):
    """Subscriptions joined to the features of their plan."""
    plan = lambda n: F.when(n % 3 == 0, "basic").when(n % 3 == 1, "fleet").otherwise("energy")
    subscriptions = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("tenant"), plan(F.col("n_nationkey")).alias("plan"), F.col("n_nationkey").alias("fleet"))
    features = table(spark, sf_dir, "part").select(F.col("p_brand").alias("feature"), plan(F.col("p_size")).alias("plan")).distinct()
    return subscriptions.join(features, "plan").select("fleet", "tenant", "feature")


@query("""WITH e AS (SELECT o_custkey AS vin, 6000 + o_orderkey % 4000 AS soh_c FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1)
SELECT vin, n_name AS model, soh_c FROM e JOIN customer ON c_custkey = vin JOIN nation ON n_nationkey = c_nationkey ORDER BY soh_c, vin LIMIT 20""")
def lowest_soh(spark, sf_dir):
    """The twenty vehicles in the poorest health, with their model."""
    e = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("vin")).agg((F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")) % 4000 + 6000).alias("soh_c"))
    v = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    return e.join(v, F.col("c_custkey") == F.col("vin")).select("vin", F.col("n_name").alias("model"), "soh_c").orderBy("soh_c", "vin").limit(20)


LAST_STATUS = "ls AS (SELECT l_suppkey AS charger, CASE max({'o': l_orderkey, 'n': l_linenumber, 'p': l_partkey, 'st': l_linestatus}).st WHEN 'O' THEN 'OUT_OF_SERVICE' ELSE 'OCCUPIED' END AS status FROM lineitem GROUP BY 1)"


def charger_status(spark, sf_dir) -> DataFrame:
    """charger, status, n: statuses of chargers with the order of their arrival."""
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_suppkey").alias("charger"), F.when(F.col("l_linestatus") == "O", "OUT_OF_SERVICE").otherwise("OCCUPIED").alias("status"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_linestatus").alias("n"))


@query(f"""WITH {TEL}, {ALERT}, {LAST_STATUS}, l AS (SELECT vin, soc FROM tel QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1),
r AS (SELECT vin, CASE WHEN bool_or(severity = 'CRITICAL') THEN 'CRITICAL' ELSE 'WARNING' END AS risk FROM alert WHERE status = 'open' GROUP BY 1)
SELECT l.vin, soc, coalesce(risk, 'NONE') AS risk, coalesce(status, 'AVAILABLE') AS status FROM l LEFT JOIN r ON r.vin = l.vin LEFT JOIN ls ON ls.charger = l.vin""")
def map_vehicles(spark, sf_dir):
    """State, risk and the status of the vehicle's charger; a charger that never spoke is available."""
    l = telemetry(spark, sf_dir).groupBy("vin").agg(F.max_by("soc", "seq").alias("soc"))
    r = alerts(spark, sf_dir).where("status = 'open'").groupBy("vin").agg(F.when(F.bool_or(F.col("severity") == "CRITICAL"), "CRITICAL").otherwise("WARNING").alias("risk"))
    s = charger_status(spark, sf_dir).groupBy(F.col("charger").alias("vin")).agg(F.max_by("status", "n").alias("status"))
    return l.join(r, "vin", "left").join(s, "vin", "left").select("vin", "soc", F.coalesce("risk", F.lit("NONE")).alias("risk"), F.coalesce("status", F.lit("AVAILABLE")).alias("status"))


def grid_size(asked: float, precise: bool) -> float:
    """Degrees of a map cell: 0.001 to 1, and at least 0.02 for roles without precise places."""
    return min(1.0, max(0.001 if precise else 0.02, asked))


@query(f"WITH {TEL} SELECT CAST(floor(lat / 0.02::DOUBLE) AS BIGINT) AS y, CAST(floor(lon / 0.02::DOUBLE) AS BIGINT) AS x, count(*) AS n, count(*) FILTER (WHERE soc < 20) AS low FROM tel GROUP BY 1, 2")
def map_grid_of_viewer(spark, sf_dir):
    size = F.lit(grid_size(0.0001, precise=False))
    return telemetry(spark, sf_dir).groupBy(F.floor(F.col("lat") / size).alias("y"), F.floor(F.col("lon") / size).alias("x")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("soc") < 20).alias("low"))


@query(f"WITH {ALERT} SELECT id, vin, status, detected_at FROM alert ORDER BY status = 'open' DESC, detected_at DESC, id DESC LIMIT 1")
def latest_incident(spark, sf_dir):
    return alerts(spark, sf_dir).orderBy((F.col("status") == "open").desc(), F.col("detected_at").desc(), F.col("id").desc()).limit(1).select("id", "vin", "status", "detected_at")


@query(f"WITH {TEL} SELECT DISTINCT tenant FROM tel")
def tenants_with_data(spark, sf_dir):
    return telemetry(spark, sf_dir).select("tenant").distinct()


@query(f"WITH {ALERT} SELECT vin, array_to_string(list_sort(list(DISTINCT severity)), ',') AS severities, bool_or(status = 'open') AS open FROM alert GROUP BY vin")
def alert_kinds(spark, sf_dir):
    """A set of a fixed range of values is bounded, whatever the group."""
    return alerts(spark, sf_dir).groupBy("vin").agg(F.array_join(F.array_sort(F.collect_set("severity")), ",").alias("severities"), F.bool_or(F.col("status") == "open").alias("open"))


# Changes


@query("""SELECT o_orderkey AS plan, CASE WHEN o_orderstatus = 'O' AND o_orderkey % 3 = 0 THEN 'approved' WHEN o_orderstatus = 'O' THEN 'proposed' WHEN o_orderstatus = 'F' THEN 'approved' ELSE 'rejected' END AS status,
o_orderstatus = 'O' AND o_orderkey % 3 = 0 AS changed FROM orders""")
def approved_plans(spark, sf_dir):
    """Only proposed plans can be approved."""
    status = F.when(F.col("o_orderstatus") == "O", "proposed").when(F.col("o_orderstatus") == "F", "approved").otherwise("rejected")
    plans = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("plan"), status.alias("status"))
    return governance.transition(plans, plans.where("plan % 3 = 0"), "plan", "proposed", "approved")


@query("SELECT 'user:' || c_custkey AS ref, c_nationkey AS kind FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'seed:' || s_suppkey, s_nationkey FROM supplier")
def incident_reload(spark, sf_dir):
    """Incidents of a seed are replaced by those of a new one; others stay."""
    ref = lambda tag, c: F.concat(tag, F.lit(":"), F.col(c).cast("string"))
    old = table(spark, sf_dir, "customer").select(ref(F.when(F.col("c_custkey") % 2 == 0, "seed").otherwise("user"), "c_custkey").alias("ref"), F.col("c_nationkey").alias("kind"))
    new = table(spark, sf_dir, "supplier").select(ref(F.lit("seed"), "s_suppkey").alias("ref"), F.col("s_nationkey").alias("kind"))
    return governance.reload(old, new, "ref", "seed:")


@query(f"WITH {TEL} SELECT seq, CAST(floor(lat * 100 + 0.5::DOUBLE) AS BIGINT) AS lat_c, CAST(floor(lon * 100 + 0.5::DOUBLE) AS BIGINT) AS lon_c, soc::BIGINT AS soc, false AS route FROM tel WHERE evt = 'error'")
def evidence_for_viewer(spark, sf_dir):
    """Evidence of alerts as a role without precise places sees it."""
    t = telemetry(spark, sf_dir).where("evt = 'error'")
    near = F.array(F.array("lat", "lon"), F.array(F.col("lat") + 0.01, F.col("lon") + 0.01))
    seen = governance.mask_evidence(F.to_json(F.struct((F.col("lat") + 0.00123).alias("lat"), (F.col("lon") + 0.00123).alias("lon"), "soc", near.alias("route"))), precise=False)
    at = lambda k: F.floor(F.get_json_object("e", f"$.{k}").cast("double") * 100 + 0.5)
    return t.select("seq", seen.alias("e")).select("seq", at("lat").alias("lat_c"), at("lon").alias("lon_c"), F.get_json_object("e", "$.soc").cast("long").alias("soc"), F.get_json_object("e", "$.route").isNotNull().alias("route"))


@query(f"WITH {TEL}, {ALERT} SELECT 'dispatcher' AS actor, 'alerts.read' AS action, (SELECT count(*) FROM alert WHERE status = 'open') AS n UNION ALL SELECT 'viewer', 'fleet.read', (SELECT count(DISTINCT vin) FROM tel)")
def access_audit(spark, sf_dir):
    """Two reads, and the records that they leave."""
    log = folder(spark)
    governance.audited(alerts(spark, sf_dir).where("status = 'open'"), log, "dispatcher", "alerts.read")
    governance.audited(telemetry(spark, sf_dir).select("vin").distinct(), log, "viewer", "fleet.read")
    return spark.read.parquet(log).select("actor", "action", "n")


@query("SELECT c_custkey AS id, c_name AS name, true AS hidden FROM customer")
def sealed_names(spark, sf_dir):
    """Personal data encrypted and read back; no two sealings of one text are alike."""
    key = F.unhex(F.sha2(F.lit("a key from the caller's store"), 256))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", governance.sealed(F.col("c_name"), key).alias("sealed"))
    return c.select("id", governance.opened(F.col("sealed"), key).alias("name"), (~F.contains("sealed", "c_name")).alias("hidden"))


CHECKS = {"orders": {"price": "o_totalprice >= 0", "status": "o_orderstatus IN ('O', 'F', 'P')", "customer": "o_custkey >= 0"}, "lineitem": {"quantity": "l_quantity > 0", "discount": "l_discount BETWEEN 0 AND 0.05", "line": "l_linenumber BETWEEN 1 AND 6"}}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS rule, count(*) FILTER (WHERE NOT coalesce({e}, false)) AS broken FROM {t}" for t, cs in CHECKS.items() for c, e in cs.items()))
def broken_rules(spark, sf_dir):
    """Rows that break each rule of a table: one scan a table, a null breaks a rule."""
    found = None
    for name, rules in CHECKS.items():
        counts = table(spark, sf_dir, name).agg(*[F.count_if(~F.coalesce(F.expr(e), F.lit(False))).alias(c) for c, e in rules.items()])
        rows = counts.select(F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(c).alias("rule"), F.col(c).alias("broken")) for c in rules])).alias("r")).select("r.*")
        found = rows if found is None else found.unionByName(rows)
    return found


# Identities and cells

#: The namespace of names of devices, itself the name-based UUID of the word fleetloom below the fixed DNS namespace.
DNS = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"


@query(f"""WITH h AS (SELECT c_custkey AS id, sha1(unhex('{DNS.replace("-", "")}') || encode('device-' || c_custkey)) AS h FROM customer)
SELECT id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(CAST('0x' || substr(h, 17, 1) AS INTEGER) % 4 + 1 AS INTEGER), 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS device FROM h""")
def device_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), C.uuid5(DNS, F.concat(F.lit("device-"), F.col("c_custkey").cast("string"))).alias("device"))


def geohash_sql(x: str, y: str) -> str:
    """A geohash of six characters from numbers of cells."""
    bit = f"(CASE WHEN (5 * c + j) % 2 = 0 THEN (({x}) >> CAST(14 - (5 * c + j) // 2 AS BIGINT)) & 1 ELSE (({y}) >> CAST(14 - (5 * c + j) // 2 AS BIGINT)) & 1 END) << CAST(4 - j AS BIGINT)"
    return f"list_aggregate(list_transform(range(0, 6), lambda c: substr('{C.GEOHASH}', CAST(list_sum(list_transform(range(0, 5), lambda j: {bit})) AS BIGINT) + 1, 1)), 'string_agg', '')"


@query(f"""WITH {TEL}, b AS (SELECT DISTINCT CAST(floor((lon + 180) / 360 * 32768::DOUBLE) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 32768::DOUBLE) AS BIGINT) AS y FROM tel)
SELECT {geohash_sql('x', 'y')} AS geohash, CAST(floor(((y + 0.5::DOUBLE) / 32768 * 180 - 90) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS lat_u, CAST(floor(((x + 0.5::DOUBLE) / 32768 * 360 - 180) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS lon_u,
CAST(floor((y / 32768.0::DOUBLE * 180 - 90) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS south_u, CAST(floor(((x + 1) / 32768.0::DOUBLE * 360 - 180) * 1000000 + 0.5::DOUBLE) AS BIGINT) AS east_u,
{" || ',' || ".join(geohash_sql(f'x + {i}' if i >= 0 else f'x - {-i}', f'y + {j}' if j >= 0 else f'y - {-j}') for j in (-1, 0, 1) for i in (-1, 0, 1) if i or j)} AS near FROM b""")
def geohash_surroundings(spark, sf_dir):
    """Centre, edges and neighbours of every cell that vehicles were in."""
    cells = telemetry(spark, sf_dir).select(C.geohash(F.col("lat"), F.col("lon"), 6).alias("geohash")).distinct()
    micro = lambda c: F.floor(c * 1_000_000 + 0.5)
    at, edge = C.geohash_centre(F.col("geohash"), 6), C.geohash_bounds(F.col("geohash"), 6)
    return cells.select("geohash", micro(at["lat"]).alias("lat_u"), micro(at["lon"]).alias("lon_u"), micro(edge["south"]).alias("south_u"), micro(edge["east"]).alias("east_u"), F.array_join(C.geohash_neighbours(F.col("geohash"), 6), ",").alias("near"))


@query(f"WITH {TEL} SELECT vin, count(*) AS n, CAST(sum(step_c) AS BIGINT) AS step_c FROM tel WHERE seq % 2 = 0 GROUP BY vin")
def evidence_without_route(spark, sf_dir):
    """One key taken out of JSON, the others kept with their types."""
    doc = F.to_json(F.struct("vin", "step_c", F.lit("a").alias("route")))
    slim = telemetry(spark, sf_dir).where("seq % 2 = 0").select(F.from_json(C.without_key(doc, "route"), "vin BIGINT, step_c BIGINT, route STRING").alias("d"))
    return slim.where("d.route IS NULL").groupBy("d.vin").agg(F.count(F.lit(1)).alias("n"), F.sum("d.step_c").alias("step_c"))


