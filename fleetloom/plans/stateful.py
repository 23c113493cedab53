"""Queries whose rows depend on earlier results: folds, streams, chains, graphs, plans and models."""

from __future__ import annotations

import math

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import chain, charging, folds, graph, ordered
from ..sources.adapters import TEL, arrivals_of, table, table_stream, telemetry, telemetry_of
from ..streaming import state
from .fleet import BANDS, VERDICTS, query


def risk_samples(t: DataFrame, distance: Column | None = None) -> DataFrame:
    """Samples for range alerts: the odometer advances 100 m with each event of the fleet. distance: to a charger; made up where it isn't given."""
    distance = F.col("vin") * 37 % 150 if distance is None else distance
    epoch = F.unix_seconds(F.col("ts").cast("timestamp"))
    return t.select(
        F.col("vin").cast("long").alias("vin"), epoch.alias("epoch"), "seq", (F.col("seq") / F.lit(10.0)).alias("odo"), F.col("soc").cast("double").alias("soc"), "state",
        (F.lit(0.1) + F.col("vin") % 5 * F.lit(0.05)).alias("catalogue"), distance.cast("double").alias("distance"),
    )


RISK = f"""{TEL}, r AS (SELECT vin, seq, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS epoch, seq / 10.0::DOUBLE AS odo, soc::DOUBLE AS soc, state <> 'NONE' AS c, 0.1::DOUBLE + vin % 5 * 0.05::DOUBLE AS cat, (vin * 37 % 150)::DOUBLE AS dist,
  row_number() OVER (PARTITION BY vin ORDER BY CAST(floor(epoch_us(ts) / 1000000) AS BIGINT), seq) AS i FROM tel),
f AS (SELECT DISTINCT vin, 0::BIGINT AS i, 0::BIGINT AS seq, NULL::DOUBLE AS so, 0::DOUBLE AS ss, 0::DOUBLE AS rate, 0::DOUBLE AS km, 0 AS level, 0 AS pending, NULL::BIGINT AS ll, NULL::BIGINT AS lc, NULL::VARCHAR AS rule, 0::BIGINT AS win, 0::DOUBLE AS margin FROM r
 UNION ALL
 SELECT vin, i, seq, so, ss, rate, km, nl, np, CASE WHEN e AND nl = 1 THEN win ELSE ll END, CASE WHEN e AND nl = 2 THEN win ELSE lc END,
   CASE WHEN e AND nl = 2 AND lc IS DISTINCT FROM win THEN 'RANGE_CRITICAL' WHEN e AND nl = 1 AND ll IS DISTINCT FROM win THEN 'RANGE_LOW' END, win, margin
 FROM (SELECT *, CASE WHEN c THEN 0 WHEN p >= 2 THEN d ELSE level END AS nl, CASE WHEN c OR p >= 2 THEN 0 ELSE p END AS np, NOT c AND NOT (d > level AND p < 2) AS e
 FROM (SELECT *, CASE WHEN d > level OR (d < level AND margin >= CASE level WHEN 2 THEN 3 ELSE 13 END) THEN pending + 1 ELSE 0 END AS p
 FROM (SELECT *, CASE WHEN margin < 0 THEN 2 WHEN margin < 10 THEN 1 ELSE 0 END AS d
 FROM (SELECT *, CASE WHEN km < 6 THEN soc / cat ELSE soc / greatest(rate, 0.02::DOUBLE) END * 0.9::DOUBLE - dist AS margin
 FROM (SELECT * EXCLUDE (so, ss, rate, km), CASE WHEN c THEN NULL WHEN so IS NULL OR g < 0 OR g >= 3 THEN odo ELSE so END AS so, CASE WHEN NOT c AND (so IS NULL OR g < 0 OR g >= 3) THEN soc ELSE ss END AS ss,
   CASE WHEN NOT c AND g >= 3 AND soc <= ss THEN CASE WHEN km = 0 THEN (ss - soc) / g ELSE 0.7::DOUBLE * rate + 0.3::DOUBLE * ((ss - soc) / g) END ELSE rate END AS rate, CASE WHEN NOT c AND g >= 3 AND soc <= ss THEN km + g ELSE km END AS km
 FROM (SELECT f.* EXCLUDE (i, seq, rule, win, margin), r.i, r.seq, r.odo, r.soc, r.c, r.cat, r.dist, r.odo - f.so AS g, r.epoch // 900 * 900 AS win FROM f JOIN r ON r.vin = f.vin AND r.i = f.i + 1)))))))"""
ALERTS_SQL = f"WITH RECURSIVE {RISK} SELECT vin, seq, rule, win AS window_start, CAST(floor(margin * 1000 + 0.5::DOUBLE) AS BIGINT) AS margin_m FROM f WHERE rule IS NOT NULL"


def whole_metres(a: DataFrame) -> DataFrame:
    return a.select("vin", "seq", "rule", "window_start", F.floor(F.col("margin") * 1000 + 0.5).alias("margin_m"))


@query(f"WITH RECURSIVE {RISK} SELECT vin, seq, CAST(floor(rate * 1000000 + 0.5::DOUBLE) AS BIGINT) AS rate_u, CAST(floor(km * 10 + 0.5::DOUBLE) AS BIGINT) AS trained FROM f WHERE i > 0")
def ewma_rate(spark, sf_dir):
    r = folds.usage_rates(risk_samples(telemetry(spark, sf_dir)))
    return r.select("vin", "seq", F.floor(F.col("rate") * 1000000 + 0.5).alias("rate_u"), F.floor(F.col("trained") * 10 + 0.5).alias("trained"))


@query(ALERTS_SQL)
def range_alerts(spark, sf_dir):
    return whole_metres(folds.range_alerts(risk_samples(telemetry(spark, sf_dir))))


@query(ALERTS_SQL)
def stream_range_alerts(spark, sf_dir):
    t = telemetry_of(table_stream(spark, sf_dir, "events"))
    return whole_metres(state.drain(state.range_alert_stream(risk_samples(t))))


@query(f"WITH {VERDICTS} SELECT vin, seq, n, verdict FROM v")
def stream_dedup_verdicts(spark, sf_dir):
    return state.drain(state.dedup_stream(arrivals_of(telemetry_of(table_stream(spark, sf_dir, "events")))))


@query("SELECT o_custkey AS vin, date_trunc('month', o_orderdate)::TIMESTAMP AS win, min(o_orderkey) AS id FROM orders GROUP BY 1, 2")
def stream_alert_upsert(spark, sf_dir):
    o = table_stream(spark, sf_dir, "orders").select(F.col("o_custkey").alias("vin"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("win"), F.col("o_orderkey").alias("id"))
    return state.upsert_stream(o, ["vin", "win"], "id")


# Chains


@query(f"""WITH RECURSIVE {TEL}, l AS (SELECT tenant, seq AS id, CAST(vin AS VARCHAR) || '|' || CAST(seq AS VARCHAR) || '|' || evt AS line, row_number() OVER (PARTITION BY tenant ORDER BY seq) AS i FROM tel),
h AS (SELECT DISTINCT tenant, 0::BIGINT AS i, '' AS hash FROM l UNION ALL SELECT l.tenant, l.i, sha256(h.hash || l.line) FROM h JOIN l ON l.tenant = h.tenant AND l.i = h.i + 1)
SELECT tenant, max(i) AS links, arg_max(hash, i) AS head, 0 AS broken FROM h GROUP BY tenant""")
def audit_chain(spark, sf_dir):
    line = F.concat_ws("|", F.col("vin").cast("string"), F.col("seq").cast("string"), "evt")
    sealed = graph.stored(folds.seal(telemetry(spark, sf_dir).select(F.col("tenant").cast("long").alias("tenant"), F.col("seq").alias("id"), line.alias("line"))))
    broken = chain.broken_links(sealed).groupBy("tenant").agg(F.count(F.lit(1)).alias("broken"))
    heads = sealed.groupBy("tenant").agg(F.count(F.lit(1)).alias("links"), F.max_by("hash", "id").alias("head"))
    return heads.join(broken, "tenant", "left").select("tenant", "links", "head", F.coalesce("broken", F.lit(0)).alias("broken"))


# Graphs

ROAD = "e AS MATERIALIZED (SELECT a, b, min(len) AS len FROM (SELECT l_partkey * 2 AS a, l_suppkey * 2 + 1 AS b, l_quantity::BIGINT AS len FROM lineitem UNION ALL SELECT l_suppkey * 2 + 1, l_partkey * 2, l_quantity::BIGINT FROM lineitem) GROUP BY 1, 2)"
ROUNDS = 14
#: dist * 10^9 + source in one number, so that the least is the nearest, then the smallest source. More rounds than any shortest way has edges.
REACH = "".join(f", d{i + 1} AS MATERIALIZED (SELECT node, min(k) AS k FROM (SELECT node, k FROM d{i} UNION ALL SELECT e.b, d.k + e.len * 1000000000 FROM d{i} d JOIN e ON e.a = d.node) GROUP BY node)" for i in range(ROUNDS))


@query(f"WITH {ROAD}, d0 AS (SELECT s_suppkey * 2 + 1 AS node, s_suppkey * 2 + 1 AS k FROM supplier WHERE s_suppkey % 10 = 3){REACH} SELECT node, k // 1000000000 AS dist, k % 1000000000 AS source FROM d{ROUNDS}")
def nearest_charger_overlay(spark, sf_dir):
    """The graph of parts and suppliers as roads; every tenth supplier has a charger."""
    edges = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") * 2).alias("a"), (F.col("l_suppkey") * 2 + 1).alias("b"), F.col("l_quantity").cast("long").alias("len"))
    sources = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 3").select((F.col("s_suppkey") * 2 + 1).alias("node"))
    return graph.nearest_source(edges, sources)


@query(f"""WITH RECURSIVE {TEL}, s AS (SELECT vin, CAST(floor((lon + 180) / 360 * 32768::DOUBLE) AS BIGINT) AS x, CAST(floor((lat + 90) / 180 * 32768::DOUBLE) AS BIGINT) AS y FROM tel WHERE state = 'CHARGING' AND soc < 20),
c AS (SELECT DISTINCT x, y, x * 4294967296 + y AS id FROM s), w AS (SELECT id, id AS other FROM c UNION SELECT w.id, q.id FROM w JOIN c p ON p.id = w.other JOIN c q ON abs(q.x - p.x) <= 1 AND abs(q.y - p.y) <= 1),
m AS (SELECT id, min(other) AS component FROM w GROUP BY id)
SELECT component, count(DISTINCT m.id) AS cells, count(*) AS stops, count(DISTINCT vin) AS vehicles FROM s JOIN m ON m.id = s.x * 4294967296 + s.y GROUP BY component HAVING count(DISTINCT vin) >= 3""")
def stop_clusters(spark, sf_dir):
    t = telemetry(spark, sf_dir).where("state = 'CHARGING' AND soc < 20")
    cells = t.select("vin", F.floor((F.col("lon") + 180) / 360 * 32768.0).alias("x"), F.floor((F.col("lat") + 90) / 180 * 32768.0).alias("y"))
    return graph.stop_clusters(cells, min_vehicles=3)


# Plans and models


def candidates(spark, sf_dir) -> DataFrame:
    """Vehicles that stand with little charge, at the depot of their tenant."""
    l = ordered.latest(telemetry(spark, sf_dir), "vin", "seq").where("soc < 75")
    return l.select(F.col("vin").cast("long").alias("vin"), F.col("tenant").cast("long").alias("depot"), F.col("soc").cast("double").alias("soc"))


def depot_chargers(spark, sf_dir) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("charger"), (F.col("s_suppkey") % 5).alias("depot"), F.when(F.col("s_suppkey") % 2 == 0, 22.0).otherwise(11.0).alias("power"))


@query(f"""WITH {TEL}, l AS (SELECT vin, tenant AS depot, soc FROM tel QUALIFY row_number() OVER (PARTITION BY vin ORDER BY seq DESC) = 1), v AS (SELECT *, row_number() OVER (PARTITION BY depot ORDER BY soc, vin) - 1 AS r FROM l WHERE soc < 75),
c AS (SELECT s_suppkey AS charger, s_suppkey % 5 AS depot, row_number() OVER (PARTITION BY s_suppkey % 5 ORDER BY s_suppkey) - 1 AS i, count(*) OVER (PARTITION BY s_suppkey % 5) AS n FROM supplier)
SELECT vin, charger FROM v JOIN c ON c.depot = v.depot AND c.i = v.r % c.n""")
def charger_shares(spark, sf_dir):
    return charging.share_out(candidates(spark, sf_dir), depot_chargers(spark, sf_dir)).select("vin", "charger")


def slot_prices(slots: int = 56) -> list[float]:
    """Price of each quarter of an hour from 18:00; 8.00 where no band holds."""
    hours = [(18 + i // 4) % 24 for i in range(slots)]
    return [next((c / 100 for lo, hi, c in BANDS if lo <= h < hi), 8.0) for h in hours]


@query()
def charge_plan(spark, sf_dir):
    """No SQL: each vehicle's plan depends on those before it at its charger. Tests hold it against all plans of small cases."""
    v = charging.share_out(candidates(spark, sf_dir), depot_chargers(spark, sf_dir)).withColumn("capacity", (F.col("vin") % 30 + 40).cast("double"))
    return charging.charge_plan(v, slot_prices())


#: Rows of a task that trains.
TASK_ROWS = 250_000


@query()
def range_model(spark, sf_dir):
    """Mean absolute error of boosted trees and of three plain guesses, over vehicles that training didn't see. No SQL: a learnt model."""
    o = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("p_partkey") == F.col("l_partkey"))
    rows = o.select(
        F.col("l_suppkey").alias("vin"), F.col("l_quantity").alias("km"), F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("catalogue"), F.col("l_discount").alias("discount"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("used"), "l_orderkey", "l_linenumber",
    ).where("km > 0")
    rows = VectorAssembler(inputCols=["km", "size", "catalogue", "discount"], outputCol="features").transform(rows)
    held = F.crc32(F.col("vin").cast("string")) % 5 == 0
    # Training reads its rows from memory again and again, a partition a task: so many tasks that each has TASK_ROWS or fewer.
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(table(spark, sf_dir, "lineitem").count() / TASK_ROWS))
    train, test = rows.where(~held).repartition(parts, "l_orderkey", "l_linenumber"), rows.where(held)
    model = GBTRegressor(labelCol="used", maxIter=10, stepSize=0.3, maxDepth=4, seed=0).fit(train)
    guess = model.transform(test).join(F.broadcast(train.agg(F.avg("used").alias("mean"))))
    return guess.agg(F.count(F.lit(1)).alias("trips"), *[F.avg(F.abs(F.col("used") - F.col(c))).alias(f"{n}_error") for n, c in (("trees", "prediction"), ("mean", "mean"), ("catalogue", "catalogue"))])


