"""Fleet-shaped views over the given tables. Quantities are whole numbers (hundredths), so every engine sums alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def table_stream(spark: SparkSession, sf_dir: str, name: str, *, max_files: int = 1000, newest_first: bool = False) -> DataFrame:
    """The same table as a stream of its files, the oldest first unless said otherwise.

    max_files bounds what one trigger takes, and so its memory: back-pressure is that later files wait."""
    path, known = f"{sf_dir}/{name}.parquet", table(spark, sf_dir, name)
    files = known.inputFiles()
    stream = spark.readStream.schema(known.schema).option("maxFilesPerTrigger", max_files).option("latestFirst", newest_first)
    if len(files) == 1 and files[0].endswith(f"/{name}.parquet"):  # a stream reads folders
        return stream.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
    return stream.parquet(path)


def hundredths(c: Column) -> Column:
    return F.floor(c * 100 + 0.5).cast("long")


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vin, tenant, ts, seq, soc, speed_c, state, evt, step_c, lat, lon of events."""
    return telemetry_of(table(spark, sf_dir, "events"))


def telemetry_of(e: DataFrame) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "CHARGING").when(F.col("event_type") == "signup", "PLUGGED").otherwise("NONE")
    return e.select(
        F.col("user_id").alias("vin"), (F.col("user_id") % 5).alias("tenant"), "ts", F.col("event_id").alias("seq"),
        F.get_json_object("props", "$.k").cast("int").alias("soc"), hundredths(F.least("value", F.lit(300.0))).alias("speed_c"), state.alias("state"),
        F.col("event_type").alias("evt"), hundredths(F.col("value")).alias("step_c"),
        ((F.col("user_id") % 100 + 1200) / F.lit(100.0)).alias("lat"), ((F.col("event_id") % 50 + 8000) / F.lit(100.0)).alias("lon"),
    )


def arrivals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vin, ts, seq, n: events in order of arrival n; every 20th comes again 40 later, every 33rd comes 50 late."""
    return arrivals_of(telemetry(spark, sf_dir))


def arrivals_of(t: DataFrame) -> DataFrame:
    t = t.select("vin", "ts", "seq")
    late = F.when(F.col("seq") % 33 == 0, F.col("seq") * 2 + 101).otherwise(F.col("seq") * 2)
    again = t.where("seq % 20 = 0").select("vin", "ts", "seq", (F.col("seq") * 2 + 81).alias("n"))
    return t.select("vin", "ts", "seq", late.alias("n")).unionByName(again)


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, vin, severity, status, detected_at of orders."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "open").when(F.col("o_orderstatus") == "F", "resolved").otherwise("acknowledged")
    severity = F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "CRITICAL").otherwise("WARNING")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("vin"), severity.alias("severity"), status.alias("status"), F.col("o_orderdate").alias("detected_at"))


#: The same views as common table expressions, for the oracle.
TEL = """tel AS (SELECT user_id AS vin, user_id % 5 AS tenant, ts, event_id AS seq, CAST(json_extract_string(props, '$.k') AS INTEGER) AS soc,
  CAST(floor(least(value, 300.0::DOUBLE) * 100 + 0.5::DOUBLE) AS BIGINT) AS speed_c, CASE event_type WHEN 'purchase' THEN 'CHARGING' WHEN 'signup' THEN 'PLUGGED' ELSE 'NONE' END AS state,
  event_type AS evt, CAST(floor(value * 100 + 0.5::DOUBLE) AS BIGINT) AS step_c, (user_id % 100 + 1200) / 100.0::DOUBLE AS lat, (event_id % 50 + 8000) / 100.0::DOUBLE AS lon FROM events)"""
ARR = """arr AS (SELECT user_id AS vin, ts, event_id AS seq, CASE WHEN event_id % 33 = 0 THEN event_id * 2 + 101 ELSE event_id * 2 END AS n FROM events
  UNION ALL SELECT user_id, ts, event_id, event_id * 2 + 81 FROM events WHERE event_id % 20 = 0)"""
ALERT = """alert AS (SELECT o_orderkey AS id, o_custkey AS vin, CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '2') THEN 'CRITICAL' ELSE 'WARNING' END AS severity,
  CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'resolved' ELSE 'acknowledged' END AS status, o_orderdate AS detected_at FROM orders)"""
