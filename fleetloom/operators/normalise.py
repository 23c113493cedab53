"""Raw messages of two makers' dialects to one event, with the class of the first rule that a message breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import dtc_decode, once, vin_valid

A_SCHEMA = (
    "vehicle STRUCT<vin: STRING>, ts STRING, pos STRUCT<lat: DOUBLE, lon: DOUBLE, hdg: DOUBLE>, spd STRUCT<kmh: DOUBLE, kph: DOUBLE>, "
    "batt STRUCT<soc: DOUBLE, temp_c: DOUBLE, v: DOUBLE, a: DOUBLE, odo_km: DOUBLE>, diag STRUCT<dtc: ARRAY<STRING>, evt: STRING>, "
    "chg STRUCT<state: STRING, charger: STRING>, amb_c DOUBLE, seq LONG, schema INT, _bad STRING"
)
B_SCHEMA = (
    "VIN STRING, time LONG, latitude DOUBLE, longitude DOUBLE, heading DOUBLE, speedKmH DOUBLE, socPct DOUBLE, packTempC DOUBLE, packV DOUBLE, packA DOUBLE, "
    "odometerKm DOUBLE, dtcRaw STRING, event STRING, plug INT, chargerId STRING, ambientC DOUBLE, seq LONG, v INT, _bad STRING"
)
#: Fixed names of events, in the order of their numbers, and the short codes of dialect B.
EVENTS = ["EVENT_UNSPECIFIED", "HARSH_BRAKE", "HARSH_ACCEL", "OVERSPEED", "IGNITION_ON", "IGNITION_OFF", "PLUG_IN", "PLUG_OUT", "CHARGE_COMPLETE", "LOW_SOC", "THERMAL_WARNING"]
B_EVENTS = {
    "": "EVENT_UNSPECIFIED", "HB": "HARSH_BRAKE", "HA": "HARSH_ACCEL", "OS": "OVERSPEED", "IGN1": "IGNITION_ON", "IGN0": "IGNITION_OFF",
    "PLUGIN": "PLUG_IN", "PLUGOUT": "PLUG_OUT", "CHGDONE": "CHARGE_COMPLETE", "LOWSOC": "LOW_SOC", "THERM": "THERMAL_WARNING",
}
STATES = ["NONE", "PLUGGED", "CHARGING"]
#: Fixed limits: km/h, age and lead in seconds, bytes of a message that a dead letter keeps.
MAX_KMH, MAX_AGE_S, MAX_AHEAD_S, KEPT_BYTES = 300.0, 7 * 86400, 300, 65536


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _number(c: Column) -> Column:
    return F.coalesce(c, F.lit(0.0))


def _all_given(*cs: Column) -> Column:
    return ~F.forall(F.array(*[c.isNull() for c in cs]), lambda b: ~b)


def parse_a(payload: Column) -> Column:
    """Struct of the common event, with parse_class for what isn't dialect A (schema 1 or 2)."""
    return once(F.from_json(payload, A_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}), _event_a)


def _event_a(m: Column) -> Column:
    ts, speed = F.try_to_timestamp(m["ts"]), F.when(m["schema"] >= 2, m["spd"]["kph"]).otherwise(m["spd"]["kmh"])
    evt = F.when(_text(m["diag"]["evt"]) == "", EVENTS[0]).otherwise(m["diag"]["evt"])
    wrong = (
        ~F.coalesce(m["schema"].isin(1, 2), F.lit(False)) | _all_given(m["vehicle"]["vin"], m["ts"], m["pos"]["lat"], m["pos"]["lon"], m["batt"]["soc"], m["seq"], speed, ts)
        | ~evt.isin(*EVENTS) | ~_text(m["chg"]["state"]).isin(*STATES)
    )
    return _event(m, wrong, vin=m["vehicle"]["vin"], ts=ts, lat=m["pos"]["lat"], lon=m["pos"]["lon"], speed=speed, soc=m["batt"]["soc"] * 100, odo=_number(m["batt"]["odo_km"]), heading=_number(m["pos"]["hdg"]), dtc=m["diag"]["dtc"], evt=evt, state=_text(m["chg"]["state"]), charger=_text(m["chg"]["charger"]), schema_ver=m["schema"])


def parse_b(payload: Column) -> Column:
    """Struct of the common event, with parse_class for what isn't dialect B (schema 1)."""
    return once(F.from_json(payload, B_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}), _event_b)


def _event_b(m: Column) -> Column:
    raw = F.trim(_text(m["dtcRaw"]))
    groups = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.length(raw) - 1) / 4), F.lit(0))), lambda i: dtc_decode(F.substring(raw, (i * 4 + 1).cast("int"), F.lit(4))))
    dtc = F.when(raw == "", F.array().cast("array<string>")).otherwise(groups)
    codes = F.create_map(*[F.lit(x) for kv in B_EVENTS.items() for x in kv])
    evt = F.try_element_at(codes, _text(m["event"]))
    wrong = (
        ~F.coalesce(m["v"] == 1, F.lit(False)) | _all_given(m["VIN"], m["time"], m["latitude"], m["longitude"], m["speedKmH"], m["socPct"], m["plug"], m["seq"], evt)
        | ~m["plug"].between(0, 2) | F.exists(dtc, lambda c: c.isNull())
    )
    state = F.try_element_at(F.array(*[F.lit(s) for s in STATES]), F.when(m["plug"].between(0, 2), m["plug"] + 1).otherwise(1))
    return _event(m, wrong, vin=m["VIN"], ts=F.timestamp_millis(m["time"]), lat=m["latitude"], lon=m["longitude"], speed=m["speedKmH"], soc=m["socPct"], odo=_number(m["odometerKm"]), heading=_number(m["heading"]), dtc=dtc, evt=evt, state=state, charger=_text(m["chargerId"]), schema_ver=m["v"])


def _event(m: Column, wrong: Column, **fields: Column) -> Column:
    fields["dtc"] = F.coalesce(fields["dtc"], F.array().cast("array<string>"))
    broken = m.isNull() | m["_bad"].isNotNull() | (m["seq"] < 0)
    parse_class = F.when(F.coalesce(broken, F.lit(False)), "MALFORMED").when(F.coalesce(wrong, F.lit(True)), "SCHEMA_INVALID")
    return F.struct(*[c.alias(n) for n, c in fields.items()], m["seq"].alias("seq"), parse_class.alias("parse_class"))


def error_class(e: Column, now: Column) -> Column:
    """Class of the first rule that event e breaks, else null."""
    within = lambda c, low, high: F.coalesce(c.between(low, high) & ~F.isnan(c), F.lit(False))
    fits = (
        (e["seq"] > 0) & within(e["lat"], -90.0, 90.0) & within(e["lon"], -180.0, 180.0) & within(e["soc"], 0.0, 100.0) & within(e["speed"], 0.0, MAX_KMH)
        & within(e["odo"], 0.0, float("inf")) & within(e["heading"], 0.0, 360.0) & F.forall(e["dtc"], lambda c: F.coalesce(c.rlike("^[PCBU][0-3][0-9A-F]{3}$"), F.lit(False)))
    )
    ahead = F.unix_micros(e["ts"]) - F.unix_micros(now)
    return (
        F.when(e["parse_class"].isNotNull(), e["parse_class"]).when(~vin_valid(e["vin"]), "VIN_INVALID").when(ahead > MAX_AHEAD_S * 1_000_000, "SCHEMA_INVALID")
        .when(ahead < -MAX_AGE_S * 1_000_000, "TOO_LATE").when(~F.coalesce(fits, F.lit(False)), "SCHEMA_INVALID")
    )


def normalise(raw: DataFrame, makers: DataFrame, directory: DataFrame) -> DataFrame:
    """Add e (the event), tenant and error_class (null: accepted) to raw (oem, payload, recv_ts).

    makers (oem, dialect) tells the dialect; an unknown maker's messages count as malformed. directory (vin, tenant)
    tells whose the vehicle is: a vehicle that isn't there is unauthorised, last of all rules. The dialect is a
    column, so both ways are expressions of one scan; the join with
    the directory is left to the optimiser, as that grows. Makers are few, and as keys of a shuffle would be as few tasks.
    A payload and an event are each named once in what uses many of their fields, so wherever the optimiser puts these, a payload is parsed once."""
    rows = raw.join(F.broadcast(makers.dropDuplicates(["oem"])), "oem", "left")
    a, b = parse_a(F.col("payload")), parse_b(F.col("payload"))
    rows = rows.withColumn("e", F.when(F.col("dialect") == "A", a).when(F.col("dialect") == "B", b))
    rows = rows.withColumn("error_class", once(F.col("e"), lambda e: F.when(e.isNull(), "MALFORMED").otherwise(error_class(e, F.col("recv_ts")))))
    owner = directory.dropDuplicates(["vin"]).select(F.col("vin").alias("__vin"), "tenant")
    rows = rows.join(owner, F.col("e.vin") == F.col("__vin"), "left").drop("__vin")
    return rows.withColumn("error_class", F.coalesce("error_class", F.when(F.col("tenant").isNull(), "UNAUTHORIZED_VIN")))


def accepted(rows: DataFrame) -> DataFrame:
    return rows.where("error_class IS NULL").select("e.*", "tenant", "oem", "recv_ts").drop("parse_class")


def dead_letters(rows: DataFrame) -> DataFrame:
    """oem, error_class, original (the first 65,536 of its bytes, as the contract of a dead letter has it), recv_ts."""
    return rows.where("error_class IS NOT NULL").select("oem", "error_class", F.substring(F.encode("payload", "UTF-8"), 1, KEPT_BYTES).alias("original"), "recv_ts")
