"""Who may see and change what: masks, guarded changes, reloads, sealed columns, and a record of each access."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import round_half_away, without_key

MASKED_DIGITS = 2


def _unlike(name: Column) -> Callable[[Column, Column], Column]:
    return lambda key, _: key != name


def mask_evidence(json: Column, precise: bool) -> Column:
    """Evidence as a role may see it: without the right to precise places, lat and lon are rounded and the route is gone.

    What is no JSON object becomes null."""
    if precise:
        return json
    kept = F.from_json(without_key(json, "route"), "map<string, variant>")
    for name in ("lat", "lon"):
        value = F.try_variant_get(F.try_element_at(kept, F.lit(name)), "$", "double")
        rest = F.map_filter(kept, _unlike(F.lit(name)))
        rounded = F.create_map(F.lit(name), F.parse_json(round_half_away(value, MASKED_DIGITS).cast("string")))
        kept = F.when(value.isNotNull(), F.map_concat(rest, rounded)).otherwise(kept)
    return F.to_json(kept)


def transition(rows: DataFrame, asked: DataFrame, key: str, before: str, after: str, status: str = "status") -> DataFrame:
    """rows with status changed from before to after where asked (key) names them, and whether it was: any other status stays.

    asked may name a row repeatedly, or one that isn't there."""
    wanted = asked.where(F.col(key).isNotNull()).select(key).distinct().withColumn("__asked", F.lit(True))
    changed = F.coalesce("__asked", F.lit(False)) & F.coalesce(F.col(status) == before, F.lit(False))
    done = rows.join(wanted, key, "left").withColumn("changed", changed).drop("__asked")
    return done.withColumn(status, F.when(F.col("changed"), after).otherwise(F.col(status)))


def reload(rows: DataFrame, new: DataFrame, ref: str, tag: str) -> DataFrame:
    """rows whose reference begins with tag replaced by new; rows without a reference stay."""
    return rows.where(~F.coalesce(F.col(ref).startswith(tag), F.lit(False))).unionByName(new)


def sealed(text: Column, key: Column) -> Column:
    """Text encrypted with AES-GCM and a fresh vector each time, in base 64; null stays null."""
    return F.base64(F.aes_encrypt(text, key))


def opened(text: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(text), key).cast("string")


def audited(rows: DataFrame, log: str, actor: str, action: str) -> DataFrame:
    """rows, of which the log (a folder) first gets a record: who did what, and how many rows were given."""
    record = rows.agg(F.lit(actor).alias("actor"), F.lit(action).alias("action"), F.count(F.lit(1)).alias("n"), F.current_timestamp().alias("at"))
    record.write.mode("append").parquet(log)
    return rows
