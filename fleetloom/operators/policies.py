"""Policies of rows as views over session variables, rights of roles as a table, and the fleet's functions for SQL.

A session acts as a role for a tenant (two session variables, at first null). A secured view gives the rows of a table that a matrix of
rights (role, object, verb, scope) lets that role read: all, those of its own tenant, or these and those of nobody. Without a role,
without a right, or for a scope of its own without a tenant, there are no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import GEOHASH, VIN_DIGITS, VIN_LETTERS, VIN_WEIGHTS

ROLE, TENANT = "fleet_role", "fleet_tenant"
SCOPES = ("all", "own", "own_or_public")

#: What each role may read, of the objects that hold a tenant's rows.
READS = [
    ("app", "vehicle", "own"), ("app", "alert", "own"), ("app", "charger", "own_or_public"), ("gateway", "vehicle", "all"), ("alerts", "vehicle", "all"), ("alerts", "alert", "all"),
    ("batch", "vehicle", "all"), ("batch", "charger", "all"), ("batch", "alert", "all"), ("privacy", "vehicle", "all"),
]


def declare(spark: SparkSession, rights: DataFrame | None = None) -> None:
    """Make the session variables, nobody at first, and the table of rights (role, object, verb, scope)."""
    spark.sql(f"DECLARE OR REPLACE VARIABLE {ROLE} STRING DEFAULT NULL")
    spark.sql(f"DECLARE OR REPLACE VARIABLE {TENANT} BIGINT DEFAULT NULL")
    rights = rights if rights is not None else spark.createDataFrame([(r, o, "SELECT", s) for r, o, s in READS], "role string, object string, verb string, scope string")
    rights.createOrReplaceTempView("fleet_rights")


def act_as(spark: SparkSession, role: str | None, tenant: int | None) -> None:
    spark.sql(f"SET VARIABLE {ROLE} = :value", args={"value": role}) if role is not None else spark.sql(f"SET VARIABLE {ROLE} = NULL")
    spark.sql(f"SET VARIABLE {TENANT} = {'NULL' if tenant is None else int(tenant)}")


def may(spark: SparkSession, verb: str, name: str) -> str:
    """The widest scope that the session's role has for a verb on an object; none without a right."""
    found = spark.sql(f"SELECT scope FROM fleet_rights WHERE role = {ROLE} AND object = :name AND verb = :verb", args={"name": name, "verb": verb}).collect()
    return min((r["scope"] for r in found), key=SCOPES.index, default="none")


def secure(rows: DataFrame, name: str, tenant: str) -> str:
    """A view name_secured of rows with only those that the session may read; its name."""
    rows.createOrReplaceTempView(f"{name}_base")
    # Rights are looked up once a query, not once a row.
    has = lambda scope: f"(SELECT count(*) > 0 FROM fleet_rights WHERE role = {ROLE} AND object = '{name}' AND verb = 'SELECT' AND scope IN ({scope}))"
    own = f"(`{tenant}` = {TENANT} AND {has("'own', 'own_or_public'")})"
    public = f"(`{tenant}` IS NULL AND {TENANT} IS NOT NULL AND {has("'own_or_public'")})"
    rows.sparkSession.sql(f"CREATE OR REPLACE TEMPORARY VIEW {name}_secured AS SELECT * FROM {name}_base WHERE {has("'all'")} OR {own} OR {public}")
    return f"{name}_secured"


def functions(spark: SparkSession, subscriptions: DataFrame | None = None, features: DataFrame | None = None) -> None:
    """vin_valid(vin), geohash(lat, lon, precision) and, with subscriptions (tenant, plan, valid_from, valid_to) and features (plan, feature), tenant_has_feature(tenant, feature, at)."""
    digits = ", ".join(f"'{c}'" for c in "0123456789X")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION vin_valid(vin STRING) RETURNS BOOLEAN RETURN coalesce(vin RLIKE '^[A-HJ-NPR-Z0-9]{{17}}$' AND substr(vin, 9, 1) =
        element_at(array({digits}), 1 + aggregate(zip_with(split(translate(vin, '{VIN_LETTERS}', '{VIN_DIGITS}'), ''), array{VIN_WEIGHTS}, (d, w) -> coalesce(try_cast(d AS INT) * w, 0)), 0, (a, x) -> a + x) % 11), false)""")
    spark.sql(f"""CREATE OR REPLACE TEMPORARY FUNCTION geohash(lat DOUBLE, lon DOUBLE, digits INT) RETURNS STRING RETURN array_join(transform(sequence(0, digits - 1), c -> substr('{GEOHASH}', 1 + CAST(aggregate(sequence(0, 4), 0L, (v, b) -> v * 2 +
        CASE WHEN (5 * c + b) % 2 = 0 THEN floor((lon + 180) / 360 * power(2, CAST((5 * c + b) div 2 AS INT) + 1)) % 2 ELSE floor((lat + 90) / 180 * power(2, CAST((5 * c + b) div 2 AS INT) + 1)) % 2 END) AS INT), 1)), '')""")
    if subscriptions is not None and features is not None:
        subscriptions.createOrReplaceTempView("fleet_subscriptions")
        features.createOrReplaceTempView("fleet_features")
        spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION tenant_has_feature(t BIGINT, f STRING, now TIMESTAMP) RETURNS BOOLEAN RETURN EXISTS (
            SELECT 1 FROM fleet_subscriptions s JOIN fleet_features p ON p.plan = s.plan WHERE s.tenant = t AND p.feature = f AND s.valid_from <= now AND (s.valid_to IS NULL OR s.valid_to > now))""")
