"""Spark sessions with the settings that the library counts on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "fleetloom", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
