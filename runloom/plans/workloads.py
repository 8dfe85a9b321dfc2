"""The test tables as changelogs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import padded


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User events: k, v, tomb, ts, event_id, run. An error deletes the user; four runs overlap."""
    e = table(spark, sf_dir, "events")
    return e.select(
        padded("user:", F.col("user_id"), 6).alias("k"), F.col("value").alias("v"), (F.col("event_type") == "error").alias("tomb"), "ts", "event_id", (F.col("event_id") % 4).alias("run"),
    )


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys to probe for: k of each customer, most of whom have no events."""
    return table(spark, sf_dir, "customer").select(padded("user:", F.col("c_custkey"), 6).alias("k"))


def changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as records of the engine: key, value (bytes), tombstone, ts (ms), seq."""
    e = table(spark, sf_dir, "events")
    return e.select(
        padded("user:", F.col("user_id"), 6).alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"), (F.col("event_type") == "error").alias("tombstone"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_id").alias("seq"),
    )
