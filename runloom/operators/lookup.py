"""Point lookups in batches, ranges, and lookups as of a time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def multi_get(probes: DataFrame, live: DataFrame, key: str = "key", value: str = "value") -> DataFrame:
    """For each probe: found and the value; a missing or deleted key, or a null one, isn't found."""
    hit = live.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_hit"))
    joined = probes.join(hit, probes[key] == hit["_key"], "left")
    return joined.select(*[probes[c] for c in probes.columns], F.coalesce("_hit", F.lit(False)).alias("found"), F.col("_value").alias(value))


def exists(probes: DataFrame, live: DataFrame, key: str = "key") -> DataFrame:
    return probes.join(live.select(key), key, "left_semi")


def missing(probes: DataFrame, live: DataFrame, key: str = "key") -> DataFrame:
    return probes.join(live.select(key), key, "left_anti")


def range_scan(live: DataFrame, low: str, high: str, key: str = "key") -> DataFrame:
    """Keys from low to high, both included, in key order; the range reaches the scan as a pushed filter."""
    return live.where(F.col(key).between(low, high)).orderBy(key)


def get_as_of(reads: DataFrame, writes: DataFrame, keys: Sequence[str], at: str, value: Column, tie: str, name: str = "value") -> DataFrame:
    """For each read the newest write of its key at or before its time.

    Both sides go through one shuffle by key and one sort: a running last value
    over their union, with no join of histories. At equal times writes come before reads.
    """
    wrote = writes.select(*keys, F.col(at), F.col(tie), F.struct(value.alias("v")).alias("_write"), F.lit(0).alias("_side"))
    read = reads.select(*keys, F.col(at), F.col(tie), F.lit(None).cast(wrote.schema["_write"].dataType).alias("_write"), F.lit(1).alias("_side"))
    before = Window.partitionBy(*keys).orderBy(at, "_side", tie).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = wrote.unionByName(read).withColumn("_seen", F.last("_write", ignorenulls=True).over(before))
    return seen.where("_side = 1").select(*keys, at, tie, F.col("_seen.v").alias(name))
