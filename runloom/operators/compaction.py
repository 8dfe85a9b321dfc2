"""When and what to merge: triggers, inputs, names of outputs. All over manifest rows, one per run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import TableConfig
from .layout import overlap


def triggered(runs: DataFrame, config: TableConfig) -> DataFrame:
    """Per level: runs, the number from which it is merged, whether that is reached, and the next index."""
    limit: Column = F.when(F.col("level") == 0, F.lit(config.level0_trigger)).otherwise(F.pow(F.lit(int(config.compaction_ratio)), F.col("level"))).cast("long")
    counted = runs.groupBy("level").agg(F.count("*").alias("runs"), (F.max("idx") + 1).cast("long").alias("next_idx"))
    return counted.select("level", "runs", limit.alias("trigger"), (F.col("runs") >= limit).alias("due"), "next_idx")


def inputs(runs: DataFrame, level: int) -> DataFrame:
    """What a merge of ``level`` reads: all of level 0, or the oldest run of a deeper one, and what they overlap in the next."""
    own = runs.where(F.col("level") == level)
    if level > 0:
        own = own.orderBy("run_seq").limit(1)
    span = own.agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    below = runs.where(F.col("level") == level + 1).join(F.broadcast(span)).where(overlap(F.col("low"), F.col("high"), F.col("min_key"), F.col("max_key")))
    return own.unionByName(below.select(*runs.columns))


def may_drop_deletes(runs: DataFrame, merged: DataFrame) -> DataFrame:
    """One row, drop: whether no run outside the merge that is older than it can hold its keys."""
    span = merged.agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"), F.max("run_seq").alias("newest"))
    rest = runs.join(merged.select("run_id"), "run_id", "left_anti").join(F.broadcast(span))
    older = rest.where((F.col("run_seq") < F.col("newest")) & overlap(F.col("low"), F.col("high"), F.col("min_key"), F.col("max_key")))
    return older.agg((F.count("*") == 0).alias("drop"))
