"""How runs lie on disk: zone maps, overlaps, blocks, prefix-coded keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import common_prefix
from ..workspace import work_path
from .folds import ordered_fold


def zone_maps(entries: DataFrame, run: str, key: str, tombstone: str) -> DataFrame:
    """Per run: entries, least and greatest key, deletes; combined before the shuffle."""
    return entries.groupBy(run).agg(
        F.count("*").alias("entries"), F.min(key).alias("min_key"), F.max(key).alias("max_key"), F.sum(F.col(tombstone).cast("long")).alias("deletes")
    )


def overlap(a_min: Column, a_max: Column, b_min: Column, b_max: Column) -> Column:
    """Whether two key ranges meet; an unknown bound is taken to reach everything."""
    return F.coalesce(~((b_max < a_min) | (b_min > a_max)), F.lit(True))


def overlapping_runs(zones: DataFrame, run: str) -> DataFrame:
    """Pairs of runs whose ranges meet. ``zones`` has a row per run: a manifest, not data."""
    a, b = zones.alias("a"), zones.alias("b")
    meets = overlap(F.col("a.min_key"), F.col("a.max_key"), F.col("b.min_key"), F.col("b.max_key"))
    return a.join(F.broadcast(b), (F.col(f"a.{run}") < F.col(f"b.{run}")) & meets).select(F.col(f"a.{run}").alias("run_a"), F.col(f"b.{run}").alias("run_b"))


def _pack(limit: int):
    def step(state, row):
        block, held = state
        size = row["size"]
        if held and held + size > limit:
            block, held = block + 1, 0
        return (block, held + size), block

    return step


def pack_blocks(entries: DataFrame, run: str, order: Sequence[str], limit: int) -> DataFrame:
    """``entries`` (with size) and the block of each: a block is closed before it would exceed ``limit``."""
    return ordered_fold(entries, [run], order, lambda: (0, 0), _pack(limit), "block", T.LongType())


def _flush(limit: int):
    def step(state, row):
        batch, held = state
        held += row["size"]
        return ((batch + 1, 0) if held >= limit else (batch, held)), batch

    return step


def flush_batches(changes: DataFrame, group: str, order: Sequence[str], limit: int) -> DataFrame:
    """``changes`` (with size) and the buffer each goes to: a buffer is flushed after it reaches ``limit``."""
    return ordered_fold(changes, [group], order, lambda: (0, 0), _flush(limit), "batch", T.LongType())


def prefix_encoded(entries: DataFrame, block: Sequence[str], key: str) -> DataFrame:
    """``entries`` with shared (characters in common with the key before, in the block) and suffix (the rest)."""
    before = F.lag(key).over(Window.partitionBy(*block).orderBy(key))
    shared = entries.withColumn("_before", before).withColumn("shared", common_prefix(F.col("_before"), F.col(key)))
    return shared.withColumn("suffix", F.substring(F.col(key), F.col("shared") + 1, F.length(key))).drop("_before")


def _decode(state, row):
    key = state[: row["shared"]] + row["suffix"]
    return key, key


def prefix_decoded(coded: DataFrame, block: Sequence[str], place: str) -> DataFrame:
    """Keys from shared and suffix, in order of ``place`` in each block: column decoded."""
    return ordered_fold(coded, list(block), [place], lambda: "", _decode, "decoded", T.StringType())


#: Name of the column with a row's range.
PART = "_part"


def _placed(rows: DataFrame, *order: str | Column) -> DataFrame:
    """``rows`` dealt out in ranges of ``order``, each task's with its number as PART; written, so that all readers see the same ranges."""
    path = work_path(rows.sparkSession, "placed")
    rows.repartitionByRange(*order).withColumn(PART, F.spark_partition_id()).write.parquet(path)
    return rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField(PART, T.IntegerType())])).parquet(path)


def ranked(rows: DataFrame, *order: str | Column, name: str = "rank") -> DataFrame:
    """``rows`` with their place in ``order`` from 0: that in their range, and the sizes of the ranges before."""
    placed = _placed(rows, *order)
    sizes = placed.groupBy(PART).count()  # a row for each range
    before = sizes.select(PART, F.coalesce(F.sum("count").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(PART).orderBy(*order))
    return placed.withColumn(name, own).join(F.broadcast(before), PART).withColumn(name, (F.col(name) + F.col("_before") - 1).cast("long")).drop(PART, "_before")


def block_index(entries: DataFrame, run: str, block: str, key: str) -> DataFrame:
    return entries.groupBy(run, block).agg(F.min(key).alias("start_key"), F.max(key).alias("end_key"), F.count("*").alias("entries"))


def block_lookup(probes: DataFrame, index: DataFrame, key: str = "key") -> DataFrame:
    """Each probe with the block that would hold it: the first whose end is not before it, if its start isn't after it.

    Probes and block ends are merged in order of run and key and each probe takes the next
    end, of alike ones that of the least block, so that no probe is compared with every block. Tasks have ranges of that order,
    a large run many of them; the first end of later ranges is carried over, one row for each range and run.
    Both go from the last row to the first: a frame that grows is kept up row by row, one that shrinks is made anew for each row.
    """
    ends = index.select("run", F.col("end_key").alias(key), F.struct("block", "start_key").alias("_block"), F.lit(1).alias("_side"))
    asked = probes.select("run", key, F.lit(None).cast(ends.schema["_block"].dataType).alias("_block"), F.lit(0).alias("_side"))
    rows = _placed(asked.unionByName(ends), "run", key)
    first = rows.groupBy("run", PART).agg(F.min(F.when(F.col("_side") == 1, F.struct(key, "_block"))).alias("_first"))
    later = Window.partitionBy("run").orderBy(F.desc(PART)).rowsBetween(Window.unboundedPreceding, -1)
    carried = first.select("run", PART, F.last("_first._block", ignorenulls=True).over(later).alias("_later"))
    after = Window.partitionBy("run", PART).orderBy(F.desc(key), F.desc("_side"), F.desc("_block")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = rows.withColumn("_next", F.last("_block", ignorenulls=True).over(after)).where("_side = 0").join(carried, ["run", PART])
    found = found.withColumn("_next", F.coalesce("_next", "_later"))
    return found.select("run", key, F.when(F.col("_next.start_key") <= F.col(key), F.col("_next.block")).alias("block"))
