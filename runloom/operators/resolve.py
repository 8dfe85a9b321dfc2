"""Which version of a key counts: newest wins, and merges by a rule of one's own.

Runs are unions with a run_seq column, later runs newer. Ranking within keys
keeps one row per key and task before the shuffle (a window group limit), so that a
hot key's history doesn't travel.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def newest_first(*columns: str) -> list[Column]:
    return [F.col(c).desc_nulls_last() for c in columns]


def latest_per_key(changes: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, tombstones included."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return changes.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def live_view(changes: DataFrame, keys: Sequence[str], order: Sequence[Column], tombstone: str = "tombstone") -> DataFrame:
    """The newest row of each key, unless it is a delete. Deletes are dropped after the choice, never before."""
    return latest_per_key(changes, keys, order).where(~F.coalesce(F.col(tombstone), F.lit(False)))


def as_runs(runs: Sequence[DataFrame]) -> DataFrame:
    """Runs, oldest first, as one changelog with run_seq."""
    numbered = [r.withColumn("run_seq", F.lit(i).cast("long")) for i, r in enumerate(runs)]
    return reduce(lambda a, b: a.unionByName(b), numbered)


def merge_runs(runs: Sequence[DataFrame], keys: Sequence[str], seq: Sequence[str], tombstone: str = "tombstone", keep_deletes: bool = False) -> DataFrame:
    """K-way merge: later runs win over earlier ones, within a run the later seq."""
    order = newest_first("run_seq", *seq)
    merged = as_runs(runs)
    return (latest_per_key(merged, keys, order) if keep_deletes else live_view(merged, keys, order, tombstone)).drop("run_seq")


def merge_numbered(changes: DataFrame, keys: Sequence[str], run: str, seq: Sequence[str], tombstone: str = "tombstone") -> DataFrame:
    """As merge_runs, of runs that are one table with a column ``run``, larger for later: one scan, however many runs."""
    return live_view(changes, keys, newest_first(run, *seq), tombstone)


def merge_ordered(changes: DataFrame, keys: Sequence[str], ascending: Sequence[Column], tombstone: str = "tombstone") -> DataFrame:
    """Merge by an order of the caller's, ``ascending`` (nulls first): the last row of each key in that order wins, then deletes are dropped.

    The rank is taken from the other end, so that each task sends on one row of a key.
    """
    return live_view(changes, keys, [c.desc_nulls_last() for c in ascending], tombstone)


def merge_two(old: DataFrame, new: DataFrame, keys: Sequence[str], tombstone: str = "tombstone") -> DataFrame:
    """Two sides with one row per key each: the new side's row where there is one, deletes dropped."""
    columns = [c for c in old.columns if c not in keys]
    o, n = old.alias("o"), new.withColumn("_new", F.lit(True)).alias("n")
    joined = o.join(n, list(keys), "full_outer")
    picked = [F.when(F.col("n._new"), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in columns]
    return joined.select(*keys, *picked).where(~F.col(tombstone))


def merge_aggregated(changes: DataFrame, keys: Sequence[str], rules: dict[str, Column], tombstone: str = "tombstone") -> DataFrame:
    """Merge by aggregates, as max or sum, over the versions that aren't deletes: combined before the shuffle."""
    return changes.where(~F.col(tombstone)).groupBy(*keys).agg(*[rule.alias(name) for name, rule in rules.items()])


def merge_folded(
    changes: DataFrame, keys: Sequence[str], order: Sequence[str], resolve: Callable[[Column, Column], Column], tombstone: str = "tombstone"
) -> DataFrame:
    """Merge by any rule: fold ``resolve(held, next)`` over a key's versions, oldest first; a key whose result is a delete goes.

    Versions are structs of all columns but the keys. All versions of a key are
    gathered in one array, so that a key's history must fit in memory;
    merge_aggregated() has no such limit and comes first where the rule allows.
    """
    columns = [c for c in changes.columns if c not in keys]
    version = F.struct(*[F.col(c) for c in (*order, *[c for c in columns if c not in order])])
    gathered = changes.groupBy(*keys).agg(F.array_sort(F.collect_list(version)).alias("versions"))
    first, rest = F.element_at("versions", 1), F.slice("versions", 2, F.greatest(F.size("versions") - 1, F.lit(0)))
    folded = gathered.select(*keys, F.aggregate(rest, first, resolve).alias("won"))
    return folded.select(*keys, *[F.col(f"won.{c}").alias(c) for c in columns]).where(~F.col(tombstone))
