"""What a cache of blocks would have done: a least-recently-used one, simulated."""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .folds import ordered_fold


def cache_key(path: Column, offset: Column) -> Column:
    return F.concat_ws(":", path, offset.cast("string"))


def _lru(capacity: int):
    def step(state, row):
        held, total = state
        key, size = row["block"], row["size"]
        if key in held:
            held.move_to_end(key)
            return (held, total), True
        if size <= capacity:  # one that is larger than the whole cache isn't kept
            held[key] = size
            total += size
            while total > capacity:
                total -= held.popitem(last=False)[1]
        return (held, total), False

    return step


def lru(accesses: DataFrame, group: str, order: Sequence[str], capacity: int) -> DataFrame:
    """``accesses`` (block, size) with hit, for a cache of ``capacity`` bytes for each group.

    With all sizes 1 the capacity is a number of blocks. State is what the cache holds.
    """
    return ordered_fold(accesses, [group], order, lambda: (OrderedDict(), 0), _lru(capacity), "hit", T.BooleanType())


def stats(judged: DataFrame) -> DataFrame:
    """hits, misses and hit_ratio (0 without accesses)."""
    hits, all_ = F.coalesce(F.sum(F.col("hit").cast("long")), F.lit(0)).cast("long"), F.count("*")
    return judged.agg(hits.alias("hits"), (all_ - hits).alias("misses"), F.round(F.when(all_ > 0, hits / all_).otherwise(F.lit(0.0)), 6).alias("hit_ratio"))
