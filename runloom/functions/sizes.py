"""How many bytes an entry is taken to hold, in memory, in a block and in a cache."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes for the time, the marker, an entry's other parts in a block, and a cached block.
TIME, MARK, BLOCK_ENTRY, CACHED_BLOCK = 8, 1, 64, 128


def entry_size(key: Column, value_length: Column) -> Column:
    """In memory: time, marker, two bytes for each character of the key, the value."""
    return (F.lit(TIME + MARK) + 2 * F.length(key) + value_length).cast("long")


def block_entry_size(key: Column, value_length: Column) -> Column:
    return entry_size(key, value_length) + BLOCK_ENTRY


def cached_block_size(key: Column, value_length: Column) -> Column:
    """An aggregate: the entries of a block and the block's own part."""
    return (F.sum(entry_size(key, value_length)) + CACHED_BLOCK).cast("long")
