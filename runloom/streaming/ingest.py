"""Changes from a stream into a table, each micro-batch one run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..sources.store import Store


def upsert_stream(changes: DataFrame, store: Store, checkpoint: str, available_now: bool = True, source: str = "stream") -> StreamingQuery:
    """Write a stream of key, value, tombstone, ts and seq.

    The table's manifest keeps the number of the last batch of each ``source``: a batch that is tried again after a crash
    is known by it, also if its run was merged since, so that nothing is applied twice. Streams into one table need
    sources of different names, each with a checkpoint of its own.
    """

    def apply(batch: DataFrame, number: int) -> None:
        store.add_run(batch, source=source, number=number)

    writer = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def without_repeats(changes: DataFrame, event_time: str, within: str, *ids: str) -> DataFrame:
    """Drop events that were delivered again within a time: the state kept is bounded by the watermark."""
    return changes.withWatermark(event_time, within).dropDuplicatesWithinWatermark(list(ids))
