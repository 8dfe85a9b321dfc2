"""The append-only log: its binary records, and replay of the valid part.

A record is key length (int32), key, value length (int32), value, delete marker
(one byte), time (int64), all little-endian. Replay applies the longest valid
prefix of a file and stops at the first record that is cut short or makes no sense.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import count, islice

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizes import entry_size

#: A length over this makes a record invalid.
LONGEST = 1 << 30


def encoded(key: str, value: bytes, tombstone: bool, ts: int) -> bytes:
    k = key.encode()
    return struct.pack("<i", len(k)) + k + struct.pack("<i", len(value)) + value + struct.pack("<?q", tombstone, ts)


def records(data: bytes) -> Iterator[tuple[str, bytes, bool, int]]:
    """The records of a file up to the first invalid one."""
    at = 0
    while at + 4 <= len(data):
        (k,) = struct.unpack_from("<i", data, at)
        if not 0 < k <= LONGEST or at + 8 + k > len(data):
            return
        (v,) = struct.unpack_from("<i", data, at + 4 + k)
        end = at + 8 + k + v + 9
        if not 0 <= v <= LONGEST or end > len(data) or data[end - 9] > 1:
            return
        try:
            key = data[at + 4 : at + 4 + k].decode()
        except UnicodeDecodeError:
            return
        tombstone, ts = struct.unpack_from("<?q", data, end - 9)
        yield key, data[at + 8 + k : end - 9], tombstone, ts
        at = end


#: Bytes from which a segment of a log is closed: what a row of a log table holds, and what is replayed at once.
SEGMENT = 1 << 20
SEGMENT_ROW = "file long, start long, content binary, seqs array<long>, bytes long"


def _segments(limit: int):
    """Rows of file, key, value, tombstone, ts, seq and size, those of a file together, as segments of its log."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, start, parts, seqs, held, size = None, 0, [], [], 0, 0

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([file], pa.int64()), pa.array([start], pa.int64()), pa.array([b"".join(parts)], pa.binary()), pa.array([seqs], pa.list_(pa.int64())), pa.array([size], pa.int64())],
                names=["file", "start", "content", "seqs", "bytes"],
            )

        for b in batches:
            for of, key, value, dead, ts, seq, own in zip(*(b.column(c).to_pylist() for c in ("file", "key", "value", "tombstone", "ts", "seq", "size")), strict=True):
                if parts and (of != file or held >= limit):
                    yield told()
                    start, parts, seqs, held, size = start + len(parts), [], [], 0, 0
                if of != file:
                    file, start = of, 0
                parts.append(encoded(key, value, dead, ts))
                seqs.append(seq)
                held, size = held + len(parts[-1]), size + own
        if parts:
            yield told()

    return run


def encode_log(changes: DataFrame, files: int | None = None, limit: int = SEGMENT) -> DataFrame:
    """``changes`` as logs: rows of file, start (records before), content (binary records), seqs (theirs) and bytes (their size in memory).

    With ``files``, changes are dealt to so many by key, each in order of seq. Without, each task writes
    one from its rows as they come: nothing is shuffled, and seqs tell the order.
    """
    size = entry_size(F.col("key"), F.octet_length("value")).alias("size")
    file = F.spark_partition_id().cast("long") if files is None else F.pmod(F.xxhash64("key"), F.lit(files))
    rows = changes.select(file.alias("file"), "key", "value", "tombstone", "ts", "seq", size)
    if files is not None:
        rows = rows.repartition("file").sortWithinPartitions("file", "seq")
    return rows.mapInArrow(_segments(limit), SEGMENT_ROW)


def replay(logs: DataFrame, at_once: int = 4096) -> DataFrame:
    """file, place, key, value, tombstone, ts and seq: the valid prefix of each segment, ``at_once`` records at a time.

    ``logs`` has file and content, and maybe start (0 if not) and seqs (else seq is the place).
    """
    columns = [c for c in ("file", "start", "content", "seqs") if c in logs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i].as_py() for c in columns}
                place, found = row.get("start") or 0, records(row["content"] or b"")
                seqs = iter(row["seqs"]) if row.get("seqs") is not None else count(place)
                while rows := list(islice(found, at_once)):
                    keys, values, dead, ts = zip(*rows, strict=True)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([row["file"]] * len(rows), b.schema.field("file").type), pa.array(range(place, place + len(rows)), pa.int64()), pa.array(keys, pa.string()), pa.array(values, pa.binary()),
                            pa.array(dead, pa.bool_()), pa.array(ts, pa.int64()), pa.array(list(islice(seqs, len(rows))), pa.int64()),
                        ],
                        names=["file", "place", "key", "value", "tombstone", "ts", "seq"],
                    )
                    place += len(rows)

    return logs.select(*columns).mapInArrow(run, f"file {dict(logs.dtypes)['file']}, place long, key string, value binary, tombstone boolean, ts long, seq long")


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """Foreign log files under a path that Spark can read, as file (its path) and content: each at most 2 GiB, what Spark reads as one value.

    A table's own log (Store.set) is in segments of SEGMENT bytes and has no such limit.
    """
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content")


def valid_prefix(entries: DataFrame, log: str, order: str, bad) -> DataFrame:
    """Rows before the first for which ``bad`` holds, in each log."""
    seen = F.max(F.coalesce(bad, F.lit(True)).cast("int")).over(Window.partitionBy(log).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return entries.withColumn("_bad", seen).where("_bad = 0").drop("_bad")
