"""Bloom filters as relations: a filter is the set of its bits.

A key's k bits are k rows; a filter of many runs is (run, bit) rows, made with one
distinct and probed with one join. bitset() makes the same bits into one binary
per run: each task ors its own bits, and what the tasks have is or-ed after the shuffle.
For runs of any size stored_filter() deals keys into chunks, each a filter of its own in words of 64 bits.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import fnv1a_each


def parameters(expected: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a filter for so many keys at a rate of false positives."""
    if expected <= 0:
        raise ValueError("the number of keys must be positive")
    if not 0 < rate < 1:
        raise ValueError("the rate must lie between 0 and 1")
    bits = math.ceil(-expected * math.log(rate) / math.log(2) ** 2)
    return bits, max(1, round(bits * math.log(2) / expected))


def positions(key: Column, bits: int | Column, hashes: int | Column) -> Column:
    """The bits of a key, one for each seed; numbers or columns of numbers."""
    n, m = (x if isinstance(x, Column) else F.lit(x) for x in (hashes, bits))
    return F.transform(fnv1a_each(key, n), lambda h: h % m)


def build(keys: DataFrame, bits: int, hashes: int, key: str = "key", by: tuple[str, ...] = ()) -> DataFrame:
    """The set bits, for each run if ``by`` names it. Null or empty keys set none."""
    return keys.where(F.length(key) > 0).select(*by, F.explode(positions(F.col(key), bits, hashes)).alias("bit")).distinct()


def for_keys(keys: DataFrame, rate: float, key: str = "key") -> tuple[DataFrame, int, int]:
    """A filter sized to the keys it holds (one at least): its bits, and its geometry."""
    bits, hashes = parameters(max(1, keys.count()), rate)
    return build(keys, bits, hashes, key), bits, hashes


def runs_to_read(probes: DataFrame, zones: DataFrame, filter_bits: DataFrame, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """(key, run) of the runs that may hold each probe: its key lies in the run's range and all its bits are set there.

    ``zones`` has a row per run (run, min_key, max_key); ``filter_bits`` has run and bit.
    """
    near = probes.where(F.length(key) > 0).select(key).distinct().join(F.broadcast(zones), F.col(key).between(F.col("min_key"), F.col("max_key")))
    asked = near.select(key, "run", F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("bit"))
    hits = asked.join(filter_bits.select("run", "bit", F.lit(1).alias("_set")), ["run", "bit"], "left")
    return hits.groupBy(key, "run").agg((F.count("*") == F.count("_set")).alias("_maybe")).where("_maybe").select(key, "run")


def might_contain(probes: DataFrame, filter_bits: DataFrame, bits: int, hashes: int, key: str = "key") -> DataFrame:
    """``probes`` (distinct keys) with maybe: whether all bits of the key are set; false for an empty or null one."""
    asked = probes.where(F.length(key) > 0).select(key, F.explode(F.array_distinct(positions(F.col(key), bits, hashes))).alias("bit"))
    hits = asked.join(filter_bits.select("bit", F.lit(1).alias("_set")), "bit", "left").groupBy(key).agg((F.count("*") == F.count("_set")).alias("_maybe"))
    return probes.join(hits, key, "left").withColumn("maybe", F.coalesce("_maybe", F.lit(False))).drop("_maybe")


def false_positive_rate(judged: DataFrame, rate_name: str = "rate") -> DataFrame:
    """``judged``: probes that are known to be absent, with maybe."""
    return judged.agg(F.count("*").alias("probes"), F.sum(F.col("maybe").cast("long")).alias("false_positives"), F.round(F.avg(F.col("maybe").cast("double")), 6).alias(rate_name))


def bitset(filter_bits: DataFrame, bits: int) -> DataFrame:
    """One binary for each run: bit b is bit b % 8 of byte b // 8."""

    size = (bits + 7) // 8

    def told(sets: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
        for run, s in sets.items():
            yield pa.RecordBatch.from_arrays([pa.array([run], pa.int64()), pa.array([s.tobytes()], pa.binary())], names=["run", "bitset"])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for b in batches:
            runs, bit = b.column("run").to_numpy(), b.column("bit").to_numpy()
            for run in np.unique(runs).tolist():
                own = bit[runs == run]
                np.bitwise_or.at(sets.setdefault(run, np.zeros(size, np.uint8)), own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
        yield from told(sets)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}
        for b in batches:
            for run, part in zip(b.column("run").to_pylist(), b.column("bitset"), strict=True):
                sets.setdefault(run, np.zeros(size, np.uint8))[:] |= np.frombuffer(part.as_py(), np.uint8)
        yield from told(sets)

    kind = "run long, bitset binary"
    return filter_bits.select(F.col("run").cast("long").alias("run"), "bit").mapInArrow(partial, kind).repartition("run").mapInArrow(whole, kind)


#: Keys of a chunk of a stored filter.
CHUNK_KEYS = 65_536


def chunk_of(key: Column, chunks: Column | int) -> Column:
    return F.pmod(F.xxhash64(F.lit("chunk"), key), chunks if isinstance(chunks, Column) else F.lit(chunks)).cast("long")


def stored_positions(key: Column, bits: int | Column, hashes: int | Column) -> Column:
    """The bits of a key in its chunk, from two hashes.

    Not those of positions(): seeds of FNV-1a that differ in a bit give hashes that hang together where keys are
    alike, and a filter then lets many more through than it is made for.
    """
    n, m = (x if isinstance(x, Column) else F.lit(x) for x in (hashes, bits))
    one, two = (F.xxhash64(F.lit(i), key).bitwiseAND(F.lit((1 << 48) - 1)) for i in (1, 2))
    return F.transform(F.sequence(F.lit(0).cast("long"), n.cast("long") - 1), lambda i: (one + i * two) % m)


def stored_filter(keys: DataFrame, expected: int, rate: float, key: str = "key") -> tuple[DataFrame, int, int, int]:
    """Rows of chunk and words (the bits of its keys, 64 in each), and the filter's chunks, bits and hashes.

    A chunk has a geometry for its share of ``expected`` keys; a task holds one chunk at a time.
    """
    chunks = max(1, -(-expected // CHUNK_KEYS))
    bits, hashes = parameters(max(1, -(-expected // chunks)), rate)
    size = -(-bits // 64)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, words = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([words.view(np.int64)], pa.list_(pa.int64()))], names=["chunk", "words"])

        for b in batches:
            chunk, at = b.column("chunk").to_numpy(), b.column("at").flatten().to_numpy()
            first = np.flatnonzero(np.append(True, chunk[1:] != chunk[:-1])) if len(chunk) else []
            for i, z in zip(first, [*first[1:], len(chunk)], strict=True):
                if now is None or chunk[i] != now:
                    if now is not None:
                        yield told()
                    now, words = int(chunk[i]), np.zeros(size, np.uint64)
                own = at[i * hashes : z * hashes]
                np.bitwise_or.at(words, own >> 6, np.uint64(1) << (own & 63).astype(np.uint64))
        if now is not None:
            yield told()

    rows = keys.where(F.length(key) > 0).select(chunk_of(F.col(key), chunks).alias("chunk"), stored_positions(F.col(key), bits, hashes).alias("at"))
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(fill, "chunk long, words array<long>"), chunks, bits, hashes


def runs_that_may_hold(probes: DataFrame, zones: DataFrame, filters: DataFrame, key: str = "key") -> DataFrame:
    """(key, run_id) of the runs that each probe has to read: its key lies in the run's range, and its chunk there has all its bits.

    ``zones`` has a row per run (run_id, min_key, max_key, chunks, bits, hashes; a manifest), ``filters`` run_id, chunk and words.
    """
    near = probes.where(F.length(key) > 0).select(key).distinct().join(F.broadcast(zones), F.col(key).between(F.col("min_key"), F.col("max_key")))
    asked = near.withColumn("chunk", chunk_of(F.col(key), F.col("chunks")))
    found = asked.join(filters, ["run_id", "chunk"])
    every = F.forall(stored_positions(F.col(key), F.col("bits"), F.col("hashes")), lambda p: F.getbit(F.get("words", (p / 64).cast("int")), (p % 64).cast("int")) == 1)
    return found.where(every).select(key, "run_id")


def serialised(bitset_bytes: bytes, bits: int, hashes: int, rate: float) -> bytes:
    """Bits, hashes, rate, length and the bits themselves, little-endian."""
    return struct.pack("<iidi", bits, hashes, rate, len(bitset_bytes)) + bitset_bytes


def deserialised(data: bytes, bits: int | None = None, hashes: int | None = None) -> tuple[int, int, float, bytes]:
    """Back from serialised(); raises if the geometry isn't the one asked for or bytes are missing."""
    m, k, rate, length = struct.unpack_from("<iidi", data)
    body = data[20 : 20 + length]
    if len(body) != length or length != (m + 7) // 8:
        raise ValueError("the filter's bits are cut short")
    if bits not in (None, m) or hashes not in (None, k):
        raise ValueError("the filter has another geometry")
    return m, k, rate, body
