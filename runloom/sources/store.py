"""A table as immutable runs and a versioned manifest.

A run is a Parquet folder, range-partitioned and sorted by key, so that row
groups have narrow key ranges; it also carries Parquet's Bloom filters on the key, and a
filter of its own in chunks. A manifest is one small JSON file per version that lists the runs and
the batches applied; it is created once and never changed, and a second writer of the same version fails. So
readers see whole versions, a crash leaves at most a run that no version names, and
vacuum() removes those. Reads prune runs by key range, lookups of many keys by the runs' filters too, before files
are opened; a lookup of one key is an equality, which Parquet's filters serve.

What is set is written to the log before it is acknowledged: a table of binary segments per batch, whole
once Spark has committed it. Opening the newest version replays the batches that no run holds yet;
a flush publishes their run first and then drops their logs.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import TableConfig
from ..functions.sizes import entry_size
from ..operators import bloom
from ..operators.lookup import multi_get, range_scan
from ..operators.resolve import latest_per_key, live_view, newest_first
from ..schema import CHANGE, normalised
from ..workspace import Files
from . import wal

STORED = T.StructType([*CHANGE.fields, T.StructField("run_seq", T.LongType(), False)])
RUN_ROW = "run_id string, path string, level int, idx long, run_seq long, entries long, deletes long, bytes long, min_key string, max_key string, chunks long, bits long, hashes long"


@dataclass(frozen=True)
class Run:
    run_id: str
    path: str
    level: int
    idx: int
    run_seq: int  # recency: the greatest of what was merged into it
    entries: int
    deletes: int
    bytes: int
    min_key: str | None
    max_key: str | None
    # of its filter: see bloom.stored_filter
    chunks: int = 0
    bits: int = 0
    hashes: int = 0

    def meets(self, low: str | None, high: str | None) -> bool:
        """Whether keys from low to high may be in it; an unknown bound reaches everything. Code-point order, as Spark's."""
        return not (low is not None and self.max_key is not None and self.max_key < low or high is not None and self.min_key is not None and self.min_key > high)


class Store:
    """One key namespace, with one writer at a time. Writes go to the log until flush(), by itself once they reach the threshold.

    A batch is read once, when it is set: later reads and the flush take it from its log.
    """

    def __init__(self, spark: SparkSession, path: str, config: TableConfig | None = None, version: int | None = None):
        self.spark, self.path, self.config = spark, path.rstrip("/"), config or TableConfig()
        self.files = Files(spark)
        self.buffer: list[DataFrame] = []  # batches of the log, in order of their numbers from next_seq on
        self.buffer_bytes = 0
        self.cached: DataFrame | None = None
        self.hits = self.misses = 0
        self.version, self.runs, self.next_seq = 0, [], 0
        self.batches: dict[str, int] = {}  # by source, the number of the last batch applied
        self.named: list[str] = []  # runs that were added under a name of the caller's, merged or not
        known = self.versions()
        if version is not None and version not in known:
            raise ValueError(f"there is no version {version}")
        if known:
            self._load(known[-1] if version is None else version)
        if version is None:
            self._recover()

    @classmethod
    def open(cls, spark: SparkSession, path: str, config: TableConfig | None = None, version: int | None = None) -> Store:
        return cls(spark, path, config, version)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    def close(self) -> None:
        """Flush what is left and release what is cached."""
        self.flush()
        self.clear_cache()

    # versions

    def versions(self) -> list[int]:
        return sorted(int(n[1:-5]) for n in self.files.names(f"{self.path}/manifest") if n.startswith("v") and n.endswith(".json"))

    def _load(self, version: int) -> None:
        told = json.loads(self.files.read(f"{self.path}/manifest/v{version:012d}.json"))
        self.version, self.next_seq, self.runs = version, told["next_seq"], [Run(**r) for r in told["runs"]]
        self.batches, self.named = told.get("batches", {}), told.get("named", [])

    def _publish(self, runs: Sequence[Run]) -> None:
        """The next version; raises FileExistsError if another writer was first."""
        body = json.dumps({"next_seq": self.next_seq, "batches": self.batches, "named": self.named, "runs": [asdict(r) for r in runs]})
        self.files.create(f"{self.path}/manifest/v{self.version + 1:012d}.json", body)
        self.version, self.runs = self.version + 1, list(runs)
        self.clear_cache()

    # writes

    def set(self, rows: DataFrame) -> None:
        """Upserts: rows of key, value, seq (their order in the batch) and maybe ts and tombstone."""
        path = self._log_path(self.next_seq + len(self.buffer))
        try:
            wal.encode_log(normalised(rows)).write.parquet(path)  # fails if another writer has this number
        except Exception as e:
            if "PATH_ALREADY_EXISTS" not in str(e):
                self.files.delete(path)
            raise
        self.clear_cache()
        self._take(path)
        if self.buffer_bytes >= self.config.memtable_threshold:
            self.flush()

    def _log_path(self, number: int) -> str:
        return f"{self.path}/log/b{number:012d}"

    def _take(self, path: str) -> None:
        """A batch of the log into the buffer."""
        log = self.spark.read.schema(wal.SEGMENT_ROW).parquet(path)
        self.buffer.append(wal.replay(log).select(*CHANGE.names))
        self.buffer_bytes += log.agg(F.sum("bytes").alias("n")).first()["n"] or 0

    def _recover(self) -> None:
        """Replay the batches of the log that no run holds yet, up to the first that isn't whole."""
        logged = set(self.files.names(f"{self.path}/log"))
        for number in range(self.next_seq, self.next_seq + len(logged)):
            path = self._log_path(number)
            if path.rsplit("/", 1)[1] not in logged:
                return
            if not self.files.exists(f"{path}/_SUCCESS"):
                self.files.delete(path)  # was never acknowledged
                return
            self._take(path)

    def _drop_logs(self) -> None:
        """Delete the logs of batches that a published run holds."""
        for name in self.files.names(f"{self.path}/log"):
            if int(name[1:]) < self.next_seq:
                self.files.delete(f"{self.path}/log/{name}")

    def delete(self, keys: DataFrame) -> None:
        """Deletes of rows of key (and seq); a key that isn't there gets its delete marker all the same."""
        seq = F.col("seq") if "seq" in keys.columns else F.lit(0).cast("long")
        self.set(keys.select("key", F.lit(None).cast("binary").alias("value"), F.lit(True).alias("tombstone"), seq.alias("seq")))

    def _buffered(self) -> DataFrame | None:
        found = None
        for i, batch in enumerate(self.buffer):
            part = batch.withColumn("run_seq", F.lit(self.next_seq + i).cast("long"))
            found = part if found is None else found.unionByName(part)
        return found

    def flush(self) -> Run | None:
        """The buffer as one new run of level 0, its newest version of each key with deletes kept; nothing if it is empty."""
        rows = self._buffered()
        if rows is None:
            return None
        newest = latest_per_key(rows, ["key"], newest_first("run_seq", "seq"))
        before, last = self.next_seq, self.next_seq + len(self.buffer) - 1
        run = self._write(newest.withColumn("run_seq", F.lit(last).cast("long")), 0, last)
        self.next_seq = last + 1
        try:
            self._publish([*self.runs, run] if run else self.runs)
        except Exception:
            self.next_seq = before  # the buffer is still what it was
            raise
        self.buffer, self.buffer_bytes = [], 0
        self._drop_logs()
        return run

    def add_run(self, rows: DataFrame, run_id: str | None = None, source: str | None = None, number: int = 0) -> Run | None:
        """Rows straight into a run of level 0, newer than all that was set before.

        With a run_id that was added before, or a ``source`` whose batch of that ``number`` or a later one was,
        nothing is done, so that a retry is harmless, also after merges. Names of runs are kept for good;
        of a source only the last number is.
        """
        if run_id is not None and run_id in self.named or source is not None and number <= self.batches.get(source, -1):
            return None
        if self.buffer:
            self.flush()
        newest = latest_per_key(normalised(rows), ["key"], newest_first("seq")).withColumn("run_seq", F.lit(self.next_seq).cast("long"))
        name = run_id if run_id is not None or source is None else f"{source}{number:012d}"
        run = self._write(newest, 0, self.next_seq, name)
        if run is None and source is None:
            return None
        before = self.next_seq, self.batches, self.named
        self.next_seq += 1
        if source is not None:
            self.batches = {**self.batches, source: number}
        if run_id is not None:
            self.named = [*self.named, run_id]
        try:
            self._publish([*self.runs, run] if run else self.runs)
        except Exception:
            self.next_seq, self.batches, self.named = before
            raise
        return run

    def _next_index(self, level: int) -> int:
        return max((r.idx for r in self.runs if r.level == level), default=-1) + 1

    def _write(self, rows: DataFrame, level: int, run_seq: int, run_id: str | None = None) -> Run | None:
        idx, name = self._next_index(level), run_id or uuid.uuid4().hex
        path = f"{self.path}/runs/L{level}_{idx}_{name}"
        writer = rows.repartitionByRange("key").sortWithinPartitions("key").write.mode("overwrite").option("compression", self.config.compression)
        writer = writer.option("parquet.page.size", self.config.data_block_size).option("parquet.block.size", self.config.run_partition_bytes)
        writer.option("parquet.bloom.filter.enabled#key", "true").option("parquet.bloom.filter.fpp#key", str(self.config.bloom_false_positive_rate)).parquet(path)
        stored = self.spark.read.schema(STORED).parquet(path)
        told = stored.agg(
            F.count("*").alias("n"), F.sum(F.col("tombstone").cast("long")).alias("dead"), F.sum(entry_size(F.col("key"), F.octet_length("value"))).alias("size"), F.min("key").alias("low"), F.max("key").alias("high")
        ).first()
        if not told["n"]:
            self.files.delete(path)
            return None
        bits, *geometry = bloom.stored_filter(stored.select("key"), told["n"], self.config.bloom_false_positive_rate)
        bits.write.mode("overwrite").parquet(self._filter_path(path))
        return Run(name, path, level, idx, run_seq, told["n"], told["dead"], told["size"], told["low"], told["high"], *geometry)

    def _filter_path(self, run_path: str) -> str:
        return f"{self.path}/filters/{run_path.rsplit('/', 1)[1]}"

    # reads

    def _stored(self, runs: Sequence[Run]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], STORED)
        return self.spark.read.schema(STORED).parquet(*[r.path for r in runs])

    def changes(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """All versions of keys that may lie from low to high: pruned runs and the buffer."""
        return self._with_buffer(self._stored([r for r in self.runs if r.meets(low, high)]))

    def _with_buffer(self, rows: DataFrame) -> DataFrame:
        fresh = self._buffered()
        return rows if fresh is None else rows.unionByName(fresh)

    def live(self, low: str | None = None, high: str | None = None) -> DataFrame:
        """key, value, ts and seq of what is there now."""
        rows = self.changes(low, high)
        if low is not None and low == high:
            return self._resolved(rows.where(F.col("key") == low))  # an equality reaches Parquet's filters, a range doesn't
        if low is not None:
            rows = rows.where(F.col("key") >= low)
        if high is not None:
            rows = rows.where(F.col("key") <= high)
        return self._resolved(rows)

    def _resolved(self, rows: DataFrame) -> DataFrame:
        return live_view(rows, ["key"], newest_first("run_seq", "seq")).select("key", "value", "ts", "seq")

    def get(self, key: str) -> tuple[bool, bytes]:
        """(found, value); (False, b"") for a key that is missing, deleted, null or empty."""
        if not key:
            return False, b""
        row = self.live(key, key).first()
        return (True, bytes(row["value"])) if row else (False, b"")

    def multi_get(self, probes: DataFrame) -> DataFrame:
        """``probes`` (key, ...) with found and value: one read for all of them, of the runs that may hold one."""
        needed = self.runs_for(probes)
        return multi_get(probes, self._resolved(self._with_buffer(self._stored(needed))))

    def runs_for(self, probes: DataFrame) -> list[Run]:
        """The runs that a lookup of ``probes`` (key, ...) has to read: whose key range and stored filter let one of the keys be there."""
        filtered = [r for r in self.runs if r.chunks]
        if not filtered:
            return list(self.runs)
        filters = reduce(DataFrame.unionByName, (self.spark.read.schema("chunk long, words array<long>").parquet(self._filter_path(r.path)).withColumn("run_id", F.lit(r.run_id)) for r in filtered))
        zones = self.manifest().select("run_id", "min_key", "max_key", "chunks", "bits", "hashes").where("chunks > 0")
        hit = {r["run_id"] for r in bloom.runs_that_may_hold(probes, zones, filters).select("run_id").distinct().collect()}  # no more than there are runs
        return [r for r in self.runs if r.run_id in hit or not r.chunks]

    def starting(self, prefix: str) -> DataFrame:
        """What is there now under keys that start with ``prefix``, in key order; the predicate reaches the scan."""
        return self._resolved(self.changes(prefix, None).where(F.col("key").startswith(prefix))).orderBy("key")

    def range(self, low: str, high: str) -> DataFrame:
        return range_scan(self.live(low, high), low, high)

    # maintenance

    def compact(self, level: int = 0) -> list[Run]:
        """Merge a level into the next while that is due (the given one in any case); returns the new runs."""
        made = []
        run = self._merge(level)
        while run is not None:
            made.append(run)
            level += 1
            due = sum(r.level == level for r in self.runs) >= self.config.trigger(level)
            run = self._merge(level) if due and level < self.config.max_levels - 1 else None
        return made

    def _merge(self, level: int) -> Run | None:
        own = [r for r in self.runs if r.level == level]
        if level > 0 and own:
            own = [min(own, key=lambda r: r.run_seq)]
        if not own:
            return None
        lows, highs = [r.min_key for r in own], [r.max_key for r in own]
        below = [r for r in self.runs if r.level == level + 1 and r.meets(min(lows), max(highs))]
        chosen = own + below
        names = {r.run_id for r in chosen}
        rest = [r for r in self.runs if r.run_id not in names]
        # a delete must stay while an older run outside may hold its key
        low, high = min(r.min_key for r in chosen), max(r.max_key for r in chosen)
        newest = max(r.run_seq for r in chosen)
        older = any(r.run_seq < newest and r.meets(low, high) for r in rest)
        rows = self._stored(chosen)
        order = newest_first("run_seq", "seq")
        merged = latest_per_key(rows, ["key"], order) if older else live_view(rows, ["key"], order)
        run = self._write(merged, level + 1, newest)
        self._publish([*rest, run] if run else rest)
        return run

    def due(self) -> list[int]:
        levels = sorted({r.level for r in self.runs})
        return [n for n in levels if sum(r.level == n for r in self.runs) >= self.config.trigger(n)]

    def vacuum(self, keep: int = 1) -> list[str]:
        """Delete runs that none of the last ``keep`` versions lists, and older versions; returns what went."""
        known = self.versions()
        named, gone = set(), []
        for v in known[-keep:] if keep else []:
            named |= {r["path"].rsplit("/", 1)[1] for r in json.loads(self.files.read(f"{self.path}/manifest/v{v:012d}.json"))["runs"]}
        for v in known[: -keep or None]:
            self.files.delete(f"{self.path}/manifest/v{v:012d}.json")
        for name in self.files.names(f"{self.path}/runs"):
            if name not in named:
                self.files.delete(f"{self.path}/runs/{name}")
                gone.append(name)
        for name in self.files.names(f"{self.path}/filters"):
            if name not in named:
                self.files.delete(f"{self.path}/filters/{name}")
        self._drop_logs()
        return gone

    # introspection

    def manifest(self) -> DataFrame:
        """The runs as rows."""
        return self.spark.createDataFrame([tuple(asdict(r).values()) for r in self.runs], RUN_ROW)

    def cache(self) -> DataFrame:
        """The live view, kept by Spark until clear_cache(), the next write or the next version.

        It is kept only if the runs and the buffer hold no more than ``block_cache_size`` bytes.
        """
        if self.cached is not None:
            self.hits += 1
            return self.cached
        self.misses += 1
        view = self.live()
        if self.config.enable_block_cache and sum(r.bytes for r in self.runs) + self.buffer_bytes <= self.config.block_cache_size:
            self.cached = view.persist()
        return view

    def cache_stats(self) -> dict[str, float]:
        """Of the views asked of cache(): hits, misses, hit_ratio (0 if there were none), entries kept, their bytes and the most allowed."""
        asked = self.hits + self.misses
        size = sum(r.bytes for r in self.runs) + self.buffer_bytes if self.cached is not None else 0
        return {"hits": self.hits, "misses": self.misses, "hit_ratio": self.hits / asked if asked else 0.0, "entries": int(self.cached is not None), "bytes": size, "capacity": self.config.block_cache_size}

    def clear_cache(self) -> None:
        if self.cached is not None:
            self.cached.unpersist()
        self.cached = None

    def with_config(self, **changes: object) -> Store:
        return Store(self.spark, self.path, replace(self.config, **changes))
