"""The table: fixtures of the blueprint, and random histories against a dictionary."""

import random
import struct

import pytest
from pyspark.sql import functions as F

from runloom.config import TableConfig
from runloom.operators import bloom
from runloom.sources import wal
from runloom.sources.store import Store
from runloom.workspace import Files

ROW = "key string, value binary, seq long"


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "t"), TableConfig(memtable_threshold=1 << 30))


def put(store, rows):
    store.set(store.spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(rows)], ROW))


def drop(store, *keys):
    store.delete(store.spark.createDataFrame([(k,) for k in keys], "key string"))


def held(store):
    return {r["key"]: bytes(r["value"]) for r in store.live().collect()}


def test_edge_values(store):
    rows = [("empty", b""), ("k" * 1000, b"x"), ("big", bytes(range(256)) * 40), ("bytes", bytes([0, 1, 2, 255, 254])), ("🔑测试键中文日本語🚀", b"u"), ("a/b.c:d!", b"p")]
    put(store, rows)
    store.flush()
    assert held(store) == dict(rows)
    assert store.get("empty") == (True, b"")
    assert store.get("none") == (False, b"") == store.get("") == store.get(None)


def test_invalid_keys_raise(store):
    for key in (None, ""):
        with pytest.raises(Exception, match="key must not be"):
            put(store, [(key, b"x")])
    assert store.buffer == []


def test_update_and_delete_across_flushes(store):
    put(store, [("a", b"1"), ("b", b"1"), ("c", b"1")])
    store.flush()
    put(store, [("a", b"2"), ("a", b"3")])
    drop(store, "b", "never")
    store.flush()
    assert held(store) == {"a": b"3", "c": b"1"}
    store.compact()
    assert held(store) == {"a": b"3", "c": b"1"}
    put(store, [("b", b"4")])
    assert held(store) == {"a": b"3", "b": b"4", "c": b"1"}


def test_deletes_stay_while_an_older_run_may_hold_the_key(store):
    put(store, [("a", b"1"), ("z", b"1")])
    store.flush()
    store._merge(0)
    store._merge(1)  # now at level 2
    drop(store, "a")
    store.flush()
    store._merge(0)  # to level 1: level 2 still has the key
    assert [r.deletes for r in store.runs if r.level == 1] == [1]
    assert held(store) == {"z": b"1"}
    store._merge(1)
    assert [r.deletes for r in store.runs] == [0]
    assert held(store) == {"z": b"1"}


def test_merge_of_nothing_but_deletes_leaves_no_run(store):
    drop(store, "a", "b")
    store.flush()
    store.compact()
    assert store.runs == [] and held(store) == {}


def test_range_is_inclusive(store):
    put(store, [(f"range_key_{i:03d}", b"v") for i in range(100)])
    store.flush()
    for low, high, n in ((10, 20, 11), (25, 35, 11), (50, 55, 6), (0, 99, 100), (90, 99, 10)):
        assert store.range(f"range_key_{low:03d}", f"range_key_{high:03d}").count() == n


def test_versions_and_vacuum(store, spark):
    put(store, [("a", b"1")])
    store.flush()
    put(store, [("a", b"2")])
    store.flush()
    assert held(Store.open(spark, store.path, version=1)) == {"a": b"1"}
    assert held(Store.open(spark, store.path)) == {"a": b"2"}
    store.compact()
    assert len(store.vacuum()) == 2 and held(Store.open(spark, store.path)) == {"a": b"2"}
    with pytest.raises(ValueError):
        Store.open(spark, store.path, version=1)


def test_second_writer_of_a_version_fails(store, spark):
    other = Store.open(spark, store.path)
    put(store, [("a", b"1")])
    store.flush()
    put(other, [("a", b"2")])
    with pytest.raises(FileExistsError):
        other.flush()
    assert held(Store.open(spark, store.path)) == {"a": b"1"}


def test_threshold_flushes(spark, tmp_path):
    store = Store(spark, str(tmp_path / "t"), TableConfig(memtable_threshold=100))
    put(store, [("a", b"x" * 200)])
    assert len(store.runs) == 1 and store.buffer == []


def test_same_batch_twice_is_applied_once(store):
    rows = store.spark.createDataFrame([("a", b"1", 0)], ROW)
    store.add_run(rows, "batch1")
    assert store.add_run(rows, "batch1") is None and len(store.runs) == 1


def test_what_is_set_survives_its_process(store, spark):
    put(store, [("a", b"1"), ("b", b"1")])
    store.flush()
    put(store, [("a", b"2"), ("a", b"3")])
    drop(store, "b")
    again = Store.open(spark, store.path)  # no flush, no close
    assert held(again) == {"a": b"3"} and len(again.buffer) == 2 and again.buffer_bytes > 0
    again.flush()
    assert store.files.names(f"{store.path}/log") == [] and held(Store.open(spark, store.path)) == {"a": b"3"}


def test_a_batch_that_was_never_acknowledged_is_not_replayed(store, spark):
    put(store, [("a", b"1")])
    put(store, [("a", b"2")])
    store.files.delete(f"{store._log_path(1)}/_SUCCESS")
    again = Store.open(spark, store.path)
    assert held(again) == {"a": b"1"}
    put(again, [("a", b"4")])
    assert held(Store.open(spark, store.path)) == {"a": b"4"}


def test_a_cut_segment_gives_its_valid_prefix(spark):
    rows = spark.createDataFrame([(f"k{i}", b"v", False, 0, 10 + i) for i in range(20)], "key string, value binary, tombstone boolean, ts long, seq long").coalesce(1)
    log = wal.encode_log(rows, limit=100)
    assert log.count() > 2
    back = wal.replay(log, at_once=3).orderBy("place").collect()
    assert [(r["key"], r["seq"], r["place"]) for r in back] == [(f"k{i}", 10 + i, i) for i in range(20)]
    cut = log.withColumn("content", F.expr("substring(content, 1, length(content) - 1)"))
    assert wal.replay(cut).count() == 20 - log.count()


def test_retry_after_merge_and_reopen(store, spark):
    rows = lambda v: spark.createDataFrame([("a", v, 0)], ROW)
    store.add_run(rows(b"old"), source="s", number=0)
    store.add_run(rows(b"name"), "named")
    store.add_run(rows(b"new"), source="s", number=1)
    store.compact()
    again = Store.open(spark, store.path)
    for how in ({"source": "s", "number": 0}, {"source": "s", "number": 1}, {"run_id": "named"}):
        assert again.add_run(rows(b"old"), **how) is None
    assert held(again) == {"a": b"new"}
    assert again.add_run(rows(b"other"), source="t", number=0) is not None and held(again) == {"a": b"other"}


def test_lookups_read_the_runs_that_may_hold_a_key(store, spark):
    for part in ("az", "by", "cx"):
        put(store, [(f"{part[0]}-key-{i:04d}", b"1") for i in range(50)] + [(f"{part[1]}-key-{i:04d}", b"2") for i in range(50)])
        store.flush()
    probes = spark.createDataFrame([("b-key-0007",), ("y-key-0003",), (None,), ("",)], "key string")
    assert [r.run_seq for r in store.runs_for(probes)] == [1]  # the first run's range holds them too
    found = {r["key"]: (r["found"], r["value"] and bytes(r["value"])) for r in store.multi_get(probes).collect()}
    assert found == {"b-key-0007": (True, b"1"), "y-key-0003": (True, b"2"), None: (False, None), "": (False, None)}
    assert store.runs_for(spark.createDataFrame([("m",)], "key string")) == []
    plan = store.live("b-key-0007", "b-key-0007")._jdf.queryExecution().toString()
    assert "EqualTo(key,b-key-0007)" in plan and "GreaterThanOrEqual(key" not in plan
    assert {r["key"] for r in store.starting("b-key-001").collect()} == {f"b-key-001{i}" for i in range(10)}


def test_stored_filters_have_no_false_negatives(spark, monkeypatch):
    monkeypatch.setattr(bloom, "CHUNK_KEYS", 100)
    keys = spark.createDataFrame([(f"é{i}",) for i in range(1000)], "key string")
    made, chunks, bits, hashes = bloom.stored_filter(keys, 1000, 0.01)
    zones = spark.createDataFrame([("r", "", "￿", chunks, bits, hashes)], "run_id string, min_key string, max_key string, chunks long, bits long, hashes long")
    made = made.withColumn("run_id", F.lit("r"))
    assert chunks == 10 and bloom.runs_that_may_hold(keys, zones, made).count() == 1000
    absent = spark.createDataFrame([(f"x{i}",) for i in range(2000)], "key string")
    assert bloom.runs_that_may_hold(absent, zones, made).count() < 100


def test_of_two_writers_one_wins(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    files, path = Files(spark), str(tmp_path / "m" / "v1.json")
    files.create(str(tmp_path / "m" / "v0.json"), "0")

    def write(i):
        try:
            files.create(path, str(i))
            return i
        except FileExistsError:
            return None

    with ThreadPoolExecutor(8) as pool:
        won = [i for i in pool.map(write, range(16)) if i is not None]
    assert len(won) == 1 and files.read(path) == str(won[0]) and files.names(str(tmp_path / "m")) == ["v0.json", "v1.json"]


def test_cache_counts(store):
    put(store, [("a", b"1")])
    assert store.cache().count() == 1 and store.cache().count() == 1
    assert store.cache_stats() == {"hits": 1, "misses": 1, "hit_ratio": 0.5, "entries": 1, "bytes": store.buffer_bytes, "capacity": 64 << 20}
    put(store, [("b", b"1")])
    assert store.cache().count() == 2 and store.cache_stats()["misses"] == 2
    store.clear_cache()
    small = store.with_config(block_cache_size=1)
    small.cache()
    assert small.cache_stats()["entries"] == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_random_history(store, seed):
    rng, model = random.Random(seed), {}
    for _ in range(14):
        what = rng.choice(["set", "set", "delete", "flush", "compact"])
        if what == "set":
            rows = [(f"k{rng.randrange(12)}", bytes([rng.randrange(256)])) for _ in range(4)]
            put(store, rows)
            model.update(rows)
        elif what == "delete":
            keys = {f"k{rng.randrange(12)}" for _ in range(2)}
            drop(store, *keys)
            for k in keys:
                model.pop(k, None)
        elif what == "flush":
            store.flush()
        else:
            store.compact()
    assert held(store) == model
    store.close()
    assert held(Store.open(store.spark, store.path)) == model


def test_each_codec(spark, tmp_path):
    for codec in ("uncompressed", "gzip", "lz4", "snappy", "zstd"):
        store = Store(spark, str(tmp_path / codec), TableConfig(compression=codec))
        put(store, [("a", b"1")])
        store.flush()
        assert held(Store.open(spark, store.path)) == {"a": b"1"}


def test_config_is_checked():
    for bad in ({"memtable_threshold": 0}, {"bloom_false_positive_rate": 1.0}, {"compression": "x"}, {"compaction_ratio": 1}):
        with pytest.raises(ValueError):
            TableConfig(**bad)


def test_log_stops_at_the_first_bad_record():
    rows = [("a", b"1", False, 5), ("é", b"", True, 6), ("c", b"xyz", False, 7)]
    data = b"".join(wal.encoded(*r) for r in rows)
    assert list(wal.records(data)) == rows
    for cut in range(1, 8):
        assert list(wal.records(data[:-cut])) == rows[:2]
    broken = wal.encoded(*rows[0]) + struct.pack("<i", -1) + data
    assert list(wal.records(broken)) == rows[:1] and list(wal.records(b"")) == []


def test_bloom_numbers():
    assert [bloom.parameters(n, p) for n, p in ((1000, 0.01), (10_000, 0.001), (10_000, 0.1))] == [(9586, 7), (143776, 10), (47926, 3)]
    assert len(bloom.serialised(bytes((9586 + 7) // 8), 9586, 7, 0.01)) == 1219
    with pytest.raises(ValueError):
        bloom.deserialised(bloom.serialised(bytes(2), 16, 1, 0.1), 17)
    for bad in ((0, 0.1), (5, 0.0), (5, 1.0)):
        with pytest.raises(ValueError):
            bloom.parameters(*bad)
