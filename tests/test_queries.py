"""Every registered query of the engine against its SQL at the smallest scale."""

import gzip
import zlib

import duckdb
import pytest
from oracle import TABLES, rows_of_spark, rows_of_sql

from conftest import SF
from runloom.plans.catalogue import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    got, columns = rows_of_spark(QUERIES[name](spark, SF))
    assert got
    if name in ORACLES:
        want, names = rows_of_sql(ORACLES[name], SF)
        assert columns == names
        assert got == want


def test_each_codec_gives_blocks_back(spark):
    blocks = {}
    for r in sorted(spark.read.parquet(f"{SF}/events.parquet").select("event_id", "props").collect()):
        blocks.setdefault(r["event_id"] // 100, []).append(r["props"])
    got = {r["block"]: r for r in QUERIES["compression_ratio"](spark, SF).collect()}
    assert set(got) == set(blocks)
    for block, rows in blocks.items():
        data, r = "\n".join(rows).encode(), got[block]
        assert r["same"] and r["raw"] == len(data) and r["gzip"] == len(gzip.compress(data, 6, mtime=0)) and r["deflate"] == len(zlib.compress(data, 6)) - 6
        assert 0 < r["zstd"] < r["raw"] and 0 < r["snappy"] < r["raw"]


def test_blocks_are_found_over_many_ranges(spark, request):
    from runloom.operators import layout

    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    request.addfinalizer(lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled"))
    assert layout._placed(spark.range(5000), "id").select(layout.PART).distinct().count() > 1
    keys = spark.range(0, 5000, 2, 7).selectExpr("0L as run", "lpad(cast(id as string), 5, '0') as key")
    ranked = layout.ranked(keys.select("key"), "key")
    assert all(int(r["key"]) == 2 * r["rank"] for r in ranked.collect())
    blocks = ranked.selectExpr("0L as run", "key", "rank div 100 as block")
    probes = spark.range(-3, 5003, 1, 5).selectExpr("0L as run", "case when id < 0 then ' ' else lpad(cast(id as string), 5, '0') end as key").distinct()
    for r in layout.block_lookup(probes, layout.block_index(blocks, "run", "block", "key")).collect():
        i = int(r["key"]) if r["key"].strip() else -1
        assert r["block"] == (i // 200 if 0 <= i <= 4998 and i % 200 != 199 else None), r


def test_a_range_of_many_probes_is_gone_through_once(spark, request):
    from runloom.operators import layout

    request.addfinalizer(lambda n=spark.conf.get("spark.sql.shuffle.partitions"): spark.conf.set("spark.sql.shuffle.partitions", n))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    probes = spark.range(100_000).selectExpr("0L as run", "lpad(cast(id as string), 6, '0') as key")
    index = spark.range(0, 100_000, 100).selectExpr("0L as run", "id div 100 as block", "lpad(cast(id as string), 6, '0') as start_key", "lpad(cast(id + 49 as string), 6, '0') as end_key")
    found = layout.block_lookup(probes, index)
    # Spark makes a frame that ends with the partition anew for each of its rows: some 5,000,000,000 steps here
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()
    assert found.where("not (block <=> if(cast(key as int) % 100 < 50, cast(key as int) div 100, null))").count() == 0
    assert found.count() == 100_000


@pytest.mark.parametrize("blocks", [(0, 1, 2), (2, 1, 0), (1, 0, 2)])
def test_of_blocks_with_the_same_end_the_least_is_found(spark, blocks):
    from runloom.operators import layout

    bounds = {0: ("a", "k"), 1: ("k", "k"), 2: ("k", "m")}
    index = spark.createDataFrame([(0, b, *bounds[b]) for b in blocks], "run long, block long, start_key string, end_key string").coalesce(1)
    probes = spark.createDataFrame([(0, k) for k in ("A", "a", "k", "l", "m", "z", None)], "run long, key string")
    assert {r["key"]: r["block"] for r in layout.block_lookup(probes, index).collect()} == {"A": None, "a": 0, "k": 0, "l": 2, "m": 2, "z": None, None: None}


def test_null_keys_are_last_in_blocks(spark, tmp_path):
    for t in TABLES:
        if t != "events":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.sql(f"copy (select * replace (case when event_id % 50 = 1 then null else event_id % 120 end as user_id, 'view' as event_type) from '{SF}/events.parquet') to '{tmp_path}/events.parquet'")
    want, _ = rows_of_sql(ORACLES["block_lookup"], str(tmp_path))
    assert rows_of_spark(QUERIES["block_lookup"](spark, str(tmp_path)))[0] == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
