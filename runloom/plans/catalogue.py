"""Every operator of the engine as a query over the test tables, with SQL for DuckDB where that can say it."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


from ..config import TableConfig
from ..functions.hashing import fnv1a
from ..functions.keys import code_unit_order, padded
from ..functions.sizes import block_entry_size, cached_block_size, entry_size
from ..operators import bloom, cache, compaction, layout, lookup, resolve
from ..sources import wal
from ..sources.store import Store
from ..streaming.ingest import upsert_stream, without_repeats
from ..workspace import work_path
from .workloads import changes, customers, events, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: The events as a changelog, in SQL.
E = """(select 'user:' || lpad(user_id::varchar, greatest(6, length(user_id::varchar))::int, '0') k, value v, event_type = 'error' tomb, ts, event_id, event_id % 4 run from events)"""
LIVE = f"(select k, v, ts, event_id from (select *, row_number() over (partition by k order by ts desc, event_id desc) rn from {E}) where rn = 1 and not tomb)"
PROBES = "(select 'user:' || lpad(c_custkey::varchar, greatest(6, length(c_custkey::varchar))::int, '0') k, c_custkey from customer)"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.live_view(events(spark, sf_dir), ["k"], resolve.newest_first("ts", "event_id"), "tomb")


# newest version wins


@query(f"select k, v from {LIVE}")
def live_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _live(spark, sf_dir).select("k", "v")


@query(f"select k, v, run from (select *, row_number() over (partition by k order by run desc, ts desc, event_id desc) rn from {E}) where rn = 1 and not tomb")
def kmerge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_numbered(events(spark, sf_dir), ["k"], "run", ["ts", "event_id"], "tomb").select("k", "v", "run")


@query(f"select k, v from (select *, row_number() over (partition by k order by v desc, event_id desc) rn from {E}) where rn = 1 and not tomb")
def merge_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_ordered(events(spark, sf_dir), ["k"], [F.col("v"), F.col("event_id")], "tomb").select("k", "v")


@query(
    f"""with l as (select *, row_number() over (partition by k, run >= 2 order by ts desc, event_id desc) rn from {E}),
o as (select * from l where rn = 1 and run < 2), n as (select * from l where rn = 1 and run >= 2)
select coalesce(n.k, o.k) k, case when n.k is not null then n.v else o.v end v from o full join n on o.k = n.k
where not case when n.k is not null then n.tomb else o.tomb end"""
)
def merge_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, newest = events(spark, sf_dir), resolve.newest_first("ts", "event_id")
    old, new = (resolve.latest_per_key(e.where(side), ["k"], newest).select("k", "v", "tomb") for side in ("run < 2", "run >= 2"))
    return resolve.merge_two(old, new, ["k"], "tomb").select("k", "v")


@query(f"select k, max(v) v from {E} where not tomb group by k")
def merge_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_aggregated(events(spark, sf_dir), ["k"], {"v": F.max("v")}, "tomb")


@query(f"select k, min(v) v from {E} where not tomb group by k")
def merge_min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_aggregated(events(spark, sf_dir), ["k"], {"v": F.min("v")}, "tomb")


@query(f"select k, round(sum(v::decimal(20, 6)), 2)::double v from {E} where not tomb group by k")
def merge_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = F.round(F.sum(F.col("v").cast("decimal(20,6)")), 2).cast("double")
    return resolve.merge_aggregated(events(spark, sf_dir), ["k"], {"v": total}, "tomb")


@query(f"select k, arg_min(v, {{'t': ts, 'e': event_id}}) v from {E} where not tomb group by k")
def merge_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.merge_aggregated(events(spark, sf_dir), ["k"], {"v": F.min_by("v", F.struct("ts", "event_id"))}, "tomb")


@query(
    f"""with r as (select k, event_id, v, tomb, row_number() over (partition by k order by ts, event_id) rn,
  sum(tomb::int) over (partition by k order by ts, event_id) dels from {E}),
l as (select *, max(dels) over (partition by k) last_del from r)
select k, count(*)::bigint writes from l where not tomb and dels = last_del group by k"""
)
def merge_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rule that is no aggregate: count the writes since the last delete."""
    versions = events(spark, sf_dir).select("k", "ts", "event_id", F.lit(1).cast("long").alias("writes"), "tomb")

    def since_delete(held: Column, new: Column) -> Column:
        n = F.when(new["tomb"], 0).otherwise(F.when(held["tomb"], 0).otherwise(held["writes"]) + 1).cast("long")
        return F.struct(new["ts"].alias("ts"), new["event_id"].alias("event_id"), n.alias("writes"), new["tomb"].alias("tomb"))

    return resolve.merge_folded(versions, ["k"], ["ts", "event_id"], since_delete, "tomb").select("k", "writes")


@query(
    """select l_orderkey, l_linenumber, arg_max(l_extendedprice, struct_pack(a := l_shipdate, b := l_partkey, c := l_suppkey, d := l_extendedprice)) price
from lineitem group by all"""
)
def upsert_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = F.max_by("l_extendedprice", F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"))
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(newest.alias("price"))


@query("select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) rn from orders) where rn = 1")
def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = resolve.latest_per_key(table(spark, sf_dir, "orders"), ["o_custkey"], resolve.newest_first("o_orderdate", "o_orderkey"))
    return newest.select("o_custkey", "o_orderkey", "o_totalprice")


@query(
    f"""select p.k, coalesce(not tomb, false) found, case when not tomb then v end v from {PROBES} p
left join (select * from (select *, row_number() over (partition by k order by case run when 3 then 0 when 2 then 1 when 1 then 2 else 3 end, ts desc, event_id desc) rn from {E}) where rn = 1) l on p.k = l.k"""
)
def tiered_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest tier first, and the first hit, be it a delete, ends the search: recency of tiers is a column."""
    return lookup.multi_get(customers(spark, sf_dir), resolve.merge_numbered(events(spark, sf_dir), ["k"], "run", ["ts", "event_id"], "tomb"), "k", "v")


# lookups


@query(f"select p.k, l.k is not null found, l.v from {PROBES} p left join {LIVE} l on p.k = l.k")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.multi_get(customers(spark, sf_dir), _live(spark, sf_dir), "k", "v")


@query(f"select p.k from {PROBES} p semi join {LIVE} l on p.k = l.k")
def exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.exists(customers(spark, sf_dir), _live(spark, sf_dir), "k")


@query(f"select p.k from {PROBES} p anti join {LIVE} l on p.k = l.k")
def missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.missing(customers(spark, sf_dir), _live(spark, sf_dir), "k")


@query(f"select k, v from {LIVE} where k between 'user:000010' and 'user:000050' order by k")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.range_scan(_live(spark, sf_dir), "user:000010", "user:000050", "k").select("k", "v")


@query(
    """select r.event_id, w.value w from (select * from events where event_type = 'view') r
asof left join (select * from events where event_type <> 'view') w on r.user_id = w.user_id and r.ts >= w.ts"""
)
def get_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    reads, writes = e.where("event_type = 'view'"), e.where("event_type <> 'view'")
    return lookup.get_as_of(reads, writes, ["user_id"], "ts", F.col("value"), "event_id", "w").select("event_id", "w")


@query(f"select k, v from {LIVE}")
def delete_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A delete of a key that isn't there succeeds and changes nothing."""
    e = events(spark, sf_dir)
    gone = e.agg(F.lit("user:none").alias("k"), F.lit(None).cast("double").alias("v"), F.lit(True).alias("tomb"), F.max("ts").alias("ts"), (F.max("event_id") + 1).alias("event_id"), F.lit(0).cast("long").alias("run"))
    return resolve.live_view(e.unionByName(gone), ["k"], resolve.newest_first("ts", "event_id"), "tomb").select("k", "v")


@query(f"select run, k, event_id, v from {E}")
def run_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All entries of the runs in key order."""
    return events(spark, sf_dir).orderBy("run", "k", "event_id").select("run", "k", "event_id", "v")


# layout


@query(f"select run, count(*) entries, min(k) min_key, max(k) max_key, sum(tomb::int)::bigint deletes from {E} group by run")
def zone_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.zone_maps(events(spark, sf_dir), "run", "k", "tomb")


@query(f"with z as (select run, min(k) a, max(k) b from {E} group by run) select x.run run_a, y.run run_b from z x join z y on x.run < y.run and not (y.b < x.a or y.a > x.b)")
def run_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.overlapping_runs(layout.zone_maps(events(spark, sf_dir), "run", "k", "tomb"), "run")




def _manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in ten runs, as manifest rows: five at level 0 that overlap, four at level 1 by key range, one at level 2."""
    ten = F.col("event_id") % 10
    fourth = F.least(F.floor(F.substring("k", 6, 20).cast("long") / 40), F.lit(3).cast("long"))
    level = F.when(ten < 5, 0).when(ten < 9, 1).otherwise(2)
    seq = F.when(ten < 5, ten + 5).when(ten < 9, fourth + 1).otherwise(F.lit(0).cast("long"))
    zones = events(spark, sf_dir).groupBy(level.alias("level"), seq.alias("run_seq")).agg(F.count("*").alias("entries"), F.min("k").alias("min_key"), F.max("k").alias("max_key"))
    return zones.withColumn("idx", F.col("run_seq") % 5).withColumn("run_id", F.concat(F.lit("r"), F.col("run_seq").cast("string")))


_MANIFEST = f"""(select level, run_seq, count(*) entries, min(k) min_key, max(k) max_key, run_seq % 5 idx, 'r' || run_seq run_id from (
select *, case when event_id % 10 < 5 then 0 when event_id % 10 < 9 then 1 else 2 end level,
  case when event_id % 10 < 5 then event_id % 10 + 5 when event_id % 10 < 9 then least(substr(k, 6)::bigint // 40, 3) + 1 else 0 end run_seq from {E}) group by level, run_seq)"""


@query(
    f"""select level, runs, trigger, runs >= trigger due, next_idx from (
select level, count(*) runs, case when level = 0 then 4 else pow(10, level) end::bigint trigger, (max(idx) + 1)::bigint next_idx from {_MANIFEST} group by level)"""
)
def compaction_trigger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.triggered(_manifest(spark, sf_dir), TableConfig())


@query(
    f"""with m as {_MANIFEST}, s as (select min(min_key) low, max(max_key) high from m where level = 0)
select run_id, level from m, s where level = 0 or level = 1 and not (max_key < low or min_key > high)"""
)
def compaction_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compaction.inputs(_manifest(spark, sf_dir), 0).select("run_id", "level")


@query(
    f"""with m as {_MANIFEST}, o as (select * from m where level = 1 order by run_seq limit 1),
s as (select min(min_key) low, max(max_key) high from o)
select run_id, level from o union all select run_id, level from m, s where level = 2 and not (max_key < low or min_key > high)"""
)
def compaction_inputs_deep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deeper level gives its oldest run."""
    return compaction.inputs(_manifest(spark, sf_dir), 1).select("run_id", "level")


@query(
    f"""with m as {_MANIFEST}, s as (select min(min_key) low, max(max_key) high, max(run_seq) newest from m where level < 2)
select count(*) = 0 "drop" from m, s where level = 2 and run_seq < newest and not (max_key < low or min_key > high)"""
)
def delete_purge_allowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = _manifest(spark, sf_dir)
    return compaction.may_drop_deletes(runs, runs.where("level < 2"))


@query(f"with l as (select count(*) n from {LIVE}) select (select count(*) from {E}) stored, n live, round((select count(*) from {E}) / n, 6) amplification from l")
def level_amplification(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored, live = events(spark, sf_dir).agg(F.count("*").alias("stored")), _live(spark, sf_dir).agg(F.count("*").alias("live"))
    return stored.crossJoin(live).withColumn("amplification", F.round(F.col("stored") / F.col("live"), 6))  # one row each




def _block_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the length of a value is that of its event id in digits
    e = events(spark, sf_dir)
    return e.select("run", "k", "event_id", block_entry_size(F.col("k"), F.length(F.col("event_id").cast("string"))).alias("size"))


_BLOCK_ENTRIES = f"(select run, k, event_id, (73 + 2 * length(k) + length(event_id::varchar))::bigint size from {E})"
_PACKED = f"""with recursive e as (select *, row_number() over (partition by run order by k, event_id) rn from {_BLOCK_ENTRIES}),
p(run, rn, k, event_id, size, block, held) as (
  select run, rn, k, event_id, size, 0::bigint, size from e where rn = 1
  union all
  select e.run, e.rn, e.k, e.event_id, e.size, case when p.held + e.size > 4096 then p.block + 1 else p.block end,
    case when p.held + e.size > 4096 then e.size else p.held + e.size end
  from p join e on e.run = p.run and e.rn = p.rn + 1)"""


@query(f"{_PACKED} select run, event_id, block from p")
def pack_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.pack_blocks(_block_entries(spark, sf_dir), "run", ["k", "event_id"], 4096).select("run", "event_id", "block")


@query(f"{_PACKED} select run, block, min(k) start_key, max(k) end_key, count(*) entries from p group by run, block")
def block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = layout.pack_blocks(_block_entries(spark, sf_dir), "run", ["k", "event_id"], 4096)
    return layout.block_index(packed, "run", "block", "k").select("run", "block", "start_key", "end_key", "entries")


_LIVE_BLOCKS = f"(select 0::bigint run, ((row_number() over (order by k) - 1) // 50)::bigint block, k from {LIVE})"


@query(
    f"""with b as (select block, min(k) s, max(k) e from {_LIVE_BLOCKS} group by block)
select p.k, (select min(block) from b where b.s <= p.k and p.k <= b.e) block from {PROBES} p"""
)
def block_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of fifty live keys, and the one that would hold each probe."""
    live = layout.ranked(_live(spark, sf_dir).select("k"), F.col("k").asc_nulls_last())
    blocks = live.select(F.lit(0).cast("long").alias("run"), "k", F.floor(F.col("rank") / 50).alias("block"))
    probes = customers(spark, sf_dir).select(F.lit(0).cast("long").alias("run"), "k")
    return layout.block_lookup(probes, layout.block_index(blocks, "run", "block", "k"), "k").select("k", "block")


_PREFIX = f"""(select k, substr(k, shared::bigint + 1) suffix, shared from (
select k, (case when b is null then 0 else coalesce(list_max(list_filter(range(1, least(length(k), length(b)) + 1), lambda i: substr(k, 1, i) = substr(b, 1, i))), 0) end)::int shared
from (select k, lag(k) over (partition by length(k) order by k) b from {PROBES})))"""


def _prefix_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = customers(spark, sf_dir).withColumn("block", F.length("k"))
    return layout.prefix_encoded(keys, ["block"], "k")


@query(f"select k, shared, suffix from {_PREFIX}")
def prefix_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _prefix_coded(spark, sf_dir).select("k", F.col("shared").cast("int").alias("shared"), "suffix")


@query(f"select k, k decoded from {PROBES}")
def prefix_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.prefix_decoded(_prefix_coded(spark, sf_dir), ["block"], "k").select("k", "decoded")


@query(
    f"""with recursive e as (select run, event_id, (9 + 2 * length(k) + length(event_id::varchar))::bigint size, row_number() over (partition by run order by ts, event_id) rn from {E}),
p(run, rn, event_id, batch, held) as (
  select run, rn, event_id, 0::bigint, size from e where rn = 1
  union all
  select e.run, e.rn, e.event_id, case when p.held >= 1000 then p.batch + 1 else p.batch end, case when p.held >= 1000 then e.size else p.held + e.size end
  from p join e on e.run = p.run and e.rn = p.rn + 1)
select run, event_id, batch from p"""
)
def flush_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = events(spark, sf_dir).withColumn("size", entry_size(F.col("k"), F.length(F.col("event_id").cast("string"))))
    return layout.flush_batches(sized, "run", ["ts", "event_id"], 1000).select("run", "event_id", "batch")


@query(f"select k, sum(9 + 2 * length(k) + length(event_id::varchar))::bigint bytes, (sum(9 + 2 * length(k) + length(event_id::varchar)) + 128)::bigint cached_bytes from {E} group by k")
def size_estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    length = F.length(F.col("event_id").cast("string"))
    return events(spark, sf_dir).groupBy("k").agg(F.sum(entry_size(F.col("k"), length)).alias("bytes"), cached_block_size(F.col("k"), length).alias("cached_bytes"))


@query()
def compression_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per block and codec, bytes before and after, and whether all give the block back."""
    sized = table(spark, sf_dir, "events").select(F.floor(F.col("event_id") / 100).alias("block"), "event_id", F.encode("props", "UTF-8").alias("body"))
    blocks = sized.groupBy("block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "body"))), lambda x: F.decode(x["body"], "UTF-8")), "\n").alias("text"))

    @F.pandas_udf("struct<raw:long,gzip:long,deflate:long,snappy:long,zstd:long,same:boolean>")
    def sizes(text: pd.Series) -> pd.DataFrame:
        rows = []
        for data in (t.encode() for t in text):
            packed = [gzip.compress(data, 6, mtime=0), zlib.compress(data, 6, -15), *(pa.Codec(c).compress(data, asbytes=True) for c in ("snappy", "zstd"))]
            back = [gzip.decompress(packed[0]), zlib.decompress(packed[1], -15), *(pa.Codec(c).decompress(p, len(data), asbytes=True) for c, p in zip(("snappy", "zstd"), packed[2:], strict=True))]
            rows.append((len(data), *map(len, packed), all(b == data for b in back)))
        return pd.DataFrame(rows, columns=["raw", "gzip", "deflate", "snappy", "zstd", "same"])

    return blocks.select("block", sizes("text").alias("s")).select("block", "s.*")


@query(f"select k, 'user:' || printf('%08d', c_custkey) wide from {PROBES}")
def key_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(padded("user:", F.col("c_custkey"), 6).alias("k"), padded("user:", F.col("c_custkey"), 8).alias("wide"))


@query("select n_name, row_number() over (order by n_name) place from nation")
def code_unit_order_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order by UTF-16 code units; of plain names it is the common one."""
    n = table(spark, sf_dir, "nation")
    return n.select("n_name", F.row_number().over(Window.orderBy(code_unit_order(F.col("n_name")))).cast("long").alias("place"))


# Bloom filters

_FNV = """list_reduce([xor(2166136261::bigint, {seed}::bigint)] || list_transform(range(1, strlen({k}) + 1), lambda i: ascii(substr({k}, i, 1))::bigint), lambda h, b: (xor(h, b) * 16777619) & 4294967295)"""
_KEYS = f"(select distinct k from {E})"
_BITS = f"(select distinct {_FNV.format(seed='s.s', k='k')} % m bit from {_KEYS}, g, (select unnest(range(0, h)) s from g) s)"
_GEOMETRY = f"g as (select ceil(-n * ln(0.01) / (ln(2) * ln(2)))::bigint m, greatest(1, round(ceil(-n * ln(0.01) / (ln(2) * ln(2))) * ln(2) / n))::bigint h from (select count(*) n from {_KEYS}))"
_MAYBE = f"""with {_GEOMETRY}, b as {_BITS}, p as (select k, {_FNV.format(seed='s.s', k='k')} % m bit from {PROBES}, g, (select unnest(range(0, h)) s from g) s),
j as (select k, bool_and(b.bit is not null) maybe from p left join b on p.bit = b.bit group by k)"""


def _filter(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int, int]:
    keys = events(spark, sf_dir).select(F.col("k").alias("key")).distinct()
    return keys, *bloom.for_keys(keys, 0.01)


@query(f"select k, s.s::int seed, {_FNV.format(seed='s.s', k='k')} hash from {_KEYS}, (select unnest(range(0, 4)) s) s")
def fnv_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = events(spark, sf_dir).select("k").distinct().withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return keys.select("k", "seed", fnv1a(F.col("k"), F.col("seed")).alias("hash"))


@query("select * from (values (1000::bigint, 0.01::double, 9586::bigint, 7::bigint), (10000, 0.01, 95851, 7), (100000, 0.01, 958506, 7), (10000, 0.001, 143776, 10), (10000, 0.1, 47926, 3)) t(n, p, bits, hashes)")
def bloom_parameters(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = [(1_000, 0.01), (10_000, 0.01), (100_000, 0.01), (10_000, 0.001), (10_000, 0.1)]
    return spark.createDataFrame([(n, p, *bloom.parameters(n, p)) for n, p in asked], "n long, p double, bits long, hashes long")


@query(f"{_MAYBE} select k as key, maybe from j")
def bloom_might_contain(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bits, m, h = _filter(spark, sf_dir)
    return bloom.might_contain(customers(spark, sf_dir).withColumnRenamed("k", "key"), bits, m, h)


@query(
    f"""with g as (select 1000::bigint m, 5::bigint h), b as (select distinct run, {_FNV.format(seed='s.s', k='k')} % m bit from (select distinct run, k from {E}), g, (select unnest(range(0, h)) s from g) s),
z as (select run, min(k) low, max(k) high from {E} group by run),
p as (select distinct k, run, {_FNV.format(seed='s.s', k='k')} % m bit from {PROBES}, z, g, (select unnest(range(0, h)) s from g) s where k between low and high)
select p.k as key, p.run from p left join b on p.run = b.run and p.bit = b.bit group by p.k, p.run having bool_and(b.bit is not null)"""
)
def run_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The runs that a lookup of each customer's key has to read, by key range and filter."""
    held = events(spark, sf_dir)
    bits = bloom.build(held.select("run", F.col("k").alias("key")).distinct(), 1000, 5, by=("run",))
    return bloom.runs_to_read(customers(spark, sf_dir).withColumnRenamed("k", "key"), layout.zone_maps(held, "run", "k", "tomb"), bits, 1000, 5)


@query(f"{_MAYBE} select count(*) probes, coalesce(sum(maybe::int), 0)::bigint false_positives, round(avg(maybe::int), 6) rate from j where k not in (select k from {_KEYS})")
def bloom_fpr(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys, bits, m, h = _filter(spark, sf_dir)
    absent = customers(spark, sf_dir).withColumnRenamed("k", "key").join(keys, "key", "left_anti")
    return bloom.false_positive_rate(bloom.might_contain(absent, bits, m, h))


@query(f"with {_GEOMETRY}, b as {_BITS} select 0::bigint run, (select m from g) bits, (select h from g) hashes, count(*) set_bits, ((select m from g) + 7) // 8 + 20 bytes from b")
def bloom_serialised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter as bytes and back: geometry, and the bits that come back set."""
    _, found, m, h = _filter(spark, sf_dir)
    sets = bloom.bitset(found.withColumn("run", F.lit(0).cast("long")), m)

    def round_trip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for run, body in zip(b.column("run").to_pylist(), b.column("bitset").to_pylist(), strict=True):
                data = bloom.serialised(body, m, h, 0.01)
                bits, hashes, _, back = bloom.deserialised(data, m, h)
                rows.append((run, bits, hashes, int.from_bytes(back, "little").bit_count(), len(data)))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["run", "bits", "hashes", "set_bits", "bytes"])

    return sets.mapInArrow(round_trip, "run long, bits long, hashes long, set_bits long, bytes long")


# cache


def _accesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.lit(0).cast("long").alias("cache"), "event_id", cache.cache_key(F.lit("run"), F.col("user_id") * 4096).alias("block"), F.lit(1).cast("long").alias("size"))


_REUSE = """with a as (select event_id, user_id, lag(event_id) over (partition by user_id order by event_id) p from events),
d as (select x.event_id, x.p, count(distinct y.user_id) n from a x left join a y on y.event_id > x.p and y.event_id < x.event_id group by all)"""


@query(f"{_REUSE} select event_id, p is not null and n < 20 hit from d")
def lru_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache of twenty blocks of one size, over all accesses."""
    return cache.lru(_accesses(spark, sf_dir), "cache", ["event_id"], 20).select("event_id", "hit")


@query(f"{_REUSE} select sum((p is not null and n < 20)::int)::bigint hits, sum((not (p is not null and n < 20))::int)::bigint misses, round(avg((p is not null and n < 20)::int), 6) hit_ratio from d")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cache.stats(cache.lru(_accesses(spark, sf_dir), "cache", ["event_id"], 20))


@query(
    """with a as (select event_id, event_id % 4 run, user_id, user_id % 7 * 100 + 200 size, lag(event_id) over (partition by event_id % 4, user_id order by event_id) p from events),
d as (select x.event_id, x.run, x.p, x.size, y.user_id other, any_value(y.size) between_size from a x left join a y on y.run = x.run and y.event_id > x.p and y.event_id < x.event_id group by all)
select run, event_id, p is not null and coalesce(sum(between_size), 0) + size <= 6000 hit from d group by run, event_id, p, size"""
)
def lru_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of different sizes under a budget of bytes, a cache for each run."""
    e = table(spark, sf_dir, "events")
    sized = e.select((F.col("event_id") % 4).alias("run"), "event_id", cache.cache_key(F.lit("run"), F.col("user_id")).alias("block"), (F.col("user_id") % 7 * 100 + 200).cast("long").alias("size"))
    return cache.lru(sized, "run", ["event_id"], 6000).select("run", "event_id", "hit")


# log


@query(f"select run, event_id from (select *, max((v is null or v > 400)::int) over (partition by run order by event_id) bad from {E}) where bad = 0")
def wal_valid_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of each log before the first bad one: here one with a value over 400."""
    return wal.valid_prefix(events(spark, sf_dir), "run", "event_id", F.col("v").isNull() | (F.col("v") > 400)).select("run", "event_id")


@query(f"select k as key, event_id::varchar as value, tomb tombstone, epoch_us(ts) // 1000 ts from {E}")
def wal_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changelog as binary log files, and replayed from them."""
    back = wal.replay(wal.encode_log(changes(spark, sf_dir), 4))
    return back.select("key", F.decode("value", "UTF-8").alias("value"), "tombstone", "ts")


# the table


def _run_order_live(order: str) -> str:
    return f"(select k as key, event_id::varchar as value from (select *, row_number() over (partition by k order by {order}) rn from {E}) where rn = 1 and not tomb)"


def _loaded(spark: SparkSession, sf_dir: str, parts: int = 4) -> Store:
    """A table with the changes in ``parts`` runs, by ranges of event_id."""
    store = Store(spark, work_path(spark, "store"))
    all_ = changes(spark, sf_dir)
    top = all_.agg(F.max("seq").alias("n")).first()["n"] + 1
    for i in range(parts):
        store.add_run(all_.where((F.col("seq") >= top * i // parts) & (F.col("seq") < top * (i + 1) // parts)))
    return store


def _told(view: DataFrame) -> DataFrame:
    return view.select("key", F.decode("value", "UTF-8").alias("value"))


@query(f"select key, value from {_run_order_live('event_id desc')}")
def store_live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_loaded(spark, sf_dir).live())


@query(f"select key, value from {_run_order_live('event_id desc')}")
def compact_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _loaded(spark, sf_dir)
    store.compact()
    store.vacuum()
    return _told(Store.open(spark, store.path).live())


@query(f"select p.k as key, l.key is not null found, l.value from {PROBES} p left join {_run_order_live('event_id desc')} l on p.k = l.key")
def store_multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _loaded(spark, sf_dir)
    got = store.multi_get(customers(spark, sf_dir).withColumnRenamed("k", "key"))
    return got.select("key", "found", F.decode("value", "UTF-8").alias("value"))


@query(f"select key, value from {_run_order_live('event_id desc')} where key between 'user:000010' and 'user:000050'")
def store_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _told(_loaded(spark, sf_dir).range("user:000010", "user:000050"))


@query(f"select k as key, event_id::varchar as value from (select *, row_number() over (partition by k order by event_id desc) rn from {E} where event_id < (select (max(event_id) + 1) * 2 // 4 from events)) where rn = 1 and not tomb")
def reopen_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table as its second version had it, after four runs and a merge."""
    store = _loaded(spark, sf_dir)
    store.compact()
    return _told(Store.open(spark, store.path, version=2).live())


@query(f"select key, value from {_run_order_live('event_id desc')}")
def recover_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log replayed into a run of an empty table."""
    logs = wal.encode_log(changes(spark, sf_dir), 3)
    back = wal.replay(logs).select("key", "value", "tombstone", "ts", F.col("place").alias("seq"))
    store = Store(spark, work_path(spark, "store"))
    store.add_run(back)
    return _told(store.live())


@query(f"select key, value from {_run_order_live('event_id desc')}")
def store_set_flush(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half the changes set and flushed, the other half set and still in the log."""
    store, all_ = Store(spark, work_path(spark, "store"), TableConfig(memtable_threshold=1 << 40)), changes(spark, sf_dir)
    middle = all_.agg(F.max("seq").alias("n")).first()["n"] // 2
    store.set(all_.where(F.col("seq") <= middle))
    store.flush()
    store.set(all_.where(F.col("seq") > middle))
    return _told(store.live())


@query(f"select key, value from {_run_order_live('event_id desc')}")
def recover_log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was set and never flushed, by a process that is gone, read from the log of the reopened table."""
    lost, all_ = Store(spark, work_path(spark, "store"), TableConfig(memtable_threshold=1 << 40)), changes(spark, sf_dir)
    top = all_.agg(F.max("seq").alias("n")).first()["n"] + 1
    for i in range(3):
        lost.set(all_.where((F.col("seq") >= top * i // 3) & (F.col("seq") < top * (i + 1) // 3)))
    return _told(Store.open(spark, lost.path).live())


@query(f"select key, value from {_run_order_live('event_id desc')}")
def retry_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch that is tried again after its run was merged and the table reopened changes nothing."""
    store, all_ = Store(spark, work_path(spark, "store")), changes(spark, sf_dir)
    middle = all_.agg(F.max("seq").alias("n")).first()["n"] // 2
    halves = [all_.where(F.col("seq") <= middle), all_.where(F.col("seq") > middle)]
    for i, half in enumerate(halves):
        store.add_run(half, source="stream", number=i)
    store.compact()
    again = Store.open(spark, store.path)
    again.add_run(halves[0], source="stream", number=0)
    return _told(again.live())


@query("select ('u' || lpad(k::varchar, 6, '0')) as key, max(event_id)::varchar as value from (select event_id, event_id % 1000 k from events) group by k")
def compaction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merges that go on to level 2: with two runs at level 0 and two at level 1 each is due."""
    store = Store(spark, work_path(spark, "store"), TableConfig(level0_trigger=2, compaction_ratio=2.0, max_levels=4))
    e = table(spark, sf_dir, "events")
    rows = e.select(padded("u", F.col("event_id") % 1000, 6).alias("key"), F.encode(F.col("event_id").cast("string"), "UTF-8").alias("value"), F.col("event_id").alias("seq"))
    top = e.agg(F.max("event_id").alias("n")).first()["n"] + 1
    for i in range(4):
        # two ranges of keys by turns, so that level 1 gets two runs that don't overlap before the merge into level 2
        store.add_run(rows.where((F.col("seq") >= top * i // 4) & (F.col("seq") < top * (i + 1) // 4)))
        if i % 2:
            store.compact()
    store.compact(1)
    assert max(r.level for r in store.runs) == 2
    return _told(Store.open(spark, store.path).live())


@query(f"select k as key, l.event_id::varchar as value from (select *, row_number() over (partition by k order by event_id desc) rn from {E}) l where rn = 1 and not tomb and starts_with(k, 'user:00001')")
def prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live entries whose key starts with a prefix."""
    return _told(_loaded(spark, sf_dir).starting("user:00001"))


@query(f"select 1 as level, 1::bigint runs, count(*) filter (not tomb) entries, 0::bigint deletes from (select *, row_number() over (partition by k order by event_id desc) rn from {E}) where rn = 1")
def manifest_after_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run without deletes at level 1: nothing older could hold the deleted keys."""
    store = _loaded(spark, sf_dir)
    store.compact()
    return store.manifest().groupBy("level").agg(F.count("*").alias("runs"), F.sum("entries").alias("entries"), F.sum("deletes").alias("deletes"))


@query(f"select key, value from {_run_order_live('event_id desc')}")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changes as a stream of files, each micro-batch a run: three arrivals, the stream started again for each."""
    path = work_path(spark, "stream")
    source = changes(spark, sf_dir)
    top = source.agg(F.max("seq").alias("n")).first()["n"] + 1
    for i in range(3):
        source.where((F.col("seq") >= top * i // 3) & (F.col("seq") < top * (i + 1) // 3)).write.mode("append").parquet(f"{path}/in")
        store = Store.open(spark, f"{path}/table")
        stream = spark.readStream.schema(source.schema).parquet(f"{path}/in")
        upsert_stream(stream, store, f"{path}/checkpoint").awaitTermination()
    return _told(store.live())


@query("select event_id, user_id from events")
def stream_without_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event delivered twice, kept once; the second half arrives when the watermark has let the state of the first go."""
    path = work_path(spark, "stream")
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"))
    ends = e.agg(F.min("ts").alias("a"), F.max("ts").alias("z")).first()
    middle = ends["a"] + (ends["z"] - ends["a"]) / 2
    for half in (e.where(F.col("ts") <= middle), e.where(F.col("ts") > middle)):
        half.unionByName(half).write.mode("append").parquet(f"{path}/in")
        once = without_repeats(spark.readStream.schema(e.schema).parquet(f"{path}/in"), "ts", "10 minutes", "event_id")
        once.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(e.schema).parquet(f"{path}/out").select("event_id", "user_id")
