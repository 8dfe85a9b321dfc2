"""Nearest neighbours by a navigable small-world graph per shard.

Vectors are dealt to shards by a hash of their id. A shard's graph has layers;
each layer is one flat array of neighbour lists of fixed width, and a vector gets its
lists by walking over those that are there before it, so that building a shard takes little more than
its size times a logarithm. Graphs are kept as a table, one row each. Searches start at the top layer, step to the nearest
neighbour until none is nearer, and on the ground layer keep a list of the best
vectors seen; they run for all queries of a block at once. The lists that the
shards return are merged, and scores are inner products in double precision.

Largest inner product is not a metric: for building and walking, a vector x is
extended by sqrt(M^2 - |x|^2), M the shard's largest norm, and a query by 0.
That makes the nearest by angle those with the largest inner product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

#: Vectors of a shard on average. Every query walks over every shard's graph, hence few large ones: at 256 numbers each
#: some 80 MB with the lists.
SHARD_ROWS = 65_536
NEIGHBOURS = 24  # a vector's own choices on a layer; the ground layer also has as many given back
WIDTH = 100  # candidates that a search keeps on the ground layer
BLOCK = 512  # queries that are searched together
BLOCKS_EACH = 8
ENTRIES = 8
#: Rows of a layer that are compared with each other, rows that come in together later, and what their walks keep.
FIRST, BATCH, BUILD = 1024, 512, 64


def usable(name: str) -> Column:
    """Not null, no null or non-finite component, not all zero."""
    x = F.col(name)
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    return x.isNotNull() & fine & F.exists(x, lambda v: v != 0)


def _levels(ids: np.ndarray) -> np.ndarray:
    """A layer for each id, as by coin tosses with chance 1/16, from a hash of the id."""
    x = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    level = np.zeros(len(ids), np.int64)
    for k in (1, 2, 3, 4):
        level += (x & np.uint64((1 << (4 * k)) - 1)) == 0
    return level


def _chosen(x: np.ndarray, top: np.ndarray, near: np.ndarray, width: int) -> np.ndarray:
    """Of each row's candidates ``top`` (best first, ``near`` their products with it) ``width`` at most, -1 where there are fewer.

    One is taken if no nearer one that was taken is closer to it than the row itself; the rest fill what is left.
    """
    there = np.isfinite(near)
    between = np.einsum("ijd,ikd->ijk", x[top], x[top], optimize=True)
    taken = np.zeros(top.shape, bool)
    for j in range(top.shape[1]):
        taken[:, j] = there[:, j] & ~((between[:, j, :j] > near[:, j, None]) & taken[:, :j]).any(1) & (taken.sum(1) < width)
    order = np.argsort(np.where(there, ~taken, 2), axis=1, kind="stable")[:, :width]
    found = np.where(np.take_along_axis(there, order, 1), np.take_along_axis(top, order, 1), -1)
    return np.pad(found, ((0, 0), (0, width - found.shape[1])), constant_values=-1).astype(np.int32)


def _give_back(x: np.ndarray, graph: np.ndarray, src: np.ndarray, chosen: np.ndarray, width: int) -> None:
    """Put the rows ``src`` into the back lists of those they chose: a list keeps its nearest."""
    a, b = np.repeat(src, chosen.shape[1]), chosen.ravel().astype(np.int64)
    a, b = a[b >= 0], b[b >= 0]
    order = np.lexsort((-np.einsum("ij,ij->i", x[a], x[b]), b))
    a, b = a[order], b[order]
    to, first = np.unique(b, return_index=True)
    at = np.arange(len(b)) - np.repeat(first, np.diff(np.append(first, len(b))))
    new = np.full((len(to), width), -1, np.int32)
    keep = at < width
    new[np.searchsorted(to, b[keep]), at[keep]] = a[keep]
    for i in range(0, len(to), 512):
        t = to[i : i + 512]
        both = np.concatenate([graph[t, width:], new[i : i + 512]], 1)
        s = np.where(both >= 0, np.einsum("ijd,id->ij", x[both], x[t]), -np.inf)
        graph[t, width:] = np.take_along_axis(both, np.argsort(-s, axis=1, kind="stable")[:, :width], 1)


def _products(x: np.ndarray, rows: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of each query with its ``rows``; -inf where a row is -1. So many at once that the copies stay within some 64 MB."""
    out = np.empty(rows.shape, np.float32)
    step = max(1, (1 << 24) // (rows.shape[1] * x.shape[1] + 1))
    for i in range(0, len(rows), step):
        out[i : i + step] = np.einsum("ijd,id->ij", x[rows[i : i + step]], q[i : i + step])
    out[rows < 0] = -np.inf
    return out


def _beam(x: np.ndarray, q: np.ndarray, graph: np.ndarray, entry: np.ndarray, width: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``width`` best rows that a walk over ``graph`` from its ``entry`` rows sees, best first, and their products; -1 where there are fewer.

    Each step looks at the neighbours of the ``at_once`` best that it hasn't looked at, until all of the best are; what is kept is
    bounded by the number of queries and the width, not by the graph.
    """
    m = len(q)
    pool, score, open_ = np.full((m, width), -1, np.int64), np.full((m, width), -np.inf, np.float32), np.zeros((m, width), bool)

    def add(who: np.ndarray, new: np.ndarray) -> None:
        new = np.sort(new, 1)
        new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
        s = _products(x, new, q[who])
        s[s < score[who, -1:]] = -np.inf
        r, c = np.nonzero(np.isfinite(s))  # who may come in: not those that are in
        for i in range(0, len(r), 1 << 16):
            y, w = r[i : i + (1 << 16)], c[i : i + (1 << 16)]
            inside = (pool[who[y]] == new[y, w][:, None]).any(1)
            s[y[inside], w[inside]] = -np.inf
        ids, sc, op = (np.concatenate(v, 1) for v in ((pool[who], new), (score[who], s), (open_[who], np.isfinite(s))))
        top = np.argsort(-sc, axis=1, kind="stable")[:, :width]
        sc = np.take_along_axis(sc, top, 1)
        pool[who], score[who], open_[who] = np.where(np.isfinite(sc), np.take_along_axis(ids, top, 1), -1), sc, np.take_along_axis(op, top, 1)

    add(np.arange(m), entry.copy())
    alive = np.arange(m)
    while True:
        alive = alive[open_[alive].any(1)]
        if not len(alive):
            return pool, score
        pick = np.argsort(~open_[alive], axis=1, kind="stable")[:, :at_once]
        valid = np.take_along_axis(open_[alive], pick, 1)
        chosen = np.where(valid, np.take_along_axis(pool[alive], pick, 1), 0)
        open_[alive[:, None], pick] = False
        add(alive, np.where(valid[:, :, None], graph[chosen], -1).reshape(len(alive), -1).astype(np.int64))


def _entries(x: np.ndarray, q: np.ndarray, layers: list[np.ndarray]) -> np.ndarray:
    """Where a walk over the next layer starts: what the ``layers``, top first, lead to, and some rows of the highest for parts that one way in doesn't reach."""
    at = np.zeros(len(q), np.int64)
    for graph in layers:
        at = _step(x, q, graph, at)
    return np.concatenate([at[:, None], np.broadcast_to(np.arange(min(ENTRIES, len(x))), (len(q), min(ENTRIES, len(x))))], 1)


def _layer(x: np.ndarray, width: int, above: list[np.ndarray]) -> np.ndarray:
    """Neighbour lists of a layer, -1 where there are fewer: a row's own choices, and as many back lists of those that chose it.

    The first rows are compared with each other. Then rows come in in batches: each looks for its nearest by a walk that
    the layers ``above`` (top first) start, and among its batch; it never meets all others.
    """
    n = len(x)
    graph = np.full((n, 2 * width), -1, np.int32)
    start = 0
    while start < n:
        size = min(n - start, FIRST if not start else min(start, BATCH))
        rows = np.arange(start, start + size)
        own = x[rows] @ x[rows].T
        np.fill_diagonal(own, -np.inf)
        look = min(2 * width, size - 1)
        top = np.argpartition(-own, max(look - 1, 0), axis=1)[:, :look] if look else np.zeros((size, 0), np.int64)
        near, top = np.take_along_axis(own, top, 1), top + start
        if start:
            found, score = _beam(x, x[rows], graph, _entries(x, x[rows], above), BUILD)
            top, near = np.concatenate([top, np.maximum(found, 0)], 1), np.concatenate([near, score], 1)
        order = np.argsort(-near, axis=1, kind="stable")[:, : 2 * width]
        top, near = np.take_along_axis(top, order, 1), np.take_along_axis(near, order, 1)
        for i in range(0, size, 256):
            graph[rows[i : i + 256], :width] = _chosen(x, top[i : i + 256], near[i : i + 256], width)
        _give_back(x, graph, rows, graph[rows, :width], width)
        start += size
    return graph


def build(ids: np.ndarray, vectors: np.ndarray, width: int = NEIGHBOURS) -> dict:
    """The graph of a shard: flat arrays, rows in order of layer, highest first."""
    level = _levels(ids)
    order = np.lexsort((ids, -level))
    ids, vectors, level = ids[order], vectors[order].astype(np.float32), level[order]
    norms = (vectors.astype(np.float64) ** 2).sum(1)
    scale = max(float(np.sqrt(norms.max())), 1e-30)
    extra = np.sqrt(np.maximum(0, scale**2 - norms))
    x = (np.concatenate([vectors, extra[:, None]], 1) / scale).astype(np.float32)
    sizes = [int((level >= k).sum()) for k in range(int(level.max()) + 1)]
    layers: list[np.ndarray] = []  # top first
    for n in sizes[::-1]:
        layers.append(_layer(x[:n], width, layers))
    return {"ids": ids, "vectors": vectors, "sizes": sizes, "layers": layers[::-1]}


def _step(x: np.ndarray, q: np.ndarray, graph: np.ndarray, start: np.ndarray) -> np.ndarray:
    """From start, move each query to its best neighbour until that doesn't help."""
    at, best = start.copy(), np.einsum("ij,ij->i", q, x[start])
    moving = np.arange(len(q))
    while len(moving):
        near = graph[at[moving]]
        s = np.where(near >= 0, np.einsum("ijd,id->ij", x[near], q[moving]), -np.inf)
        j = s.argmax(1)
        value = s[np.arange(len(j)), j]
        better = value > best[moving]
        moved = moving[better]
        at[moved], best[moved] = near[better, j[better]], value[better]
        moving = moved
    return at


def search(index: dict, queries: np.ndarray, width: int = WIDTH) -> np.ndarray:
    """For each query the rows of the ``width`` best found, best first, -1 where there are fewer.

    An extension of the query is 0, so that its product with an extended vector
    is that with the vector itself.
    """
    x, q = index["vectors"], queries.astype(np.float32)
    return _beam(x, q, index["layers"][0], _entries(x, q, index["layers"][:0:-1]), width)[0]


def _index_rows(batch: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    t = pa.Table.from_batches(batch)
    ids = t.column("vec_id").to_numpy()
    v = t.column("v").combine_chunks()
    return ids, v.flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)


def build_shards(vectors: DataFrame, shards: int) -> DataFrame:
    """One row per shard: sizes, ids, vectors, and all layers in one flat array.

    ``vectors`` has vec_id and v. A shard holds SHARD_ROWS rows on average.
    """

    def make(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        ids, x = _index_rows(table.to_batches())
        g = build(ids, x)
        flat = np.concatenate([layer.ravel() for layer in g["layers"]])
        return pa.table({
            "shard": pa.array([key[0].as_py()], pa.int64()), "dim": pa.array([x.shape[1]], pa.int64()),
            "sizes": pa.array([g["sizes"]], pa.list_(pa.int64())), "ids": pa.array([g["ids"].astype("<i8").tobytes()], pa.binary()),
            "vectors": pa.array([g["vectors"].astype("<f4").tobytes()], pa.binary()), "graph": pa.array([flat.astype("<i4").tobytes()], pa.binary()),
        })

    dealt = vectors.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).alias("shard"), "vec_id", "v", F.size("v").alias("d"))
    return dealt.groupBy("shard", "d").applyInArrow(make, "shard long, dim long, sizes array<long>, ids binary, vectors binary, graph binary")


def nearest(rows: DataFrame, every: int = 20, k: int = 20, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest of each query row.

    ``rows`` has vec_id and embedding; queries are rows whose vec_id is divisible
    by ``every``, candidates all other rows. Vectors that are null, zero, or hold
    a null or non-finite component take no part, nor do rows without vec_id; a
    query meets only vectors of its own length. Fewer candidates than ``k`` are all
    returned, ties go to the smaller vec_id, a vec_id that comes more than
    once takes part with its first vector by value, an empty table gives no rows.
    """
    good = rows.where(F.col("vec_id").isNotNull() & usable("embedding")).groupBy("vec_id").agg(F.min(F.transform("embedding", lambda v: v.cast("double"))).alias("v"))
    good, _ = written(good, "vectors")
    count = good.count()
    shards = max(1, -(-count // shard_rows))
    graphs, _ = written(build_shards(good, shards), "graphs")
    asked = good.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v", F.size("v").cast("long").alias("dim"))
    blocks = max(1, -(-asked.count() // BLOCK))
    # a task searches one shard for at most BLOCKS_EACH blocks of queries: both sides carry shard and slice
    slices = -(-blocks // BLOCKS_EACH)
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks))
    packed = asked.groupBy("dim", block.alias("block")).agg(F.collect_list(F.struct("vec_id", "v")).alias("queries"))
    packed = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)).cast("array<long>"))).withColumn("slice", F.col("block") % slices)
    spread = graphs.withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1)).cast("array<long>")))
    pairs = spread.join(packed, ["shard", "slice", "dim"]).select("dim", "sizes", "ids", "vectors", "graph", "queries")

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                row = {c: b.column(c)[i] for c in b.schema.names}
                dim, sizes = row["dim"].as_py(), row["sizes"].as_py()
                ids = np.frombuffer(row["ids"].as_py(), "<i8")
                x = np.frombuffer(row["vectors"].as_py(), "<f4").reshape(-1, dim)
                flat, layers, start = np.frombuffer(row["graph"].as_py(), "<i4").reshape(-1, 2 * NEIGHBOURS), [], 0
                for n in sizes:
                    layers.append(flat[start : start + n])
                    start += n
                values = row["queries"].values
                qid = values.field("vec_id").to_numpy()
                q = values.field("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                width = max(WIDTH, k + 1)
                got = search({"vectors": x, "layers": layers}, q, width)
                own = ids[np.maximum(got, 0)] == qid[:, None]
                got = np.where(own, -1, got)
                order = np.argsort(got < 0, axis=1, kind="stable")[:, : k + 4]  # some more than k: rounding is settled on doubles
                got = np.take_along_axis(got, order, 1)
                some = got >= 0
                r, c = np.nonzero(some)
                at_ = got[r, c]
                yield pa.RecordBatch.from_arrays([pa.array(qid[r]), pa.array(ids[at_])], names=["query_id", "vec_id"])

    found = pairs.mapInArrow(find, "query_id long, vec_id long")
    left = good.select(F.col("vec_id").alias("query_id"), F.col("v").alias("a"))
    scored = found.join(good.select("vec_id", F.col("v").alias("b")), "vec_id").join(left, "query_id")
    score = F.aggregate(F.zip_with("a", "b", lambda p, r: p * r), F.lit(0.0), lambda s, v: s + v)
    ranked = scored.select("query_id", "vec_id", score.alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id")))
    return ranked.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
