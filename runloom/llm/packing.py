"""Best-fit packing of tokenised documents into sequences of a fixed length.

Only lengths matter for a plan, and there are at most ``capacity`` different
ones; so the driver plans over counts per length, whatever the number of documents, and
plans alike sequences together. First the Martello-Toth reduction fixes small
sets that dominate all others that hold the same document: a document alone
where nothing fits beside it, a pair that fills a sequence, a pair with the
longest that fits where no other set can hold more. What is left is packed best fit,
longest first. Documents then find their places by their rank among
those of the same length.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, written
from .word_bpe import word_ids

CAPACITY = 4096
#: Appended to each document's ids.
END_ID = 1

#: How often a sequence of a kind occurs, and its (length, how many) in order.
Kind = tuple[int, tuple[tuple[int, int], ...]]


def _fits_two(sizes: np.ndarray, more: int, room: int) -> bool:
    """Whether two lengths of ``sizes`` (sorted) add up to over ``more`` and at most ``room``."""
    at = np.searchsorted(sizes, room - sizes, side="right") - 1
    good = at >= 0
    return bool(good.any() and (sizes[good] + sizes[at[good]]).max() > more)


def reduce_dominated(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Fix dominating sets; takes their documents out of ``counts``.

    For a document of length w with room r = capacity - w, and k the longest other length that fits:
    nothing fits: w alone; k = r: the pair is full; any two others exceed r, or
    any three do and no two add up to over k: the pair (w, k), as whatever else stood
    beside w can stand where k stood.
    """
    fixed: list[Kind] = []
    sizes = sorted(s for s, n in counts.items() if n)

    def take(size: int, n: int) -> None:
        counts[size] -= n
        if not counts[size]:
            del counts[size]
            sizes.pop(bisect.bisect_left(sizes, size))

    for w in sizes[::-1]:
        while counts.get(w):
            room = capacity - w
            own = counts[w]
            low = []  # the three shortest others
            for s in sizes[:3]:
                low += [s] * min(3, counts[s] - (s == w))
            low = low[:3]
            if not low or low[0] > room:
                fixed.append((own, ((w, 1),)))
                take(w, own)
                break
            at = bisect.bisect_right(sizes, room) - 1
            k = sizes[at]
            if k == w and own == 1:
                k = sizes[at - 1] if at else 0
            alone = len(low) < 2 or low[0] + low[1] > room
            if not (k and (k == room or alone or (len(low) < 3 or sum(low) > room) and not _fits_two(np.array(sizes), k, room))):
                break
            if k == w:
                fixed.append((own // 2, ((w, 2),)))
                take(w, own // 2 * 2)
            else:
                n = min(own, counts[k])
                fixed.append((n, ((w, 1), (k, 1))))
                take(w, n)
                take(k, n)
    return fixed


def best_fit(counts: dict[int, int], capacity: int) -> list[Kind]:
    """Best fit, longest first, over counts: alike sequences are filled together."""
    rooms: list[int] = []
    open_: dict[int, list[Kind]] = {}

    def put(room: int, kind: Kind) -> None:
        if kind[0]:
            if room not in open_:
                bisect.insort(rooms, room)
                open_[room] = []
            open_[room].append(kind)

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            at = bisect.bisect_left(rooms, size)
            if at < len(rooms):
                room = rooms[at]
                many, held = open_[room].pop()
                if not open_[room]:
                    del open_[room], rooms[at]
            else:
                room, many, held = capacity, left, ()
            each = min(room // size, left)
            n = min(many, left // each)
            put(room - each * size, (n, (*held, (size, each))))
            left -= n * each
            if held:
                put(room, (many - n, held))
    return [kind for kinds in open_.values() for kind in kinds]


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[Kind]:
    left = {s: n for s, n in counts.items() if n}
    return reduce_dominated(left, capacity) + best_fit(left, capacity)


def places(kinds: list[Kind]) -> dict[int, tuple[np.ndarray, ...]]:
    """By length: from which rank on a kind of sequence is filled, its first number, how many each, and where."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    filled: dict[int, int] = {}
    first = 0
    for many, held in kinds:
        at = 0
        for size, each in held:
            found.setdefault(size, []).append((filled.get(size, 0), first, each, at))
            filled[size] = filled.get(size, 0) + many * each
            at += size * each
        first += many
    return {size: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for size, rows in found.items()}


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Tokenised documents, those over ``capacity`` cut: doc_id, piece, start, length, ids_crc32 (and ids)."""
    kind = dict(docs.dtypes)["doc_id"]
    closing = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = word_ids(tokenizer_path).ids
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                c = b.slice(i, 1024)
                who, rows, ids = [], [], []
                for j, t in enumerate(c.column("text")):
                    data = encode(t.as_py()) + closing
                    for piece, at in enumerate(range(0, len(data), 4 * capacity)):
                        part = data[at : at + 4 * capacity]
                        who.append(j)
                        rows.append((piece, at // 4, len(part) // 4, zlib.crc32(part)))
                        if keep_ids:
                            ids.append(np.frombuffer(part, "<u4").astype(np.int32))
                cols = zip(*rows, strict=True)
                arrays = [c.column("doc_id").take(pa.array(who, pa.int64())), *(pa.array(x, k) for x, k in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    arrays.append(pa.array(ids, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(cut, schema)


def pack_pieces(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``cut`` (doc_id, piece, length, ids_crc32, ...; a written table) with sequence_id and offset.

    A piece's rank among those of its length is its rank in a bucket, dealt by
    hash, plus the sizes of the buckets before: so that no task gets all the pieces
    of a common length.
    """
    spark = cut.sparkSession
    many = partitions(spark, 16)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(many)).cast("int")
    dealt = cut.withColumn("bucket", bucket)
    # the window below deals pieces by length and bucket already, so that this join moves only the sums
    sums = dealt.groupBy("length", "bucket").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select("length", "bucket", before.alias("before"))
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    where = spark.sparkContext.broadcast(places(plan(counts, capacity)))
    rank = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ranked = dealt.withColumn("rank", rank).join(starts, ["length", "bucket"]).withColumn("rank", F.col("rank") + F.col("before"))

    # a function of two columns: the ids stay in the JVM, for batches of rows in order of length are all long ones
    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def place(length: pa.Array, rank: pa.Array) -> pa.Array:
        size, rank = length.to_numpy(), rank.to_numpy()
        sequence, offset = np.empty(len(size), np.int64), np.empty(len(size), np.int64)
        order = np.argsort(size, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
            if len(rows):
                s = int(size[rows[0]])
                start, first, each, at = where.value[s]
                i = np.searchsorted(start, rank[rows], side="right") - 1
                k = rank[rows] - start[i]
                sequence[rows] = first[i] + k // each[i]
                offset[rows] = at[i] + k % each[i] * s
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    placed = ranked.select(*cut.columns, place("length", "rank").alias("place"))
    return placed.select(*cut.columns, "place.sequence_id", "place.offset")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places in sequences of ``capacity`` tokens.

    A null or empty text is the end id alone. Each row is packed, repeated ones
    too; an empty table gives no rows; other columns aren't read. Sequence
    numbers run from 0; offsets leave no gap.
    """
    cut, _ = written(pieces(docs, tokenizer_path, capacity, end_id, keep_ids), "pieces")
    return pack_pieces(cut, capacity)
