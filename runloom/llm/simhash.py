"""SimHash fingerprints linked by BK-trees.

Different fingerprints within ``radius`` bits differ in at most ``radius`` of
radius + agree blocks of bits, so they are alike in some ``agree`` blocks. For
each choice of that many blocks, fingerprints alike in them form a shard; a pair is
sure to meet in one. Each shard has a BK-tree: a node's children are keyed
by their Hamming distance to it, and a search follows only edges within the radius
of its own distance. All trees of a batch are built, and all searches run, level
by level at once. Trees travel to their searches by the shuffle, not by a
broadcast, for they grow with the corpus.

Groups of many near copies are contracted before the trees see them: a sweep over
the fingerprints in order links neighbours, and linked ones share a label. Trees
link labels only, a shard under one label is left out, and in a large shard only those
ask that aren't of its commonest label; a pair within one label needs no link. So
a group gives about one link for each of its members, however many pairs it has.

Within ten bits, as whole documents are compared, a tree prunes next to nothing and many blocks
have to agree, in hundreds of choices. There fingerprints are dealt by the first one or two
agreeing blocks only, and a task goes through the choices of the others itself, in memory.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, written
from .components import contracted

SHINGLE, RADIUS, SEED = 4, 4, 42
#: Members of a shard from which it is cut: so many ask in a slice, of trees of at most TREE times as many.
SLICE, TREE = 4_096, 64
#: Rows that a task works on together, unless a shard has more.
TOGETHER = 65_536
#: Pairs that a search looks at together.
AT_ONCE = 2_000_000
#: Following fingerprints that the sweep compares each one with.
SWEEP = 8
#: Fingerprints of a shard that a task goes through by choices of blocks, on average; low bits that number the blocks it was dealt by.
DEALT, CHOICE = 1 << 19, 10
#: Places up to which fingerprints in order are compared by shifts.
SHIFTS = 64
#: Byte v's bits, each in a byte of its own.
_SPREAD = np.array([sum(((v >> j) & 1) << (8 * j) for j in range(8)) for v in range(256)], np.uint64)


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the shingles in order, repeats included: A-Z lower-cased words, joined by spaces; a shorter text is one shingle, one without words none."""
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    n = len(words) - shingle + 1
    one = xxhash.xxh64_intdigest
    if n <= 1:
        return np.array([one(joined, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    return np.fromiter([one(joined[a:b], SEED) for a, b in zip(starts, ends[shingle - 1 :].tolist(), strict=True)], np.uint64, n)


def majority(h: np.ndarray) -> int:
    """Bit i is 1 if it is 1 in over half of the hashes; of none: 0."""
    if not len(h):
        return 0
    lanes = _SPREAD[h.view(np.uint8).reshape(-1, 8)]  # eight counters of a byte each
    sums = np.add.reduceat(lanes, np.arange(0, len(h), 255), axis=0).view(np.uint8).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * sums > len(h), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of each row of ``docs`` (doc_id, text)."""

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = np.fromiter((fingerprint(t.as_py(), shingle) for t in b.column("text").cast(pa.binary())), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(made.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(convert, f"doc_id {dict(docs.dtypes)['doc_id']}, fp long")


def bit_blocks(count: int) -> list[tuple[int, int]]:
    """(first bit, width) of ``count`` blocks of the 64 bits."""
    edges = [64 * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def agreeing(different: int, radius: int) -> int:
    """How many blocks shards agree in: the number with the least work at this many fingerprints."""

    def work(agree: int) -> float:
        n = radius + agree
        return comb(n, agree) * (60 + 0.5 * different / 2 ** (64 * agree // n))

    return min((1, 2, 3, 4), key=work)


class Forest:
    """BK-trees over fingerprints ``fp``, sorted by tree; ``first`` are the trees' first places, their roots."""

    def __init__(self, fp: np.ndarray, first: np.ndarray):
        self.fp = fp
        at = np.repeat(first, np.diff(np.append(first, len(fp))))
        active = np.flatnonzero(at != np.arange(len(fp)))
        keys, children = [], []
        while len(active):
            d = np.bitwise_count(fp[active] ^ fp[at[active]]).astype(np.int64)
            key = at[active] * 65 + d
            order = np.argsort(key, kind="stable")
            key, active = key[order], active[order]
            new = np.flatnonzero(np.diff(key, prepend=-1))  # the first at each distance of each node becomes the child there
            keys.append(key[new])
            children.append(active[new])
            below = np.repeat(active[new], np.diff(np.append(new, len(key))))
            at[active] = below
            active = active[below != active]
        keys_, self.children = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (keys, children))
        order = np.argsort(keys_, kind="stable")
        self.keys, self.children = keys_[order], self.children[order]

    def within(self, fp: np.ndarray, root: np.ndarray, radius: int, found: Callable[[np.ndarray, np.ndarray], np.ndarray], settles: np.ndarray) -> None:
        """Tell ``found`` of all places at most ``radius`` bits from fingerprints ``fp``, each searched in the tree of its ``root``.

        found(number, place) returns which of these pairs count. A search with ``settles`` ends if its root counts:
        where all members of a tree search it, those near the root are linked by it.
        """
        q, node, top = np.arange(len(fp)), root, True
        while len(q):
            d = np.bitwise_count(fp[q] ^ self.fp[node]).astype(np.int64)
            hit = np.flatnonzero(d <= radius)
            counts = found(q[hit], node[hit])
            if top:
                goes_on = np.ones(len(q), bool)
                goes_on[hit[counts]] = False
                goes_on |= ~settles
                q, node, d, top = q[goes_on], node[goes_on], d[goes_on], False
            low = np.searchsorted(self.keys, node * 65 + np.maximum(0, d - radius))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(64, d + radius), side="right")
            n = high - low
            some = n > 0
            n, low, q = n[some], low[some], q[some]
            if not len(n):
                return
            ends = np.cumsum(n)
            q, node = np.repeat(q, n), self.children[np.arange(ends[-1]) + np.repeat(low - (ends - n), n)]


def joined_labels(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each a place in the array, after the labels at ``a`` and ``b`` are made one: the smaller."""
    while True:
        la, lb = label[a], label[b]
        different = la != lb
        if not different.any():
            return label
        a, b, la, lb = a[different], b[different], la[different], lb[different]
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label = up


class Labels:
    """Which of a task's labels are one: ``label`` by row, and sketches of rows, if pairs are to be alike in them too."""

    def __init__(self, label: np.ndarray, sketch: np.ndarray | None = None):
        self.names, self.of = np.unique(label, return_inverse=True)
        self.up = np.arange(len(self.names))
        self.sketch = sketch

    def now(self, rows: np.ndarray) -> np.ndarray:
        return self.up[self.of[rows]]

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Make the labels of rows ``a`` and ``b`` one, pair by pair; which pairs have one label now."""
        for i in range(0, len(a), AT_ONCE):
            x, y = a[i : i + AT_ONCE], b[i : i + AT_ONCE]
            apart = self.now(x) != self.now(y)
            x, y = x[apart], y[apart]
            if self.sketch is not None:
                alike = np.bitwise_count(self.sketch[x] ^ self.sketch[y]).sum(1) <= UNLIKE
                x, y = x[alike], y[alike]
            self.up = joined_labels(self.up, self.of[x], self.of[y])
        return self.now(a) == self.now(b)

    def links(self) -> pa.RecordBatch:
        told = np.flatnonzero(self.up != np.arange(len(self.up)))
        return pa.RecordBatch.from_arrays([pa.array(self.names[told]), pa.array(self.names[self.up[told]])], names=["a", "b"])


#: Sketch columns, where nodes have them.
SKETCH = ("sketch0", "sketch1")


def _sketches(nodes: DataFrame) -> list[str]:
    return [c for c in SKETCH if c in nodes.columns]


def _sketch_of(b: pa.RecordBatch) -> np.ndarray | None:
    return np.stack([b.column(c).to_numpy() for c in SKETCH], 1).view(np.uint64) if SKETCH[0] in b.schema.names else None


def swept(nodes: DataFrame, radius: int) -> DataFrame:
    """Links of labels (a, b) of some of ``nodes`` (fp, label, maybe sketches) within ``radius`` bits: of neighbours in the order of fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp, labels = b.column("fp").to_numpy().view(np.uint64), Labels(b.column("label").to_numpy(), _sketch_of(b))
            for k in range(1, min(SWEEP, len(fp) - 1) + 1):
                near = np.flatnonzero(np.bitwise_count(fp[k:] ^ fp[:-k]) <= radius)
                labels.join(near, near + k)
            yield labels.links()

    placed = nodes.select("fp", "label", *_sketches(nodes)).repartitionByRange(partitions(nodes.sparkSession), "fp").sortWithinPartitions("fp")
    return placed.mapInArrow(run, "a long, b long")


def _by_trees(radius: int):
    def connect(shard: np.ndarray, fp: np.ndarray, role: np.ndarray, labels: Labels, key: np.ndarray) -> None:
        held = np.flatnonzero(role != ASKS)
        first = np.flatnonzero(np.append(True, shard[held][1:] != shard[held][:-1]))
        sizes = np.diff(np.append(first, len(held)))
        # the member nearest to what most have in common becomes the root
        bits = np.unpackbits(fp[held].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        common = np.packbits(2 * np.add.reduceat(bits, first, axis=0, dtype=np.int64) > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
        held = held[np.lexsort((np.bitwise_count(fp[held] ^ np.repeat(common, sizes)), shard[held]))]
        forest = Forest(fp[held], first)
        asks = np.flatnonzero(role != HELD)
        tree = np.minimum(np.searchsorted(shard[held][first], shard[asks]), len(first) - 1)
        there = shard[held][first][tree] == shard[asks]
        asks, tree = asks[there], tree[there]
        work = np.cumsum(sizes[tree])
        start = 0
        while start < len(asks):
            stop = max(start + 1, int(np.searchsorted(work, (work[start - 1] if start else 0) + AT_ONCE)))
            q = asks[start:stop]
            forest.within(fp[q], first[tree[start:stop]], radius, lambda i, place: labels.join(q[i], held[place]), role[q] == BOTH)  # noqa: B023
            start = stop

    return connect


def choices(fingerprints_: int, radius: int) -> tuple[int, int]:
    """How many blocks agree, and by how many of them fingerprints are dealt, at this many fingerprints: with the least work, and shards of at most DEALT on average."""

    def work(agree: int) -> float:
        n = radius + agree
        return comb(n, agree) * (40 + 2.5 * fingerprints_ / 2 ** (64 * agree / n))  # nanoseconds: to sort by one choice, to compare with half a bucket

    dealt = next((c for c in (1, 2) if fingerprints_ <= DEALT << (64 * c // (radius + c + 2))), 3)
    return min(range(dealt, dealt + 4), key=work), dealt


def first_keys(agree: int, dealt: int, radius: int) -> list[Column]:
    """A key for each choice of the first ``dealt`` of ``agree`` blocks of fp; its lowest bits are the choice's number."""
    blocks, keys = bit_blocks(radius + agree), []
    for i, chosen in enumerate(combinations(range(radius + dealt), dealt)):
        key = F.lit(0).cast("long")
        for first, width in (blocks[c] for c in chosen):
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1)))
        keys.append(F.shiftleft(key, CHOICE).bitwiseOR(F.lit(i)))
    return keys


def _by_choices(agree: int, dealt: int, radius: int):
    """Compare, in a shard of first_keys, what is alike in the other blocks of some choice: so all pairs within ``radius`` are."""
    blocks = bit_blocks(radius + agree)
    firsts = list(combinations(range(radius + dealt), dealt))

    def in_shard(rows: np.ndarray, fp: np.ndarray, last: int, labels: Labels) -> None:
        moved = len(rows)
        for chosen in combinations(range(last + 1, radius + agree), agree - dealt):
            if moved * 64 >= len(rows):  # in the order of labels, pairs within one are passed over
                now = labels.now(rows)
                if now.min() == now.max():
                    return
                by_label = np.argsort(now, kind="stable")
                rows, label, moved = rows[by_label], now[by_label], 0
                own = fp[rows]
                parts = {b: (own >> np.uint64(blocks[b][0]) & np.uint64((1 << blocks[b][1]) - 1)).astype(np.uint16) for b in range(last + 1, radius + agree)}
            key = np.zeros(len(rows), np.uint16)
            for b in chosen:
                key = (key << np.uint16(blocks[b][1])) ^ parts[b]  # bits beyond 16 go: that only makes buckets larger
            order = np.argsort(key, kind="stable")
            a, b = _near_in_buckets(own[order], key[order], label[order], radius)
            a, b = rows[order[a]], rows[order[b]]
            apart = labels.now(a) != labels.now(b)
            moved += int(labels.join(a[apart], b[apart]).sum())

    def connect(shard: np.ndarray, fp: np.ndarray, role: np.ndarray, labels: Labels, key: np.ndarray) -> None:
        edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])).tolist()
        for start, stop in zip(edges, [*edges[1:], len(shard)], strict=True):
            in_shard(np.arange(start, stop), fp, firsts[int(key[start]) & ((1 << CHOICE) - 1)][-1], labels)

    return connect


def _near_in_buckets(fp: np.ndarray, key: np.ndarray, label: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (a, b) of pairs within ``radius``: all that share a key and not a label, maybe others. Sorted by key and label."""
    here = np.arange(len(fp))
    new_key = key[1:] != key[:-1]

    def ends(new: np.ndarray) -> np.ndarray:
        edges = np.append(np.flatnonzero(new) + 1, len(fp))
        return np.repeat(edges, np.diff(edges, prepend=0))

    bucket, run = ends(new_key), ends(new_key | (label[1:] != label[:-1]))
    # what most have to compare with is compared by shifts of all, which gather nothing
    shifts = min(SHIFTS, int(np.bincount(np.minimum(bucket - here - 1, SHIFTS + 1)).cumsum().searchsorted(0.7 * len(fp))))
    found = []
    for k in range(1, shifts + 1):
        at = np.flatnonzero(np.bitwise_count(fp[k:] ^ fp[:-k]) <= radius)
        found.append((at, at + k))
    first = np.maximum(run, here + shifts + 1)
    some = np.flatnonzero(first < bucket)
    n = (bucket - first)[some]
    total = np.cumsum(n)
    start = 0
    while start < len(some):
        stop = max(start + 1, int(np.searchsorted(total, (total[start - 1] if start else 0) + AT_ONCE)))
        m = n[start:stop]
        a = np.repeat(some[start:stop], m)
        b = np.arange(len(a)) + np.repeat(first[some[start:stop]] - (np.cumsum(m) - m), m)
        near = np.bitwise_count(fp[a] ^ fp[b]) <= radius
        found.append((a[near], b[near]))
        start = stop
    if not found:
        return here[:0], here[:0]
    return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])


def _by_pivots(shard: np.ndarray, fp: np.ndarray, role: np.ndarray, labels: Labels, key: np.ndarray) -> None:
    """Compare, shard by shard, one that asks with all that are there, rare labels first, until a shard has one label or nobody asks any more."""
    place, n = np.unique(np.stack([shard, labels.of], 1), axis=0, return_inverse=True, return_counts=True)[1:]
    rows = np.lexsort((n[place.ravel()], role == HELD, shard))
    while len(rows):
        first = np.flatnonzero(np.append(True, shard[rows][1:] != shard[rows][:-1]))
        sizes = np.diff(np.append(first, len(rows)))
        now = labels.now(rows)
        goes_on = (np.minimum.reduceat(now, first) != np.maximum.reduceat(now, first)) & (role[rows[first]] != HELD)
        first, keep, sizes = first[goes_on], np.repeat(goes_on, sizes), sizes[goes_on]
        pivot, others = np.repeat(rows[first], sizes), rows[keep]
        labels.join(pivot, others)
        rows = others[others != pivot]


#: What a row does in its cell: stands in the tree, asks, or both.
HELD, ASKS, BOTH = 0, 1, 2


def block_links(nodes: DataFrame, keys: list[Column] | Column, connect, slice_rows: int = SLICE, tree: int = TREE) -> DataFrame:
    """Links (a, b) of labels of ``nodes`` (fp, label, maybe sketches) that ``connect`` finds among nodes that share one of ``keys``.

    Nodes under one key form a shard. A shard of over ``slice_rows`` is left out if it has
    one label; else it is cut into cells of slices of those that ask, all that aren't of its commonest label,
    and of those that are asked, ``tree`` times as many. Of the links within a batch of shards, only a spanning star of each connected
    part is returned: less than there are labels, however many pairs there are.
    """
    spark = nodes.sparkSession
    extra = _sketches(nodes)
    array = F.array(*keys) if isinstance(keys, list) else keys
    dealt = nodes.select("fp", "label", *extra, F.explode(array).alias("shard"))
    large, _ = written(dealt.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > slice_rows), "large-shards")
    both = F.array(F.struct(F.lit(0).alias("cell"), F.lit(BOTH).alias("role")))
    if large.limit(1).count():
        of = dealt.join(large, "shard", "left_semi").groupBy("shard", "label").agg(F.count("*").alias("k"))
        sizes = of.groupBy("shard").agg(F.sum("k").alias("n"), F.max("k").alias("most"), F.max_by("label", "k").alias("main"))
        cut = sizes.select("shard", "main", F.ceil((F.col("n") - F.col("most")) / slice_rows).cast("int").alias("slices"), F.ceil(F.col("n") / (tree * slice_rows)).cast("int").alias("trees"))
        cut, _ = written(cut, "slices")

        def numbers(n: str) -> Column:
            return F.when(F.col(n) > 0, F.sequence(F.lit(0), F.col(n) - 1)).otherwise(F.array().cast("array<int>"))

        own_slice, own_tree = F.pmod(F.xxhash64("label", "fp"), F.greatest("slices", F.lit(1))).cast("int"), F.pmod(F.xxhash64("fp"), F.col("trees")).cast("int")
        stands = F.transform(numbers("slices"), lambda s: F.struct((own_tree * F.col("slices") + s).alias("cell"), F.lit(HELD).alias("role")))
        asks = F.transform(numbers("trees"), lambda t: F.struct((t * F.col("slices") + own_slice).alias("cell"), F.lit(ASKS).alias("role")))
        cells = F.when(F.col("main").isNull(), both).when(F.col("label") == F.col("main"), stands).otherwise(F.concat(stands, asks))
        dealt = dealt.join(cut, "shard", "left").select("fp", "label", *extra, "shard", F.explode(cells).alias("at"))
    else:
        dealt = dealt.select("fp", "label", *extra, "shard", F.explode(both).alias("at"))
    dealt = dealt.select("shard", "at.cell", F.col("at.role").cast("byte").alias("role"), "fp", "label", *extra)

    def work(t: pa.Table) -> pa.RecordBatch:
        shard, cell = t.column("shard").to_numpy(), t.column("cell").to_numpy()
        new = np.append(True, (shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1]))
        number, label = np.cumsum(new) - 1, t.column("label").to_numpy()
        first = np.flatnonzero(new)
        some = (np.minimum.reduceat(label, first) != np.maximum.reduceat(label, first))[number]  # of one label there is nothing to link
        sketch = np.stack([t.column(c).to_numpy() for c in extra], 1).view(np.uint64)[some] if extra else None
        labels = Labels(label[some], sketch)
        if some.any():
            connect(number[some], t.column("fp").to_numpy().view(np.uint64)[some], t.column("role").to_numpy()[some], labels, shard[some])
        return labels.links()

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows >= TOGETHER:  # work on all cells but the last, which may go on
                t = pa.Table.from_batches(held).combine_chunks()
                shard, cell = t.column("shard").to_numpy(), t.column("cell").to_numpy()
                change = np.flatnonzero((shard[1:] != shard[:-1]) | (cell[1:] != cell[:-1])) + 1
                if len(change):
                    cut = int(change[-1])
                    yield work(t.slice(0, cut).combine_chunks())
                    t = t.slice(cut)
                held, rows = t.combine_chunks().to_batches(), 0
        if held:
            yield work(pa.Table.from_batches(held).combine_chunks())

    placed = dealt.repartition(partitions(spark), "shard", "cell").sortWithinPartitions("shard", "cell")
    return placed.mapInArrow(search, "a long, b long")


def shard_keys(fingerprints_: int, radius: int) -> list[Column]:
    """A key for each choice of agreeing blocks of fp, at so many different fingerprints."""
    agree = agreeing(fingerprints_, radius)
    keys = []
    for i, chosen in enumerate(combinations(bit_blocks(radius + agree), agree)):
        key = F.lit(i).cast("long")
        narrow = sum(width for _, width in chosen) <= 48  # then the bits themselves name the shard, in few bytes
        for first, width in chosen:
            own = F.shiftrightunsigned("fp", first).bitwiseAND(F.lit((1 << width) - 1 if width < 64 else -1))
            key = F.shiftleft(key, width).bitwiseOR(own) if narrow else F.xxhash64(key, own)
        keys.append(key)
    return keys


def links(nodes: DataFrame, radius: int = RADIUS, slice_rows: int = SLICE) -> DataFrame:
    """Links (a, b) that connect all of ``nodes`` (fp, distinct) that are within ``radius`` bits of each other: about one for each node that has any."""
    labelled = nodes.select("fp", F.col("fp").alias("label"))
    near, _ = written(swept(labelled, radius), "near")
    return near.unionByName(block_links(contracted(labelled, near), shard_keys(nodes.count(), radius), _by_trees(radius), slice_rows))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs`` (doc_id, text).

    Fingerprints within ``radius`` bits are linked; component_id is the smallest
    doc_id that links reach. A null text counts as empty, and texts without words have
    fingerprint 0, linked like any other; equal texts have equal fingerprints.
    Rows stay one to one, repeated ones too; an empty table gives no rows; a null
    doc_id is a member of its component but never names it unless all are null;
    other columns aren't read. Equal fingerprints are one node from the start, so
    that copies cost nothing further.
    """
    known, _ = written(fingerprints(docs, shingle), "fingerprints")
    return components(known, radius)


#: A fingerprint of over a share of 1 in so many of all rows is joined by a broadcast: there are fewer than that of them.
OFTEN = 1_000


def components(known: DataFrame, radius: int) -> DataFrame:
    """``known`` (doc_id, fp, ...; a written table) with component_id: see near_duplicates."""
    nodes, _ = written(known.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.first("fp").alias("label")), "nodes")
    labelled = contracted(nodes, swept(nodes, radius))
    labelled = contracted(labelled, block_links(labelled, shard_keys(nodes.count(), radius), _by_trees(radius)))
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"), F.count("*").alias("of"))
    # a fingerprint alone has its own first; only those in company look for the least of all
    company = labelled.join(least.where("of > 1").drop("of"), "label", "left")
    every, _ = written(company.select("fp", "n", F.coalesce("component_id", "first").alias("component_id")), "named")
    often = every.where(F.col("n") * OFTEN > known.count()).select("fp", F.struct("component_id").alias("hot"))
    marked = known.join(F.broadcast(often), "fp", "left")
    rare = marked.where("hot is null").drop("hot").join(every.select("fp", "component_id"), "fp")
    return rare.select(*known.columns, "component_id").unionByName(marked.where("hot is not null").select(*known.columns, F.col("hot.component_id").alias("component_id")))


# whole documents


def shingle_set(text: str | bytes, shingle: int) -> np.ndarray:
    """Sorted hashes of the different shingles; a shorter text is one shingle, one without words none."""
    return np.unique(shingle_hashes(text.encode() if isinstance(text, str) else text, shingle))


#: Bands of least hashes, and hashes in each: sets that share 0.8 have no band in common once in 2,800 pairs.
BANDS, ROWS = 20, 5
#: A sketch has one bit of each of so many least hashes. Sets that share a part s have 1/2 + s/2 of these bits alike: at 0.8
#: more than UNLIKE of them differ in one of 130,000 pairs, of sets that share nothing no more than that differ in one of 5 * 10^9.
BITS, UNLIKE = 128, 29
_TIMES, _PLUS = np.random.default_rng(11).integers(0, 1 << 63, (2, BITS), np.uint64) * np.uint64(2) + np.uint64(1)


def bands_and_sketch(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each band a hash of the least values that its hashes give the shingles (none of an empty set), and the sketch as two words."""
    if not len(shingles):
        return np.empty(0, np.int64), np.zeros(2, np.int64)
    x = shingles[:, None]
    least = np.minimum.reduce([(x[i : i + 4096] * _TIMES + _PLUS).min(0) for i in range(0, len(x), 4096)])
    rows = least[: BANDS * ROWS].reshape(BANDS, ROWS)
    bands = np.array([xxhash.xxh64_intdigest(row.tobytes(), k) for k, row in enumerate(rows)], np.uint64)
    # the lowest bits of products follow those of the shingles: take one further up
    return bands.view(np.int64), np.packbits((least >> np.uint64(17) & np.uint64(1)).astype(bool), bitorder="little").view("<i8")


#: Shingles of a component up to which one task goes through it, and members of a larger one that are gone through in a pass.
COMPONENT, HEADS = 4_000_000, 256


def leaders(members: DataFrame, similarity: float, component: int = COMPONENT) -> DataFrame:
    """Those of ``members`` (component_id, doc_id, row, shingles) that stay: their rows.

    In order of doc_id and row, a member stays unless it is at least ``similarity`` like one
    of its component that stays. A component of few shingles is gone through in one
    task. Of a larger one the first members are, and all others are held against
    those of them that stay, in slices; what is left goes on until it is small enough.
    """

    def alike(sets: list[list[int]], order: list[int], known: list[list[int]], similar: list[int] | None) -> list[int]:
        """Of ``sets`` in order those that are like none of ``known``, and, if ``similar`` is given, none of those before that stay: it gets them."""
        holders: dict[int | None, list[int]] = {}  # by shingle, who has it; None: sets that are empty
        held: list[list[int]] = []

        def hold(s: list[int]) -> None:
            for h in s or (None,):
                holders.setdefault(h, []).append(len(held))
            held.append(s)

        for s in known:
            hold(s)
        stay = []
        for i in order:
            shared = Counter(j for h in sets[i] or (None,) for j in holders.get(h, ()))
            if not any(n >= similarity * (len(sets[i]) + len(held[j]) - n) for j, n in shared.items()):
                stay.append(i)
                if similar is not None:
                    hold(sets[i])
        return stay

    def go_through(table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table.select(["doc_id", "row"]), sort_keys=[("doc_id", "ascending"), ("row", "ascending")])
        stay = alike(table.column("shingles").to_pylist(), order.to_pylist(), [], [])
        return pa.table({"row": table.column("row").take(pa.array(stay, pa.int64()))})

    columns = members.columns

    def unlike(left: pa.Table, right: pa.Table) -> pa.Table:
        stay = alike(left.column("shingles").to_pylist(), list(range(left.num_rows)), right.column("shingles").to_pylist(), None)
        return left.take(pa.array(stay, pa.int64())).select(columns)

    kept = None
    left, _ = written(members, "members")
    while True:
        size = left.groupBy("component_id").agg(F.sum(F.size("shingles").cast("long") + 1).alias("_size"))
        large, _ = written(size.where(F.col("_size") > component).select("component_id", F.ceil(F.col("_size") / component).cast("int").alias("_slices")), "large")
        some = large.limit(1).count() > 0
        small = left.join(large, "component_id", "left_anti") if some else left
        done = small.groupBy("component_id").applyInArrow(go_through, "row long")
        kept = done if kept is None else kept.unionByName(done)
        if not some:
            return kept
        rest = left.join(large, "component_id")
        place = F.row_number().over(Window.partitionBy("component_id").orderBy("doc_id", "row"))
        heads, _ = written(rest.withColumn("_place", place).where(F.col("_place") <= HEADS), "heads")
        stay, _ = written(heads.groupBy("component_id").applyInArrow(go_through, "row long"), "stay")
        kept = kept.unionByName(stay)
        others = rest.join(heads.select("row"), "row", "left_anti").withColumn("_slice", F.pmod(F.xxhash64("row"), F.col("_slices")).cast("int"))
        known = heads.join(stay, "row", "left_semi").withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
        by = ("component_id", "_slice")
        left, _ = written(others.groupBy(*by).cogroup(known.groupBy(*by)).applyInArrow(unlike, members.schema), "members")


#: Name of a column beside those of the documents.
ROW = "_near_row"
#: Rows up to which their hashes, 8 bytes each, and their labels are broadcast, so that no texts are shuffled; beyond, a join by shuffle.
FEW = 1 << 20


def _few(rows: DataFrame) -> DataFrame:
    """``rows``, a written table of hashes, to be broadcast if it has at most FEW."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def classes(rows: DataFrame, shingle: int, radius: int) -> tuple[DataFrame, DataFrame, bool]:
    """``rows`` (row, doc_id, text) as classes of one set of shingles: node, at (the least doc_id and row), label; the different
    rows; and whether a row is there twice.

    Classes that links reach share a label. Candidates are classes whose fingerprints lie within ``radius`` or that
    share a band of least hashes; they are linked only if their sketches are alike, so that chance doesn't
    join what has nothing in common. Rows without doc_id make classes of their own, whose
    sketches are turned round: they are alike with each other alone.
    """
    kind = dict(rows.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, fps, bands, sketches = [], [], [], []
            for t, unnamed in zip(b.column("text").cast(pa.binary()), b.column("unnamed").to_pylist(), strict=True):
                h = shingle_hashes(t.as_py(), shingle)
                some = np.unique(h)
                own_bands, sketch = bands_and_sketch(some)
                nodes.append(xxhash.xxh64_intdigest(some.tobytes(), unnamed))
                fps.append(majority(h))
                bands.append(own_bands)
                sketches.append(~sketch if unnamed else sketch)
            words = np.array(sketches, np.int64).reshape(-1, 2)
            numbers = [pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, fps)]
            yield pa.RecordBatch.from_arrays(
                [b.column("row"), b.column("doc_id"), *numbers, pa.array(bands, pa.list_(pa.int64())), pa.array(words[:, 0]), pa.array(words[:, 1])], names=["row", "doc_id", "node", "fp", "bands", *SKETCH]
            )

    asked = rows.select("row", "doc_id", F.col("doc_id").isNull().cast("int").alias("unnamed"), text_or_empty().alias("text"))
    known, _ = written(asked.mapInArrow(read, f"row long, doc_id {kind}, node long, fp long, bands array<long>, {SKETCH[0]} long, {SKETCH[1]} long"), "classes")
    place = F.struct("doc_id", "row")
    once = known.groupBy("node").agg(F.min(place).alias("at"), *[F.min(c).alias(c) for c in ("fp", *SKETCH)], F.min("bands").alias("bands"), F.first("node").alias("label"))
    nodes, _ = written(once, "nodes")
    nodes = contracted(nodes, swept(nodes, radius))
    agree, dealt = choices(nodes.count(), radius)
    nodes = contracted(nodes, block_links(nodes, first_keys(agree, dealt, radius), _by_choices(agree, dealt, radius), 2 * DEALT, 1))
    for a, z in ((0, 4), (4, BANDS)):  # a few bands first: what they link meets as one in the others
        nodes = contracted(nodes, block_links(nodes, F.slice("bands", a + 1, z - a), _by_pivots))
    every, _ = written(known.groupBy("row").agg(F.count("*").alias("n")), "rows")
    return nodes.select("node", "at", "label"), every.select("row"), every.where("n > 1").limit(1).count() > 0


def one_of_each(docs: DataFrame, shingle: int = 5, radius: int = 10, similarity: float = 0.8) -> DataFrame:
    """``docs`` without those that are near-duplicates of a document of a smaller doc_id that stays.

    Candidates are documents that links of fingerprints or bands join; a document goes only if
    at least ``similarity`` of its and a staying one's shingles of ``shingle`` words
    are shared (those of both over those of either), so that a chance likeness
    removes nothing. Columns stay as they are. Rows are told apart by doc_id and a hash of
    the text: of whole repeats one stays (of those that differ in other columns the one whose
    columns have the least hash), and of those that share a doc_id each is
    judged by its own text. Rows without doc_id are compared with each other alone, in the
    order of those hashes. A null text counts as empty, and all texts without words are alike. An empty table stays empty.
    """
    marked = docs.withColumn(ROW, F.xxhash64(F.col("doc_id").isNull(), "doc_id", text_or_empty()))
    rows = marked.select(F.col(ROW).alias("row"), "doc_id", "text")
    found, every, twice = classes(rows, shingle, radius)
    groups = found.groupBy("label").agg(F.count("*").alias("k")).where("k > 1").select("label")
    suspects, _ = written(found.join(groups, "label").select(F.col("at.row").alias("row"), F.col("label").alias("component_id")), "suspects")
    kind = dict(docs.dtypes)["doc_id"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [shingle_set(t.as_py(), shingle).view(np.int64) for t in b.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(made, pa.list_(pa.int64()))], names=["component_id", "doc_id", "row", "shingles"])

    texts = rows.join(_few(suspects), "row").select("component_id", "doc_id", "row", text_or_empty().alias("text"))
    members = texts.mapInArrow(sets, f"component_id long, doc_id {kind}, row long, shingles array<long>").dropDuplicates(["row"])
    stay = leaders(members, similarity)
    alone = found.select(F.col("at.row").alias("row"), "label").join(groups, "label", "left_anti").select("row")
    keep, _ = written(alone.unionByName(stay).distinct(), "kept")
    gone, _ = written(every.join(keep, "row", "left_anti").select(F.col("row").alias("_gone")), "gone")
    left = marked.join(_few(gone), marked[ROW] == gone["_gone"], "left_anti")
    if not twice:
        return left.drop(ROW)
    hashed = F.xxhash64(*[c for c, k in docs.dtypes if "map<" not in k and k != "variant"])
    place = F.row_number().over(Window.partitionBy(ROW).orderBy(hashed))
    return left.withColumn(f"{ROW}_place", place).where(F.col(f"{ROW}_place") == 1).drop(ROW, f"{ROW}_place")
