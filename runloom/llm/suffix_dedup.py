"""Removal of repeated byte strings by prefix-free parsing.

Each document is parsed into phrases. A rolling hash over a few bytes is the trigger:
of the triggers in each window of ``length`` bytes the least one rules, and
a phrase is the run of windows under one trigger, with all their bytes. A
phrase so depends on nothing but its bytes, and strings that are the same lie
under the same trigger, at the same place before it. Phrases of one spelling are one
entry of the dictionary, and the parse says where each stands first; all its
later places are repeats as a whole. Only entries that share a trigger and differ
need a look inside: the suffixes of those entries are sorted (prefix doubling,
to ``length`` bytes), and alike suffixes, in order of the places that the parse
gives their phrases, show which windows are repeats.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import partitions, text_or_empty, written

LENGTH = 100
#: Bytes of a trigger; at most LENGTH.
TRIGGER = 32
#: Windows of a document that are parsed at once: bounds memory for very long texts.
STRETCH = 1 << 20
#: Entries that share a trigger up to which they are sorted in one task; beyond, each of their windows is dealt out on its own.
SHARED = 20_000
#: Bytes of entries that are sorted together.
TOGETHER = 1 << 20
NO_ID = (1 << 63) - 1

_BYTE = np.random.default_rng(7).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def _rolling(data: np.ndarray, width: int) -> np.ndarray:
    """A 64-bit hash of each ``width`` bytes, from hashes of half the width."""
    powers = {1: _BYTE[data]}
    out, got, have = None, 0, 1
    h = powers[1]
    while True:
        if width & have:
            # what is hashed so far, then the next ``have`` bytes
            if out is None:
                out = h
            else:
                n = len(data) - (got + have) + 1
                out = out[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + h[got : got + n]
            got += have
        if have * 2 > width:
            break
        n = len(data) - 2 * have + 1
        h = h[:n] * np.uint64(pow(_BASE, have, 1 << 64)) + h[have : have + n]
        have *= 2
    out = out ^ (out >> np.uint64(31))
    out = out * np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours."""
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def parse(data: bytes, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of phrases, their numbers of windows, and their triggers' hashes."""
    starts, counts, triggers = [], [], []
    windows = len(data) - length + 1
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, windows, STRETCH):
        here = min(STRETCH, windows - at)
        h = _rolling(raw[at : at + here + length - 1], trigger)
        key = (h & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(h), dtype=np.uint64)
        ruling = (_least(key, length - trigger + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        first = np.flatnonzero(np.diff(ruling, prepend=-1))
        starts.append(first + at)
        counts.append(np.diff(np.append(first, here)))
        triggers.append(h[ruling[first]].view(np.int64))
    if not starts:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(triggers)


def merged(start: np.ndarray, stop: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of each group joined where they overlap or touch; groups are numbers from 0."""
    order = np.lexsort((start, group))
    start, stop, group = start[order], stop[order], group[order]
    if not len(start):
        return start, stop, group
    shift = int(stop.max()) + 2
    reach = np.maximum.accumulate(stop + group * shift)
    new = np.append(True, start[1:] + group[1:] * shift > reach[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return start[first], reach[last] - group[first] * shift, group[first]


def _batch(cols: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v) if not isinstance(v, pa.Array) else v for v in cols.values()], names=list(cols))


def _same(*columns: np.ndarray) -> np.ndarray:
    """Whether each row is the same as the one before it; the first isn't."""
    return np.append(False, np.logical_and.reduce([c[1:] == c[:-1] for c in columns]))


def _parse_batches(length: int, trigger: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Phrases (key: trigger, entry: hash of the bytes, d, sub, start, n windows).

        Of phrases that a batch has several times the first goes on; the others are
        repeats for sure and go on as merged spans, with n = -length. The same place in
        a row that repeats as a whole is no repeat.
        """
        for whole in batches:
            for i in range(0, whole.num_rows, 2048):
                b = whole.slice(i, 2048)
                ds, subs = b.column("d").to_numpy(), b.column("sub").to_numpy()
                parts, entries, rows = [], [], []
                one = xxhash.xxh64_intdigest
                for j, t in enumerate(b.column("text")):
                    data = t.as_py()
                    starts, counts, triggers = parse(data, length, trigger)
                    if len(starts):
                        entries += [one(data[a:z]) for a, z in zip(starts.tolist(), (starts + counts + length - 1).tolist(), strict=True)]
                        parts.append((starts, counts, triggers))
                        rows.append(np.full(len(starts), j))
                if not parts:
                    continue
                start, n, key = (np.concatenate(x) for x in zip(*parts, strict=True))
                entry, row = np.array(entries, np.uint64).view(np.int64), np.concatenate(rows)
                order = np.lexsort((start, subs[row], ds[row], entry, key))
                start, n, key, entry, row = (x[order] for x in (start, n, key, entry, row))
                one_place = _same(key, entry, ds[row], subs[row], start)  # of a row that repeats as a whole
                start, n, key, entry, row = (x[~one_place] for x in (start, n, key, entry, row))
                again = np.append(False, (key[1:] == key[:-1]) & (entry[1:] == entry[:-1]))
                s, e, g = merged(start[again], start[again] + n[again] + length - 1, row[again])
                own = ~again
                yield _batch({
                    "key": np.concatenate([key[own], (ds[g] * 2654435761 + s)]), "entry": np.concatenate([entry[own], np.zeros(len(s), np.int64)]),
                    "d": np.concatenate([ds[row[own]], ds[g]]), "sub": np.concatenate([subs[row[own]], subs[g]]),
                    "start": np.concatenate([start[own], s]), "n": np.concatenate([n[own], s - e]),
                })

    return run


def _resolve(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From phrases sorted by key, entry and place: spans (key null) of all but the first of each
        entry, and the first ones themselves (with key) where a key has several entries."""
        last_key = last_entry = last_place = None
        waiting: dict | None = None  # the first of a key that has one entry so far
        for b in batches:
            c = {name: b.column(name).to_numpy() for name in b.schema.names}
            direct = c["n"] < 0
            spans = [(c["d"][direct], c["sub"][direct], c["start"][direct], c["start"][direct] - c["n"][direct])]
            c = {name: v[~direct] for name, v in c.items()}
            wanted = []
            if len(c["key"]):
                key, entry = c["key"], c["entry"]
                new_key = np.append(last_key is None or key[0] != last_key, key[1:] != key[:-1])
                new = new_key | np.append(last_entry is None or entry[0] != last_entry, entry[1:] != entry[:-1])
                place = (c["d"], c["sub"], c["start"])
                one_place = _same(*place) & ~new
                one_place[0] = not new[0] and last_place == tuple(x[0] for x in place)
                rest = ~new & ~one_place
                spans.append((c["d"][rest], c["sub"][rest], c["start"][rest], c["start"][rest] + c["n"][rest] + length - 1))
                group = np.cumsum(new_key)  # 0: goes on from the last batch
                many = np.bincount(group[new], minlength=group[-1] + 1)
                if many[0] and waiting is not None:
                    wanted.append(waiting)
                    waiting = None
                if group[-1] > 0:
                    waiting = None
                emit = new & ((many >= 2)[group] | (group == 0))
                wanted.append({name: v[emit] for name, v in c.items()})
                if group[-1] > 0 and many[-1] == 1:
                    i = int(np.flatnonzero(new)[-1])
                    waiting = {name: v[i : i + 1] for name, v in c.items()}
                last_key, last_entry, last_place = key[-1], entry[-1], tuple(x[-1] for x in place)
            d, sub, start, stop = (np.concatenate(x) for x in zip(*spans, strict=True))
            w = {name: np.concatenate([x[name] for x in wanted]) if wanted else np.empty(0, np.int64) for name in c}
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([d, w["d"]])), pa.array(np.concatenate([sub, w["sub"]])), pa.array(np.concatenate([start, w["start"]])),
                    pa.array(np.concatenate([stop, w["start"] + w["n"] + length - 1])),
                    pa.array(np.concatenate([np.zeros(len(d), np.int64), w["key"]]), mask=np.arange(len(d) + len(w["d"])) < len(d)),
                ],
                names=["d", "sub", "start", "stop", "key"],
            )

    return run


def suffix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes by their first ``length`` bytes: prefix doubling."""
    have = 8
    padded = np.concatenate([data, np.zeros(have, np.uint8)])
    rank = np.unique(np.lib.stride_tricks.sliding_window_view(padded, 8)[: len(data)].copy().view(">u8").ravel(), return_inverse=True)[1].astype(np.int64)
    while have < length:
        step = min(have, length - have)
        second = np.zeros(len(rank), np.int64)
        second[: len(rank) - step] = rank[step:] + 1
        rank = np.unique(rank * (len(rank) + 2) + second, return_inverse=True)[1].astype(np.int64)
        have += step
    return rank


class Entries:
    """Dictionary entries of whole keys and where each stands first; see repeats()."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, bytes]] = []
        self.size = 0

    def add(self, key: int, d: int, sub: int, start: int, data: bytes) -> None:
        self.rows.append((key, d, sub, start, data))
        self.size += len(data)

    def repeats(self, length: int) -> tuple[list[tuple[int, int, int, int]], np.ndarray]:
        """Spans (d, sub, start, stop) of windows that stand earlier in another place, and for each row whether it holds a first window."""
        lengths = np.array([len(r[4]) for r in self.rows])
        data = np.frombuffer(b"".join(r[4] for r in self.rows), np.uint8)
        base = np.cumsum(lengths) - lengths
        row = np.repeat(np.arange(len(lengths)), lengths - length + 1)
        many = lengths - length + 1
        offset = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        rank = suffix_ranks(data, length)[base[row] + offset]
        key, d, sub, start = (np.array([r[i] for r in self.rows], np.int64) for i in range(4))
        at = start[row] + offset
        order = np.lexsort((at, sub[row], d[row], rank))
        alike = np.append(False, rank[order][1:] == rank[order][:-1])
        same_place = alike & np.append(False, (d[row[order]][1:] == d[row[order]][:-1]) & (sub[row[order]][1:] == sub[row[order]][:-1]) & (at[order][1:] == at[order][:-1]))
        again = np.zeros(len(row), bool)
        again[order] = alike & ~same_place
        first = np.zeros(len(lengths), bool)
        first[row[~again]] = True
        hit = np.flatnonzero(again)
        s, e, g = merged(at[hit], at[hit] + length, row[hit])
        return list(zip(d[g].tolist(), sub[g].tolist(), s.tolist(), e.tolist(), strict=True)), first


def _look_inside(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """From entries sorted by key and place: spans of their repeated windows."""

        def told(spans: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
            cols = list(zip(*spans, strict=True)) if spans else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["d", "sub", "start", "stop"])

        held, last = Entries(), None
        limit = TOGETHER
        for b in batches:
            for key, d, sub, start, data in zip(*(b.column(n).to_pylist() for n in ("key", "d", "sub", "start", "data")), strict=True):
                if held.size >= limit:
                    spans, first = held.repeats(length)
                    yield told(spans)
                    kept = Entries()
                    if key == last:  # the key goes on: what may still be the first of later windows stays
                        for r, f in zip(held.rows, first, strict=True):
                            if f and r[0] == key:
                                kept.add(*r)
                    held, limit = kept, max(TOGETHER, 2 * kept.size)
                held.add(key, d, sub, start, data)
                last = key
        if held.rows:
            yield told(held.repeats(length)[0])

    return run


def repeated_spans(rows: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> tuple[DataFrame, list[str]]:
    """(d, sub, start, stop) of bytes under strings of ``length`` bytes that also start earlier, and the tables written for it.

    ``rows`` has d (order of documents), sub (order among equal d) and text as bytes.
    """
    spark = rows.sparkSession
    phrases = rows.mapInArrow(_parse_batches(length, trigger), "key long, entry long, d long, sub long, start long, n long")
    dealt = phrases.repartition(partitions(spark), "key").sortWithinPartitions("key", "entry", "d", "sub", "start")
    resolved, resolved_path = written(dealt.mapInArrow(_resolve(length), "d long, sub long, start long, stop long, key long"), "phrases")
    asked = resolved.where(F.col("key").isNotNull())
    shared, shared_path = written(asked.groupBy("key").count().where(F.col("count") > SHARED).select("key", F.lit(True).alias("hot")), "shared")
    inside = asked.join(shared, "key", "left").groupBy("d", "sub").agg(F.collect_list(F.struct("key", "start", "stop", "hot")).alias("wanted"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                data = b.column("text")[i].as_py()
                d, sub = b.column("d")[i].as_py(), b.column("sub")[i].as_py()
                made = []
                for w in b.column("wanted")[i].as_py():
                    if w["hot"]:
                        for at in range(w["start"], w["stop"] - length + 1):
                            part = data[at : at + length]
                            made.append((np.uint64(xxhash.xxh64_intdigest(part)).astype(np.int64), at, part))
                    else:
                        made.append((w["key"], w["start"], data[w["start"] : w["stop"]]))
                keys, starts, parts = zip(*made, strict=True)
                n = len(made)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.array([d] * n, pa.int64()), pa.array([sub] * n, pa.int64()), pa.array(starts, pa.int64()), pa.array(parts, pa.binary())],
                    names=["key", "d", "sub", "start", "data"],
                )

    entries = rows.join(inside, ["d", "sub"]).select("d", "sub", "text", "wanted").mapInArrow(fetch, "key long, d long, sub long, start long, data binary")
    sorted_ = entries.repartition(partitions(spark), "key").sortWithinPartitions("key", "d", "sub", "start")
    within, within_path = written(sorted_.mapInArrow(_look_inside(length), "d long, sub long, start long, stop long"), "within")
    spans = resolved.where(F.col("key").isNull()).select("d", "sub", "start", "stop").unionByName(within)
    return spans, [resolved_path, shared_path, within_path]


#: Names of columns beside those of the documents.
DOC, SUB, SPANS = "_dedup_doc", "_dedup_sub", "_dedup_spans"


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with DOC and SUB, which order and name its rows: SUB is 0 unless ids repeat, and then a hash of the text."""
    if dict(docs.dtypes)["doc_id"] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("doc_id must be a whole number: documents are ordered by it")
    unique = docs.groupBy("doc_id").count().where(F.col("count") > 1).limit(1).count() == 0
    sub = F.lit(0).cast("long") if unique else F.xxhash64(text_or_empty())
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias(DOC), sub.alias(SUB), *docs.columns)


def _with_spans(docs: DataFrame, length: int, trigger: int) -> DataFrame:
    named = keyed(docs)
    rows = named.select(F.col(DOC).alias("d"), F.col(SUB).alias("sub"), F.encode(text_or_empty(), "UTF-8").alias("text"))
    found, _ = repeated_spans(rows, length, trigger)
    per = found.groupBy(F.col("d").alias(DOC), F.col("sub").alias(SUB)).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("_dedup_raw"))
    spans = F.coalesce("_dedup_raw", F.array().cast("array<struct<start:bigint,stop:bigint>>")).alias(SPANS)
    return named.join(per, [DOC, SUB], "left").select(*docs.columns, spans)


def removed_spans(docs: DataFrame, length: int = LENGTH, trigger: int = TRIGGER) -> DataFrame:
    """``docs`` (doc_id, text, ...) with all its columns and spans, array<struct<start, stop>>: bytes of the text's UTF-8 to remove.

    A byte is removed if a string of ``length`` bytes covers it that also starts earlier: in a
    document of a smaller id, or earlier in the same one. Strings don't reach
    from one document into the next, overlapping ones count, and all are judged on the input.
    Spans are sorted and don't touch; a text without any has an empty array. A null text
    counts as empty. Rows without doc_id come after all others; rows that share a
    doc_id are ordered by a hash of their text, and whole repeats of a row are
    one document with one result; an empty table gives no rows; a column spans is replaced. A doc_id that isn't a whole number raises TypeError.
    """
    kept = [c for c in docs.columns if c != "spans"]
    return _with_spans(docs, length, trigger).select(*kept, F.col(SPANS).alias("spans"))


def _union(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s in spans:
        a, z = s["start"], s["stop"]
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], z))
        else:
            out.append((a, z))
    return out


def kept_bytes(data: bytes, spans: list[dict]) -> tuple[bytes, list[tuple[int, int]]]:
    """What is left of ``data``, and the maximal removed runs."""
    runs, at, parts = _union(spans), 0, []
    for a, z in runs:
        parts.append(data[at:a])
        at = z
    return b"".join([*parts, data[at:]]), runs


def digests(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for t, s in zip(b.column("text").cast(pa.binary()), b.column("spans"), strict=True):
                data = t.as_py()
                left, runs = kept_bytes(data, s.as_py())
                rows.append((len(data), len(data) - len(left), len(runs), hashlib.sha256(left).hexdigest()))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    spans = removed_spans(docs.select("doc_id", text_or_empty().alias("text")), length)
    return spans.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated strings cut out of the texts; other columns, and null texts, stay as they are.

    A column n_chars becomes the number of characters left. A cut can fall inside a character; bytes of such a broken character are left out too.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i = b.schema.get_field_index("text")
            texts = [None if t is None else kept_bytes(t, s.as_py())[0].decode("utf-8", "ignore") for t, s in zip(b.column(i).cast(pa.binary()).to_pylist(), b.column(SPANS), strict=True)]
            columns = [pa.array(texts, pa.string()) if j == i else c for j, c in enumerate(b.columns) if b.schema.names[j] != SPANS]
            yield pa.RecordBatch.from_arrays(columns, names=[n for n in b.schema.names if n != SPANS])

    left = _with_spans(docs, length, TRIGGER).mapInArrow(run, docs.schema)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left
