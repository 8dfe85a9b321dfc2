"""URL filter over a sorted array of digests.

Rules (host and path prefix with a verdict) are kept as one sorted array of
64-bit xxhash keys beside their full strings. Every Python worker maps that
array from a file, all candidate strings of a batch are searched in it at once
(binary search), and a hit counts only if the stored string is the same, so
that equal digests of different strings do no harm.
"""

from __future__ import annotations

import mmap
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SEED = 0
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: str) -> Column:
    found = F.regexp_extract(F.col(url), r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, UPPER, LOWER), F.lit(""))


def path_of(url: str) -> Column:
    return F.coalesce(F.regexp_extract(F.col(url), r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode("utf-8", "surrogatepass"), SEED)


class DigestArray:
    """Sorted 64-bit keys, offsets and strings in one buffer; of equal rules the last counts."""

    def __init__(self, keys: np.ndarray, ends: np.ndarray, blob: bytes, allow: np.ndarray, lengths: list[int], labels: int):
        self.keys, self.ends, self.blob, self.allow = keys, ends, blob, allow
        # the lengths that rules' paths have, longest first, and the most labels of a rule's host: nothing else is looked for
        self.lengths, self.labels = lengths, labels

    @classmethod
    def build(cls, rules: Iterable[tuple[str, str]], digest=digest) -> DigestArray:
        named = dict(rules)
        rows = sorted((digest(rule), rule.encode(), verdict == "allow") for rule, verdict in named.items())
        ends = np.cumsum([0, *(len(r[1]) for r in rows)]).astype(np.int64)
        lengths = sorted({len(rule) - rule.index("/") for rule in named}, reverse=True)
        return cls(np.array([r[0] for r in rows], np.uint64), ends, b"".join(r[1] for r in rows), np.array([r[2] for r in rows], np.uint8), lengths, max((rule[: rule.index("/")].count(".") + 1 for rule in named), default=0))

    def packed(self) -> bytes:
        head = np.array([len(self.keys), len(self.blob), len(self.lengths), self.labels], np.int64)
        return b"".join(x.tobytes() for x in (head, np.array(self.lengths, np.int64), self.keys, self.ends, self.allow)) + self.blob

    @classmethod
    def mapped(cls, data: bytes) -> DigestArray:
        """Write the packed form to a file of this worker and map it."""
        with tempfile.TemporaryFile() as f:  # has no name any more, yet stays mapped
            f.write(data)
            f.flush()
            m = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        n, size, k, labels = np.frombuffer(m, np.int64, 4)
        at = 32

        def take(kind, count):
            nonlocal at
            x = np.frombuffer(m, kind, count, at)
            at += x.nbytes
            return x

        lengths = take(np.int64, k).tolist()
        keys, ends, allow = take(np.uint64, n), take(np.int64, n + 1), take(np.uint8, n)
        return cls(keys, ends, memoryview(m)[at : at + int(size)], allow, lengths, int(labels))

    def find(self, strings: list[str], digest=digest) -> np.ndarray:
        """The place of each string in the array, or -1."""
        out = np.full(len(strings), -1, np.int64)
        if not strings or not len(self.keys):
            return out
        asked = np.fromiter(map(digest, strings), np.uint64, len(strings))
        at = np.searchsorted(self.keys, asked)
        todo = np.flatnonzero((at < len(self.keys)) & (self.keys[np.minimum(at, len(self.keys) - 1)] == asked))
        for i in todo.tolist():
            j, wanted = int(at[i]), strings[i].encode()
            while j < len(self.keys) and self.keys[j] == asked[i]:  # all that share the digest
                if self.blob[self.ends[j] : self.ends[j + 1]] == wanted:
                    out[i] = j
                    break
                j += 1
        return out

    def rule(self, j: int) -> str:
        return bytes(self.blob[self.ends[j] : self.ends[j + 1]]).decode()


def candidates(host: str, path: str, lengths: list[int], most_labels: int) -> list[str]:
    """Rules that would fit, longest first, of one length with the longer host first."""
    labels = host.rsplit(".", most_labels)
    hosts = [".".join(labels[i:]) for i in range(len(labels) > most_labels, len(labels))]
    found = [h + path[:n] for h in hosts for n in lengths if len(path) >= n]
    return sorted(found, key=len, reverse=True)


_mapped: dict[int, DigestArray] = {}


def judge_urls(df: DataFrame, rules: list[tuple[str, str]], url: str = "url", default: str = "allow") -> DataFrame:
    """``df`` with host, path, rule and verdict.

    ``rules`` are ("host/path", "allow" or "block") pairs; a rule fits its host
    and all subdomains whose url path starts with its path; the longest wins.
    Without a rule, rule is null and the verdict ``default``: a url that isn't in
    the array isn't blocked. A null url, or one without ``://``, has empty host
    and path and hence no rule. Rows are neither dropped nor merged; an empty
    table stays empty. Of the input's columns, those named like a result column
    are replaced, all others stay. The packed rules go to the workers as one
    broadcast; they come from the driver, so its memory bounds them.
    """
    spark = df.sparkSession
    index = DigestArray.build(rules).packed()
    shared, key = spark.sparkContext.broadcast(index), xxhash.xxh64_intdigest(index)
    kept = [c for c in df.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = df.select(*[df[c] for c in kept], host_of(url).alias("host"), path_of(url).alias("path"))
    schema = T.StructType([*parsed.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _mapped:
            _mapped.clear()  # a worker keeps the rules it saw last
            _mapped[key] = DigestArray.mapped(shared.value)
        array = _mapped[key]
        for b in batches:
            asked, first = [], [0]
            for host, path in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), strict=True):
                asked += candidates(host, path, array.lengths, array.labels)
                first.append(len(asked))
            at = array.find(asked)
            hits = np.flatnonzero(at >= 0)
            best = np.searchsorted(hits, first[:-1])  # the first hit of a row is its longest
            got, verdicts = [], []
            for i, end in zip(best.tolist(), first[1:], strict=True):
                j = int(at[hits[i]]) if i < len(hits) and hits[i] < end else None
                got.append(None if j is None else array.rule(j))
                verdicts.append(default if j is None else "allow" if array.allow[j] else "block")
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string()), pa.array(verdicts, pa.string())], names=[*b.schema.names, "rule", "verdict"])

    return parsed.mapInArrow(probe, schema)
