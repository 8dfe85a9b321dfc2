"""Flat token files and the scan that finds the documents in them.

A flat file is nothing but little-endian token ids, documents one after the
other, each ended by an end-of-document id. The scan looks at a file in blocks;
a vectorised search gives the separators of a block, and a prefix scan over the
blocks' sums tells how many tokens and documents lie before a block and how
much of its first document earlier blocks hold.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_or_empty, written

#: The id after the last of the byte-pair vocabulary: it ends a document.
END_OF_DOCUMENT = 50256
#: Tokens in a block, and bytes of a file that flat_files() makes.
BLOCK = 1 << 18
FILE_BYTES = 4 << 20

_encoders: dict[str, object] = {}


def _encoder(ranks_path: str):
    import public_tokenizers
    import tiktoken

    if ranks_path not in _encoders:
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _encoders[ranks_path] = tiktoken.Encoding("flat", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[ranks_path]


#: Longer texts are encoded in parts cut before a space that follows a letter, where no token can reach across.
PART = 1 << 16


def _parts(text: str) -> Iterator[str]:
    start = 0
    while len(text) - start > PART:
        cut = start + PART
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalpha() and cut + 1 < len(text) and text[cut + 1].isalpha()):
            cut += 1
        yield text[start:cut]
        start = cut
    yield text[start:]


def encode(text: str, ranks_path: str) -> np.ndarray:
    encoder = _encoder(ranks_path)
    return np.concatenate([np.asarray(encoder.encode_ordinary(p), np.int64) for p in _parts(text)])


def flat_files(docs: DataFrame, ranks_path: str, end: int = END_OF_DOCUMENT) -> DataFrame:
    """``docs`` (doc_id, text) as flat files: rows of file, content (16-bit ids) and doc_ids, in the order of the content.

    Each task makes files of its own, of about FILE_BYTES, from its rows as they
    come, so that nothing is shuffled; a lost task makes the same ones anew. The
    content has no index; doc_ids is a column beside it that the scan doesn't
    read. A null text is an empty document: a separator alone.
    """
    kind = dict(docs.dtypes)["doc_id"]
    closing = int(end).to_bytes(2, "little")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        parts: list[bytes] = []
        ids: list[pa.Array] = []
        size = made = 0

        def file() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array([task + made], pa.int64()), pa.array([b"".join(parts)], pa.binary()), pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), pa.concat_arrays(ids))],
                names=["file", "content", "doc_ids"],
            )

        for b in batches:
            for i, t in enumerate(b.column("text")):
                parts.append(encode(t.as_py(), ranks_path).astype("<u2").tobytes() + closing)
                ids.append(b.column("doc_id")[i : i + 1])
                size += len(parts[-1])
                if size >= FILE_BYTES:
                    yield file()
                    parts, ids, size, made = [], [], 0, made + 1
        if parts:
            yield file()

    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(pack, f"file long, content binary, doc_ids array<{kind}>")


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Real flat files under ``path`` as rows of file (their path) and content.

    A file must be under 2 GiB, the most that Spark's binary reader takes.
    """
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")


def scan_token_files(files: DataFrame, end: int = END_OF_DOCUMENT, width: int = 2, block: int = BLOCK) -> DataFrame:
    """file, ordinal, start and n_tokens of each document in flat files (rows of file and content).

    Tokens after the last separator of a file are a document too; an empty or null
    file has none. A separator right after another, or at the very start, ends an
    empty document. Files must hold whole tokens of ``width`` bytes.
    """
    kind = dict(files.dtypes)["file"].replace("bigint", "long")
    found = files.where(F.octet_length("content") > 0).select("file", "content")

    def separators(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids = np.frombuffer(b.column("content")[i].as_py(), f"<u{width}")
                for k, at in enumerate(range(0, len(ids), block)):
                    part = ids[at : at + block]
                    hits = np.flatnonzero(part == end)
                    yield pa.RecordBatch.from_arrays(
                        [b.column("file")[i : i + 1], pa.array([k], pa.int64()), pa.array([len(part)], pa.int64()), pa.array([hits.tolist()], pa.list_(pa.int64()))],
                        names=["file", "block", "size", "hits"],
                    )

    blocks = found.mapInArrow(separators, f"file {kind}, block long, size long, hits array<long>")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    last = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stitched = (
        blocks.withColumn("base", F.coalesce(F.sum("size").over(before), F.lit(0)))
        .withColumn("docs", F.coalesce(F.sum(F.size("hits")).over(before), F.lit(0)).cast("long"))
        .withColumn("open", F.coalesce(F.max(F.when(F.size("hits") > 0, F.col("base") + F.element_at("hits", -1) + 1)).over(before), F.lit(0)))
        .withColumn("ends", F.col("block") == F.max("block").over(last))
    )
    # ends of documents by their place in the file; the file's end counts if tokens follow its last separator
    ends = F.transform("hits", lambda h: h + F.col("base"))
    tail = F.greatest(F.col("open"), F.coalesce(F.get("ends_at", F.size("ends_at") - 1) + 1, F.lit(0)))
    whole = F.when(F.col("ends") & (tail < F.col("base") + F.col("size")), F.concat("ends_at", F.array(F.col("base") + F.col("size")))).otherwise(F.col("ends_at"))
    each = stitched.withColumn("ends_at", ends).withColumn("ends_at", whole).select("file", "docs", "open", "ends_at", F.posexplode("ends_at").alias("i", "stop"))
    start = F.when(F.col("i") == 0, F.col("open")).otherwise(F.get("ends_at", F.col("i") - 1) + 1)
    return each.select("file", (F.col("docs") + F.col("i")).alias("ordinal"), start.alias("start"), (F.col("stop") - start).alias("n_tokens"))


def token_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """doc_id and n_tokens of each row of ``docs`` (doc_id, text), counted in flat token files.

    The documents are made flat files, written to the shared folder as a table with a
    row per file, and those are scanned. A null or empty text has 0 tokens; rows stay one to one, repeated
    ones too; an empty table gives no rows; other columns aren't read.
    """
    made, _ = written(flat_files(docs, ranks_path), "token-files")
    found = scan_token_files(made.select("file", "content"))
    places = made.select("file", F.posexplode("doc_ids").alias("ordinal", "doc_id")).withColumn("ordinal", F.col("ordinal").cast("long"))
    return places.join(found, ["file", "ordinal"]).select("doc_id", "n_tokens")
