"""32-bit FNV-1a of a key's UTF-8 bytes, seeded, as one expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the hash.
BASIS, PRIME, MASK = 2166136261, 16777619, 4294967295


def key_bytes(key: Column) -> Column:
    """The UTF-8 bytes as an array of numbers."""
    digits = F.hex(F.encode(key, "UTF-8"))
    count = F.octet_length(key)
    return F.when(count == 0, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.conv(F.substring(digits, i * 2 + 1, F.lit(2)), 16, 10).cast("long"))
    )


def fnv1a_each(key: Column, hashes: Column) -> Column:
    """The hashes of a key for seeds 0, 1, ...: all go through its bytes together."""
    start = F.transform(F.sequence(F.lit(0), hashes - 1), lambda seed: F.lit(BASIS).cast("long").bitwiseXOR(seed.cast("long")))
    return F.aggregate(key_bytes(key), start, lambda hs, b: F.transform(hs, lambda h: (h.bitwiseXOR(b) * F.lit(PRIME)).bitwiseAND(F.lit(MASK).cast("long"))))


def fnv1a(key: Column, seed: Column) -> Column:
    start = F.lit(BASIS).cast("long").bitwiseXOR(seed.cast("long"))
    return F.aggregate(key_bytes(key), start, lambda h, b: (h.bitwiseXOR(b) * F.lit(PRIME)).bitwiseAND(F.lit(MASK).cast("long")))
