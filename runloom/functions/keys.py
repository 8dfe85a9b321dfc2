"""Keys: formats, order, common prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def padded(prefix: str, number: Column, width: int) -> Column:
    """``prefix`` and the number with leading zeros; longer numbers keep all their digits."""
    digits = number.cast("string")
    return F.concat(F.lit(prefix), F.lpad(digits, F.greatest(F.length(digits), F.lit(width)), "0"))


def code_unit_order(key: Column) -> Column:
    """A sort key that orders by UTF-16 code units; Spark's own order is by UTF-8 bytes, that is by code points."""
    return F.encode(key, "UTF-16BE")


def common_prefix(a: Column, b: Column) -> Column:
    """Characters that both keys start with; whole characters, so none is split."""
    length = F.least(F.length(a), F.length(b))
    same = F.aggregate(
        F.sequence(F.lit(1), F.greatest(length, F.lit(1))),
        F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")),
        lambda s, i: F.struct(
            (s["n"] + F.when(s["on"] & (i <= length) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1))), 1).otherwise(0)).alias("n"),
            (s["on"] & (i <= length) & (F.substring(a, i, F.lit(1)) == F.substring(b, i, F.lit(1)))).alias("on"),
        ),
        lambda s: s["n"],
    )
    return F.when(a.isNull() | b.isNull(), 0).otherwise(same)
