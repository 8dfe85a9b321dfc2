"""Mixing sources to target weights.

Sizes are summed per source, the sums give each source a target, target over
size is its repetition rate, and a document is emitted floor(rate) times plus
one more time when a draw that its hash seeds falls under the fraction.
Everything is DataFrame expressions; what is shuffled is one partial sum per
source and task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, text_or_empty, written

#: Up to so many sources are broadcast (some MB); more are joined by a shuffle.
BROADCAST_SOURCES = 65_536


def word_count(text: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def draw(seed: int) -> Column:
    """A number in [0, 1) from the md5 of seed and doc_id, or of the text's md5 where there is no id: 52 bits, the same in any engine."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.md5(F.encode(text_or_empty(), "UTF-8")))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 13)
    return F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: int) -> DataFrame:
    """Per source: source_size and target.

    Targets go by weight until they reach ``most`` times the source's size; what
    is left over is dealt anew among the others. That ends at one level L with
    target = min(most * size, weight * L): with sources in order of the level at
    which they fill up, a source is full if it fills before the level that all
    earlier ones, taken as full, leave to the rest.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.row_number().over(by_name)
    weighed = sums.select(
        "source", "source_size", F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"),
        place.alias("place"),
    )
    order = Window.orderBy((F.col("source_size") / F.col("w")).asc(), "place").rowsBetween(Window.unboundedPreceding, -1)
    caps = F.coalesce(F.sum(F.col("source_size") * most).over(order), F.lit(0))
    used = F.coalesce(F.sum("w").over(order), F.lit(0))
    level = (F.lit(float(share)) * F.sum("source_size").over(one) - caps) / (F.sum("w").over(one) - used)
    full = F.col("source_size") * most <= F.col("w") * F.col("level")
    left = F.min(F.when(~F.col("full"), F.struct(F.col("source_size") / F.col("w"), "place", "level"))).over(one)
    return (
        weighed.withColumn("level", level).withColumn("full", full).withColumn("left", left)
        .select("source", "source_size", F.when(F.col("full"), (F.col("source_size") * most).cast("double")).otherwise(F.col("w") * F.col("left.level")).alias("target"))
    )


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies.

    copies is how often the mix takes the document, at most ``most`` times.
    A null text has size 0, a null source is a source of its own, an empty table
    stays empty, a source without words gets target 0 and no copies. Repeated
    rows of one id get the same draw, hence the same number of copies; rows
    without id draw by their text. Columns of ``docs`` other than doc_id, text and source don't matter.
    """
    sized, _ = written(docs.select("doc_id", "source", word_count().alias("size"), draw(seed).alias("draw")), "mix-sizes")
    targets = source_targets(sized, weights, share, most)
    if sized.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    return (
        sized.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
        .select("d.doc_id", "d.source", "size", "source_size", "target", copies_at().alias("copies"))
    )


def copies_at() -> Column:
    """How often a row with source_size, target and draw is taken: floor(rate), and once more by its draw."""
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    return (F.floor(rate) + (F.col("draw") < rate - F.floor(rate)).cast("long")).cast("long")


def emit(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 17) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as mix() takes it, with its columns as they are.

    Only sums per source are shuffled; texts stay where they are read. Nulls, repeats
    and empty tables are as in mix(); columns may have any names.
    """
    sized = docs.select("source", word_count().alias("size"))
    targets, _ = written(source_targets(sized, weights, share, most), "mix-targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "source", draw(seed).alias("draw"))
    joined = rows.alias("d").join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source"))).select("row", "draw", "source_size", "target")
    return joined.select("row", F.explode(F.array_repeat(F.lit(1), copies_at().cast("int"))).alias("copy")).select("row.*")
