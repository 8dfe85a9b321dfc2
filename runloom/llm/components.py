"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def stars(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) of each node that isn't the smallest of its component.

    ``edges`` has columns a and b. A round hangs every node's larger neighbours
    on the smallest of its neighbourhood and then its smaller ones; that keeps
    components as they are and ends in stars, after a number of rounds that
    grows with the logarithm of a component's size. No round makes more links
    than the one before. A link is kept at its larger end, so that the many links of
    a centre meet in one place only where they are joined with a written table, which
    Spark can split. Links of each round are written to the shared folder.
    """
    spark = edges.sparkSession
    now, path = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        low, low_path = written(now.groupBy("u").agg(F.min("v").alias("m")), "least")
        above = low.withColumnRenamed("u", "v")
        if now.count() == low.count() and not now.join(above, "v", "left_semi").limit(1).count():
            dropped(spark, low_path)
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        hung = now.join(above, "v", "left").select("u", F.coalesce("m", "v").alias("v")).distinct()
        least = hung.groupBy("u").agg(F.min("v").alias("m"))
        small = hung.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after, after_path = written(small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "links")
        dropped(spark, path, low_path)
        now, path = after, after_path
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")


def contracted(nodes: DataFrame, links: DataFrame, name: str = "labelled") -> DataFrame:
    """``nodes`` (label, ...) with each label replaced by the smallest that ``links`` (a, b: labels) reach from it."""
    found, path = written(links, "near")
    if not found.limit(1).count():
        dropped(nodes.sparkSession, path)
        return nodes
    hung = stars(found)
    joined = nodes.join(hung, nodes["label"] == hung["node"], "left")
    return written(joined.select(*[F.coalesce("root", "label").alias("label") if c == "label" else nodes[c] for c in nodes.columns]), name)[0]
