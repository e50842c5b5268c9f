"""Connected components of a graph given as a table of links (large-star, small-star)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedpulse.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node reachable.

    Each step links a node's neighbours to the least of them, first the larger neighbours, then the
    smaller ones; after a few steps (the square of the logarithm of the longest path, at most) every
    link leads to its root. The least neighbour is an aggregate that is combined before the shuffle,
    and a node with many neighbours is a skewed join key, which Spark splits."""
    a, b = links.columns[:2]
    edges = _distinct(links.select(F.col(a).alias("a"), F.col(b).alias("b")))
    edges = stored(edges, "links")
    before = None
    while True:
        now = _checksum(edges)
        if now == before or not now[0]:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        before = now
        edges = _star(edges, large=True)
        edges = _star(edges, large=False)


def _distinct(e: DataFrame) -> DataFrame:
    """Links with the smaller end first, once each."""
    return (e.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def _checksum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _star(edges: DataFrame, large: bool) -> DataFrame:
    if large:   # the larger neighbours of a node go to the least of its neighbours and itself
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        least = stored(least.select(F.col("a").alias("u"), "m"), "links-least")
        j = edges.join(least, F.col("a") == F.col("u")).select(F.col("b").alias("v"), "m")
        return stored(_distinct(j.select(F.col("m").alias("a"), F.col("v").alias("b"))), "links")
    least = stored(edges.groupBy("b").agg(F.min("a").alias("m")).select(F.col("b").alias("u"), "m"), "links-least")
    j = edges.join(least, F.col("b") == F.col("u"))
    pairs = j.select(F.col("m").alias("a"), F.explode(F.array("a", "b")).alias("b"))
    return stored(_distinct(pairs), "links")
