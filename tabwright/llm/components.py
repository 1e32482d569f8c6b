"""Connected components by alternating large-star and small-star steps; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) of all nodes in `links` (a, b); the root is the smallest node of the component.

    Each step reduces neighbourhoods to their minimum map-side before it shuffles; a node with a third of
    all links meets its minimum in a skew join that adaptive execution splits.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    edges = stored(edges.distinct(), "links")
    while not _stars(edges):
        edges = stored(_small_star(_large_star(edges)), "links")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return stored(roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct(), "components")


def _stars(edges: DataFrame) -> bool:
    """Does every node have one parent at most, and no parent a parent of its own?"""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionAll(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    seen = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return seen.where((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0))).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u points to the minimum of u's neighbourhood."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
    joined = edges.join(least, F.col("a") == F.col("u"))
    moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b"))
    return moved.unionAll(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()
