"""Connected components of a graph given as a table of edges, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airgrid.llm.tasks import stored


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(arcs: DataFrame, keep_larger: bool) -> DataFrame:
    """Tie the neighbours of each node to its least neighbour (or itself); a node's neighbours never meet in one row."""
    least = arcs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    tied = arcs.join(least, "u")
    if keep_larger:
        return tied.filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.filter(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).union(
        least.filter(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node hangs from one other at most, and from none that hangs itself: then no round changes anything."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("hangs")).union(edges.select("v", F.lit(0)))
    found = ends.groupBy("node").agg(F.sum("hangs").alias("times"), F.min("hangs").alias("least"))
    return found.filter("times > 1 OR (times = 1 AND least = 0)").isEmpty()


def star_forest(edges: DataFrame) -> DataFrame:
    """(u, v) for every node u of ``edges(u, v)`` but the least of its component, which is v.

    Each round writes its edges to the shared folder; rounds end when the edges are stars, so a forest with no more than a few
    new edges takes few rounds, one without any takes none.
    """
    edges = stored(edges.filter(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    while not _are_stars(edges):
        large = _star(_both(edges), keep_larger=True).distinct()
        edges = stored(_star(large.filter(F.col("v") <= F.col("u")), keep_larger=False).distinct(), "edges")
    return edges


def members(forest: DataFrame) -> DataFrame:
    """(node, component) for every node of a forest of stars; the component is its least node."""
    return forest.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        forest.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its least node."""
    return members(star_forest(edges))
