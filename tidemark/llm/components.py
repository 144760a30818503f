"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.session import stable


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Hang the larger (or the smaller) neighbours of every node on the least node around it."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if larger:
        both = both.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        hung = both.where("v > u").join(least, "u").select(F.greatest("v", "m").alias("b"), F.least("v", "m").alias("a"))
    else:
        # every edge is (a < b); b is the node, its smaller neighbours and itself go to the least one
        least = edges.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        near = edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
        hung = near.join(least, "u").select(F.col("v").alias("b"), F.col("m").alias("a")).unionByName(
            least.select(F.col("u").alias("b"), F.col("m").alias("a")))
    return hung.where("a < b").select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b: long); component is the least node of its group.

    A link to itself, a NULL end or a repeated link adds nothing.  Every round reads and writes
    tables in the shared folder; sums over a node's links are combined before the shuffle, so a
    node with very many links is no burden.  The number of rounds grows as the logarithm of the
    longest path.
    """
    edges = stable(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    before = mark(edges)
    while before[0]:
        edges = stable(_star(_star(edges, True), False), "links")
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("component"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
