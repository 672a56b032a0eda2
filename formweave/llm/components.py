"""Connected components of a link table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import cut, hot_keys, meet


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every larger neighbour of a node points to the node's least neighbour (or to the node itself)."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.count("*").alias("c"), F.least(F.min("b"), F.first("a")).alias("m"))
    across = meet(both.where("b > a"), least, ["a"], "b", hot_keys(least, "a", "c", 2 * total))
    return across.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    """The smaller neighbours of a node, and the node, point to the least of them."""
    least = edges.groupBy("a").agg(F.count("*").alias("c"), F.min("b").alias("m"))
    across = meet(edges, least, ["a"], "b", hot_keys(least, "a", "c", total)).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return across.union(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component) for each node of the links (a, b); component is the least node that it reaches.

    Null ends and links of a node to itself are dropped; nodes without a link do
    not appear.  Each round is cut by a checkpoint; no round gathers a node's links
    in one row, and a hub's links are dealt over many tasks.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    edges = cut(edges)
    total, seen = edges.count(), None
    for _ in range(most):
        edges = cut(_small_star(_large_star(edges, total), total))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
        total = seen[0]
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
