"""Connected components of an edge table, by alternating large and small stars.

Each round rewires every node's neighbours to the smallest one seen, so the graph becomes a
forest of stars in a logarithmic number of rounds. Every step is a partial + final minimum per
node and an equi-join; no neighbourhood is ever collected. Rounds are written to the shared
folder, and the end is reached when a round changes nothing (its row count and hash sum).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweave.session import cut_lineage


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour (or itself)."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    moved = both.where(F.col("b") > F.col("a")).join(least, "a")
    return moved.select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node itself, is tied to the smallest of them."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, component)`` for every node of an edge: the smallest node it is connected with.

    Node ids are of any ordered type; loops and repeated edges do not matter."""
    stars = cut_lineage(edges.select(F.col(a).alias("a"), F.col(b).alias("b"))
                        .where(F.col("a") != F.col("b")).distinct(), "edges")
    before = None
    while (state := _state(stars)) != before:
        before = state
        stars = cut_lineage(_small_star(_large_star(stars)), "stars")
    loops = edges.where(F.col(a) == F.col(b)).select(F.col(a).alias("node"))
    linked = stars.select(F.col("a").alias("node"), F.col("b").alias("component"))
    roots = stars.select(F.col("b").alias("node")).unionByName(loops).distinct()
    alone = roots.join(linked, "node", "left_anti").select("node", F.col("node").alias("component"))
    return linked.unionByName(alone)
