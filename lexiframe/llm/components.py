"""Connected components of an edge table: alternating large-star / small-star rounds.

Every round only groups, joins and writes narrow edge rows; no component is gathered anywhere, so a component of any
size costs no task more than its share of edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node of ``edges`` (columns a, b: long); root is the least node that is reachable.

    Self-loops, repeated and reversed edges are harmless; nodes without an edge are not listed; no edges give an
    empty table.  Raises when ``max_rounds`` do not suffice (they cover chains far beyond 2^20 nodes)."""
    now = written(edges.where(F.col("a") != F.col("b")).select(
        F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    mark = _mark(now)
    for _ in range(max_rounds):
        if mark[0] == 0:
            break
        for star in (_large_star, _small_star):
            least = _least(now)
            moved = written(star(now, least), "cc-edges")
            forget(least)
            forget(now)
            now = moved
        last, mark = mark, _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("connected components did not settle")
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root")).distinct()


def _mark(edges: DataFrame) -> tuple:
    """Two numbers that tell whether a round changed the (distinct) edges."""
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.expr("bit_xor(xxhash64(u, v))").alias("h")).first()
    return row["n"], row["h"]


def _least(edges: DataFrame) -> DataFrame:
    """u and m, the least smaller neighbour of u: a table of its own, so that the join with it can split the edges of a hub."""
    return written(edges.groupBy("u").agg(F.min("v").alias("m")), "cc-least")


def _large_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    linked = both.where(F.col("v") > F.col("u")).join(least, "u", "left")
    return linked.select(F.col("v").alias("u"), F.coalesce("m", "u").alias("v")).distinct()


def _small_star(edges: DataFrame, least: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, is linked to the least of them."""
    moved = edges.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()
