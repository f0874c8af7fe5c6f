"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, join_hot


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return join_hot(both, least, ["a"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """edges: a > b in every row, as _large_star leaves them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = join_hot(edges, least, ["a"]).where(F.col("b") > F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of each node that has an edge; root is the smallest node of its component, itself included.

    edges has the long columns a and b, in any direction, repeated or not; loops
    are ignored and null ends are not allowed. Each round is a few shuffles of
    the edges and is written to the shared folder; the number of rounds grows
    with the logarithm of the longest path. A star's centre with any number of
    edges is pre-aggregated, and the join on it is one that Spark can split.
    """
    now = cut(edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = _state(now)
    for _ in range(rounds if before[0] else 0):
        then = cut(_small_star(_large_star(now).where(F.col("a") != F.col("b")).distinct()).where(F.col("a") != F.col("b")).distinct(), "edges")
        after = _state(then)
        discard(now)
        now, before, last = then, after, before
        if after == last:
            break
    else:
        if before[0]:
            raise RuntimeError(f"components: no fixed point after {rounds} rounds")
    roots = now.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
    return roots.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
