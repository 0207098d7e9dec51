"""Connected components by alternating large-star and small-star steps; nothing but two numbers per round is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clientele.llm.shared import Scratch, stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Tie every larger neighbour of a node to the smallest node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
    return both.filter("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Tie a node and its smaller neighbours to the smallest of them (edges have a < b)."""
    least = stored(edges.groupBy("b").agg(F.min("a").alias("m")))
    moved = edges.join(least, "b")
    own = least.select(F.col("m").alias("a"), "b")
    others = moved.filter("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return own.unionByName(others).distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round is written to the shared folder, so a lost executor costs a part of one round. Hubs are aggregated
    before the shuffle and their joins are ordinary skew-splittable ones.
    """
    spark = edges.sparkSession
    with Scratch(spark) as scratch:
        edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
        state = _state(edges)
        while state[0]:
            with Scratch(spark) as step:
                moved = step.keep(stored(_small_star(stored(_large_star(edges)))))
            scratch.drop(edges)
            edges, before, state = moved, state, _state(moved)
            if state == before:
                break
        scratch.keep(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
