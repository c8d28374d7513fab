"""Connected components of a graph given as a table of edges, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize


def _star(edges: DataFrame) -> DataFrame:
    """edges: (u, v). For each u, its other neighbours point to its smallest neighbour, or to u if that is smaller.

    The smallest neighbour is an aggregate that Spark combines before the shuffle; the join back is on u alone, which
    Spark splits where one u has very many neighbours.
    """
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("c"), F.least("u", "m").alias("m"))
    return edges.join(least, F.col("u") == F.col("c")).select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b")


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): component is the smallest node reachable. edges: (a, b) of longs, any direction, no nulls.

    Nodes without an edge have no row. Every round is written to the shared folder, so the plan stays short, and takes the
    place of the one before; the rounds end when nothing changes, which takes about the logarithm of a component's width.
    """
    now = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a != b").distinct(), "edges")
    before = None
    while True:
        two_way = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(two_way).where("a > b")  # neighbours above their centre, and the centre itself, point to the least
        own = two_way.groupBy("u").agg(F.min("v").alias("v")).where("v < u").select(F.col("u").alias("a"), F.col("v").alias("b"))
        large = large.unionByName(own).distinct()
        down = large.select(F.col("a").alias("u"), F.col("b").alias("v"))
        small = _star(down).unionByName(down.groupBy("u").agg(F.min("v").alias("b")).select(F.col("u").alias("a"), "b")).distinct()
        last, now = now, materialize(small, "edges")
        discard(last)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % 1_000_000_007)).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component").unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
