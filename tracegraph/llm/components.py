"""Connected components of a link table by alternating star contraction; every step is a join and an aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tracegraph.llm.common import land


def components(links: DataFrame) -> DataFrame:
    """Rows (node, root) for every node of ``links`` (a, b) that is not the least of its component.

    Each round hangs the larger neighbours of every node below its least neighbour, then the smaller
    ones; rounds grow with the logarithm of the longest chain. Minima are partial aggregates laid
    down before they are joined back, so a node with very many links is split like any skewed join.
    """
    edges = land(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = land(both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")), "star")
        large = land(both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "star")
        least = land(large.groupBy("a").agg(F.min("b").alias("m")), "star")
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = land(moved.union(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(now) == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = tuple(now)
