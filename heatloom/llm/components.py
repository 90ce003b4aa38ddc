"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heatloom.llm.common import drop, stored


def components(links: DataFrame) -> DataFrame:
    """node, root for each node of links (a, b: bigint) but the roots; a root is the smallest node of its component.

    Every round is a few joins on nodes; its table is written to the shared folder. Nulls, loops and repeated links are
    left out. Stops when a round changes nothing, after a number of rounds that grows with the logarithm of the size.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are a table of their own, so that the join can split a hub's links over tasks
        least = stored(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # every node that has no smaller neighbour but itself stays a root; a node's links to smaller ones now meet at the smallest
        large = stored(large, "links")
        low = stored(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edges = edges, stored(small.union(low.select("a", F.col("m").alias("b"))).distinct(), "links")
        drop(before, least, large, low)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            roots.stored_at = edges.stored_at
            return roots
        state = now
