"""Connected components of an undirected graph held as a DataFrame of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.llm.common import materialize


def connected_components(links: DataFrame) -> DataFrame:
    """``node``, ``root`` (smallest node reachable) of every node of ``links(a, b)``.

    Alternating large-star and small-star steps: each turns the neighbours of
    a node into children of the smallest, so rounds grow with the logarithm of
    the node count.  Minima are combined before they are shuffled, no list of
    neighbours is ever built, and each round is checkpointed.
    """
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    before = None
    while True:
        # large star: v > u; every neighbour above a node moves to its least neighbour
        both = edges.select(F.col("v").alias("n"), F.col("u").alias("m")).unionByName(edges.select(F.col("u").alias("n"), F.col("v").alias("m")))
        least = both.groupBy("n").agg(F.min("m").alias("least")).select("n", F.least("least", "n").alias("least"))
        large = both.where("m > n").join(least, "n").select(F.col("m").alias("v"), F.col("least").alias("u")).where("v <> u").distinct()
        # small star: a node and its smaller neighbours move to the least of them
        below = large.groupBy("v").agg(F.min("u").alias("least"))
        joined = large.join(below, "v")
        small = joined.select(F.col("u").alias("v"), F.col("least").alias("u")).where("v <> u").unionByName(below.select("v", F.col("least").alias("u")))
        edges = materialize(small.distinct())
        # a star forest is a fixed point: no child is also a parent, and each has one parent
        state = edges.agg(F.count("*"), F.countDistinct("v"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
