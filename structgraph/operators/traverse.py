"""Traversal by frontiers: one join per level, each level checkpointed.

A level is joined to the stored edges, so pass a table that is cheap to scan
(a stored graph, a checkpoint).  Frontier and visited nodes are broadcast while
their counted rows are few, so edges aren't shuffled then; else both sides are
shuffled by node, and the engine may split a hub's edges.  Only counts reach
the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.session import materialize, small


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    """Out-edges of a node, duplicates kept."""
    return edges.where(F.col("src") == node).select(F.col("dst").alias("id"), "category")


def both_ways(edges: DataFrame, node: int) -> DataFrame:
    """Out- and in-edges of a node with their direction."""
    out = edges.where(F.col("src") == node).select(F.lit("out").alias("direction"), F.col("dst").alias("id"), "category")
    return out.unionByName(edges.where(F.col("dst") == node).select(F.lit("in").alias("direction"), F.col("src").alias("id"), "category"))


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    down = edges.select(F.col("src").alias("id"), F.col("dst").alias("next"))
    up = edges.select(F.col("dst").alias("id"), F.col("src").alias("next"))
    return {"down": down, "up": up, "both": down.unionByName(up)}[direction]


def reach(edges: DataFrame, seeds: DataFrame, depth: int, direction: str = "down", follow: tuple[int, ...] | None = None) -> DataFrame:
    """``source``, ``id``, ``depth`` (fewest hops) of all within ``depth`` hops of each seed (column ``id``), seeds excluded."""
    if follow is not None:
        edges = edges.where(F.col("category").isin(*follow))
    steps = _steps(edges, direction)
    levels = [materialize(seeds.select(F.col("id").alias("source"), "id").distinct().withColumn("depth", F.lit(0)))]
    n = total = levels[0].count()
    for d in range(1, depth + 1):
        found = steps.join(small(levels[-1].select("source", "id"), n), "id").select("source", F.col("next").alias("id")).distinct()
        visited = small(reduce(DataFrame.unionByName, levels).select("source", "id"), total)
        level = materialize(found.join(visited, ["source", "id"], "left_anti").withColumn("depth", F.lit(d)))
        n = level.count()
        if not n:
            break
        total += n
        levels.append(level)
    return reduce(DataFrame.unionByName, levels).where("depth > 0")


def shortest_path(edges: DataFrame, start: int, end: int) -> list[int] | None:
    """Node ids of a shortest path, direction ignored, however long; of several the one with the smallest predecessors.

    What a level finds can only be new or in the two levels before it, so the
    nodes visited earlier aren't looked at again.
    """
    spark = edges.sparkSession
    steps = _steps(edges, "both")
    if steps.where(F.col("id").isin(start, end)).select("id").distinct().count() < len({start, end}):
        return None
    if start == end:
        return [start]
    levels = [spark.createDataFrame([(start, None)], "id long, before long")]
    sizes = [1]
    while True:
        found = steps.join(small(levels[-1].select("id"), sizes[-1]), "id").groupBy(F.col("next").alias("id")).agg(F.min("id").alias("before"))
        recent = small(reduce(DataFrame.unionByName, levels[-2:]).select("id"), sum(sizes[-2:]))
        level = materialize(found.join(recent, "id", "left_anti"))
        n, met = level.agg(F.count("*"), F.count_if(F.col("id") == end)).first()
        if not n:
            return None
        levels.append(level)
        sizes.append(n)
        if met:
            path = [end]
            for one in reversed(levels[1:]):
                path.append(one.where(F.col("id") == path[-1]).first()["before"])
            return path[::-1]


def distances(edges: DataFrame, start: int, depth: int) -> DataFrame:
    """``id`` and ``depth`` of all nodes within ``depth`` undirected hops."""
    seeds = edges.sparkSession.createDataFrame([(start,)], "id long")
    return reach(edges, seeds, depth, "both").select("id", "depth")


def parent_chain(nodes: DataFrame) -> DataFrame:
    """``id``, ``ancestor``, ``distance``: every node's ancestors, however many.

    Chains double: those of full length are joined to the chains of their last
    ancestor, so rounds grow with the logarithm of the depth.  In a cycle each
    ancestor counts once, at its least distance.
    """
    chain = materialize(nodes.where("parent_id is not null").select("id", F.col("parent_id").alias("ancestor"), F.lit(1).alias("distance")).distinct())
    length, n = 1, chain.count()
    while True:
        last = chain.where(F.col("distance") == length)
        more = chain.select(F.col("id").alias("ancestor"), F.col("ancestor").alias("higher"), F.col("distance").alias("d"))
        longer = last.join(small(more, n), "ancestor").select("id", F.col("higher").alias("ancestor"), (F.col("distance") + F.col("d")).alias("distance"))
        grown = materialize(chain.unionByName(longer).groupBy("id", "ancestor").agg(F.min("distance").alias("distance")))
        if (now := grown.count()) == n:
            return grown
        chain, n, length = grown, now, length * 2


def flows(nodes: DataFrame, edges: DataFrame, entry_kinds: tuple[int, ...], depth: int = 6) -> DataFrame:
    """``key``, ``source``, ``id``, ``depth``: what each entry node reaches, if that is two nodes or more.

    The key is the lower-case name with ``_`` for blanks; of several entries
    with one key the largest id wins.
    """
    entry = nodes.where(F.col("kind").isin(*entry_kinds)).select("id", F.replace(F.lower("name"), F.lit(" "), F.lit("_")).alias("key"))
    found = reach(edges, entry, depth)
    enough = found.groupBy("source").agg(F.count("*").alias("n")).where("n >= 2")
    last = entry.join(enough, entry["id"] == enough["source"], "left_semi").groupBy("key").agg(F.max("id").alias("source"))
    return found.join(last, "source").select("key", "source", "id", "depth")
