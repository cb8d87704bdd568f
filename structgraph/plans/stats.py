"""Aggregates over graphs and over collections of build results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.registries import CONFIDENCE, EDGE_CATEGORIES, NODE_KINDS


def counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: nodes, distinct nodes, edges, cross edges."""
    n = nodes.agg(F.count("*").alias("nodes"), F.countDistinct("id").alias("distinct_nodes"))
    cross = F.count_if("is_cross") if "is_cross" in edges.columns else F.lit(0)
    return n.join(edges.agg(F.count("*").alias("edges"), F.coalesce(cross, F.lit(0)).cast("long").alias("cross_edges")), how="cross")


def by_kind(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("kind").agg(F.count("*").alias("n"))


def by_confidence(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("confidence").agg(F.count("*").alias("n"))


def majority(nodes: DataFrame, column: str) -> DataFrame:
    """The most frequent value, if more than half (integer division) have it."""
    own = nodes.groupBy(column).agg(F.count("*").alias("n"))
    best = own.agg(F.max_by(F.col(column), F.struct("n", (-F.col(column)))).alias("value"), F.max("n").alias("n"), F.sum("n").alias("total"))
    return best.where("n > total div 2").select("value", "n")


def prefixes(nodes: DataFrame, length: int = 10, uses: int = 3) -> DataFrame:
    """Parent prefixes of qualified names that are long and used enough."""
    parts = F.split("qname", "::")
    own = nodes.where(F.size(parts) > 1).select(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "::").alias("prefix"))
    return own.where(F.length("prefix") >= length).groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= uses)


def spread(df: DataFrame, column: str) -> DataFrame:
    """min, median, p90 (the element at place floor(0.9 n)), max, n.

    Exact places come from a distributed sort by ranges and block offsets;
    only the counts of the blocks reach the driver.
    """
    own = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    ranked = own.groupBy("v").agg(F.count("*").alias("c"))
    from pyspark.sql.window import Window as W

    blocks = ranked.repartitionByRange("v").withColumn("block", F.spark_partition_id())
    inside = blocks.withColumn("upto", F.sum("c").over(W.partitionBy("block").orderBy("v")))
    before = inside.groupBy("block").agg(F.sum("c").alias("own")).withColumn("before", F.sum("own").over(W.orderBy("block")) - F.col("own"))
    placed = inside.join(before.select("block", "before"), "block").withColumn("upto", F.col("upto") + F.col("before"))
    n = own.agg(F.count("*")).scalar()
    at = lambda k: F.min(F.when(F.col("upto") > k, F.col("v")))
    mid = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return placed.agg(F.min("v").alias("min"), mid.alias("median"), at(F.floor(n * F.lit(9) / 10)).alias("p90"), F.max("v").alias("max"), F.coalesce(F.sum("c"), F.lit(0)).cast("long").alias("n"))


def shares(df: DataFrame, key: str) -> DataFrame:
    """``key``, ``n`` and ``percent`` of the total (one window over the groups, which are few)."""
    from pyspark.sql.window import Window as W

    own = df.groupBy(key).agg(F.count("*").alias("n"))
    return own.select(key, "n", F.round(F.col("n") * 100.0 / F.sum("n").over(W.partitionBy(F.lit(1))), 4).alias("percent"))


def of_kind(nodes: DataFrame, kind: int) -> DataFrame:
    """One row, ``n``: how many nodes of a kind."""
    return nodes.where(F.col("kind") == kind).agg(F.count("*").alias("n"))


def shared_names(df: DataFrame, name: str, repo: str, least: int = 2) -> DataFrame:
    """``name`` and ``repos`` of the names that ``least`` repositories or more have."""
    return df.groupBy(F.col(name).alias("name")).agg(F.countDistinct(repo).alias("repos")).where(F.col("repos") >= least)


def first_per_group(df: DataFrame, group: str, order: str, most: int) -> DataFrame:
    """At most ``most`` rows of each group by ``order``, for display."""
    from pyspark.sql.window import Window as W

    k = F.row_number().over(W.partitionBy(group).orderBy(order))
    return df.withColumn("_k", k).where(F.col("_k") <= most).drop("_k")


def sweep(spark: SparkSession, path: str) -> DataFrame:
    """Build results, one JSON row each: ``repo_spec, ok, elapsed_s, size_mb, node_count, edge_count, cross_edge_count``."""
    return spark.read.schema("repo_spec string, ok boolean, elapsed_s double, size_mb double, node_count long, edge_count long, cross_edge_count long").json(path)


def slowest(rows: DataFrame, seconds: float = 30.0, most: int = 30) -> DataFrame:
    """Results that took longer than ``seconds``, slowest first."""
    return rows.where(F.col("elapsed_s") > seconds).orderBy(F.desc("elapsed_s"), "repo_spec").limit(most)


def near_empty(rows: DataFrame, nodes: int = 100) -> DataFrame:
    """Good results with fewer than ``nodes`` nodes, fewest first."""
    return rows.where(F.col("ok") & (F.col("node_count") < nodes)).orderBy("node_count", "repo_spec")


def most_crossed(rows: DataFrame, most: int = 30) -> DataFrame:
    """Results with cross edges, most first."""
    return rows.where("cross_edge_count > 0").orderBy(F.desc("cross_edge_count"), "repo_spec").limit(most)


def pivot_kinds(df: DataFrame, row: str, kinds: list) -> DataFrame:
    """A row per ``row`` and a column per kind with their count."""
    return df.groupBy(row).pivot("kind", kinds).agg(F.count(F.lit(1))).fillna(0)


def misses(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Expected (repo, kind) without a node: left join, 0 where none."""
    n = found.groupBy("repo", "kind").agg(F.count("*").alias("n"))
    return expected.join(n, ["repo", "kind"], "left").select("repo", "kind", F.coalesce("n", F.lit(0)).alias("n")).where("n = 0")


def by_language(sweep: DataFrame) -> DataFrame:
    """Totals of sweep rows (``ok, elapsed_s, node_count, edge_count, cross_edge_count``)."""
    return sweep.agg(F.count_if("ok").alias("ok"), F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"), F.sum("cross_edge_count").alias("cross_edges"))


def _label(column, names: dict[int, str], unknown: str):
    table = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return F.coalesce(F.element_at(table, column), F.concat(F.lit(unknown), column.cast("string")))


def kind_name(column):
    return _label(column, NODE_KINDS, "kind_")


def category_name(column):
    return _label(column, EDGE_CATEGORIES, "cat_")


def confidence_name(column):
    return _label(column, CONFIDENCE, "confidence_")
