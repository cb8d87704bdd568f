"""Graphs on disk: Parquet by graph key, a manifest, and cell updates.

Tables: ``nodes``, ``cells``, ``edges`` (with ``is_cross``).  A store is
written to a staging folder; the old one is moved aside, the new one moved to
its place, the old one deleted.  A store that a crash left aside is moved back
by the next ``read``.  The manifest has rows and hash of every partition.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.session import materialize

FORMAT_VERSION = 1


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p, jvm.org.apache.hadoop.fs.Path


def fingerprint(df: DataFrame) -> DataFrame:
    """``graph_key``, ``rows``, ``content_hash``: the rows' hashes added up, so order doesn't count and repetition does."""
    row = F.xxhash64(*sorted(c for c in df.columns if c != "graph_key")).cast("decimal(20,0)")
    own = df.groupBy(F.col("graph_key").cast("string").alias("graph_key"))
    return own.agg(F.count("*").alias("rows"), F.sum(row).cast("string").alias("content_hash"))


def _move(spark: SparkSession, old: str, new: str) -> None:
    fs, a, Path = _fs(spark, old)
    if not fs.rename(a, Path(new)):
        raise OSError(f"cannot move {old} to {new}")


def _swap(spark: SparkSession, staging: str, path: str) -> None:
    """``staging`` in place of ``path``; at any moment one of old and new is whole on disk."""
    fs, final, Path = _fs(spark, path)
    aside = f"{path}.old"
    if fs.exists(final):
        fs.delete(Path(aside), True)
        _move(spark, path, aside)
    _move(spark, staging, path)
    fs.delete(Path(aside), True)


def recover(spark: SparkSession, path: str) -> bool:
    """Move a store back that a crash left aside; whether there was one."""
    path = path.rstrip("/")
    fs, final, Path = _fs(spark, path)
    if fs.exists(final) or not fs.exists(Path(f"{path}.old")):
        return False
    _move(spark, f"{path}.old", path)
    return True


def write(tables: dict[str, DataFrame], path: str, graph_type: str = "code") -> None:
    """Write all tables, a manifest of each partition's hash, and the format row."""
    spark = next(iter(tables.values())).sparkSession
    path = path.rstrip("/")
    staging = f"{path}.{uuid4().hex}.tmp"
    for name, df in tables.items():
        order = [c for c in ("id", "node_id", "src") if c in df.columns]
        df.sortWithinPartitions("graph_key", *order).write.partitionBy("graph_key").parquet(f"{staging}/{name}")
    # what was written is read again, so the manifest says what is on disk
    parts = [fingerprint(spark.read.parquet(f"{staging}/{n}")).withColumn("table", F.lit(n)) for n in tables]
    reduce(DataFrame.unionByName, parts).coalesce(1).write.parquet(f"{staging}/_manifest")
    spark.createDataFrame([(FORMAT_VERSION, graph_type)], "format_version int, graph_type string").coalesce(1).write.parquet(f"{staging}/_meta")
    _swap(spark, staging, path)


def verify(spark: SparkSession, path: str) -> DataFrame:
    """Partitions that differ from the manifest, on either side: ``table``, ``graph_key``, ``rows``, ``content_hash``, ``said`` (of the manifest)."""
    said = spark.read.parquet(f"{path}/_manifest").select("table", "graph_key", "rows", "content_hash")
    names = [r["table"] for r in said.select("table").distinct().orderBy("table").collect()]
    there = reduce(DataFrame.unionByName, [fingerprint(spark.read.parquet(f"{path}/{n}")).withColumn("table", F.lit(n)) for n in names]).select(*said.columns)
    missing, strange = said.exceptAll(there).withColumn("said", F.lit(True)), there.exceptAll(said).withColumn("said", F.lit(False))
    return missing.unionByName(strange)


def read(spark: SparkSession, path: str, verified: bool = True) -> dict[str, DataFrame]:
    """The tables of a store; raises if the format or (``verified``) any partition doesn't match the manifest."""
    path = path.rstrip("/")
    recover(spark, path)
    meta = spark.read.parquet(f"{path}/_meta").first()
    if meta["format_version"] != FORMAT_VERSION:
        raise ValueError(f"format {meta['format_version']}, not {FORMAT_VERSION}")
    if verified and (bad := verify(spark, path).first()):
        raise ValueError(f"table {bad['table']}, partition {bad['graph_key']} doesn't match its manifest")
    names = [r["table"] for r in spark.read.parquet(f"{path}/_manifest").select("table").distinct().orderBy("table").collect()]
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}


def node(spark: SparkSession, path: str, node_id: int) -> DataFrame:
    """The stored node with an id; files are sorted by id, so few row groups are read."""
    return spark.read.parquet(f"{path}/nodes").where(F.col("id") == node_id)


def edges(spark: SparkSession, path: str, cross: bool | None = None) -> DataFrame:
    """``src``, ``dst``, ``category`` of all stored edges, of one side only if asked for."""
    found = spark.read.parquet(f"{path}/edges")
    return (found if cross is None else found.where(F.col("is_cross") == cross)).select("src", "dst", "category")


def upsert_cell(cells: DataFrame, nodes: DataFrame, new: DataFrame) -> DataFrame:
    """``cells`` with each row of ``new(node_id, cell_type, …)`` in place of the first cell of that node and
    type, or added; raises if a node isn't there."""
    known = nodes.select(F.col("id").alias("node_id")).distinct()
    if not new.join(known, "node_id", "left_anti").isEmpty():
        raise KeyError("a node isn't in the graph")
    first = cells.join(new.select("node_id", "cell_type").distinct(), ["node_id", "cell_type"], "left_semi").groupBy("node_id", "cell_type").agg(F.min("ord").alias("ord"))
    left = cells.join(first, ["node_id", "cell_type", "ord"], "left_anti")
    end = cells.groupBy("node_id").agg((F.max("ord") + 1).alias("next"))
    placed = new.drop("ord").join(first, ["node_id", "cell_type"], "left").join(end, "node_id", "left")
    placed = placed.withColumn("ord", F.coalesce("ord", "next", F.lit(0)).cast(cells.schema["ord"].dataType)).drop("next")
    return left.unionByName(placed.select(*cells.columns))


def remove_cell(cells: DataFrame, keys: DataFrame) -> tuple[DataFrame, bool]:
    """``cells`` without those of ``keys(node_id, cell_type)``, and whether there were any."""
    hit = not cells.join(keys, ["node_id", "cell_type"], "left_semi").isEmpty()
    return (cells.join(keys, ["node_id", "cell_type"], "left_anti") if hit else cells), hit


def replace_partitions(df: DataFrame, path: str, table: str) -> None:
    """Overwrite the graph keys that ``df`` has in one table of a store, and the manifest after them.

    ``df`` may be derived from the store.  Between the two steps the store
    doesn't verify; running the call again mends it.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    df = materialize(df)
    keys = df.select(F.col("graph_key").cast("string").alias("graph_key")).distinct()
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_key").parquet(f"{path}/{table}")
    manifest = spark.read.parquet(f"{path}/_manifest")
    other = manifest.join(keys.withColumn("table", F.lit(table)), ["table", "graph_key"], "left_anti")
    own = fingerprint(spark.read.parquet(f"{path}/{table}")).join(keys, "graph_key", "left_semi").withColumn("table", F.lit(table))
    staging = f"{path}/_manifest.{uuid4().hex}.tmp"
    materialize(other.unionByName(own)).coalesce(1).write.parquet(staging)
    _swap(spark, staging, f"{path}/_manifest")


def nodes_json(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.to_json(F.struct("id", "kind", "name", "qname", "confidence"), {"ignoreNullFields": "false"}).alias("value"))


def edges_json(edges: DataFrame) -> DataFrame:
    return edges.select(F.to_json(F.struct(F.col("src").alias("from"), F.col("dst").alias("to"), "category")).alias("value"))
