"""Incremental refresh: a stream of changed files replaces their facts.

The state is a Parquet table of files by batch; ``current`` reads the last
text of every path, from which a graph can be built again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "path string, source string"


def follow(changes: DataFrame, table: str, checkpoint: str, available_now: bool = True):
    """Append each micro-batch of changed files (``path``, ``source``; null source: deleted) to ``table``.

    A batch is written under its own id, so a batch that is run again after a
    failure replaces itself.
    """

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.select("path", "source").write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    out = changes.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()


def current(spark: SparkSession, table: str) -> DataFrame:
    """The last text of every path that isn't deleted (of equal paths in a batch the greatest text)."""
    rows = spark.read.schema(SCHEMA + ", batch long").parquet(table)
    last = rows.groupBy("path").agg(F.max(F.struct("batch", F.col("source").isNull().alias("gone"), "source")).alias("last"))
    return last.where("NOT last.gone").select("path", "last.source")
