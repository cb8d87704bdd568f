"""Corpus pipeline: each stage works on all that the one before kept.

toxicity drops documents that score as toxic, simhash keeps one document of
each group of near copies, benchmark drops documents that overlap a benchmark
item, secrets replaces secrets in the texts, mixing adds each document's
domain memberships and its rate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from structgraph.llm import decontaminate, mixing, secrets, simhash, toxicity
from structgraph.llm.common import shared_dir

STAGES = [
    ("toxicity", toxicity.keep_clean),
    ("simhash", simhash.keep_one),
    ("benchmark", decontaminate.drop_contaminated),
    ("secrets", secrets.redact_secrets),
    ("mixing", mixing.mix),
]

#: Learned scores, 64-bit XXH64 fingerprints and token hashes have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet and read again."""
    from uuid import uuid4

    root = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{name}")
        docs = spark.read.parquet(f"{root}/{name}")
    return docs
