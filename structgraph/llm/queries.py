"""Queries of the training-data operators, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from structgraph.llm import decontaminate, license, mixing, quality, quotes, secrets, simhash, toxicity, urlfilter, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    own = (
        quality.op1_quality, mixing.op2_mixing, urlfilter.op3_urlfilter, secrets.op4_secrets, license.op5_license,
        simhash.op6_simhash, quotes.op7_quotes, warc.op8_warc, toxicity.op9_toxicity, decontaminate.op10_decontaminate,
    )
    return {f.__name__: f for f in own} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    """The others use learned scores, XXH64, or floating-point tests; tests hold them against brute force."""
    return {"op3_urlfilter": urlfilter.OP3_SQL, "op5_license": license.OP5_SQL, "op8_warc": warc.OP8_SQL}
