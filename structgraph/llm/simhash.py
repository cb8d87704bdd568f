"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  Two fingerprints
that differ in two bits at most differ in the upper segment by one bit at most,
and then share one of its 32 variants with one position wiped out, or by two,
and then their lower segments are equal.  So each *distinct* fingerprint is
indexed under 32 one-wildcard variants of the upper segment and under its whole
lower segment, keys are joined on equality and candidates are verified by the
Hamming distance.

Keys are counted first; a key of two members names both in its count.  Only
members of keys with more are joined, and a bit array of those keys, of the
same size whatever the input, leaves most others out of that second shuffle.

A key that many fingerprints share isn't paired within itself.  Its members go
on to an exact second index: all fingerprints one bit away from each, and
itself.  Two fingerprints are within two bits if and only if they meet under
such a key, and at most 65 can meet under one, so linking them to the least of
them costs a fixed number of rows each, however large a group is.

Texts: A-Z lower-cased, words of ``[^\\x20\\x09-\\x0D]+``, three-word shingles
with repeats (fewer words: the whole sequence), XXH64 with seed 42.  Null,
empty and blank texts have fingerprint zero and link like any other.  Repeated
rows give repeated rows.  Rows with a null doc_id get a component like others,
but never name one; a component of such rows only has a null name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from structgraph.llm.common import bit_array, free_name, map_arrow, materialize, may_be_in, table
from structgraph.llm.components import connected_components

#: Members of keys with more of them than this go to the exact second index.
CROWDED = 32
WORDS = 3
_BLOCK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Signed 64-bit fingerprint of a whole text."""
    return _fingerprint((text or "").encode("utf-8", "surrogatepass"))


def _fingerprint(text: bytes) -> int:
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= WORDS:
        return int(np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64).view(np.int64)[0])
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[: -WORDS])).tolist()
    stops = (ends[WORDS - 1 :] - 1).tolist()
    digest, counts, n = xxhash.xxh64_intdigest, np.zeros(64, np.int64), len(stops)
    for i in range(0, n, _BLOCK):
        h = np.array([digest(joined[a:b], 42) for a, b in zip(starts[i : i + _BLOCK], stops[i : i + _BLOCK], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.int64)[0])


def fingerprints(documents: DataFrame, *keep: str) -> DataFrame:
    """``doc_id`` and ``fp`` of every row, and its text columns ``keep``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            text = x.column("text")
            fps = np.fromiter((_fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"") for t in text), np.int64, len(text))
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(fps), *(x.column(c) for c in keep)], ["doc_id", "fp", *keep])

    schema = StructType([StructField("doc_id", LongType()), StructField("fp", LongType()), *(StructField(c, StringType()) for c in keep)])
    return map_arrow(documents.select(F.col("doc_id").cast("long"), "text", *keep), run, schema)


def _keys(fps: DataFrame) -> DataFrame:
    """``fp`` and its keys: the wiped position and what is left of the upper segment, and (at place 32) the lower segment."""
    wiped = "transform(sequence(0, 31), j -> shiftleft(cast(j as bigint), 32) | (shiftrightunsigned(fp, 32) & ~shiftleft(1L, j)))"
    return fps.select("fp", F.explode(F.expr(f"concat({wiped}, array(shiftleft(32L, 32) | (fp & 4294967295L)))")).alias("key"))


def links(fps: DataFrame, crowded: int = CROWDED) -> DataFrame:
    """Links ``a``, ``b`` between distinct fingerprints that connect all within two bits.

    Every pair of fingerprints within two bits is connected; pairs in crowded
    variants are connected through the least fingerprint that meets them.
    """
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2
    # checkpoints of small rows have few partitions, and each row here becomes 33
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = _keys(fps.repartition(parts, "fp"))
    shared = materialize(keys.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1"))
    pairs = shared.where("n = 2").select("a", "b").where(near)
    more = shared.where("n > 2").select("key", "n")
    members = materialize(keys.where(may_be_in(bit_array(more, "key"), "key")).join(more, "key"))
    few = members.where(F.col("n") <= crowded)
    some = few.select("key", F.col("fp").alias("a")).join(few.select("key", F.col("fp").alias("b")), "key").where(F.col("a") < F.col("b")).where(near).select("a", "b")
    # all that is one bit away, and itself
    many = members.where(F.col("n") > crowded).select("fp").distinct()
    ball = many.select("fp", F.explode(F.expr("concat(array(fp), transform(sequence(0, 63), j -> fp ^ shiftleft(1L, j)))")).alias("key"))
    met = ball.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).where("n > 1")
    star = ball.join(met.where("n > 2").select("key", "a"), "key").select("a", F.col("fp").alias("b")).where("a <> b")
    return pairs.unionByName(some).unionByName(met.where("n = 2").select("a", "b")).unionByName(star).distinct()


def _grouped(documents: DataFrame, *keep: str) -> tuple[DataFrame, DataFrame]:
    """The fingerprints of all rows; of each distinct one ``fp``, its least doc_id and the ``root`` of its component."""
    found = materialize(fingerprints(documents, *keep))
    distinct = materialize(found.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = materialize(connected_components(links(distinct.select("fp"))))
    return found, distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``fp`` and ``component_id`` of every row."""
    found, own = _grouped(documents)
    named = own.groupBy("root").agg(F.min("least").alias("component_id"))
    named = own.select("fp", "root").join(named, "root").select("fp", "component_id")
    return found.join(named, "fp").select("doc_id", "fp", "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component one row, that of the least doc_id (null after all others).

    Rows go by a key of doc_id, text and the other columns, so rows that share
    a doc_id, or have none, are told apart; of one doc_id the least key stays.
    Rows whose key has no bit in the bit array of keys that go, or that several
    rows have, stay without a shuffle of their texts.
    """
    name = free_name("row_key", docs.columns)
    key = F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256), F.hex(F.xxhash64(*docs.columns)))
    keyed = docs.select("*", key.alias(name))
    found, own = _grouped(keyed, name)
    rows = found.groupBy(name, "doc_id", "fp").agg(F.count("*").alias("n")).join(own.select("fp", "root"), "fp")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.col(name).alias("k"))
    rows = materialize(rows.select(name, "n", "root", order.alias("o")))
    first = rows.groupBy("root").agg(F.min("o").alias("first"))
    gone = rows.join(first, "root").where(F.col("o.k") != F.col("first.k")).select(name)
    gone = materialize(gone)
    asked = bit_array(gone.unionByName(rows.where("n > 1").select(name)), name)
    some = keyed.where(may_be_in(asked, name)).join(gone, name, "left_anti").dropDuplicates([name])
    return keyed.where(~may_be_in(asked, name)).unionByName(some.select(*keyed.columns)).select(*docs.columns)
