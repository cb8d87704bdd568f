"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of letters, digits and ``_``.  A seed is a mask
over consecutive tokens; its hash covers the positions marked 1 and ignores
those marked 0, so a hit survives substitutions there.  The seeds of the
benchmark (test) are joined on equal hashes with the seeds at every position of
every whole text (training), and each diagonal that a hit is on is verified:
within some window of ``WINDOW`` aligned tokens (shorter items: the whole item)
at least ``SIMILARITY`` are equal.

Texts are read once, however large the benchmark is.  What meets no bit of a
bit array of the test hashes (``MOST_BITS`` at most, whatever their number)
can't be a hit and is left out before the join; of a text with such places the
seeds there and the tokens around them go on.  Of hits that follow one another
on a diagonal only the first is joined, so repetitive texts and items meet in
few rows.  The driver holds the bit array alone.  The test seeds and items are
broadcast up to ``BROADCAST_SEEDS`` and ``BROADCAST_TOKENS``, else shuffled.

Items of fewer than ``LEAST_TOKENS`` tokens, and null ones, can't be told from
chance and match nothing.  Null and empty texts match nothing.  Of the windows
of a text and an item the most similar counts, of equals the first in the text.
Repeated rows of documents give repeated rows; items with equal ids each count
by themselves.  Other columns of documents are neither read nor changed.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.llm import textbytes as tb
from structgraph.llm.common import free_name, map_arrow, materialize, table

WINDOW = 13
#: Whichever two of WINDOW tokens are replaced, one of these masks ignores both somewhere in the window.
MASKS = ("101110111", "1110111001", "1110010111")
#: For items shorter than the window: the same, for as many replacements as their length allows.
SHORT = ("111", "1101")
SIMILARITY = 0.8
LEAST_TOKENS = 5
#: Bits a test seed and probes of each in the bit array: under one of a million other seeds gets by.
SEED_BITS = 64
PROBES = 6
MOST_BITS = 1 << 28
BROADCAST_SEEDS = 500_000
BROADCAST_TOKENS = 4_000_000
BROADCAST_DIGESTS = 200_000
_WORD = np.zeros(256, bool)
_WORD[list(b"0123456789_ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")] = True


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Of each code point whether it is a letter, a digit or ``_``."""
    out = np.zeros(0x110000, bool)
    for block in range(0, 0x110000, 1 << 14):
        points = [p for p in range(block, block + (1 << 14)) if not 0xD800 <= p < 0xE000]
        out[[ord(c) for c in re.findall(r"\w", "".join(map(chr, points)))]] = True
    return out


def _word_bytes(data: np.ndarray) -> np.ndarray:
    mask = _WORD[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        b = [np.append(data, [0, 0, 0])[lead + i].astype(np.int32) & m for i, m in ((0, 0xFF), (1, 0x3F), (2, 0x3F), (3, 0x3F))]
        size = 2 + (b[0] >= 0xE0) + (b[0] >= 0xF0)
        point = np.select([size == 2, size == 3], [(b[0] & 0x1F) << 6 | b[1], (b[0] & 0x0F) << 12 | b[1] << 6 | b[2]], (b[0] & 0x07) << 18 | b[1] << 12 | b[2] << 6 | b[3])
        is_word = _letters()[np.minimum(point, 0x10FFFF)]
        for i in range(4):
            own = lead[(size > i) & is_word] + i
            mask[own[own < len(data)]] = True
    return mask


def batch_tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all tokens of a batch of texts, and of each text the place of its first (and the end)."""
    found, firsts, n = [np.empty(0, np.uint64)], [np.zeros(1, np.int64)], 0
    for _, own in tb.pieces(column):
        data, at = tb.text_bytes(tb.lowered(own))
        starts, ends = tb.runs(_word_bytes(data), at)
        out = np.empty(len(starts), np.uint64)
        for part in tb.blocks(starts, ends):
            a, b = starts[part], ends[part]
            out[part] = tb.Hashes(data, int(a[0]), int(b[-1])).of(a, b)
        found.append(out)
        firsts.append(n + np.searchsorted(starts, at[1:]))
        n += len(out)
    return np.concatenate(found), np.concatenate(firsts)


def seed_hashes(tokens: np.ndarray, mask: str, number: int) -> np.ndarray:
    """A hash of the unmasked tokens at every position."""
    n = len(tokens) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, (number + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1, np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = tb.mixed(out * np.uint64(0xD6E8FEB86659FD93) + tokens[i : i + n])
    return out


def _seeds(tokens: np.ndarray, first: np.ndarray, number: int, mask: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all texts of a batch and one mask: text, place in it, hash, and whether the place before has a seed too."""
    own = seed_hashes(tokens, mask, number)
    text = np.searchsorted(first, np.arange(len(own)), "right") - 1
    at = np.arange(len(own)) - first[text]
    whole = first[text + 1] - first[text] - at >= len(mask)
    return text, at, own, whole


def _row_keys(n: int, begun: int) -> np.ndarray:
    """Numbers of a task's rows: the same each time the task runs."""
    context = TaskContext.get()
    return (np.int64(context.partitionId() if context else 0) << np.int64(33)) + np.arange(begun, begun + n)


def items(benchmark: DataFrame) -> DataFrame:
    """``item``, ``item_id``, ``n`` and ``tokens`` (hashes) of the items that are long enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = 0
        for x in batches:
            tokens, first = batch_tokens(x.column("text"))
            n = np.diff(first)
            keep = np.flatnonzero(n >= LEAST_TOKENS)
            key = _row_keys(x.num_rows, begun)[keep]
            begun += x.num_rows
            own = [tokens[first[k] : first[k + 1]].tobytes() for k in keep]
            yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), x.column("item_id").take(pa.array(keep)), pa.array(n[keep], pa.int64()), pa.array(own, pa.binary())], ["item", "item_id", "n", "tokens"])

    return map_arrow(benchmark.select(F.col("item_id").cast("long"), "text"), run, "item long, item_id long, n long, tokens binary")


def benchmark_seeds(known: DataFrame) -> DataFrame:
    """``hash``, ``earlier`` (the hash one place before, if there is one), ``item``, ``place`` of every seed of ``items``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            for key, raw in zip(x["item"], x["tokens"], strict=True):
                tokens = np.frombuffer(raw, np.uint64)
                for k, mask in enumerate((*MASKS, *SHORT)):
                    if (mask in SHORT) == (len(tokens) < WINDOW):
                        h = seed_hashes(tokens, mask, k).view(np.int64)
                        yield pd.DataFrame({"hash": h, "earlier": pd.Series(h, dtype="Int64").shift(1), "item": key, "place": np.arange(len(h))})

    return known.select("item", "tokens").mapInPandas(run, "hash long, earlier long, item long, place long")


def _slots(hashes: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return hashes + np.uint64(probe) * (hashes >> np.uint64(32) | np.uint64(1)) & np.uint64(bits - 1)


def bit_table(seeds: DataFrame, n: int) -> np.ndarray:
    """Bytes with ``PROBES`` bits of each hash set, about ``SEED_BITS`` bits a seed and ``MOST_BITS`` at most."""
    bits = min(MOST_BITS, max(1 << 16, 1 << (SEED_BITS * n - 1).bit_length()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            h = x["hash"].to_numpy(np.int64).view(np.uint64)
            slots = np.unique(np.concatenate([_slots(h, k, bits) for k in range(PROBES)]))
            word, first = np.unique(slots >> np.uint64(6), return_index=True)
            if len(word):
                v = np.bitwise_or.reduceat(np.uint64(1) << (slots & np.uint64(63)), first)
                yield pd.DataFrame({"w": word.view(np.int64), "v": v.view(np.int64)})

    found = seeds.select("hash").mapInPandas(run, "w long, v long").groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(bits // 64, np.int64)
    out[found["w"].to_numpy(np.int64)] = found["v"].to_numpy(np.int64)
    return out.view(np.uint8)


def _maybe(hashes: np.ndarray, table_: np.ndarray) -> np.ndarray:
    """Places of the hashes whose bits are all set."""
    found = np.arange(len(hashes))
    for k in range(PROBES):
        slot = _slots(hashes[found], k, len(table_) * 8)
        found = found[table_[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1 == 1]
    return found


def candidates(documents: DataFrame, table_: np.ndarray, masks: tuple[int, ...], keep: tuple[str, ...]) -> DataFrame:
    """Texts with a seed that has its bit set: ``row``, columns ``keep``, ``n`` (tokens), ``hits`` and the tokens around them."""
    every, reach = (*MASKS, *SHORT), WINDOW

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun = 0
        for x in batches:
            tokens, first = batch_tokens(x.column("text"))
            parts = []
            near = np.zeros(len(tokens) + 1, np.int64)
            for k in masks:
                text, at, own, whole = _seeds(tokens, first, k, every[k])
                hit = _maybe(own, table_)
                hit = hit[whole[hit]]
                parts.append((text[hit], at[hit], own[hit], np.where(at[hit] > 0, own[hit - 1], 0)))
                np.add.at(near, np.maximum(hit - reach, first[text[hit]]), 1)
                np.add.at(near, np.minimum(hit + reach, first[text[hit] + 1]), -1)
            text, at, own, earlier = (np.concatenate([p[i] for p in parts]) for i in range(4))
            order = np.argsort(text, kind="stable")
            text, at, own, earlier = text[order], at[order], own[order], earlier[order]
            docs = np.unique(text)
            around = np.flatnonzero(np.cumsum(near)[:-1] > 0)
            of = np.searchsorted(first, around, "right") - 1
            cut = lambda values, owner: pa.array(np.append(np.searchsorted(owner, docs), len(values)), pa.int32())
            hits = pa.StructArray.from_arrays([pa.array(own.view(np.int64)), pa.array(earlier.view(np.int64), mask=at == 0), pa.array(at, pa.int64())], ["hash", "earlier", "place"])
            row = _row_keys(x.num_rows, begun)[docs]
            begun += x.num_rows
            if len(docs):
                kept = [x.column(c).take(pa.array(docs)) for c in keep]
                lists = [pa.ListArray.from_arrays(cut(around, of), pa.array(v)) for v in (around - first[of], tokens[around].view(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(row, pa.int64()), *kept, pa.array(np.diff(first)[docs], pa.int64()), pa.ListArray.from_arrays(cut(text, text), hits), *lists], ["row", *keep, "n", "hits", "places", "around"])

    own = documents.select(*keep, "text")
    fields = "".join(f"{c} {own.schema[c].dataType.simpleString()}, " for c in keep)
    return map_arrow(own, run, f"row long, {fields}n long, hits array<struct<hash: long, earlier: long, place: long>>, places array<long>, around array<long>")


def verify(places: np.ndarray, around: np.ndarray, n: int, item: np.ndarray, diagonal: int) -> tuple[float, int, int] | None:
    """Similarity, start and end of the first best window on a diagonal, if it suffices; tokens not around a hit count as different."""
    a, b = max(0, diagonal), min(n, diagonal + len(item))
    size = min(WINDOW, len(item))
    if b - a < size:
        return None
    lo, hi = np.searchsorted(places, (a, b))
    equal = np.zeros(b - a + 1, np.int64)
    equal[places[lo:hi] - a + 1] = around[lo:hi] == item[places[lo:hi] - diagonal]
    sums = np.cumsum(equal)
    sums = sums[size:] - sums[:-size]
    k = int(sums.argmax())
    if sums[k] < math.ceil(SIMILARITY * size - 1e-9):
        return None
    return float(sums[k]) / size, a + k, a + k + size


def _found(documents: DataFrame, benchmark: DataFrame, keep: tuple[str, ...]) -> DataFrame:
    """``row``, ``item``, columns ``keep``, ``item_id``, ``first_token``, ``end_token``, ``similarity`` of every diagonal that holds."""
    known = materialize(items(benchmark))
    about = known.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count_if(F.col("n") < WINDOW), F.count("*")).first()
    seeds = benchmark_seeds(known)
    masks = (*range(len(MASKS)),) * (about[2] > about[1]) + (*range(len(MASKS), len(MASKS) + len(SHORT)),) * (about[1] > 0)
    n_seeds = len(MASKS) * about[0]
    rows = materialize(candidates(documents, bit_table(seeds, n_seeds), masks or (0,), keep))
    seeds = F.broadcast(seeds) if n_seeds <= BROADCAST_SEEDS else seeds
    one = seeds.withColumnsRenamed({"earlier": "e", "place": "p"})
    asked = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    # of hits that follow one another on a diagonal the first
    met = asked.join(one, "hash").where("earlier is null OR e is null OR earlier <> e").select("row", "item", (F.col("place") - F.col("p")).alias("diagonal")).distinct()
    tests = known.select("item", "item_id", "tokens")
    tests = F.broadcast(tests) if about[0] <= BROADCAST_TOKENS else tests
    both = met.join(rows.select("row", *keep, "n", "places", "around"), "row").join(tests, "item")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            best = [verify(p, a, n, np.frombuffer(t, np.int64), d) for p, a, n, t, d in zip(x["places"], x["around"], x["n"], x["tokens"], x["diagonal"], strict=True)]
            holds = [b is not None for b in best]
            out = x.loc[holds, ["row", "item", *keep, "item_id"]]
            for i, c in enumerate(("similarity", "first_token", "end_token")):
                out[c] = [b[i] for b in best if b]
            yield out.astype({c: "Int64" for c in ("item_id", *(["doc_id"] if "doc_id" in keep else []))})

    fields = "".join(f"{c} {rows.schema[c].dataType.simpleString()}, " for c in keep)
    return both.select("row", "item", *keep, "item_id", "n", "places", "around", "tokens", "diagonal").mapInPandas(run, f"row long, item long, {fields}item_id long, similarity double, first_token long, end_token long")


def overlaps(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_token``, ``end_token``, ``similarity`` of every document and item that overlap."""
    found = _found(documents.select(F.col("doc_id").cast("long"), "text"), benchmark, ("doc_id",))
    best = found.groupBy("row", "item").agg(F.max(F.struct("similarity", (-F.col("first_token")).alias("first"), "end_token", "doc_id", "item_id")).alias("b"))
    return best.select("b.doc_id", "b.item_id", (-F.col("b.first")).alias("first_token"), "b.end_token", "b.similarity")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that overlap no benchmark item.

    Whether one does follows from its text, so documents go by the digest of
    the text; the digests found are broadcast if they are few.
    """
    name = free_name("digest", docs.columns)
    keyed = docs.withColumn(name, F.sha2("text", 256))
    found = _found(keyed.select(F.col(name).alias("digest"), "text"), table(spark, sf_dir, "benchmark"), ("digest",))
    gone = materialize(found.select(F.col("digest").alias(name)).distinct())
    few = gone.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS
    return keyed.join(F.broadcast(gone) if few else gone, name, "left_anti").select(*docs.columns)
