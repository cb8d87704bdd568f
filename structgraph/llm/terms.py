"""Hashed terms of whole texts, and their selection for small models."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.llm import textbytes as tb
from structgraph.llm.common import bounded_sample, map_arrow, materialize

#: Terms are hashed into so many buckets.
BUCKETS = 1 << 18
#: Terms with a smaller G statistic are left to chance.
LEAST_G = 8.0
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?\"'()[]{}<>|#*$%&-_/\\+=~`^@")] = True
#: Marks at a word's end count up to so many characters.
_MARKS = 8


def text_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a batch of texts: the text and the id of every term of every word, and the words of every text.

    A word gives itself without the marks around it, its first four and five
    letters, and the marks at its end.
    """
    data, at = tb.text_bytes(tb.lowered(column))
    starts, ends = tb.words(data, at)
    text = tb.owners(starts, at)
    n_words = np.bincount(text, minlength=len(at) - 1)
    inner = ~_EDGE[data] & ~tb._SPACE[data]
    inner_at, inner_before = np.flatnonzero(inner), tb.before(inner)
    lead = (data & 0xC0) != 0x80
    lead_at, lead_before = np.flatnonzero(lead), tb.before(lead)
    rows, found = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for part in tb.blocks(starts, ends):
        a, b, of = starts[part], ends[part], text[part]
        hashes = tb.Hashes(data, int(a[0]), int(b[-1]))
        first, last = inner_before[a], inner_before[b]
        has = last > first
        wa = inner_at[first[has]]
        wb = inner_at[last[has] - 1] + 1
        char = lead_before[wa]
        n = lead_before[wb] - char
        tail = a.copy()
        tail[has] = wb
        mark = tail < b
        spans = [(of[has], wa, wb), (of[mark], tail[mark], np.minimum(b, tail + _MARKS)[mark])]
        spans += [(of[has][n > k], wa[n > k], lead_at[char[n > k] + k]) for k in (4, 5)]
        for salt, (own, x, y) in enumerate(spans, 1):
            rows.append(own)
            found.append((hashes.of(x, y, salt) % np.uint64(BUCKETS)).astype(np.int64))
    return np.concatenate(rows), np.concatenate(found), n_words


def batch_terms(column: pa.Array) -> list[np.ndarray]:
    """Sorted distinct term ids of every text of a batch."""
    out: list[np.ndarray] = []
    for _, part in tb.pieces(column):
        rows, ids, _ = text_terms(part)
        both = np.unique(rows * BUCKETS + ids)
        out += np.split((both % BUCKETS).astype(np.int32), np.searchsorted(both, np.arange(1, len(part)) * BUCKETS))
    return out


def term_ids(text: str | None) -> np.ndarray:
    """Sorted distinct term ids of a whole text (null: none)."""
    return batch_terms(pa.array([text], pa.string()))[0]


class Matcher:
    """Finds which of ``chosen`` (sorted term ids) whole texts have."""

    def __init__(self, chosen: np.ndarray) -> None:
        self.n = max(1, len(chosen))
        self.place = np.full(BUCKETS, -1, np.int64)
        self.place[chosen] = np.arange(len(chosen))

    def match(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of every text's terms, one after another, the text of each, and the words of every text."""
        found, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for first, part in tb.pieces(column):
            rows, ids, words = text_terms(part)
            own = self.place[ids]
            found.append(np.unique((rows[own >= 0] + first) * self.n + own[own >= 0]))
            counts.append(words)
        both = np.concatenate(found)
        return both % self.n, both // self.n, np.concatenate(counts)


def labelled_terms(documents: DataFrame, labels: DataFrame, label: str, rows: int, classes: int, keep: int) -> pd.DataFrame:
    """``label`` and ``terms`` of at most ``rows`` labelled documents, by doc_id.

    ``labels`` has one row per doc_id.  The sample goes by a hash of doc_id,
    so it is the same each time; its size bounds the broadcast, the checkpoint
    and what the driver receives: counts per term and class, then of each
    document only the terms that ``select_terms`` would keep.
    """
    sample = bounded_sample(labels.select("doc_id", F.col(label).cast("int").alias("label")).where("doc_id is not null and label is not null"), "doc_id", rows)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            own = pa.array([t.tobytes() for t in batch_terms(x.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), x.column("label"), own], ["doc_id", "label", "terms"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((classes, BUCKETS), np.int32)
        for x in batches:
            for y, t in zip(x["label"], x["terms"], strict=True):
                total[y, np.frombuffer(t, np.int32)] += 1
        y, t = np.nonzero(total)
        yield pd.DataFrame({"label": y.astype(np.int32), "term": t.astype(np.int32), "n": total[y, t].astype(np.int64)})

    own = documents.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(sample.select(F.col("doc_id").cast("long"), "label")), "doc_id").select("doc_id", "label", "text")
    found = map_arrow(own, extract, "doc_id long, label int, terms binary")
    found = materialize(found.groupBy("doc_id", "label").agg(F.min("terms").alias("terms")))
    seen, sizes = np.zeros((classes, BUCKETS)), np.zeros(classes)
    for r in found.groupBy("label").agg(F.count("*").alias("n")).collect():
        sizes[r["label"]] = r["n"]
    counts = found.mapInPandas(count, "label int, term int, n long").groupBy("label", "term").agg(F.sum("n").cast("int").alias("n")).toPandas()
    seen[counts["label"].to_numpy(), counts["term"].to_numpy()] = counts["n"].to_numpy()
    chosen = _choose(seen, sizes, keep)

    def restrict(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in batches:
            yield x.assign(terms=[t[np.isin(t, chosen, assume_unique=True)].tobytes() for t in (np.frombuffer(t, np.int32) for t in x["terms"])])

    out = found.mapInPandas(restrict, found.schema).toPandas().sort_values("doc_id", kind="stable")
    return out.assign(terms=[np.frombuffer(t, np.int32) for t in out["terms"]]).reset_index(drop=True)


def select_terms(terms: list[np.ndarray], labels: np.ndarray, classes: int, keep: int) -> np.ndarray:
    """Ids of the terms that say most about the class (G statistic), sorted."""
    seen = np.zeros((classes, BUCKETS))
    for c in range(classes):
        if own := [t for t, y in zip(terms, labels, strict=True) if y == c]:
            seen[c] = np.bincount(np.concatenate(own), minlength=BUCKETS)
    return _choose(seen, np.bincount(labels, minlength=classes).astype(float), keep)


def _choose(seen: np.ndarray, sizes: np.ndarray, keep: int, least: int = 4) -> np.ndarray:
    total, n = seen.sum(0), max(1.0, sizes.sum())
    with np.errstate(divide="ignore", invalid="ignore"):
        g = np.zeros(BUCKETS)
        for c in range(len(sizes)):
            for have, of in ((seen[c], total), (sizes[c] - seen[c], n - total)):
                g += np.where(have > 0, have * np.log(have * n / (of * max(sizes[c], 1e-9))), 0)
    g[total < least] = 0
    order = np.lexsort((np.arange(BUCKETS), -g))[:keep]
    return np.sort(order[g[order] > LEAST_G]).astype(np.int32)


def packed(terms: list[np.ndarray], chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in ``chosen`` of every text's terms, one after another, and the text of each."""
    if not terms or not len(chosen):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    rows = np.repeat(np.arange(len(terms)), [len(t) for t in terms])
    flat = np.concatenate(terms)
    at = np.minimum(np.searchsorted(chosen, flat), len(chosen) - 1)
    hit = chosen[at] == flat
    return at[hit], rows[hit]
