"""Toxicity scores from a factorization machine over hashed terms.

A text is the set of its hashed terms (words, their first letters, edge
marks).  The score is the logistic of

    w0 + sum_i w_i + sum_{i<j} <v_i, v_j>

so a pair of terms can count although neither does alone.  The model is
fitted on at most ``FIT_ROWS`` labelled rows, and every text is scored whole.

Null and empty texts get the score of w0 alone.  Rows with equal doc_id are
scored each by its own text; a null doc_id is scored and never used to fit.
Of several labels of a document the largest counts.  Without labels (or with
one class only) every score is the base rate, 0 if there is none.  Columns
other than doc_id, text, toxic are neither needed nor changed, whatever their
names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from structgraph.llm.common import free_name, map_arrow, table
from structgraph.llm.terms import Matcher, labelled_terms, packed, select_terms

#: At most so many labelled rows are used to fit (bounds driver memory).
FIT_ROWS = 16_000
TERMS = 4096
FACTORS = 4
THRESHOLD = 0.3


@dataclass
class FactorizationMachine:
    bias: float
    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def margin(self, terms: list[np.ndarray]) -> np.ndarray:
        return self._margin(*packed(terms, self.terms), len(terms))[0]

    def _margin(self, at: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        k = self.factors.shape[1]
        sums = np.zeros((n, k))
        out = self.bias + np.bincount(rows, self.weights[at], n)
        for f in range(k):
            v = self.factors[at, f]
            sums[:, f] = np.bincount(rows, v, n)
            out += 0.5 * (sums[:, f] ** 2 - np.bincount(rows, v * v, n))
        return out, sums

    def score(self, terms: list[np.ndarray]) -> np.ndarray:
        return _logistic(self.margin(terms))

    def score_at(self, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts, by the places of their terms and the text of each."""
        return _logistic(self._margin(at, rows, n)[0])


def _logistic(margin: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def fit(terms: list[np.ndarray], labels: np.ndarray, keep: int = TERMS, factors: int = FACTORS, rounds: int = 40, seed: int = 7) -> FactorizationMachine:
    """Adagrad on logistic loss; the same input gives the same model."""
    labels = np.asarray(labels, np.int64)
    if not len(labels) or labels.min() == labels.max():
        rate = float(labels.mean()) if len(labels) else 0.0
        bias = -30.0 if rate == 0 else 30.0
        return FactorizationMachine(bias, np.empty(0, np.int32), np.empty(0), np.empty((0, factors)))
    chosen = select_terms(terms, labels, 2, keep)
    at, rows = packed(terms, chosen)
    rng, n, m = np.random.default_rng(seed), len(labels), len(chosen)
    rate = labels.mean()
    fm = FactorizationMachine(float(np.log(rate / (1 - rate))), chosen, np.zeros(m), rng.normal(0, 0.02, (m, factors)))
    seen_b, seen_w, seen_v = 1e-6, np.full(m, 1e-6), np.full((m, factors), 1e-6)
    starts = np.searchsorted(rows, np.arange(n + 1))
    size = max(64, n // 32)
    for _ in range(rounds):
        order = rng.permutation(n)
        for i in range(0, n, size):
            part = np.sort(order[i : i + size])
            take = np.concatenate([np.arange(starts[p], starts[p + 1]) for p in part]) if len(part) else np.empty(0, int)
            own, local = at[take], np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            margin, sums = fm._margin(own, local, len(part))
            err = (_logistic(margin) - labels[part]) / len(part)
            gb = err.sum()
            gw = np.bincount(own, err[local], m) + 1e-5 * fm.weights
            seen_b += gb * gb
            seen_w += gw * gw
            for f in range(factors):
                gv = np.bincount(own, err[local] * (sums[local, f] - fm.factors[own, f]), m) + 1e-4 * fm.factors[:, f]
                seen_v[:, f] += gv * gv
                fm.factors[:, f] -= 0.03 * gv / np.sqrt(seen_v[:, f])
            fm.weights -= 0.15 * gw / np.sqrt(seen_w)
            fm.bias -= 0.05 * gb / np.sqrt(seen_b)
    return fm


def held_out(doc_id: str = "doc_id"):
    """Rows whose crc32(doc_id as text) mod 4 is 2 (null doc_id: false)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit_on(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> FactorizationMachine:
    """Fit on labelled rows that aren't held out."""
    own = labels.where(~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    found = labelled_terms(documents, own.withColumn("toxic", (F.col("toxic") > 0).cast("int")), "toxic", rows, 2, TERMS)
    return fit(list(found["terms"]), found["label"].to_numpy(np.int64))


def score(documents: DataFrame, model: FactorizationMachine, column: str = "toxicity", text: bool = True) -> DataFrame:
    """All columns of ``documents`` (``text`` only if asked for) and their score under the name ``column`` (double, 0 to 1)."""
    kept = [f for f in documents.schema.fields if text or f.name != "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(model.terms)
        for x in batches:
            at, rows, _ = own.match(x.column("text"))
            scores = pa.array(model.score_at(at, rows, x.num_rows), pa.float64())
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in kept), scores], [*(f.name for f in kept), column])

    return map_arrow(documents, run, StructType([*kept, StructField(column, DoubleType())]))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_on(documents, table(spark, sf_dir, "labels"))
    scored = score(documents, model, text=False)
    return scored.select("doc_id", held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that score below the threshold, columns as they were."""
    column = free_name("toxicity", docs.columns)
    scored = score(docs, fit_on(docs, table(spark, sf_dir, "labels")), column)
    return scored.where(F.col(column) < THRESHOLD).select(*docs.columns)
