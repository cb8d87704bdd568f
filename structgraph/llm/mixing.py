"""Mixing to target weights by soft membership.

A classifier fitted on the labelled table gives every document a posterior
over domains (softmax over hashed terms).  Document rates r_i >= 0 are then
fitted by projected gradients so that the expected tokens of each domain d
meet its target:

    minimise 1/2 sum_d (sum_i r_i t_i p_id - T_d)^2 / A_d,   r_i >= 0

with t_i the tokens of document i and A_d the expected tokens there are.  In
the inner product weighted by t_i the gradient of r_i is p_i . g with g of D
numbers, g_d = (S_d - T_d) / A_d.  Steps are projected lazily: the steps of all
rounds add up to one vector of D numbers, ``lean``, and a document's rate is
the projection of 1 - p_i . lean on r_i >= 0.  So rates start at one, no state
of documents is kept or shuffled between rounds, and of all rates that fit
equally well those nearest to one are found.  A round is one pass that combines
D sums and the D by D curvature of the documents with a rate above zero, which
scales the step; a step that doesn't bring the fit closer is halved.

Rounds go on until the residual is ``TOLERANCE`` of the target tokens.  Where
no rates >= 0 reach the targets, a pull of ``PULL`` towards rates of one makes
the nearest fit unique, and rounds end there.  Rates that haven't settled after
``ROUNDS`` raise an error, so none is returned that misses what can be reached.

Targets are shares of ``budget`` (by default all tokens), so documents keep a
rate of about share wanted / share there.  Rates are expectations: 0.4 keeps
four of ten such documents, 2.3 repeats one.

Words are runs of anything but ASCII white space.  Null and empty texts have no
tokens, the posterior of the bias, and a rate like any document of that
posterior.  Repeated rows and null ids count as any row.  An empty table gives
an empty result; without labels the posterior is uniform.  Of several labels of
a document the least quality and the most toxicity count.  Input columns stay
whatever their names; where one has the name of a new column, that gets a ``_``
behind.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from structgraph.llm.common import free_name, map_arrow, materialize, table
from structgraph.llm.terms import Matcher, labelled_terms, packed, select_terms

#: Domains of the labels table, and the share of tokens wanted of each.
DOMAINS = ("good", "poor", "toxic")
TARGETS = (0.90, 0.08, 0.02)
#: At most so many labelled rows are used to fit (bounds driver memory).
FIT_ROWS = 16_000
TERMS = 6144
ROUNDS = 200
TOLERANCE = 1e-8
PULL = 1e-8


@dataclass
class DomainClassifier:
    terms: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, terms: list[np.ndarray]) -> np.ndarray:
        return self.posterior_at(*packed(terms, self.terms), len(terms))

    def posterior_at(self, at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
        """Of ``n`` texts, by the places of their terms and the text of each."""
        logits = np.tile(self.bias, (n, 1))
        for d in range(len(self.bias)):
            logits[:, d] += np.bincount(rows, self.weights[at, d], n)
        logits -= logits.max(1, keepdims=True)
        out = np.exp(np.clip(logits, -30, 0))
        return out / out.sum(1, keepdims=True)


def fit(terms: list[np.ndarray], labels: np.ndarray, classes: int, keep: int = TERMS, rounds: int = 25, seed: int = 11) -> DomainClassifier:
    """Softmax regression by Adagrad; the same input gives the same model."""
    if not len(labels):
        return DomainClassifier(np.empty(0, np.int32), np.empty((0, classes)), np.zeros(classes))
    chosen = select_terms(terms, labels, classes, keep)
    at, rows = packed(terms, chosen)
    n, m, rng = len(labels), len(chosen), np.random.default_rng(seed)
    share = (np.bincount(labels, minlength=classes) + 0.5) / (n + 0.5 * classes)
    out = DomainClassifier(chosen, np.zeros((m, classes)), np.log(share))
    seen_w, seen_b = np.full((m, classes), 1e-6), np.full(classes, 1e-6)
    starts = np.searchsorted(rows, np.arange(n + 1))
    size = max(64, n // 32)
    for _ in range(rounds):
        order = rng.permutation(n)
        for i in range(0, n, size):
            part = order[i : i + size]
            take = np.concatenate([np.arange(starts[p], starts[p + 1]) for p in part])
            own, local = at[take], np.repeat(np.arange(len(part)), starts[part + 1] - starts[part])
            logits = np.stack([out.bias[d] + np.bincount(local, out.weights[own, d], len(part)) for d in range(classes)], 1)
            p = np.exp(logits - logits.max(1, keepdims=True))
            err = p / p.sum(1, keepdims=True)
            err[np.arange(len(part)), labels[part]] -= 1
            err /= len(part)
            for d in range(classes):
                g = np.bincount(own, err[local, d], m) + 1e-4 * out.weights[:, d]
                seen_w[:, d] += g * g
                out.weights[:, d] -= 0.1 * g / np.sqrt(seen_w[:, d])
            g = err.sum(0)
            seen_b += g * g
            out.bias -= 0.05 * g / np.sqrt(seen_b)
    return out


def fit_on(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> DomainClassifier:
    own = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).when(F.col("quality").isNotNull(), 1)
    found = labelled_terms(documents, own.select("doc_id", domain.alias("domain")), "domain", rows, len(DOMAINS), TERMS)
    return fit(list(found["terms"]), found["label"].to_numpy(np.int64), len(DOMAINS))


def memberships(documents: DataFrame, model: DomainClassifier, names: tuple[str, ...] = DOMAINS, text: bool = True) -> DataFrame:
    """All columns of ``documents`` (``text`` only if asked for), ``n_tokens`` (words) and ``p_<domain>``."""
    kept = [f for f in documents.schema.fields if text or f.name != "text"]
    added = [free_name(c, documents.columns) for c in ("n_tokens", *(f"p_{d}" for d in names))]
    schema = StructType([*kept, StructField(added[0], LongType()), *(StructField(c, DoubleType()) for c in added[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Matcher(model.terms)
        for x in batches:
            at, rows, words = own.match(x.column("text"))
            p = model.posterior_at(at, rows, x.num_rows)
            new = [pa.array(words, pa.int64()), *(pa.array(p[:, d], pa.float64()) for d in range(len(names)))]
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in kept), *new], [*(f.name for f in kept), *added])

    return map_arrow(documents, run, schema)


def _rates(p: np.ndarray, lean: np.ndarray) -> np.ndarray:
    """Rates of the posteriors in the rows of ``p``."""
    return np.maximum(0.0, 1.0 - p @ lean)


def rate(columns: list[str], lean: np.ndarray) -> Column:
    """The same as a column: the posteriors are in ``columns``."""
    pull = sum((F.col(c) * float(x) for c, x in zip(columns, lean, strict=True)), F.lit(0.0))
    return F.greatest(F.lit(0.0), 1.0 - pull)


@dataclass
class _Sums:
    """Over all documents at some rates: expected tokens of each domain, curvature, tokens weighted by squared rates."""

    tokens: np.ndarray
    curvature: np.ndarray
    squares: float


def _sums(soft: DataFrame, names: tuple[str, ...], lean: np.ndarray) -> _Sums:
    p, n = [f"p_{d}" for d in names], len(names)
    own = soft.select(F.col("n_tokens").cast("double").alias("t"), *p, rate(p, lean).alias("r"))
    pairs = [(i, j) for i in range(n) for j in range(i, n)]
    parts = [F.sum(F.col("t") * F.col("r") * F.col(c)) for c in p]
    parts += [F.sum(F.when(F.col("r") > 0, F.col("t") * F.col(p[i]) * F.col(p[j]))) for i, j in pairs]
    found = [x or 0.0 for x in own.agg(*parts, F.sum(F.col("t") * F.col("r") * F.col("r"))).first()]
    curvature = np.zeros((n, n))
    for (i, j), x in zip(pairs, found[n:-1], strict=True):
        curvature[i, j] = curvature[j, i] = x
    return _Sums(np.array(found[:n]), curvature, found[-1])


def fit_rates(soft: DataFrame, targets: tuple[float, ...] = TARGETS, names: tuple[str, ...] = DOMAINS, budget: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """``lean``, from which ``rate`` follows; see the module."""
    return settle(lambda lean: _sums(soft, names, lean), targets, budget, rounds, tolerance)


def settle(sums: Callable[[np.ndarray], _Sums], targets: tuple[float, ...], budget: float | None = None, rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> np.ndarray:
    """The rounds; ``sums`` makes the pass over the documents."""
    lean = np.zeros(len(targets))
    now = sums(lean)
    if not now.tokens.sum() > 0:
        return lean
    want = np.asarray(targets, float) / sum(targets) * (now.tokens.sum() if budget is None else budget)
    scale = PULL * np.maximum(now.tokens, 1e-9 * now.tokens.sum())
    close = tolerance * max(1.0, want.sum())
    loss = lambda s, x: s.squares / 2 + want @ x + scale @ x**2 / 2
    slope = lambda s, x: s.tokens - want - scale * x
    for _ in range(rounds):
        residual = slope(now, lean)
        if np.abs(residual).max() <= close:
            return lean
        step, length = np.linalg.solve(now.curvature + np.diag(scale), residual), 1.0
        while True:
            at = lean + length * step
            then = sums(at)
            lower = loss(then, at) <= loss(now, lean) - 1e-4 * length * (residual @ step)
            if lower or np.linalg.norm(slope(then, at)) < 0.5 * np.linalg.norm(residual):
                lean, now = at, then
                break
            length /= 2
            if length < 1e-12:
                raise RuntimeError(f"rates don't settle: {np.abs(residual).max():.3g} tokens off")
    raise RuntimeError(f"rates haven't settled after {rounds} rounds")


def with_rates(soft: DataFrame, lean: np.ndarray, names: tuple[str, ...] = DOMAINS, columns: list[str] | None = None) -> DataFrame:
    """All columns of ``soft`` and ``rate``; the posteriors are in ``columns`` (by default ``p_<domain>``)."""
    return soft.withColumn(free_name("rate", soft.columns), rate(columns or [f"p_{d}" for d in names], lean))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long"), "text")
    soft = materialize(memberships(documents, fit_on(documents, table(spark, sf_dir, "labels")), text=False))
    return with_rates(soft, fit_rates(soft))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document with its memberships and rate."""
    model = fit_on(docs, table(spark, sf_dir, "labels"))
    soft = materialize(memberships(docs.select("text"), model, text=False))
    # texts are read twice; a copy of them with the memberships would cost more
    columns = [free_name(f"p_{d}", docs.columns) for d in DOMAINS]
    return with_rates(memberships(docs, model), fit_rates(soft), columns=columns)
