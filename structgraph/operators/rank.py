"""Personalized PageRank and other rankings."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.registries import WEIGHTS
from structgraph.session import materialize, small


@dataclass
class ActivationConfig:
    """``damping`` is the probability to go on."""

    weights: dict[int, float] = field(default_factory=lambda: dict(WEIGHTS))
    default_weight: float = 1.0
    damping: float = 0.5
    direction: str = "forward"
    specificity: str = "none"
    top_k: int | None = 50
    max_iterations: int = 100
    epsilon: float = 1e-6


def weight(config: ActivationConfig):
    out = F.when(F.lit(False), F.lit(0.0))
    for c, w in config.weights.items():
        out = out.when(F.col("category") == c, F.lit(float(w)))
    return out.otherwise(F.lit(float(config.default_weight)))


def degrees(edges: DataFrame) -> DataFrame:
    """``id``, ``degree``: in and out, a self-loop counts twice."""
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def weighted_out(edges: DataFrame, config: ActivationConfig | None = None) -> DataFrame:
    """``id``, ``w``: the weights of a node's out-edges added up."""
    return edges.groupBy(F.col("src").alias("id")).agg(F.sum(weight(config or ActivationConfig())).alias("w"))


def dangling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes without an out-edge."""
    return nodes.join(edges.select("src").distinct(), nodes["id"] == F.col("src"), "left_anti")


def moved(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row, ``moved``: how far scores moved in all (L1)."""
    both = after.select("id", "score").unionByName(before.select("id", (-F.col("score")).alias("score")))
    return both.groupBy("id").agg(F.abs(F.sum("score")).alias("d")).agg(F.coalesce(F.sum("d"), F.lit(0.0)).alias("moved"))


def ppr(nodes: DataFrame, edges: DataFrame, seeds: list[int], config: ActivationConfig | None = None, rounds: int | None = None) -> tuple[DataFrame, int]:
    """``id``, ``score`` over zero, best first (ties by id), and the rounds made.

    Edge probabilities are normalised once.  A round is one join by source and
    one sum by target, checkpointed, so its plan stays the same; scores are
    broadcast while they are few.  What isn't passed on (the restart and what
    dangling nodes hold) is one minus what is, and goes back to the seeds.
    ``rounds`` fixes their number; else they end when the scores move less
    than epsilon.  Repeated seeds count once.
    """
    config = config or ActivationConfig()
    spark = nodes.sparkSession
    d = min(0.99, max(0.01, config.damping))
    ids = materialize(nodes.select("id").distinct())
    n_ids, n = ids.agg(F.count("*"), F.count_if(F.col("id").isin(*set(seeds)) if seeds else F.lit(False))).first()
    if not n:
        return spark.createDataFrame([], "id long, score double"), 0
    start = ids.where(F.col("id").isin(*set(seeds)))
    weighted = edges.select("src", "dst", weight(config).alias("w")).where("w > 0")
    back = weighted.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")
    weighted = {"forward": weighted, "backward": back, "undirected": weighted.unionByName(back)}[config.direction]
    for end in ("src", "dst"):
        weighted = weighted.join(small(ids.select(F.col("id").alias(end)), n_ids), end, "left_semi")
    pairs = weighted.groupBy("src", "dst").agg(F.sum("w").alias("w"))
    total = weighted.groupBy("src").agg(F.sum("w").alias("all"))
    moves = materialize(pairs.join(total, "src").select("src", "dst", (F.col("w") / F.col("all")).alias("p")))
    restart = start.select("id", F.lit(1.0 / n).alias("r"))
    scores, size, made = restart.select("id", F.col("r").alias("score")), n, 0
    while made < (rounds if rounds is not None else config.max_iterations):
        held = small(scores.select(F.col("id").alias("src"), "score"), size)
        pushed = materialize(moves.join(held, "src").groupBy(F.col("dst").alias("id")).agg(F.sum(d * F.col("score") * F.col("p")).alias("score")))
        size, passed = pushed.agg(F.count("*"), F.coalesce(F.sum("score"), F.lit(0.0))).first()
        size += n
        again = restart.select("id", (F.col("r") * (1.0 - passed)).alias("score"))
        new = pushed.unionByName(again).groupBy("id").agg(F.sum("score").alias("score"))
        made += 1
        settled = rounds is None and moved(scores, new).first()["moved"] < config.epsilon
        scores = new
        if settled:
            break
    if config.specificity != "none":
        own = scores.join(degrees(edges), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        factor = 1 / (1 + F.col("degree")) if config.specificity == "idf" else F.log1p(1 + F.col("degree"))
        scores = own.select("id", (F.col("score") * factor).alias("score"))
    scores = scores.where("score > 0")
    return (top(scores, config.top_k) if config.top_k is not None else scores), made


def top(scores: DataFrame, k: int) -> DataFrame:
    return scores.orderBy(F.desc("score"), "id").limit(k)


def score_of(scores: DataFrame, ids: DataFrame) -> DataFrame:
    """The score of each id, 0 where there is none."""
    return ids.join(scores, "id", "left").select("id", F.coalesce("score", F.lit(0.0)).alias("score"))
