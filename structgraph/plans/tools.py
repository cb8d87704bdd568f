"""The query tools: find, neighbours, flow, trace, impact, activate, status, view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.operators import rank, traverse
from structgraph.plans import stats
from structgraph.registries import ENTRY_KINDS, KIND

FOUND = 30
# The tier of a kind by its name; anything else is a service.
TIERS = {"entry": ENTRY_KINDS, "handler": (KIND["function"], KIND["method"]), "data": (KIND["database"], KIND["cache"], KIND["blob_store"], KIND["search_index"], KIND["email_service"])}


def tier(kind):
    out = F.when(F.lit(False), F.lit(""))
    for name, kinds in TIERS.items():
        out = out.when(kind.isin(*kinds), F.lit(name))
    return out.otherwise(F.lit("service"))


def find_node(nodes: DataFrame, name: str) -> DataFrame:
    """One node or none: exact name, then part of a qname, then part of either in any case (smallest qname, id first)."""
    low = name.lower()
    order = F.when(F.col("name") == name, 0).when(F.col("qname").contains(name), 1).when(F.lower("name").contains(low) | F.lower("qname").contains(low), 2)
    return nodes.withColumn("priority", order).where("priority is not null").orderBy("priority", "qname", "id").limit(1).drop("priority")


def find(nodes: DataFrame, query: str, most: int = FOUND) -> DataFrame:
    """Nodes whose qname has the query, else the one ``find_node`` gives."""
    found = nodes.where(F.col("qname").contains(query)).orderBy("qname", "id").limit(most)
    return found if not found.isEmpty() else find_node(nodes, query)


def impact(nodes: DataFrame, edges: DataFrame, node: int, direction: str = "up", depth: int = 3) -> DataFrame:
    """What depends on a node (``up``) or what it depends on (``down``), with tier and distance (1 to 10)."""
    seed = edges.sparkSession.createDataFrame([(node,)], "id long")
    found = traverse.reach(edges, seed, max(1, min(10, depth)), direction).select("id", "depth")
    return found.join(nodes.select("id", "kind", "name", "qname"), "id").withColumn("tier", tier(F.col("kind")))


def trace(nodes: DataFrame, edges: DataFrame, start: int, end: int) -> DataFrame:
    """The steps of a shortest path with kind and tier, and whether the tier changed (nodes = steps, hops = steps - 1)."""
    path = traverse.shortest_path(edges, start, end) or []
    steps = edges.sparkSession.createDataFrame(list(enumerate(path)), "step int, id long")
    from pyspark.sql.window import Window as W

    own = steps.join(nodes.select("id", "kind", "name", "qname"), "id").withColumn("tier", tier(F.col("kind")))
    return own.withColumn("changed", F.coalesce(F.lag("tier").over(W.orderBy("step")) != F.col("tier"), F.lit(False)))


def flow(nodes: DataFrame, edges: DataFrame, feature: str, depth: int = 6) -> DataFrame:
    """A flow by its key, else by part of a key, else what the node with that qname reaches."""
    slug = feature.lower().replace(" ", "_")
    flows = traverse.flows(nodes, edges, ENTRY_KINDS, depth)
    key = F.when(F.col("key") == slug, 0).when(F.col("key").contains(slug) | F.lit(slug).contains(F.col("key")), 1)
    best = flows.withColumn("priority", key).where("priority is not null").orderBy("priority", "key").limit(1).select("key").first()
    if best:
        return flows.where(F.col("key") == best["key"]).select("id", "depth")
    start = nodes.where(F.col("qname").contains(feature)).orderBy("qname", "id").limit(1).select("id")
    return traverse.reach(edges, start, depth).select("id", "depth")


def activate(nodes: DataFrame, edges: DataFrame, seeds: str, top_k: int = 20) -> DataFrame:
    """Ranked nodes for a comma-separated list of names."""
    ids = [r["id"] for s in seeds.split(",") if s.strip() for r in find_node(nodes, s.strip()).select("id").collect()]
    scores, _ = rank.ppr(nodes, edges, ids, rank.ActivationConfig(top_k=max(1, min(100, top_k))))
    return scores.join(nodes.select("id", "name", "qname", "kind"), "id")


FLOWS = 20
PREVIEW = 30


def entry_points(nodes: DataFrame) -> DataFrame:
    """Nodes of the kinds that a flow starts from."""
    return nodes.where(F.col("kind").isin(*ENTRY_KINDS))


def status(nodes: DataFrame, edges: DataFrame, cells: DataFrame | None = None, depth: int = 6) -> dict[str, DataFrame]:
    """Counts, kinds, confidences; with ``cells`` also the first ``FLOWS`` flows and ``PREVIEW`` lines of the text."""
    out = {"counts": stats.counts(nodes, edges), "kinds": stats.by_kind(nodes).orderBy(F.desc("n"), "kind").limit(15), "confidence": stats.by_confidence(nodes)}
    if cells is not None:
        from structgraph.plans import textproj

        flows = traverse.flows(nodes, edges, ENTRY_KINDS, depth).select("key", F.col("source").alias("id")).distinct()
        out["flows"] = flows.join(nodes.select("id", "kind", "confidence"), "id").orderBy("key").limit(FLOWS)
        out["preview"] = textproj.dense_text(nodes, edges, cells).limit(PREVIEW)
    return out


def view(nodes: DataFrame, edges: DataFrame, node: int, depth: int = 1) -> DataFrame:
    """Children by ``defines`` and other connections of a node, up to ``depth`` (1 to 5)."""
    seed = edges.sparkSession.createDataFrame([(node,)], "id long")
    found = traverse.reach(edges, seed, max(1, min(5, depth))).select("id", "depth")
    children = edges.where("category = 1").select(F.col("dst").alias("id"), F.lit(True).alias("child")).distinct()
    return found.join(children, "id", "left").withColumn("child", F.coalesce("child", F.lit(False))).join(nodes.select("id", "name", "kind"), "id")
