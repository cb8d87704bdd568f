"""Links between stacks: declarative joins on normalised keys.

Nodes carry ``id, kind, name, qname, confidence`` (and ``repo`` for shared
schemas); links are ``src, dst, category, confidence`` with the weaker of two
confidences.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.functions import paths as P
from structgraph.registries import CATEGORY, DROPPABLE, KIND
from structgraph.session import spread


def keyed(nodes: DataFrame, kind: str, prefix: str) -> DataFrame:
    """``id``, ``key`` (qname without prefix), ``confidence`` of one kind."""
    own = nodes.where((F.col("kind") == KIND[kind]) & F.col("qname").startswith(prefix))
    return own.select("id", F.substr("qname", F.lit(len(prefix) + 1)).alias("key"), "confidence")


def _link(a: DataFrame, b: DataFrame, on, category: str) -> DataFrame:
    x = a.select(F.col("id").alias("src"), F.col("key").alias("k"), F.col("confidence").alias("ca"))
    y = b.select(F.col("id").alias("dst"), F.col("key").alias("m"), F.col("confidence").alias("cb"))
    return x.join(y, on).select("src", "dst", F.lit(CATEGORY[category]).alias("category"), F.least("ca", "cb").alias("confidence"))


def routes(nodes: DataFrame, methods: DataFrame) -> DataFrame:
    """``dst``, ``method``, ``path``, ``confidence``: of ``route:<path>`` nodes one row per method in
    ``methods(node_id, method)``, of ``<METHOD> <path>`` nodes the one they name (if the path starts with /)."""
    own = nodes.where(F.col("kind") == KIND["route"]).select(F.col("id").alias("dst"), "qname", "confidence")
    a = own.where("qname like 'route:%'").join(methods, F.col("dst") == F.col("node_id")).select("dst", F.upper("method").alias("method"), F.expr("substr(qname, 7)").alias("path"), "confidence")
    b = own.where("qname not like 'route:%'").select("dst", F.upper(F.regexp_extract("qname", r"^(\S+) (/.*)$", 1)).alias("method"), F.regexp_extract("qname", r"^(\S+) (/.*)$", 2).alias("path"), "confidence").where("path <> ''")
    return a.unionByName(b).select("dst", "method", P.normalise_http_path(F.col("path")).alias("path"), "confidence")


def http_links(nodes: DataFrame, methods: DataFrame, any_matches: bool = False) -> DataFrame:
    """Endpoints to routes by method and path; where the whole path has no route,
    the path without one, then two leading droppable segments."""
    ends = nodes.where(F.col("kind") == KIND["endpoint"]).select(F.col("id").alias("src"), P.endpoint_method(F.col("qname")).alias("method"), P.normalise_http_path(P.endpoint_path(F.col("qname"))).alias("path"), F.col("confidence").alias("ce"))
    parts = F.split(F.substr("path", F.lit(2)), "/")
    cut = lambda n: F.concat(F.lit("/"), F.array_join(F.slice(parts, n + 1, F.size(parts)), "/"))
    free = lambda i: F.get(parts, F.lit(i)).isin(*DROPPABLE)
    keys = F.array(
        F.struct(F.lit(0).alias("rank"), F.col("path").alias("key")),
        F.when(free(0) & (F.size(parts) > 1), F.struct(F.lit(1).alias("rank"), cut(1).alias("key"))),
        F.when(free(0) & free(1) & (F.size(parts) > 2), F.struct(F.lit(2).alias("rank"), cut(2).alias("key"))),
    )
    tried = ends.select("src", "method", "ce", F.explode(F.array_compact(keys)).alias("t")).select("src", "method", "ce", "t.rank", "t.key")
    known = routes(nodes, methods)
    same = F.col("method") == F.col("m")
    known = known.select("dst", F.col("method").alias("m"), F.col("path").alias("key"), "confidence")
    met = tried.join(known, (tried["key"] == known["key"]) & same)
    if any_matches:
        met = met.unionByName(tried.join(known.where(F.col("m").isin("ANY", "ALL")), tried["key"] == known["key"]).where(~same))
    met = met.select("src", "dst", "rank", "ce", "confidence")
    best = met.groupBy("src").agg(F.min("rank").alias("best"))
    won = met.join(best, "src").where("rank = best")
    return won.groupBy("src", "dst").agg(F.max(F.least("ce", "confidence")).alias("confidence")).select("src", "dst", F.lit(CATEGORY["http_calls"]).alias("category"), "confidence")


def grpc_links(nodes: DataFrame) -> DataFrame:
    client = keyed(nodes, "grpc_client", "grpc_client:").withColumn("key", F.substring_index("key", ".", 1))
    return _link(client, keyed(nodes, "grpc_service", "grpc:"), F.expr("k = m"), "grpc_calls")


def queue_links(nodes: DataFrame) -> DataFrame:
    return _link(keyed(nodes, "queue_producer", "queue_producer:"), keyed(nodes, "queue_consumer", "queue_consumer:"), F.expr("k = m"), "queue_flows")


def event_links(nodes: DataFrame) -> DataFrame:
    return _link(keyed(nodes, "event_emitter", "event_emit:"), keyed(nodes, "event_handler", "event_handle:"), F.expr("k = m"), "event_flows")


def cli_links(nodes: DataFrame) -> DataFrame:
    return _link(keyed(nodes, "cli_invocation", "cli_invoke:"), keyed(nodes, "cli_command", "cli:"), F.expr("k = m"), "cli_invokes")


def _pairs_joined(a: DataFrame, b: DataFrame, pairs: DataFrame, category: str) -> DataFrame:
    """Links of the nodes whose names are in ``pairs(k, m)``."""
    x = a.select(F.col("id").alias("src"), F.col("key").alias("k"), F.col("confidence").alias("ca"))
    y = b.select(F.col("id").alias("dst"), F.col("key").alias("m"), F.col("confidence").alias("cb"))
    return x.join(pairs.distinct(), "k").join(y, "m").select("src", "dst", F.lit(CATEGORY[category]).alias("category"), F.least("ca", "cb").alias("confidence"))


_PARTS = "array_distinct(concat(array(''), flatten(transform(sequence(1, length({0})), i -> transform(sequence(1, length({0}) - i + 1), n -> substr({0}, i, n))))))"
_ENDS = "array_distinct(concat(array(''), transform(sequence(1, length({0})), i -> substr({0}, i))))"


def _within(names: DataFrame, long: str, others: DataFrame, short: str, parts: str) -> DataFrame:
    """Pairs of a name and another that is one of its parts: the parts of each name are exploded and joined on equality."""
    own = names.select(long, F.explode(F.when(F.length(f"{long}_n") == 0, F.array(F.lit(""))).otherwise(F.expr(parts.format(f"{long}_n")))).alias("part"))
    return own.join(others, own["part"] == others[f"{short}_n"]).select(long, short)


def _named(nodes: DataFrame, column: str, norm: Column) -> DataFrame:
    """Distinct names and what they are compared by."""
    return nodes.select(F.col("key").alias(column)).distinct().withColumn(f"{column}_n", norm)


def graphql_links(nodes: DataFrame) -> DataFrame:
    """Names that are equal or contain one another, whatever their case."""
    a, b = keyed(nodes, "graphql_operation", "graphql_op:"), keyed(nodes, "graphql_resolver", "graphql_resolver:")
    x, y = _named(a, "k", F.lower("k")), _named(b, "m", F.lower("m"))
    pairs = _within(x, "k", y, "m", _PARTS).unionByName(_within(y, "m", x, "k", _PARTS).select("k", "m"))
    return _pairs_joined(a, b, pairs, "graphql_calls")


#: Lots that each side of an all-pairs link is dealt into: their pairs are what tasks share.
LOTS = 64


def _all_pairs(a: DataFrame, b: DataFrame, category: str) -> DataFrame:
    """Links of every node of ``a`` to every node of ``b``.

    Both are dealt into lots and each lot is one row, so a pair of lots is what
    is shuffled; its links are only made in the task that gives them, and
    no task has more than its share of the lots' pairs.
    """
    other = F.explode(F.sequence(F.lit(0), F.lit(LOTS - 1)))
    lot = lambda df, name: df.select(F.pmod(F.xxhash64("id"), F.lit(LOTS)).cast("int").alias(name), F.struct("id", "confidence").alias("n")).groupBy(name).agg(F.collect_list("n").alias(f"{name}s"))
    x, y = lot(a, "x").withColumn("y", other), lot(b, "y").withColumn("x", other)
    pairs = spread(x, "x", "y").join(spread(y, "x", "y"), ["x", "y"]).select(F.explode("xs").alias("s"), "ys").select("s", F.explode("ys").alias("t"))
    return pairs.select(F.col("s.id").alias("src"), F.col("t.id").alias("dst"), F.lit(CATEGORY[category]).alias("category"), F.least("s.confidence", "t.confidence").alias("confidence"))


def socket_links(nodes: DataFrame) -> DataFrame:
    """Paths that are equal or end with one another; ``ws`` on either side and handler ``default`` match any."""
    a, b = keyed(nodes, "ws_client", "ws_client:"), keyed(nodes, "ws_handler", "ws:")
    norm = F.lower(F.btrim("key", F.lit("/")))
    wild_a, wild_b = norm == "ws", norm.isin("ws", "default")
    # wild names match every name of the other side by definition
    wild = _all_pairs(a.where(wild_a), b, "ws_connects").unionByName(_all_pairs(a.where(~wild_a), b.where(wild_b), "ws_connects"))
    a, b = a.where(~wild_a), b.where(~wild_b)
    x, y = _named(a, "k", F.lower(F.btrim("k", F.lit("/")))), _named(b, "m", F.lower(F.btrim("m", F.lit("/"))))
    pairs = _within(x, "k", y, "m", _ENDS).unionByName(_within(y, "m", x, "k", _ENDS).select("k", "m"))
    return _pairs_joined(a, b, pairs, "ws_connects").unionByName(wild)


#: What marks a name as a schema.
SCHEMA_HINTS = ("Schema", "Validator", "Type", "Model", "Entity", "DTO", "Input", "Output", "Params", "Request", "Response")


def schema_links(nodes: DataFrame) -> DataFrame:
    """Schema-like children of modules with one name in two repositories, each pair once (smaller id first)."""
    modules = nodes.where(F.col("kind") == KIND["module"]).select(F.col("id").alias("parent_id"), F.col("confidence").alias("mc"))
    hint = F.col("qname").rlike("|".join(SCHEMA_HINTS))
    own = nodes.where(F.col("kind").isin(KIND["class"], KIND["interface"], KIND["struct"]) & hint).drop("confidence").join(modules, "parent_id").select("id", "name", "repo", "mc")
    many = own.groupBy("name").agg(F.countDistinct("repo").alias("n")).where("n >= 2").select("name")
    own = own.join(many, "name", "left_semi")
    a, b = own.select("name", F.col("id").alias("src"), F.col("repo").alias("ra"), F.col("mc").alias("ca")), own.select("name", F.col("id").alias("dst"), F.col("repo").alias("rb"), F.col("mc").alias("cb"))
    return a.join(b, "name").where("src < dst AND ra <> rb").select("src", "dst", F.lit(CATEGORY["shares_schema"]).alias("category"), F.least("ca", "cb").alias("confidence"))


#: Resolvers by name: functions of (nodes, methods) that give links.  More can be added.
RESOLVERS: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] = {
    "http": http_links,
    **{n: (lambda nodes, _, f=f: f(nodes)) for n, f in (("grpc", grpc_links), ("queue", queue_links), ("graphql", graphql_links), ("socket", socket_links), ("event", event_links), ("schema", schema_links), ("cli", cli_links))},
}


def all_links(nodes: DataFrame, methods: DataFrame, resolvers: dict[str, Callable[[DataFrame, DataFrame], DataFrame]] | None = None) -> DataFrame:
    """What all ``resolvers`` (by default ``RESOLVERS``) link."""
    return reduce(DataFrame.unionByName, [f(nodes, methods) for f in (RESOLVERS if resolvers is None else resolvers).values()])
