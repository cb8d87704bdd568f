"""Queries by operator id, and the SQL that gives the same rows.

Graph queries run on the property graph of the star schema; resolvers and
extractors run on small authored tables that both sides spell as VALUES.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.fkgraph import K, stored_graph, with_graph
from structgraph.functions import paths as P
from structgraph.operators import post, rank, resolve, stack, traverse
from structgraph.plans import stats

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _ORACLE[name] = sql
        return f

    return keep


def graph(name: str, sql: str | None, recursive: bool = False):
    """A query of (nodes, edges) of the star schema's graph."""

    def keep(f: Callable[[DataFrame, DataFrame], DataFrame]):
        query(name, with_graph(sql, recursive) if sql else None)(lambda spark, d: f(*stored_graph(spark, d)))
        return f

    return keep


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLE)


R, C = 101 * K, 103 * K

# --- aggregates, sorts, sets ---------------------------------------------


@graph("a1_counts", "SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(DISTINCT id) FROM nodes) AS distinct_nodes, (SELECT count(*) FROM edges) AS edges, cast(0 AS BIGINT) AS cross_edges")
def _(n, e):
    return stats.counts(n, e)


@graph("a2_count_of_kind", "SELECT count(*) AS n FROM nodes WHERE kind = 105")
def _(n, e):
    return stats.of_kind(n, 105)


@graph("a3_by_kind", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind")
def _(n, e):
    return stats.by_kind(n)


@graph("a3_by_confidence", "SELECT confidence, count(*) AS n FROM nodes GROUP BY confidence")
def _(n, e):
    return stats.by_confidence(n)


@graph("a4_majority", "SELECT kind AS value, n FROM (SELECT kind, count(*) AS n, sum(count(*)) OVER () AS total FROM nodes GROUP BY kind) WHERE n > total // 2")
def _(n, e):
    return stats.majority(n, "kind")


@graph("a5_prefixes", "SELECT prefix, count(*) AS n FROM (SELECT array_to_string(string_split(qname, '::')[1:-2], '::') AS prefix FROM nodes WHERE contains(qname, '::')) WHERE length(prefix) >= 10 GROUP BY prefix HAVING count(*) >= 3")
def _(n, e):
    return stats.prefixes(n)


@graph("a6_degree", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id")
def _(n, e):
    return rank.degrees(e)


_W = "CASE category WHEN 4 THEN 5.0 WHEN 9 THEN 4.0 WHEN 15 THEN 4.0 WHEN 5 THEN 3.0 ELSE 1.0 END"


@graph("a7_weighted_out", f"SELECT src AS id, cast(sum({_W}) AS DOUBLE) AS w FROM edges GROUP BY src")
def _(n, e):
    return rank.weighted_out(e)


@graph("a8_dangling", "SELECT count(*) AS n FROM nodes WHERE id NOT IN (SELECT src FROM edges)")
def _(n, e):
    return rank.dangling(n, e).agg(F.count("*").alias("n"))


@query("a15_spread", "SELECT min(value) AS min, median(value) AS median, list_sort(list(value))[cast(floor(count(*) * 9 / 10) AS BIGINT) + 1] AS p90, max(value) AS max, count(value) AS n FROM events WHERE value IS NOT NULL")
def _(spark, d):
    return stats.spread(spark.read.parquet(f"{d}/events.parquet"), "value")


@graph("a16_shares", "SELECT category, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM edges), 4) AS percent FROM edges GROUP BY category")
def _(n, e):
    return stats.shares(e, "category")


@graph("a17_pivot", "SELECT confidence, count(*) FILTER (kind = 103) AS \"103\", count(*) FILTER (kind = 104) AS \"104\", count(*) FILTER (kind = 105) AS \"105\" FROM nodes GROUP BY confidence")
def _(n, e):
    return stats.pivot_kinds(n, "confidence", [103, 104, 105])


@query("a18_shared_names", "SELECT p_brand AS name, count(DISTINCT p_type) AS repos FROM part GROUP BY p_brand HAVING count(DISTINCT p_type) >= 2")
def _(spark, d):
    return stats.shared_names(spark.read.parquet(f"{d}/part.parquet"), "p_brand", "p_type")


@graph("o1_top_k", "SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id ORDER BY degree DESC, id LIMIT 20")
def _(n, e):
    return rank.degrees(e).orderBy(F.desc("degree"), "id").limit(20)


@graph("o2_common_kinds", "SELECT kind, count(*) AS n FROM nodes GROUP BY kind ORDER BY n DESC, kind LIMIT 15")
def _(n, e):
    return stats.by_kind(n).orderBy(F.desc("n"), "kind").limit(15)


@graph("o3_per_group", "SELECT kind, id FROM (SELECT kind, id, row_number() OVER (PARTITION BY kind ORDER BY id) AS k FROM nodes) WHERE k <= 15")
def _(n, e):
    return stats.first_per_group(n, "kind", "id", 15).select("kind", "id")


@graph("u1_union", "SELECT src, dst FROM edges UNION ALL SELECT src, dst FROM edges WHERE category = 2")
def _(n, e):
    return e.select("src", "dst").unionByName(e.where("category = 2").select("src", "dst"))


@graph("u2_distinct", "SELECT DISTINCT category, confidence FROM edges")
def _(n, e):
    return e.select("category", "confidence").distinct()


# --- traversal -----------------------------------------------------------


@graph("t1_neighbours", f"SELECT dst AS id, category FROM edges WHERE src = {105 * K + 1}")
def _(n, e):
    return traverse.neighbours(e, 105 * K + 1)


@graph("q3_both_ways", f"SELECT 'out' AS direction, dst AS id, category FROM edges WHERE src = {C + 1} UNION ALL SELECT 'in', src, category FROM edges WHERE dst = {C + 1}")
def _(n, e):
    return traverse.both_ways(e, C + 1)


def _seed(df: DataFrame, *ids: int) -> DataFrame:
    return df.sparkSession.createDataFrame([(i,) for i in ids], "id long")


def _reach_sql(start: int, a: str, b: str, depth: int, where: str = "") -> str:
    return f", r(id, depth) AS (SELECT cast({start} AS BIGINT), 0 UNION SELECT e.{b}, r.depth + 1 FROM r JOIN edges e ON e.{a} = r.id WHERE r.depth < {depth} {where}) "


@graph("t2_bfs_follow", _reach_sql(105 * K + 1, "src", "dst", 4, "AND e.category IN (1, 9)") + f"SELECT id, min(depth) AS depth FROM r WHERE id <> {105 * K + 1} GROUP BY id", True)
def _(n, e):
    return traverse.reach(e, _seed(e, 105 * K + 1), 4, "down", (1, 9)).select("id", "depth")


@graph("t3_parent_chain", ", r(id, ancestor, distance) AS (SELECT id, parent_id, 1 FROM nodes WHERE parent_id IS NOT NULL UNION ALL SELECT r.id, n.parent_id, r.distance + 1 FROM r JOIN nodes n ON n.id = r.ancestor WHERE n.parent_id IS NOT NULL) SELECT id, ancestor, distance FROM r", True)
def _(n, e):
    return traverse.parent_chain(n)


@graph("t4_upstream", _reach_sql(R, "dst", "src", 3) + f", f AS (SELECT id, min(depth) AS depth FROM r WHERE id <> {R} GROUP BY id) SELECT depth, kind, count(*) AS n FROM f JOIN nodes USING (id) GROUP BY depth, kind", True)
def _(n, e):
    found = traverse.reach(e, _seed(e, R), 3, "up")
    return found.join(n.select("id", "kind"), "id").groupBy("depth", "kind").agg(F.count("*").alias("n"))


@graph("t4_downstream", _reach_sql(105 * K + 1, "src", "dst", 6) + f"SELECT id, min(depth) AS depth FROM r WHERE id <> {105 * K + 1} GROUP BY id", True)
def _(n, e):
    return traverse.reach(e, _seed(e, 105 * K + 1), 6).select("id", "depth")


@graph("t5_distance", f", b(x, y) AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), r(id, depth) AS (SELECT cast({C + 1} AS BIGINT), 0 UNION SELECT b.y, r.depth + 1 FROM r JOIN b ON b.x = r.id WHERE r.depth < 3) SELECT id, min(depth) AS depth FROM r WHERE id <> {C + 1} GROUP BY id", True)
def _(n, e):
    return traverse.distances(e, C + 1, 3)


_LEVELS = 8  # the star schema's graph is no deeper
_PATH = f", b(x, y) AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges), l0 AS (SELECT cast({C + 1} AS BIGINT) AS id, cast(NULL AS BIGINT) AS before, 0 AS depth)"
for _i in range(_LEVELS):
    _seen = " UNION ALL ".join(f"SELECT id FROM l{j}" for j in range(_i + 1))
    _PATH += f", l{_i + 1} AS (SELECT b.y AS id, min(b.x) AS before, {_i + 1} AS depth FROM l{_i} l JOIN b ON b.x = l.id WHERE b.y NOT IN ({_seen}) GROUP BY b.y)"
_PATH += ", v AS (" + " UNION ALL ".join(f"SELECT * FROM l{j}" for j in range(_LEVELS + 1)) + f"), p(id, before, depth) AS (SELECT * FROM v WHERE id = {104 * K + 1} UNION ALL SELECT v.* FROM p JOIN v ON v.id = p.before) SELECT depth AS step, id FROM p"


@graph("t5_path", _PATH, True)
def _(n, e):
    found = traverse.shortest_path(e, C + 1, 104 * K + 1) or []
    return n.sparkSession.createDataFrame(list(enumerate(found)), "step int, id long")


@graph("q4_flows", _reach_sql(101 * K, "dst", "src", 2) + "SELECT lower(replace(n.name, ' ', '_')) AS key, r.id, min(r.depth) AS depth FROM r JOIN nodes n ON n.id = " + str(R) + f" WHERE r.id <> {R} GROUP BY ALL", True)
def _(n, e):
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "category")
    return traverse.flows(n.where(F.col("id") == R), back, (101,), 2).select("key", "id", "depth")


# --- ranking -------------------------------------------------------------


def _ppr_sql(seed: int, rounds: int, d: float = 0.5) -> str:
    out = f", w AS (SELECT src, dst, sum({_W}) AS w FROM edges GROUP BY ALL), m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), v0 AS (SELECT cast({seed} AS BIGINT) AS id, 1.0::DOUBLE AS s)"
    for i in range(rounds):
        out += f", v{i + 1} AS (SELECT id, sum(s) AS s FROM (SELECT m.dst AS id, {d}::DOUBLE * v.s * m.p AS s FROM v{i} v JOIN m ON m.src = v.id UNION ALL SELECT cast({seed} AS BIGINT), {1 - d}::DOUBLE + {d}::DOUBLE * coalesce((SELECT sum(s) FROM v{i} WHERE id NOT IN (SELECT src FROM m)), 0)) GROUP BY id)"
    return out + f" SELECT id, round(s, 6) AS score FROM v{rounds} WHERE s > 0"


@graph("t6_ppr", _ppr_sql(105 * K + 1, 5))
def _(n, e):
    scores, _ = rank.ppr(n, e, [105 * K + 1], rank.ActivationConfig(top_k=None), rounds=5)
    return scores.select("id", F.round("score", 6).alias("score"))


def _activate_sql(seeds: tuple[int, int], rounds: int) -> str:
    start = f"(SELECT unnest([{seeds[0]}, {seeds[1]}])::BIGINT AS id)"
    out = f", w AS (SELECT src, dst, sum(w) AS w FROM (SELECT src, dst, {_W} AS w FROM edges UNION ALL SELECT dst, src, {_W} FROM edges) GROUP BY ALL), m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM w), v0 AS (SELECT id, 0.5::DOUBLE AS s FROM {start} t)"
    for i in range(rounds):
        out += f", v{i + 1} AS (SELECT id, sum(s) AS s FROM (SELECT m.dst AS id, 0.5::DOUBLE * v.s * m.p AS s FROM v{i} v JOIN m ON m.src = v.id UNION ALL SELECT id, 0.25::DOUBLE FROM {start} t) GROUP BY id)"
    degree = "(SELECT id, count(*) AS n FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id)"
    return out + f" SELECT v.id, round(s / (1 + n), 6) AS score FROM v{rounds} v JOIN {degree} d ON d.id = v.id ORDER BY s / (1 + n) DESC, v.id LIMIT 20"


@graph("t8_activate", _activate_sql((C + 1, 105 * K + 1), 8))
def _(n, e):
    return rank.ppr(n, e, [C + 1, 105 * K + 1], rank.ActivationConfig(top_k=20, direction="undirected", specificity="idf"), rounds=8)[0].withColumn("score", F.round("score", 6))


@graph("t7_weights", f"SELECT category, {_W}::DOUBLE AS w FROM (SELECT DISTINCT category FROM edges)")
def _(n, e):
    return e.select("category").distinct().select("category", rank.weight(rank.ActivationConfig()).alias("w"))


# --- search and filters --------------------------------------------------


@graph("q2_find", "SELECT id, qname FROM nodes WHERE contains(qname, 'ASIA') ORDER BY qname, id LIMIT 30")
def _(n, e):
    from structgraph.plans.tools import find

    return find(n, "ASIA").select("id", "qname")


@graph("q7_impact", _reach_sql(102 * K + 1, "dst", "src", 2) + f", f AS (SELECT id, min(depth) AS depth FROM r WHERE id <> {102 * K + 1} GROUP BY id) SELECT 'service' AS tier, depth, count(*) AS n FROM f GROUP BY depth", True)
def _(n, e):
    from structgraph.plans.tools import impact

    return impact(n, e, 102 * K + 1, "up", 2).groupBy("tier", "depth").agg(F.count("*").alias("n"))


@graph("f1_noncritical", "SELECT id, CASE WHEN list_has_any(string_split(lower(qname), '::'), ['tests','test','__tests__','spec','specs','fixtures','fixture','examples','example','e2e','__mocks__','mocks','testdata']) AND qname NOT LIKE 'route:%' THEN 0 ELSE confidence END AS confidence FROM nodes")
def _(n, e):
    return post.downgrade(n).select("id", "confidence")


@graph("f4_category_filter", "SELECT src, dst FROM edges WHERE category IN (4, 9, 10)")
def _(n, e):
    return e.where(F.col("category").isin(4, 9, 10)).select("src", "dst")


# --- authored tables -----------------------------------------------------


def _values(rows: list[tuple], columns: str) -> str:
    def lit(x):
        return "NULL" if x is None else str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, (int, float)) else "'" + x.replace("'", "''") + "'"

    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS t({columns}))"


NODES = [
    # id, kind, name, qname, parent_id, confidence, repo
    (1, 1, "users{k}", "app::users{k}", None, 2, 1), (2, 1, "helpers{k}", "app::helpers{k}", None, 2, 1), (3, 1, "auth{k}", "app::auth{k}", None, 1, 2),
    (4, 1, "test_users{k}", "app::tests::test_users{k}", None, 2, 1), (5, 1, "users{k}", "lib::users{k}", None, 2, 2), (6, 1, "sub", "app::auth{k}::sub", None, 2, 2),
    (11, 2, "UserModel{k}", "app::users{k}::UserModel{k}", 1, 2, 1), (12, 4, "login", "app::users{k}::UserModel{k}::login", 11, 2, 1), (13, 4, "save", "app::users{k}::UserModel{k}::save", 11, 2, 1),
    (14, 3, "slug", "app::helpers{k}::slug", 2, 2, 1), (15, 3, "check", "app::auth{k}::check", 3, 2, 2), (16, 2, "UserModel{k}", "app::auth{k}::UserModel{k}", 3, 2, 2), (17, 3, "make", "app::users{k}::make", 1, 2, 1),
    (21, 5, "/api/users{k}/:id", "route:/api/users{k}/:id", 1, 2, 1), (22, 5, "GET /health{k}", "GET /health{k}", 1, 1, 1), (23, 5, "/users{k}/{id}", "route:/users{k}/{id}", 1, 2, 1), (24, 5, "GET nolead{k}", "GET nolead{k}", 1, 2, 1), (25, 5, "/any", "route:/any{k}", 1, 2, 1), (26, 5, "/tests/x", "route:/tests/x{k}", 4, 2, 1),
    (31, 9, "e", "endpoint:GET:/api/users{k}/${x}", 2, 1, 2), (32, 9, "e", "endpoint:GET:/health{k}/", 2, 2, 2), (33, 9, "e", "endpoint:POST:/api/v1/users{k}/:k", 2, 2, 2), (34, 9, "e", "endpoint:GET:/any{k}", 2, 2, 2), (35, 9, "e", "endpoint:GET:/v1/none{k}", 2, 0, 2), (36, 9, "e", "endpoint:DELETE:/api{k}", 2, 2, 2),
    (41, 11, "Order", "grpc:Order{k}", 1, 2, 1), (42, 12, "Order", "grpc_client:Order{k}.Get", 2, 1, 2), (43, 12, "Cart", "grpc_client:Cart{k}", 2, 1, 2),
    (51, 13, "jobs", "queue_consumer:jobs{k}", 1, 1, 1), (52, 14, "jobs", "queue_producer:jobs{k}", 2, 0, 2), (53, 14, "other", "queue_producer:other{k}", 2, 1, 2),
    (61, 15, "GetUser", "graphql_resolver:GetUser{k}x", 1, 1, 1), (62, 16, "getUserById", "graphql_op:getUser{k}xById", 2, 2, 2), (63, 16, "x", "graphql_op:posts{k}", 2, 2, 2),
    (71, 17, "/chat", "ws:/chat{k}", 1, 1, 1), (72, 18, "live/chat/", "ws_client:live/chat{k}/", 2, 2, 2), (73, 17, "default", "ws:default", 1, 0, 1), (74, 18, "/feed", "ws_client:/feed{k}", 2, 2, 2),
    (81, 19, "made", "event_handle:made{k}", 1, 0, 1), (82, 20, "made", "event_emit:made{k}", 2, 0, 2), (83, 20, "gone", "event_emit:gone{k}", 2, 0, 2),
    (91, 21, "tool", "cli:tool{k}", 1, 2, 1), (92, 22, "tool", "cli_invoke:tool{k}", 2, 1, 2),
]
METHODS = [(21, "GET"), (21, "put"), (23, "POST"), (25, "ANY"), (26, "GET")]
#: Each row stands once for each supplier: keys have its number in place of ``{k}``, ids are apart by it.
_STEP = 1000


def _scaled_sql(rows: list[tuple], columns: str, ids: tuple[str, ...], texts: tuple[str, ...]) -> str:
    out = [f"{c} + {_STEP} * s_suppkey AS {c}" if c in ids else f"replace({c}, '{{k}}', s_suppkey::VARCHAR) AS {c}" if c in texts else c for c in columns.split(", ")]
    return f"(SELECT {', '.join(out)} FROM supplier, {_values(rows, columns)} v)"


def _scaled(spark: SparkSession, d: str, rows: list[tuple], schema: str, ids: tuple[str, ...], texts: tuple[str, ...]) -> DataFrame:
    names = [x.split() for x in schema.split(", ")]
    each = F.array(*[F.struct(*[F.lit(v).cast(t).alias(c) for (c, t), v in zip(names, r, strict=True)]) for r in rows])
    own = spark.read.parquet(f"{d}/supplier.parquet").select("s_suppkey", F.explode(each).alias("t"))
    key = F.col("s_suppkey")
    return own.select(*[(F.col(f"t.{c}") + _STEP * key if c in ids else F.replace(f"t.{c}", F.lit("{k}"), key.cast("string")) if c in texts else F.col(f"t.{c}")).alias(c) for c, _ in names])


_NODE_IDS, _NODE_TEXTS = ("id", "parent_id"), ("name", "qname")
_N = _scaled_sql(NODES, "id, kind, name, qname, parent_id, confidence, repo", _NODE_IDS, _NODE_TEXTS)
_M = _scaled_sql(METHODS, "node_id, method", ("node_id",), ())


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, NODES, "id long, kind int, name string, qname string, parent_id long, confidence int, repo long", _NODE_IDS, _NODE_TEXTS).withColumn("ord", F.col("id"))


def _methods(spark: SparkSession, d: str) -> DataFrame:
    return _scaled(spark, d, METHODS, "node_id long, method string", ("node_id",), ())


def _equal_sql(kind_a, prefix_a, kind_b, prefix_b, category, key="a.k") -> str:
    return f"WITH n AS {_N}, a AS (SELECT id, confidence, substr(qname, {len(prefix_a) + 1}) AS k FROM n WHERE kind = {kind_a}), b AS (SELECT id, confidence, substr(qname, {len(prefix_b) + 1}) AS k FROM n WHERE kind = {kind_b}) SELECT cast(a.id AS BIGINT) AS src, cast(b.id AS BIGINT) AS dst, {category} AS category, least(a.confidence, b.confidence) AS confidence FROM a JOIN b ON {key} = b.k"


_SEG = "list_transform(list_filter(string_split(trim({p}), '/'), lambda s: s <> ''), lambda s: CASE WHEN s[1] = ':' OR (s[1] = '{{' AND s[-1] = '}}') OR contains(s, '${{') THEN '{{}}' ELSE s END)"


def _norm(p: str) -> str:
    return "('/' || array_to_string(" + _SEG.format(p=p) + ", '/'))"


_FREE = "('protected', 'api', 'public', 'internal', 'v1', 'v2', 'v3')"
_HTTP_SQL = f"""WITH n AS {_N}, m AS {_M},
r AS (SELECT id AS dst, upper(method) AS method, {_norm("substr(qname, 7)")} AS path, confidence FROM n JOIN m ON id = node_id WHERE qname LIKE 'route:%'
  UNION ALL SELECT id, upper(string_split(qname, ' ')[1]), {_norm("string_split(qname, ' ')[2]")}, confidence FROM n WHERE kind = 5 AND qname LIKE '% /%'),
e AS (SELECT id AS src, confidence AS c, upper(string_split(qname, ':')[2]) AS method, {_norm("regexp_extract(qname, '^endpoint:[^:]*:(.*)$', 1)")} AS path FROM n WHERE kind = 9),
p AS (SELECT *, string_split(substr(path, 2), '/') AS s FROM e),
t AS (SELECT src, c, method, 0 AS k, path FROM p UNION ALL SELECT src, c, method, 1, '/' || array_to_string(s[2:], '/') FROM p WHERE s[1] IN {_FREE} AND len(s) > 1
  UNION ALL SELECT src, c, method, 2, '/' || array_to_string(s[3:], '/') FROM p WHERE s[1] IN {_FREE} AND s[2] IN {_FREE} AND len(s) > 2),
j AS (SELECT src, dst, k, least(c, confidence) AS confidence FROM t JOIN r USING (method, path)), q AS (SELECT *, min(k) OVER (PARTITION BY src) AS best FROM j)
SELECT cast(src AS BIGINT) AS src, cast(dst AS BIGINT) AS dst, 10 AS category, max(confidence) AS confidence FROM q WHERE k = best GROUP BY src, dst"""


@query("j11_http_links", _HTTP_SQL)
def _(spark, d):
    return stack.http_links(_nodes(spark, d), _methods(spark, d))


for _name, _f, _sql in (
    ("j12_grpc_links", stack.grpc_links, _equal_sql(12, "grpc_client:", 11, "grpc:", 11, "string_split(a.k, '.')[1]")),
    ("j13_queue_links", stack.queue_links, _equal_sql(14, "queue_producer:", 13, "queue_consumer:", 12)),
    ("j14_graphql_links", stack.graphql_links, _equal_sql(16, "graphql_op:", 15, "graphql_resolver:", 13, "contains(lower(a.k), lower(b.k)) OR contains(lower(b.k), lower(a.k)) OR a.k")),
    ("j15_socket_links", stack.socket_links, _equal_sql(18, "ws_client:", 17, "ws:", 14, "ends_with(lower(trim(a.k, '/')), lower(trim(b.k, '/'))) OR ends_with(lower(trim(b.k, '/')), lower(trim(a.k, '/'))) OR lower(trim(a.k, '/')) = 'ws' OR lower(trim(b.k, '/')) IN ('ws', 'default') OR a.k")),
    ("j16_event_links", stack.event_links, _equal_sql(20, "event_emit:", 19, "event_handle:", 15)),
    ("j17_cli_links", stack.cli_links, _equal_sql(22, "cli_invoke:", 21, "cli:", 17)),
    ("j18_schema_links", stack.schema_links, f"WITH n AS {_N}, s AS (SELECT c.id, c.name, c.repo, m.confidence FROM n c JOIN n m ON m.id = c.parent_id AND m.kind = 1 WHERE c.kind IN (2, 7, 8) AND regexp_matches(c.qname, 'Schema|Validator|Type|Model|Entity|DTO|Input|Output|Params|Request|Response')) SELECT cast(a.id AS BIGINT) AS src, cast(b.id AS BIGINT) AS dst, 16 AS category, least(a.confidence, b.confidence) AS confidence FROM s a JOIN s b ON a.name = b.name AND a.id < b.id AND a.repo <> b.repo"),
):
    query(_name, _sql)(lambda spark, d, f=_f: f(_nodes(spark, d)))


@query("j19_demote_unmatched", f"WITH n AS {_N}, l AS ({_HTTP_SQL}) SELECT cast(id AS BIGINT) AS id, CASE WHEN kind IN (5, 9) AND confidence > 0 AND id NOT IN (SELECT src FROM l UNION SELECT dst FROM l) THEN 1 ELSE confidence END AS confidence FROM n")
def _(spark, d):
    n = _nodes(spark, d)
    return post.demote_unmatched(n, stack.http_links(n, _methods(spark, d))).select("id", "confidence")


@query("j20_tests", f"WITH n AS {_N}, m AS (SELECT id, qname, string_split(qname, '::') AS s FROM n WHERE kind = 1), t AS (SELECT id, s, regexp_replace(s[-1], '^test_', '') AS k FROM m WHERE s[-1] LIKE 'test\\_%' ESCAPE '\\'), c AS (SELECT t.id AS src, m.id AS dst, CASE WHEN t.s[1] = m.s[1] THEN 1 ELSE 0 END AS shared FROM t JOIN m ON m.s[-1] = t.k AND m.id <> t.id) SELECT cast(src AS BIGINT) AS src, cast(dst AS BIGINT) AS dst, 7 AS category, 2 AS confidence FROM (SELECT *, max(shared) OVER (PARTITION BY src) AS best, row_number() OVER (PARTITION BY src ORDER BY shared DESC, dst) AS k FROM c) WHERE shared = best AND k <= 3")
def _(spark, d):
    return post.test_edges(_nodes(spark, d))


IMPORTS = [
    # from_module, form, module, name, alias, level, ord
    (1, "symbol", "helpers{k}", "slug", None, 1, 1), (1, "module", "app.auth{k}", None, "au", 0, 2), (3, "symbol", "app.users{k}", "UserModel{k}", "U", 0, 3),
    (3, "symbol", "app.auth{k}", "sub", None, 0, 4), (2, "module", "app.users{k}", None, None, 0, 5), (2, "module", "not.there", None, None, 0, 6), (2, "symbol", "app.users{k}", "missing", None, 0, 7),
]
CALLS = [
    # src, q_form, base, name, ord
    (12, "bare", None, "slug", 1), (12, "self", None, "save", 2), (12, "attribute", "au", "check", 3), (15, "attribute", "U", "login", 4), (15, "bare", None, "UserModel{k}", 5),
    (15, "attribute", "nobody", "x", 6), (14, "complex", None, "y", 7), (17, "bare", None, "make", 8), (14, "self", None, "save", 9),
]
REFS = [(21, 1, "bare", None, "make", 9, 1), (22, 1, "attribute", "au", "check", 9, 2), (23, 2, "bare", None, "none", 9, 3)]


def _resolved(spark: SparkSession, d: str):
    n = _nodes(spark, d)
    targets = resolve.import_targets(n, _scaled(spark, d, IMPORTS, "from_module long, form string, module string, name string, alias string, level int, ord long", ("from_module",), ("module", "name")))
    return n, targets


_IMPORTS = _scaled_sql(IMPORTS, "from_module, form, module, name, alias, level, ord", ("from_module",), ("module", "name"))
_CALLS = _scaled_sql(CALLS, "src, q_form, base, name, ord", ("src",), ("name",))
_REFS = _scaled_sql(REFS, "src, from_module, q_form, base, name, category, ord", ("src", "from_module"), ())
_RES = f"""WITH RECURSIVE n AS {_N}, i AS {_IMPORTS}, c AS {_CALLS}, f AS {_REFS},
m AS (SELECT id, qname FROM n WHERE kind = 1), sy AS (SELECT n.parent_id AS mid, n.name, max(n.id) AS id FROM n JOIN m ON m.id = n.parent_id GROUP BY ALL),
cm AS (SELECT n.parent_id AS cid, n.name, max(n.id) AS id FROM n JOIN n p ON p.id = n.parent_id AND p.kind IN (2, 8) WHERE n.kind = 4 GROUP BY ALL),
ip AS (SELECT i.*, CASE WHEN level > 0 THEN array_to_string(list_concat(string_split(q.qname, '::')[1:len(string_split(q.qname, '::')) - level], string_split(i.module, '.')), '::') ELSE replace(i.module, '.', '::') END AS path FROM i JOIN n q ON q.id = i.from_module),
t AS (SELECT from_module, m.id AS target_id, coalesce(alias, string_split(module, '.')[1]) AS binding, ord FROM ip JOIN m ON m.qname = path WHERE form = 'module'
  UNION ALL SELECT from_module, coalesce(sub.id, sy.id), coalesce(alias, ip.name), ord FROM ip LEFT JOIN m sub ON sub.qname = path || '::' || ip.name LEFT JOIN m home ON home.qname = path LEFT JOIN sy ON sy.mid = home.id AND sy.name = ip.name WHERE form = 'symbol' AND coalesce(sub.id, sy.id) IS NOT NULL),
b AS (SELECT from_module, binding, arg_max(target_id, ord) AS id FROM t GROUP BY ALL),
up(id, a, k) AS (SELECT id, id, 0 FROM n UNION ALL SELECT up.id, n.parent_id, k + 1 FROM up JOIN n ON n.id = up.a WHERE n.parent_id IS NOT NULL),
mo AS (SELECT up.id, arg_min(a, k) AS mid FROM up JOIN m ON m.id = a GROUP BY up.id), ow AS (SELECT up.id, arg_min(a, k) AS cid FROM up JOIN n ON n.id = a AND n.kind IN (2, 8) GROUP BY up.id),
rc AS (SELECT c.*, CASE q_form WHEN 'bare' THEN coalesce((SELECT b.id FROM b WHERE b.from_module = mo.mid AND b.binding = c.name), (SELECT sy.id FROM sy WHERE sy.mid = mo.mid AND sy.name = c.name))
  WHEN 'attribute' THEN (SELECT coalesce(sy.id, cm.id) FROM b LEFT JOIN sy ON sy.mid = b.id AND sy.name = c.name LEFT JOIN cm ON cm.cid = b.id AND cm.name = c.name WHERE b.from_module = mo.mid AND b.binding = c.base)
  WHEN 'self' THEN (SELECT cm.id FROM cm WHERE cm.cid = ow.cid AND cm.name = c.name) END AS dst FROM c LEFT JOIN mo ON mo.id = c.src LEFT JOIN ow ON ow.id = c.src),
rf AS (SELECT f.*, CASE q_form WHEN 'bare' THEN coalesce((SELECT b.id FROM b WHERE b.from_module = f.from_module AND b.binding = f.name), (SELECT sy.id FROM sy WHERE sy.mid = f.from_module AND sy.name = f.name))
  WHEN 'attribute' THEN (SELECT coalesce(sy.id, cm.id) FROM b LEFT JOIN sy ON sy.mid = b.id AND sy.name = f.name LEFT JOIN cm ON cm.cid = b.id AND cm.name = f.name WHERE b.from_module = f.from_module AND b.binding = f.base) END AS dst FROM f)
"""


@query("j1_j2_imports", _RES + "SELECT cast(from_module AS BIGINT) AS from_module, cast(target_id AS BIGINT) AS target_id, binding FROM t")
def _(spark, d):
    return _resolved(spark, d)[1].select("from_module", "target_id", "binding")


def _calls(spark, d):
    n, targets = _resolved(spark, d)
    return resolve.resolve_calls(n, _scaled(spark, d, CALLS, "src long, q_form string, base string, name string, ord long", ("src",), ("name",)), resolve.bindings(targets))


@query("j6_j8_calls", _RES + "SELECT cast(src AS BIGINT) AS src, cast(dst AS BIGINT) AS dst FROM rc WHERE dst IS NOT NULL")
def _(spark, d):
    return _calls(spark, d)[0].select("src", "dst")


@query("j9_unresolved", _RES + "SELECT cast(src AS BIGINT) AS src, name, cast(ord AS BIGINT) AS ord FROM rc WHERE dst IS NULL")
def _(spark, d):
    return _calls(spark, d)[1].select("src", "name", "ord")


@query("j10_refs", _RES + "SELECT cast(src AS BIGINT) AS src, cast(dst AS BIGINT) AS dst, category FROM rf WHERE dst IS NOT NULL")
def _(spark, d):
    n, targets = _resolved(spark, d)
    refs = _scaled(spark, d, REFS, "src long, from_module long, q_form string, base string, name string, category int, ord long", ("src", "from_module"), ())
    return resolve.resolve_refs(n, refs, resolve.bindings(targets))[0].select("src", "dst", "category")


# --- functions and extractors over the text tables -----------------------


@query("s2_s3_paths", "SELECT page_id, regexp_extract(url, '\\.([^./\\\\]+)$', 1) AS ext, replace(regexp_replace(url, '\\.[^./\\\\]*$', ''), '/', '::') AS qname FROM pages")
def _(spark, d):
    u = F.col("url")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", P.extension(u).alias("ext"), P.module_qname(u).alias("qname"))


@query("fn_normalise_http_path", f"SELECT page_id, {_norm("regexp_replace(url, '^[a-z]+://[^/]*', '')")} AS path FROM pages")
def _(spark, d):
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", P.normalise_http_path(F.regexp_replace("url", "^[a-z]+://[^/]*", "")).alias("path"))


@query("d7_preview", "SELECT doc_id, substr(rtrim(string_split(text, chr(10))[1], chr(13)), 1, 120) || CASE WHEN contains(text, chr(10)) OR length(string_split(text, chr(10))[1]) > 120 THEN '…' ELSE '' END AS line FROM documents")
def _(spark, d):
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", P.preview(F.col("text")).alias("line"))


@query("w3_carry_forward", "SELECT conv_id, turn, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS asked FROM conversations")
def _(spark, d):
    from pyspark.sql.window import Window as W

    w = W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)
    return spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", F.last(F.when(F.col("role") == "user", F.col("turn")), ignorenulls=True).over(w).alias("asked"))


from structgraph import queries_files as _files  # noqa: E402, F401  its queries register themselves
