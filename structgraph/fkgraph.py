"""A property graph from a star schema: rows are nodes, foreign keys are edges.

The text is plain SQL, so that other engines can build the same graph.
"""

from __future__ import annotations

from zlib import crc32

from pyspark.sql import DataFrame, SparkSession

from structgraph.session import shared_dir

K = 1_000_000_000_000
NODES = f"""
SELECT cast(101 * {K} + r_regionkey AS BIGINT) AS id, 101 AS kind, r_name AS name, r_name AS qname, cast(NULL AS BIGINT) AS parent_id, 2 AS confidence FROM {{region}}
UNION ALL SELECT cast(102 * {K} + n_nationkey AS BIGINT), 102, n_name, concat(r_name, '::', n_name), cast(101 * {K} + n_regionkey AS BIGINT), 2 FROM {{nation}} JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT cast(103 * {K} + c_custkey AS BIGINT), 103, c_name, concat(r_name, '::', n_name, '::', c_name), cast(102 * {K} + c_nationkey AS BIGINT), CASE WHEN c_acctbal < 0 THEN 0 WHEN c_acctbal < 5000 THEN 1 ELSE 2 END FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT cast(104 * {K} + s_suppkey AS BIGINT), 104, s_name, concat(r_name, '::', n_name, '::', s_name), cast(102 * {K} + s_nationkey AS BIGINT), 2 FROM {{supplier}} JOIN {{nation}} ON s_nationkey = n_nationkey JOIN {{region}} ON n_regionkey = r_regionkey
UNION ALL SELECT cast(105 * {K} + o_orderkey AS BIGINT), 105, concat('order', cast(o_orderkey AS STRING)), concat('orders::', o_orderpriority, '::order', cast(o_orderkey AS STRING)), cast(103 * {K} + o_custkey AS BIGINT), CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END FROM {{orders}}
UNION ALL SELECT cast(106 * {K} + p_partkey AS BIGINT), 106, p_name, concat('parts::', p_brand, '::', p_name), cast(NULL AS BIGINT), 2 FROM {{part}}
UNION ALL SELECT DISTINCT cast(107 * {K} + user_id AS BIGINT), 107, concat('user', cast(user_id AS STRING)), concat('users::user', cast(user_id AS STRING)), cast(NULL AS BIGINT), 1 FROM {{events}}
UNION ALL SELECT id, 108, event_type, concat('events::', event_type), cast(NULL AS BIGINT), 1 FROM (SELECT cast(108 * {K} + row_number() OVER (ORDER BY event_type) AS BIGINT) AS id, event_type FROM (SELECT DISTINCT event_type FROM {{events}}) t) u
"""
EDGES = f"""
SELECT cast(102 * {K} + n_nationkey AS BIGINT) AS src, cast(101 * {K} + n_regionkey AS BIGINT) AS dst, 2 AS category, 2 AS confidence FROM {{nation}}
UNION ALL SELECT cast(103 * {K} + c_custkey AS BIGINT), cast(102 * {K} + c_nationkey AS BIGINT), 1, 2 FROM {{customer}}
UNION ALL SELECT cast(104 * {K} + s_suppkey AS BIGINT), cast(102 * {K} + s_nationkey AS BIGINT), 1, 2 FROM {{supplier}}
UNION ALL SELECT cast(105 * {K} + o_orderkey AS BIGINT), cast(103 * {K} + o_custkey AS BIGINT), 9, CASE o_orderstatus WHEN 'F' THEN 2 WHEN 'O' THEN 1 ELSE 0 END FROM {{orders}}
UNION ALL SELECT DISTINCT cast(105 * {K} + l_orderkey AS BIGINT), cast(106 * {K} + l_partkey AS BIGINT), 4, 1 FROM {{lineitem}}
UNION ALL SELECT DISTINCT cast(105 * {K} + l_orderkey AS BIGINT), cast(104 * {K} + l_suppkey AS BIGINT), 5, 1 FROM {{lineitem}}
UNION ALL SELECT DISTINCT cast(107 * {K} + user_id AS BIGINT), t.id, 15, 0 FROM {{events}} e JOIN (SELECT cast(108 * {K} + row_number() OVER (ORDER BY event_type) AS BIGINT) AS id, event_type FROM (SELECT DISTINCT event_type FROM {{events}}) d) t ON e.event_type = t.event_type
"""
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")


_SCHEMAS: dict[tuple[str, str], object] = {}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The tables; a schema is read from the files once per path."""
    out = {}
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        known = _SCHEMAS.get((sf_dir, t))
        out[t] = spark.read.schema(known).parquet(path) if known is not None else spark.read.parquet(path)
        _SCHEMAS[sf_dir, t] = out[t].schema
    return out


def fk_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES, **_tables(spark, sf_dir))


def fk_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(EDGES, **_tables(spark, sf_dir))


_STORED: dict[tuple[str, str, str], str] = {}


def _state(spark: SparkSession, sf_dir: str) -> str:
    """Sizes and times of the tables' folders: another text after they change."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for t in TABLES:
        path = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{t}.parquet")
        fs = path.getFileSystem(conf)
        out.append(f"{t}:{fs.getContentSummary(path).getLength()}:{fs.getFileStatus(path).getModificationTime()}")
    return ",".join(out)


def stored_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as Parquet in the shared folder, made once a session for the tables as they are.

    Nodes go by id and edges by source, so a search for one reads few row groups.
    """
    key = (spark.sparkContext.applicationId, sf_dir, _state(spark, sf_dir))
    root = _STORED.get(key)
    if root is None:
        root = f"{shared_dir(spark)}/star-{key[0]}-{crc32(repr(key).encode()):08x}"
        fk_nodes(spark, sf_dir).repartitionByRange("id").sortWithinPartitions("id").write.mode("overwrite").parquet(f"{root}/nodes")
        fk_edges(spark, sf_dir).repartitionByRange("src").sortWithinPartitions("src").write.mode("overwrite").parquet(f"{root}/edges")
        _STORED[key] = root
    return spark.read.parquet(f"{root}/nodes"), spark.read.parquet(f"{root}/edges")


def with_graph(sql: str, recursive: bool = False) -> str:
    """``sql`` over the graph, for an engine where the tables are views."""
    named = {t: t for t in TABLES}
    return f"WITH {'RECURSIVE ' * recursive}nodes AS ({NODES.format(**named)}), edges AS ({EDGES.format(**named)}) {sql}"
