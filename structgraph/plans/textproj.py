"""Dense text of a graph: legend, scopes, defaults, topology, node blocks.

Lines are rows with a sort key, made by joins and one aggregation per node, so
only the scopes (25 at most) reach the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.functions.paths import compact_position, preview
from structgraph.plans import stats
from structgraph.registries import CONFIDENCE

SCOPES = 25
DEPENDS = (4, 9, 10)
STARRED = (5, 9)
# The text's legend, names of the kinds that have one, labels of cells.
LEGEND = ("[LEGEND]", "> depends    * entry point    @ external")
KIND_NAMES = {1: "Module", 2: "Class", 3: "Function", 4: "Method", 5: "Route", 6: "Package", 7: "Interface", 8: "Struct", 9: "Endpoint"}
CELL_LABELS = {
    1: "code", 2: "doc", 3: "position", 4: "intent", 5: "method", 6: "hit", 7: "test", 8: "attn", 9: "fail", 10: "constraint", 11: "decision",
    12: "env", 13: "conv", 14: "vector",
}


def _named(column: Column, names: dict[int, str], other: str) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), column), F.lit(other))


def scope_savings(nodes: DataFrame) -> DataFrame:
    """``prefix``, ``n``, ``saving``: the bytes that an alias with a letter per segment (two for one) saves, its legend line paid."""
    own = stats.prefixes(nodes)
    segments = F.size(F.split("prefix", "::"))
    short = F.when(segments == 1, 2).otherwise(segments)
    size = F.octet_length("prefix")
    return own.select("prefix", "n", F.greatest(F.lit(0).cast("long"), F.col("n") * (size - short) - (size + short + 3)).alias("saving"))


def scopes(nodes: DataFrame) -> list[tuple[str, str]]:
    """``(prefix, alias)`` of the prefixes that save most, longest first; aliases are given by saving."""
    best = [r["prefix"] for r in scope_savings(nodes).orderBy(F.desc("saving"), "prefix").limit(SCOPES).collect()]
    used: set[str] = set()
    out = []
    for p in best:
        out.append((p, alias(p, used)))
        used.add(out[-1][1])
    return sorted(out, key=lambda x: -len(x[0].encode()))


def alias(prefix: str, used: set[str]) -> str:
    """Capital initials (of one part its first two letters); a clash adds a letter of the last part, then a number."""
    parts = prefix.split("::")
    short = (parts[0] + "Xx"[len(parts[0]) :])[:2].capitalize() if len(parts) == 1 else "".join(x[:1] for x in parts).upper()
    tries = [short, *([short + parts[-1][1].lower()] if len(parts[-1]) > 1 else []), *(f"{short}{i}" for i in range(2, 100))]
    return next((t for t in tries if t not in used), short)


def abbreviate(qname: Column, known: list[tuple[str, str]]) -> Column:
    """The longest prefix that ends at a ``::`` or is all, by its alias."""
    out = F.when(F.lit(False), qname)
    for prefix, short in known:
        out = out.when(qname == prefix, F.lit(short)).when(qname.startswith(prefix + "::"), F.concat(F.lit(short), F.substr(qname, F.lit(len(prefix) + 1), F.length(qname))))
    return out.otherwise(qname)


def cell_line(cell_type: Column, text: Column, raw: Column) -> Column:
    body = F.when(cell_type == 3, compact_position(text)).when(raw.isNotNull(), F.concat(F.lit("<"), F.octet_length(raw).cast("string"), F.lit(" bytes>"))).otherwise(preview(text))
    return F.concat(F.lit(":"), F.rpad(_named(cell_type, CELL_LABELS, "cell"), 10, " "), F.lit(" "), body)


def topology(nodes: DataFrame, edges: DataFrame, known: list[tuple[str, str]]) -> DataFrame:
    """``line`` of what depends on what: ``source[ *] > target``, each once; a source must be known."""
    own = nodes.select("id", abbreviate(F.col("qname"), known).alias("short"), F.when(F.col("kind").isin(*STARRED), F.lit(" *")).otherwise(F.lit("")).alias("star"))
    a, b = own.select(F.col("id").alias("src"), F.concat("short", "star").alias("x")), own.select(F.col("id").alias("dst"), F.col("short").alias("y"))
    links = edges.where(F.col("category").isin(*DEPENDS)).join(a, "src").join(b, "dst", "left")
    target = F.coalesce("y", F.concat(F.lit("@unresolved#"), F.lower(F.hex("dst"))))
    return links.select(F.concat("x", F.lit(" > "), target).alias("line")).distinct()


def _label(name: str) -> Column:
    return F.rpad(F.lit(name), 11, " ")


def node_lines(nodes: DataFrame, cells: DataFrame, known: list[tuple[str, str]], kind: int | None, confidence: int | None) -> DataFrame:
    """``qname``, ``id``, ``pos``, ``line`` of all node blocks; kinds and confidences that are the default aren't said."""
    one = F.struct("ord", "cell_type", cell_line(F.col("cell_type"), F.col("text"), F.col("bytes")).alias("line"), F.when(F.col("cell_type") == 3, F.element_at(F.split(F.get_json_object("text", "$.file"), "/"), -1)).alias("file"))
    body = cells.groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_list(one)).alias("cells"), (F.count_if(F.col("cell_type") == 1) > 1).alias("many"))
    none = F.array().cast("array<string>")
    said = lambda column, default, label, name: F.when(~F.col(column).eqNullSafe(F.lit(default)), F.array(F.concat(_label(label), name))).otherwise(none)
    files = F.expr("array_join(transform(filter(cells, c -> c.file IS NOT NULL), c -> c.file), ', ')")
    folded = F.concat(F.when(files != "", F.array(F.concat(_label(":files"), F.lit(" "), files))).otherwise(none), F.expr("transform(filter(cells, c -> c.file IS NULL AND c.cell_type <> 1), c -> c.line)"))
    block = nodes.join(body, "id", "left").select(
        "qname", "id", F.concat(
            F.array(F.concat(F.lit("["), abbreviate(F.col("qname"), known), F.lit("]"), F.when(F.col("kind").isin(*STARRED), F.lit(" *")).otherwise(F.lit("")))),
            said("kind", kind, ":kind", F.concat(F.lit(" "), _named(F.col("kind"), KIND_NAMES, "Node"))),
            said("confidence", confidence, ":confidence", F.concat(F.lit(" "), _named(F.col("confidence"), CONFIDENCE, ""))),
            F.when((F.col("kind") == 1) & F.col("many"), folded).otherwise(F.coalesce(F.expr("transform(cells, c -> c.line)"), none)),
            F.array(F.lit("")),
        ).alias("block"),
    )
    return block.select("qname", "id", F.posexplode("block").alias("pos", "line"))


def lines(nodes: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """``section``, ``key``, ``id``, ``pos``, ``line`` of the whole text."""
    spark = nodes.sparkSession
    known = scopes(nodes)
    kind, confidence = ((r := stats.majority(nodes, c).first()) and r["value"] for c in ("kind", "confidence"))
    head = [("0legend", i, x) for i, x in enumerate(LEGEND)]
    head += [("1scopes", i, x) for i, x in enumerate(["", "[SCOPES]", *(f"{a} = {p}" for p, a in known)])] if known else []
    said = [f":kind       {KIND_NAMES.get(kind, 'Node')}"] * (kind is not None) + [f":confidence {CONFIDENCE[confidence]}"] * (confidence is not None) if kind is not None or confidence is not None else []
    head += [("2defaults", i, x) for i, x in enumerate(["", "[DEFAULTS]", *said])] if said else []
    head += [("3topology", 0, ""), ("3topology", 1, "[TOPOLOGY]"), ("5nodes", 0, "")]
    top = spark.createDataFrame([(s, "", 0, i, x) for s, i, x in head], "section string, key string, id long, pos int, line string")
    links = topology(nodes, edges, known).select(F.lit("4links").alias("section"), F.col("line").alias("key"), F.lit(0).cast("long").alias("id"), F.lit(0).alias("pos"), "line")
    blocks = node_lines(nodes, cells, known, kind, confidence).select(F.lit("6blocks").alias("section"), F.col("qname").alias("key"), "id", "pos", "line")
    return reduce(DataFrame.unionByName, [top, links, blocks])


def dense_text(nodes: DataFrame, edges: DataFrame, cells: DataFrame) -> DataFrame:
    """The text's lines in order."""
    return lines(nodes, edges, cells).orderBy("section", "key", "id", "pos").select("line")


def write_text(nodes: DataFrame, edges: DataFrame, cells: DataFrame, path: str) -> None:
    dense_text(nodes, edges, cells).write.mode("overwrite").text(path)
