"""From source files to a linked graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.extract.facts import extract_all
from structgraph.ids import node_ids, repo_id
from structgraph.operators import post, resolve, stack
from structgraph.parse import facts as schema
from structgraph.parse import python_ast, scan
from structgraph.session import materialize, spread
from structgraph.sources.files import describe, walk

#: Rows of facts, and characters of the sources they are of, that go to the engine at once.
BATCH_ROWS, BATCH_CHARS = 10_000, 4_000_000
DOTTED = ("java", "csharp", "php", "rust", "scala", "clojure", "elixir")


@dataclass
class Graph:
    """Tables of a built graph; ``edges`` has ``is_cross``."""

    nodes: DataFrame
    edges: DataFrame
    cells: DataFrame
    unresolved_calls: DataFrame
    unresolved_refs: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"nodes": self.nodes, "edges": self.edges, "cells": self.cells}


#: Parsers by language: functions of (path, source, module) that give a ``Facts``; languages that
#: aren't here are scanned by rules.
PARSERS: dict[str, Callable] = {"python": python_ast.parse}


def _parse(path: str, lang: str, source: str, module: str, parsers: dict[str, Callable] | None = None):
    own = (PARSERS if parsers is None else parsers).get(lang)
    return own(path, source, module) if own else scan.parse(path, source, module, lang)


def _frames(batches: Iterator[pd.DataFrame], parsers: dict[str, Callable]) -> Iterator[pd.DataFrame]:
    """Facts of many files a frame: making one costs far more than the few rows of a file."""

    def frame(rows: list[dict]) -> pd.DataFrame:
        out = pd.DataFrame(rows, columns=[*schema.COLUMNS, "lang"], dtype=object)
        return out.astype({c: "Int64" for c in ("ord", "kind", "confidence", "category", "level", "cell_type")})

    held: list[dict] = []
    chars = 0
    for x in batches:
        for path, lang, source, module in zip(x["path"], x["lang"], x["source"], x["module_qname"], strict=True):
            rows = _parse(path, lang, source, module, parsers).rows
            for r in rows:
                r["module"] = r.get("module") if r["tag"] == "import" else module
                r["lang"] = lang
            held += rows
            chars += len(source)
            if len(held) >= BATCH_ROWS or chars >= BATCH_CHARS:
                yield frame(held)
                held, chars = [], 0
    if held:
        yield frame(held)


def parse_files(files: DataFrame) -> DataFrame:
    """The fact stream of all files but .proto; the one stage that needs Python."""
    parsers = dict(PARSERS)  # goes to the tasks as it is now
    return files.where("lang <> 'proto'").mapInPandas(lambda batches: _frames(batches, parsers), schema.SCHEMA + ", lang string")


def style(lang: str) -> str:
    return lang if lang in ("python", "go", "ruby") else "dotted" if lang in DOTTED else "typescript"


def relative_source(importer: Column, raw: Column) -> Column:
    """The module that a relative import of a script means (``./x``, ``../x/y``); others resolve to nothing."""
    parts = F.split(importer, "::")
    ups = (F.length(raw) - F.length(F.replace(raw, F.lit("../"), F.lit("")))) / 3
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1 - ups.cast("int"), F.lit(0)))
    rest = F.split(F.regexp_replace(F.regexp_replace(raw, r"^(?:\.{1,2}/)+", ""), r"\.[jt]sx?$", ""), "/")
    return F.when(raw.startswith("./") | raw.startswith("../"), F.array_join(F.concat(kept, rest), "::"))


def build(spark: SparkSession, files: DataFrame, repo: str = "repo", mode: str = "packages") -> Graph:
    """Files (``path, lang, source, module_qname``) to a graph.

    ``mode="packages"`` makes the folder of a Go file its module, so that files
    of a package see each other; ``"files"`` keeps one module per file.
    """
    if mode == "packages":
        folder = F.regexp_replace("module_qname", "::[^:]*$", "")
        files = files.withColumn("module_qname", F.when((F.col("lang") == "go") & F.col("module_qname").contains("::"), folder).otherwise(F.col("module_qname")))
    files = materialize(spread(files, "path"))  # every extractor reads them again
    facts = materialize(parse_files(files))
    rid = F.lit(repo_id(repo))
    ident = lambda kind, qname: node_ids(rid, kind, qname)
    order = F.xxhash64("path")  # files have no order of their own; this one doesn't change
    node = facts.where("tag = 'node'").select("lang", "kind", "name", "qname", "parent", "confidence", F.struct("path", "ord").alias("o"))
    place = {c: F.col(c) for c in ("kind", "name", "qname", "parent", "confidence")}
    extra = materialize(extract_all(files.select("path", "lang", "source"))).join(files.select("path", "lang", F.col("module_qname").alias("parent")), "path").select("lang", *[place[c] for c in ("kind", "name", "qname", "parent", "confidence")], F.struct("path", F.lit(1 << 40).cast("long").alias("ord")).alias("o"))
    protos = files.where("lang = 'proto'").select("lang", F.lit(1).alias("kind"), F.element_at(F.split("module_qname", "::"), -1).alias("name"), F.col("module_qname").alias("qname"), F.lit(None).cast("string").alias("parent"), F.lit(2).alias("confidence"), F.struct("path", F.lit(0).cast("long").alias("ord")).alias("o"))
    every = materialize(reduce(DataFrame.unionByName, [node, extra, protos]).withColumn("id", ident(F.col("kind"), F.col("qname"))))
    # names to ids within a language; of equal names the first kind
    names = every.groupBy("lang", "qname").agg(F.min_by("id", "o").alias("id"))
    to = lambda df, column, name: df.join(names.select("lang", F.col("qname").alias(column), F.col("id").alias(name)), ["lang", column], "left")
    nodes = to(every.withColumn("ord", F.xxhash64("o.path") * 0 + F.col("o.ord")), "parent", "parent_id").select("lang", "id", "kind", "name", "qname", "parent_id", F.col("confidence").cast("int").alias("confidence"), F.col("ord"))
    nodes = materialize(nodes)
    edge = facts.where("tag = 'edge'").select("lang", F.col("src").alias("a"), F.col("dst").alias("b"), "category", "confidence")
    edges = to(to(edge, "a", "src"), "b", "dst").where("src is not null and dst is not null").select("lang", "src", "dst", "category", "confidence")
    stored = extra.where(F.col("qname").startswith("data_source:"))
    uses = to(to(stored.select("lang", F.col("parent").alias("a"), F.col("qname").alias("b")), "a", "src"), "b", "dst").select("lang", "src", "dst", F.lit(18).alias("category"), F.lit(1).alias("confidence"))
    edges = edges.unionByName(uses)
    imports = to(facts.where("tag = 'import'").select("lang", F.col("src").alias("a"), "form", "module", "name", "alias", "level", order.alias("h"), "ord"), "a", "from_module").select("lang", "from_module", "form", "module", "name", "alias", "level", "ord")
    calls = to(facts.where("tag = 'call'").select("lang", F.col("src").alias("a"), "q_form", "base", "name", "ord"), "a", "src").select("lang", "src", "q_form", "base", "name", "ord")
    refs = to(to(facts.where("tag = 'ref'").select("lang", F.col("src").alias("a"), F.col("module").alias("b"), "q_form", "base", "name", "category", "ord"), "a", "src"), "b", "from_module").select("lang", "src", "from_module", "q_form", "base", "name", "category", "ord")
    imports, calls, refs, edges = map(materialize, (imports, calls, refs, edges))
    parts: list[dict[str, DataFrame]] = []
    for lang in sorted(r["lang"] for r in nodes.select("lang").distinct().collect()):
        own = [df.where(F.col("lang") == lang).drop("lang") for df in (nodes, edges, imports, calls, refs)]
        built = resolve.build(*own, style=style(lang), resolve_source=relative_source)
        parts.append({k: v.withColumn("graph_key", F.lit(lang)) for k, v in built.items()})
    union = lambda k: reduce(DataFrame.unionByName, [p[k] for p in parts])
    merged = union("nodes").withColumn("repo", rid)
    cells = facts.where("tag = 'cell'").select("lang", F.col("qname").alias("a"), "cell_type", F.lit("text").alias("tag"), "text", "ord")
    cells = materialize(to(cells, "a", "node_id").select(F.col("lang").alias("graph_key"), "node_id", "cell_type", "tag", "text", F.lit(None).cast("binary").alias("bytes"), "ord"))
    methods = cells.where("cell_type = 5").select("node_id", F.get_json_object("text", "$.method").alias("method")).where("method is not null")
    routed = extra.where("kind = 5 and qname like 'route:%'")
    cross = materialize(stack.all_links(merged, methods.unionByName(_extracted_methods(files, routed, ident))))
    merged = post.demote_unmatched(post.downgrade(merged), cross)
    cross = cross.unionByName(post.test_edges(merged))
    flagged = union("edges").withColumn("is_cross", F.lit(False)).unionByName(cross.withColumns({"graph_key": F.lit("cross_stack"), "is_cross": F.lit(True)}))
    return Graph(materialize(merged), materialize(flagged), cells, union("unresolved_calls"), union("unresolved_refs"))


def _extracted_methods(files: DataFrame, routed: DataFrame, ident) -> DataFrame:
    from structgraph.extract.facts import BY_LANGUAGE, backend_routes

    langs = next(x for x, f in BY_LANGUAGE if backend_routes in f)
    found = backend_routes(files.where(F.col("lang").isin(*langs)).select("path", "lang", "source"))
    return found.select(ident(F.col("kind"), F.col("qname")).alias("node_id"), F.explode("methods").alias("method"))


def generate(spark: SparkSession, root: str, mode: str = "packages") -> Graph:
    files = walk(spark, root)
    if files.isEmpty():
        raise ValueError(f"nothing to parse under {root}")
    return build(spark, files, root, mode)


def parse_one(spark: SparkSession, source: str, path: str) -> DataFrame:
    """The node facts of a single text."""
    return parse_files(describe(spark.createDataFrame([(path, source)], "path string, source string"))).where("tag = 'node'")
