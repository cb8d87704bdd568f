"""Symbol tables, and imports, calls and references resolved by joins.

Priorities ("first this, then that") are ranks with a minimum, never an OR.
Schemas: ``nodes(id, kind, name, qname, parent_id, ord)``;
``imports(from_module, form, module, name, alias, level, ord)`` with form
``module`` or ``symbol``; ``calls(src, q_form, base, name, ord)`` with q_form
``bare``, ``self``, ``attribute`` or ``complex``;
``refs(src, from_module, q_form, base, name, category, ord)``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from structgraph.functions.paths import relative_module
from structgraph.operators.traverse import parent_chain
from structgraph.registries import CATEGORY, KIND
from structgraph.session import materialize

METHOD_OWNERS = (KIND["class"], KIND["struct"])
#: Kinds that extractors add; they never shadow code of the same name.
EXTRACTED = (KIND["component"], KIND["hook"], KIND["composable"])


def last_by(df: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Of rows with equal keys the value that comes last."""
    return df.groupBy(*keys).agg(F.max_by(F.col(value), order).alias(value))


def modules(nodes: DataFrame) -> DataFrame:
    own = nodes.where(F.col("kind") == KIND["module"]).select(F.col("qname").alias("module"), F.col("id").alias("module_id"), "ord")
    return last_by(own, ["module"], "module_id", F.struct("ord", "module_id"))


def module_symbols(nodes: DataFrame, code_first: bool = True) -> DataFrame:
    """``module_id``, ``name``, ``symbol_id``: direct children of modules, the last of a name."""
    parents = nodes.where(F.col("kind") == KIND["module"]).select(F.col("id").alias("parent_id"))
    own = nodes.join(parents, "parent_id", "left_semi").select(F.col("parent_id").alias("module_id"), "name", F.col("id").alias("symbol_id"), "ord", "kind")
    rank = ~F.col("kind").isin(*EXTRACTED) if code_first else F.lit(True)
    return last_by(own, ["module_id", "name"], "symbol_id", F.struct(rank, "ord", "symbol_id"))


def class_methods(nodes: DataFrame) -> DataFrame:
    """``class_id``, ``name``, ``method_id``: methods of classes and structs only."""
    owners = nodes.where(F.col("kind").isin(*METHOD_OWNERS)).select(F.col("id").alias("parent_id"))
    own = nodes.where(F.col("kind") == KIND["method"]).join(owners, "parent_id", "left_semi").select(F.col("parent_id").alias("class_id"), "name", F.col("id").alias("method_id"), "ord")
    return last_by(own, ["class_id", "name"], "method_id", F.struct("ord", "method_id"))


def _path(style: str, column: str) -> Column:
    sep = {"python": r"\.", "dotted": r"\.", "ruby": "/", "go": None}[style]
    return F.regexp_replace(column, sep, "::") if sep else F.col(column)


def import_targets(nodes: DataFrame, imports: DataFrame, style: str = "python", resolve_source: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """``from_module``, ``target_id``, ``binding`` (null: none), ``ord`` of imports that resolve.

    ``style`` is python, dotted, go, ruby or typescript; the last resolves
    sources with ``resolve_source(importer's qname, raw path)``.
    """
    known, symbols = modules(nodes), module_symbols(nodes)
    names = nodes.select(F.col("id").alias("from_module"), F.col("qname").alias("from_qname"))
    own = imports.join(names, "from_module", "left")
    if style == "typescript":
        source = resolve_source(F.col("from_qname"), F.col("module")) if resolve_source else F.lit(None).cast("string")
        own = own.withColumn("path", source)
    else:
        plain = _path(style, "module")
        own = own.withColumn("path", F.when(F.coalesce("level", F.lit(0)) > 0, relative_module(F.col("from_qname"), F.col("module"), F.col("level"))).otherwise(plain))
    whole = own.where("form = 'module'").join(known.withColumnRenamed("module", "path"), "path")
    if style in ("python", "dotted"):
        first = F.element_at(F.split("module", r"\."), 1)
    else:
        first = F.element_at(F.split("path", "::"), -1)
    binding = F.coalesce("alias", F.lit(None).cast("string") if style in ("typescript", "ruby") else first)
    whole = whole.select("from_module", F.col("module_id").alias("target_id"), binding.alias("binding"), "ord")
    # a symbol: a submodule of that name, else a symbol of the module, else (default) the module
    parts = own.where("form = 'symbol'").join(known.select(F.col("module").alias("path"), F.col("module_id").alias("home")), "path", "left")
    sub = known.select(F.col("module").alias("sub"), F.col("module_id").alias("sub_id"))
    parts = parts.withColumn("sub", F.when(F.col("path") == "", F.col("name")).otherwise(F.concat("path", F.lit("::"), "name"))).join(sub, "sub", "left")
    inside = symbols.select(F.col("module_id").alias("home"), "name", "symbol_id")
    parts = parts.join(inside, ["home", "name"], "left")
    default = F.when(F.col("name") == "default", F.col("home")) if style == "typescript" else F.lit(None).cast("long")
    found = F.coalesce("symbol_id", default) if style == "typescript" else F.coalesce("sub_id", "symbol_id")
    parts = parts.withColumn("target_id", found).where("target_id is not null").select("from_module", "target_id", F.coalesce("alias", "name").alias("binding"), "ord")
    return whole.unionByName(parts)


def bindings(targets: DataFrame) -> DataFrame:
    own = targets.where("binding is not null").select("from_module", "binding", "target_id", "ord")
    return last_by(own, ["from_module", "binding"], "target_id", F.struct("ord", "target_id"))


def import_edges(targets: DataFrame) -> DataFrame:
    return targets.select(F.col("from_module").alias("src"), F.col("target_id").alias("dst"), F.lit(CATEGORY["imports"]).alias("category"), F.lit(2).alias("confidence"))


def _nearest(nodes: DataFrame, above: DataFrame, kinds: tuple[int, ...], name: str) -> DataFrame:
    """``src`` and its nearest self-or-ancestor of some kinds; ``above`` are the nodes' ancestors."""
    chain = above.unionByName(nodes.select("id", F.col("id").alias("ancestor"), F.lit(0).alias("distance")))
    own = chain.join(nodes.where(F.col("kind").isin(*kinds)).select(F.col("id").alias("ancestor")), "ancestor", "left_semi")
    return own.groupBy(F.col("id").alias("src")).agg(F.min_by("ancestor", "distance").alias(name))


def _resolved(nodes: DataFrame, asked: DataFrame, bound: DataFrame, above: DataFrame | None = None) -> DataFrame:
    """``asked`` with ``dst``: of bare names the binding, then the module's symbol; of attributes what the
    base is bound to; of self calls (with ``above``, the nodes' ancestors) the method of the enclosing class."""
    symbols, methods = module_symbols(nodes), class_methods(nodes)
    out = asked.join(bound.select(F.col("from_module").alias("module_id"), F.col("binding").alias("name"), F.col("target_id").alias("by_name")), ["module_id", "name"], "left")
    out = out.join(symbols.select("module_id", "name", F.col("symbol_id").alias("own")), ["module_id", "name"], "left")
    out = out.join(bound.select(F.col("from_module").alias("module_id"), F.col("binding").alias("base"), F.col("target_id").alias("holder")), ["module_id", "base"], "left")
    out = out.join(symbols.select(F.col("module_id").alias("holder"), "name", F.col("symbol_id").alias("in_module")), ["holder", "name"], "left")
    out = out.join(methods.select(F.col("class_id").alias("holder"), "name", F.col("method_id").alias("in_class")), ["holder", "name"], "left")
    if above is not None:
        out = out.join(_nearest(nodes, above, METHOD_OWNERS, "class_id"), "src", "left").join(methods.select("class_id", "name", F.col("method_id").alias("by_self")), ["class_id", "name"], "left")
    else:
        out = out.withColumn("by_self", F.lit(None).cast("long"))
    dst = F.when(F.col("q_form") == "bare", F.coalesce("by_name", "own")).when(F.col("q_form") == "attribute", F.coalesce("in_module", "in_class")).when(F.col("q_form") == "self", F.col("by_self"))
    return out.select(*asked.columns, dst.alias("dst"))


def _asked_calls(nodes: DataFrame, calls: DataFrame, bound: DataFrame) -> DataFrame:
    above = parent_chain(nodes)
    return _resolved(nodes, calls.join(_nearest(nodes, above, (KIND["module"],), "module_id"), "src", "left"), bound, above)


def _asked_refs(nodes: DataFrame, refs: DataFrame, bound: DataFrame) -> DataFrame:
    return _resolved(nodes, refs.withColumnRenamed("from_module", "module_id"), bound)


def _split_calls(out: DataFrame, calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = out.where("dst is not null").select("src", "dst", F.lit(CATEGORY["calls"]).alias("category"), F.lit(2).alias("confidence"))
    return edges, out.where("dst is null").select(*calls.columns)


def _split_refs(out: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    edges = out.where("dst is not null").select("src", "dst", "category", F.lit(2).alias("confidence"))
    return edges, out.where("dst is null").withColumnRenamed("module_id", "from_module").select(*refs.columns)


def resolve_calls(nodes: DataFrame, calls: DataFrame, bound: DataFrame, extra_hook: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Call edges, and the calls that stay unresolved (``extra_hook`` may resolve some: src, dst, ord)."""
    out = _asked_calls(nodes, calls, bound)
    if extra_hook:
        more = extra_hook(out.where("dst is null")).select("src", "ord", F.col("dst").alias("more"))
        out = out.join(more, ["src", "ord"], "left").withColumn("dst", F.coalesce("dst", "more")).drop("more")
    return _split_calls(out, calls)


def resolve_refs(nodes: DataFrame, refs: DataFrame, bound: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges of each reference's own category, and the references that stay unresolved."""
    return _split_refs(_asked_refs(nodes, refs, bound), refs)


def merge_nodes(facts: DataFrame) -> DataFrame:
    """One row per id: the first confidence, the last of everything else."""
    order = F.struct("ord", "qname")
    return facts.groupBy("id").agg(F.max_by("kind", order).alias("kind"), F.max_by("name", order).alias("name"), F.max_by("qname", order).alias("qname"), F.max_by("parent_id", order).alias("parent_id"), F.min_by("confidence", order).alias("confidence"), F.min("ord").alias("ord"))


def build(nodes: DataFrame, edges: DataFrame, imports: DataFrame, calls: DataFrame, refs: DataFrame, style: str = "python", resolve_source=None) -> dict[str, DataFrame]:
    """``nodes``, ``edges``, ``unresolved_calls``, ``unresolved_refs`` of one language's facts.

    What several results are made of is stored once, so no plan holds the whole resolution.
    """
    nodes = materialize(merge_nodes(nodes))
    targets = materialize(import_targets(nodes, imports, style, resolve_source))
    bound = materialize(bindings(targets))
    call_edges, lost_calls = _split_calls(materialize(_asked_calls(nodes, calls, bound)), calls)
    ref_edges, lost_refs = _split_refs(materialize(_asked_refs(nodes, refs, bound)), refs)
    own = edges.select("src", "dst", "category", "confidence")
    return {"nodes": nodes, "edges": reduce(DataFrame.unionByName, [own, import_edges(targets), call_edges, ref_edges]), "unresolved_calls": lost_calls, "unresolved_refs": lost_refs}
