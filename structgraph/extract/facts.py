"""Facts about frameworks in source text: ``path, kind, name, qname, confidence`` per fact.

Patterns are a literal array that is filtered per file, so a file is read once
and nothing is joined or shuffled; the first of equal facts in a file is kept
by distinct names, which are equal rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from structgraph.extract import patterns as X
from structgraph.functions import paths as P
from structgraph.registries import KIND


def _hits(files: DataFrame, rows: list[dict]) -> DataFrame:
    """A row per file and pattern found in it: ``path``, ``source``, ``p`` (a struct of the pattern's row)."""
    table = F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in r.items()]) for r in rows])
    return files.select("path", "source", F.explode(F.filter(table, lambda p: F.contains(F.col("source"), p["pattern"]))).alias("p"))


def _facts(found: DataFrame, kind: str, prefix: str, confidence: int, name: str = "name") -> DataFrame:
    own = found.where(F.col(name).isNotNull()).select("path", F.lit(KIND[kind]).alias("kind"), F.col(name).alias("name"), F.concat(F.lit(prefix), F.col(name)).alias("qname"), F.lit(confidence).alias("confidence"))
    return own.distinct()


def lines(files: DataFrame) -> DataFrame:
    """``path``, ``line_no``, ``line`` (trimmed)."""
    return files.select("path", F.posexplode(F.split("source", r"\r?\n")).alias("line_no", "line")).withColumn("line", F.expr("trim(BOTH ' \t' FROM line)"))


def _queues(files: DataFrame, rows: tuple, kind: str) -> DataFrame:
    hits = _hits(files, [{"pattern": p, "framework": f} for p, f in rows])
    return _facts(hits.withColumn("name", F.coalesce(P.literal_after(F.col("source"), F.col("p.pattern"), 128), F.col("p.framework"))), kind, f"{kind}:", 1)


def queue_consumers(files: DataFrame) -> DataFrame:
    return _queues(files, X.QUEUE_CONSUMERS, "queue_consumer")


def queue_producers(files: DataFrame) -> DataFrame:
    return _queues(files, X.QUEUE_PRODUCERS, "queue_producer")


def raw_hits(files: DataFrame, what: str) -> DataFrame:
    """``path``, ``pattern`` and ``framework`` (null: none) of every pattern found: ``queue_consumers``, ``queue_producers`` or ``cli_invocations``."""
    rows = {"queue_consumers": X.QUEUE_CONSUMERS, "queue_producers": X.QUEUE_PRODUCERS, "cli_invocations": [(p, None) for p in X.CLI_INVOCATIONS]}[what]
    hits = _hits(files, [{"pattern": p, "framework": f} for p, f in rows])
    return hits.select("path", "p.pattern", F.col("p.framework").cast("string").alias("framework"))


def cli_commands(files: DataFrame) -> DataFrame:
    line, lit = F.col("line"), lambda rest: P.leading_literal(rest, 64)
    after = lambda mark: F.substr(line, F.instr(line, F.lit(mark)) + len(mark), F.length(line))
    cobra = F.when(line.contains("cobra.Command") & line.contains("Use:"), lit(after("Use:")))
    click = F.when(line.startswith("@click.command("), lit(after("@click.command(")))
    commander = F.when(line.contains(".command("), lit(after(".command(")))
    clap = F.when(line.contains("#[command(name"), lit(F.regexp_extract(line, r"name[^=]*=(.*)$", 1)))
    return _facts(lines(files).withColumn("name", F.coalesce(cobra, click, commander, clap)), "cli_command", "cli:", 2)


def cli_invocations(files: DataFrame) -> DataFrame:
    import re

    mark = "|".join(re.escape(p) for p in sorted(X.CLI_INVOCATIONS, key=len, reverse=True))
    pattern = rf"""(?:{mark})\s*("[^"]*"|'[^']*')"""
    found = files.select("path", F.explode(F.regexp_extract_all("source", F.lit(pattern), F.lit(1))).alias("quoted"))
    return _facts(found.withColumn("name", P.leading_literal(F.col("quoted"), 64)), "cli_invocation", "cli_invoke:", 1)


def socket_handlers(files: DataFrame) -> DataFrame:
    hits = _hits(files, [{"pattern": p} for p in X.SOCKET_HANDLERS])
    default = F.when(F.col("p.pattern").rlike("Gateway|Channel|Cable"), F.lit("default")).otherwise(F.lit("ws"))
    return _facts(hits.withColumn("name", F.coalesce(P.socket_path(P.literal_after(F.col("source"), F.col("p.pattern"), 256)), default)), "ws_handler", "ws:", 1)


def socket_clients(files: DataFrame) -> DataFrame:
    hits = _hits(files, [{"pattern": p} for p in X.SOCKET_CLIENTS])
    return _facts(hits.withColumn("name", F.coalesce(P.socket_path(P.literal_after(F.col("source"), F.col("p.pattern"), 256)), F.lit("ws"))), "ws_client", "ws_client:", 1)


def _events(files: DataFrame, rows: tuple, kind: str, prefix: str) -> DataFrame:
    hits = _hits(files, [{"pattern": p, "named": n} for p, n in rows])
    plain = F.regexp_replace(F.expr("trim(BOTH '.' FROM p.pattern)"), r"\(+$", "")
    return _facts(hits.withColumn("name", F.coalesce(F.when(F.col("p.named"), P.literal_after(F.col("source"), F.col("p.pattern"), 128)), plain)), kind, prefix, 0)


def event_emitters(files: DataFrame) -> DataFrame:
    return _events(files, X.EVENT_EMITTERS, "event_emitter", "event_emit:")


def event_handlers(files: DataFrame) -> DataFrame:
    return _events(files, X.EVENT_HANDLERS, "event_handler", "event_handle:")


_BODY = r"\s*(?:query|mutation|subscription) (\w+)"


def graphql_operations(files: DataFrame) -> DataFrame:
    """Per line the first call pattern, named by the file's first tagged operation; then every tagged template."""
    first = reduce(lambda a, t: F.coalesce(a, F.when(F.col("source").contains(t), F.regexp_extract(F.substr(F.col("source"), F.instr("source", F.lit(t)) + len(t), F.length("source")), "^" + _BODY, 1))), ["gql`", "gql(`", 'gql("', "graphql(`", 'graphql("'], F.lit(None).cast("string"))
    named = files.select("path", "source", F.nullif(first, F.lit("")).alias("operation"))
    call = reduce(lambda a, p: a.when(F.col("line").contains(p), F.lit(p.rstrip("("))), X.GRAPHQL_OPERATIONS, F.when(F.lit(False), F.lit("")))
    each = named.select("path", "operation", F.explode(F.split("source", r"\r?\n")).alias("line")).withColumn("call", call).where("call is not null")
    called = each.select("path", F.coalesce("operation", "call").alias("name"))
    tagged = files.select("path", F.explode(F.regexp_extract_all("source", F.lit("gql`" + _BODY), F.lit(1))).alias("name"))
    weak, strong = _facts(called, "graphql_operation", "graphql_op:", 1), _facts(tagged, "graphql_operation", "graphql_op:", 2)
    return weak.unionByName(strong.join(weak, ["path", "name"], "left_anti").select(*weak.columns))


def graphql_resolvers(files: DataFrame) -> DataFrame:
    import re

    clean = lambda p: re.sub(r"(\(| \{|\):)$", "", p.lstrip("@")).replace("type ", "").replace("graphene.", "")
    hits = _hits(files, [{"pattern": p, "name": clean(p)} for p in X.GRAPHQL_RESOLVERS])
    return _facts(hits.select("path", "p.name"), "graphql_resolver", "graphql_resolver:", 1)


def grpc_services(files: DataFrame) -> DataFrame:
    """Services of .proto files with ``methods``, their number of rpcs (cell text is made of both)."""
    from pyspark.sql.window import Window as W

    service = F.when(F.col("line").startswith("service "), F.trim(F.substring_index(F.expr("substr(line, 9)"), "{", 1)))
    marked = lines(files).withColumn("service", F.nullif(service, F.lit(""))).withColumn("rpc", F.col("line").rlike(r"^rpc +[^( ]"))
    inside = F.last("service", ignorenulls=True).over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0))
    found = marked.withColumn("name", inside).where("name is not null").groupBy("path", "name").agg(F.count_if("rpc").alias("methods"))
    return found.select("path", F.lit(KIND["grpc_service"]).alias("kind"), "name", F.concat(F.lit("grpc:"), "name").alias("qname"), F.lit(2).alias("confidence"), "methods")


def grpc_clients(files: DataFrame) -> DataFrame:
    marks = F.array(*map(F.lit, X.GRPC_CLIENTS))
    each = lines(files).select("path", "line", F.explode(F.filter(marks, lambda m: F.contains(F.col("line"), m))).alias("mark"))
    token = F.regexp_extract(F.substr("line", F.lit(1), F.instr(F.col("line"), F.col("mark")) - 1), r"(\w*)$", 1)
    name = F.when(token.endswith("Service"), F.regexp_replace(token, "Service$", "")).otherwise(F.regexp_replace(token, "Svc$", ""))
    return _facts(each.withColumn("name", F.when(F.length(name) >= 2, name)), "grpc_client", "grpc_client:", 1)


def data_sources(files: DataFrame) -> DataFrame:
    """One fact per provider and file, with the kind of the first pattern."""
    hits = _hits(files, [{"pattern": p, "ord": i, "kind": k, "provider": v} for i, (p, k, v) in enumerate(X.DATA_SOURCES)])
    first = hits.groupBy("path", F.col("p.provider").alias("name")).agg(F.min_by("p.kind", "p.ord").alias("kind"))
    return first.select("path", "kind", "name", F.concat(F.lit("data_source:"), "name").alias("qname"), F.lit(1).alias("confidence"))


# --- routes of TypeScript back ends --------------------------------------

_VERBS = "get|post|put|patch|delete|options|head|all"
_CLIENT = r"axios|fetch\(|http\.|client\.|this\.http|request\("


def express_routes(files: DataFrame) -> DataFrame:
    """``path``, ``method``, ``route`` of ``.verb('/…'`` lines that don't look like a client's."""
    pattern = rf"""\.({_VERBS})\(\s*["'`](/[^"'`]*)["'`]"""
    each = lines(files).where(~F.col("line").rlike(_CLIENT))
    every = each.select("path", F.regexp_extract_all("line", F.lit(pattern), F.lit(1)).alias("method"), F.regexp_extract_all("line", F.lit(pattern), F.lit(2)).alias("route"))
    found = every.select("path", F.explode(F.arrays_zip("method", "route")).alias("r")).select("path", F.upper("r.method").alias("method"), "r.route")
    return found.where("octet_length(route) <= 256").distinct()


def _exports(found: DataFrame) -> DataFrame:
    pattern = r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\b"
    named = F.array_distinct(F.regexp_extract_all("source", F.lit(pattern), F.lit(1)))
    default = F.when(F.col("source").contains("export default"), F.array(F.lit("GET"))).otherwise(F.array().cast("array<string>"))
    return found.select("path", F.explode(F.when(F.size(named) > 0, named).otherwise(default)).alias("method"), "route")


def next_routes(files: DataFrame) -> DataFrame:
    app = F.regexp_extract("path", r"(?:^|/)app(/api/.*?)/?route\.[jt]sx?$", 1)
    page = F.regexp_extract("path", r"(?:^|/)pages(/api/.*?)(?:/index)?\.[jt]sx?$", 1)
    route = F.coalesce(F.nullif(app, F.lit("")), F.nullif(page, F.lit("")))
    return _exports(files.withColumn("route", P.bracket_params(F.regexp_replace(route, "/$", ""))).where("route is not null"))


def kit_routes(files: DataFrame) -> DataFrame:
    route = F.regexp_extract("path", r"(?:^|/)routes(/.*?)/?\+server\.[jt]s$", 1)
    own = files.where(F.col("path").rlike(r"(?:^|/)routes/(?:.*/)?\+server\.[jt]s$"))
    return _exports(own.withColumn("route", P.bracket_params(F.when(route.isin("", "/"), F.lit("/")).otherwise(F.regexp_replace(route, "/$", "")))))


def nest_routes(files: DataFrame) -> DataFrame:
    """``@Controller(prefix)`` holds for the verbs after it."""
    from pyspark.sql.window import Window as W

    text = lambda mark: F.regexp_extract("line", rf"""@{mark}\(\s*["'`]([^"'`]*)["'`]""", 1)
    prefix = F.when(F.col("line").contains("@Controller("), text("Controller"))
    verb = F.regexp_extract("line", r"@(Get|Post|Put|Patch|Delete|Options|Head|All)\(", 1)
    each = lines(files).withColumn("prefix", prefix).withColumn("verb", verb)
    each = each.withColumn("prefix", F.last("prefix", ignorenulls=True).over(W.partitionBy("path").orderBy("line_no").rowsBetween(W.unboundedPreceding, 0)))
    parts = F.filter(F.split(F.concat_ws("/", "prefix", text("(?:Get|Post|Put|Patch|Delete|Options|Head|All)")), "/"), lambda s: s != "")
    return each.where("verb <> '' AND prefix is not null").select("path", F.upper("verb").alias("method"), F.concat(F.lit("/"), F.array_join(parts, "/")).alias("route")).distinct()


def backend_routes(files: DataFrame) -> DataFrame:
    """All four shapes: a ``route:<path>`` fact per route and its ``methods``, sorted."""
    every = reduce(DataFrame.unionByName, [f(files) for f in (express_routes, next_routes, kit_routes, nest_routes)])
    found = every.groupBy("path", "route").agg(F.array_sort(F.collect_set("method")).alias("methods"))
    return found.select("path", F.lit(KIND["route"]).alias("kind"), F.col("route").alias("name"), F.concat(F.lit("route:"), "route").alias("qname"), F.lit(1).alias("confidence"), "methods")


# --- front ends ----------------------------------------------------------


def _declared(files: DataFrame, pattern: str) -> DataFrame:
    return files.select("path", F.explode(F.regexp_extract_all("source", F.lit(pattern), F.lit(1))).alias("name"))


def router_paths(files: DataFrame) -> DataFrame:
    """``GET <path>`` routes of ``<Route path=`` and ``path: '…'``."""
    found = _declared(files, r"""(?:<Route\b[^>]*?\bpath=\{?|\bpath:\s*)["'`]([^"'`]*)["'`]""")
    own = found.withColumn("name", F.when(F.col("name").startswith("/"), F.col("name")).otherwise(F.concat(F.lit("/"), "name")))
    return _facts(own, "route", "GET ", 1)


def react_facts(files: DataFrame) -> DataFrame:
    jsx = files.where(F.col("source").rlike(r"<[A-Z]\w*|</\w+>|/>"))
    components = _facts(_declared(jsx, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:function|const|class)\s+([A-Z]\w*)"), "component", "component:", 1)
    hooks = _facts(_declared(files, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:function|const)\s+(use[A-Z]\w*)"), "hook", "hook:", 1)
    return reduce(DataFrame.unionByName, [components, hooks, router_paths(files)])


def angular_facts(files: DataFrame) -> DataFrame:
    kinds = (("Component", "component"), ("Injectable", "service"), ("Directive", "directive"), ("Pipe", "pipe"))
    found = [_facts(_declared(files, rf"@{d}\((?:(?!\bclass\b|@(?:Component|Injectable|Directive|Pipe)\()[\s\S])*\bclass\s+(\w+)"), k, f"{k}:", 2) for d, k in kinds]
    guards = _facts(_declared(files, r"\bclass\s+(\w+Guard)\b"), "guard", "guard:", 1)
    return reduce(DataFrame.unionByName, [*found, guards, router_paths(files)])


def vue_facts(files: DataFrame) -> DataFrame:
    named = files.where(F.col("path").endswith(".vue")).select("path", F.regexp_extract("path", r"([^/]+)\.vue$", 1).alias("name"))
    defined = _declared(files, r"(?:const|let|var)\s+([A-Z]\w*)\s*=\s*defineComponent\(")
    composables = _facts(_declared(files, r"(?m)^\s*(?:export\s+)?(?:default\s+)?(?:function|const)\s+(use[A-Z]\w*)"), "composable", "composable:", 1)
    return reduce(DataFrame.unionByName, [_facts(named.unionByName(defined), "component", "component:", 1), composables, router_paths(files)])


#: Which extractors run on which languages (None: all but proto).
BY_LANGUAGE = (
    (None, (queue_consumers, queue_producers, cli_commands, cli_invocations, socket_handlers, socket_clients, event_emitters, event_handlers, graphql_operations, graphql_resolvers, grpc_clients, data_sources)),
    (("typescript", "react", "angular", "vue"), (backend_routes,)),
    (("react", "typescript"), (react_facts,)),
    (("angular", "typescript"), (angular_facts,)),
    (("vue", "typescript"), (vue_facts,)),
    (("proto",), (grpc_services,)),
)


def extract_all(files: DataFrame) -> DataFrame:
    """All facts of files (``path``, ``lang``, ``source``) by language."""
    parts: list[DataFrame] = []
    for langs, functions in BY_LANGUAGE:
        own = files.where(F.col("lang").isin(*langs) if langs else F.col("lang") != "proto")
        parts += [f(own).select("path", "kind", "name", "qname", "confidence") for f in functions]
    return reduce(DataFrame.unionByName, parts)

