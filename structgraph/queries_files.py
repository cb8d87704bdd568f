"""Queries over source files: extractors, parsers, the build, the store and the text projection.

The files are authored templates; ``{k}`` in them stands for the key of a
supplier, so their number grows with the scale of the tables.  Both sides spell
the templates out.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from structgraph.extract import facts as X
from structgraph.extract import patterns as XP
from structgraph.fkgraph import K
from structgraph.functions import paths as P
from structgraph.operators import rank, resolve, traverse
from structgraph.parsed_files import PARSED
from structgraph.plans import build, stats, textproj, tools
from structgraph.queries import _N, C, R, _nodes, _values, graph, query
from structgraph.registries import KIND
from structgraph.session import shared_dir
from structgraph.sources import files as SF
from structgraph.sources import store

TEMPLATES = [
    ("jobs/a{k}.py", "@celery.task\ndef run{k}(): pass\n@shared_task('mail{k}')\nchannel.consume( \"in{k}\" )\nconsumer.subscribe(topics)\n"),
    ("jobs/b{k}.rb", "include Sidekiq::Worker\nJob{k}.perform_async('x{k}')\nperform_in(5)\nchannel.publish '" + "y" * 130 + "'\n"),
    ("jobs/c{k}.ts", "new Queue(\"q{k}\"); new Worker('q{k}', f);\nnc.publish('t{k}');\nproducer.send({});\nnc.subscribe(\"\")\n"),
    ("cmd/d{k}.go", "cmd := &cobra.Command{Use: \"tool{k}\", Run: f}\nexec.Command(\"git{k}\", \"x\")\nexec.CommandContext( 'ls')\nexec.Command(name)\nws := websocket.Upgrader{}\n"),
    ("cmd/e{k}.py", "@click.command('go{k}')\n  @click.command(name)\nsubprocess.run('tar{k}')\nos.system(\"tar{k}\")\nsubprocess.run([\"no\"])\n"),
    ("cmd/f{k}.rs", "#[command(name = \"r{k}\")]\n#[command(about = \"none\")]\nstd::process::Command::new(\"cc{k}\")\nlet x = Command::new('dd');\n"),
    ("cmd/g{k}.ts", "program.command('serve{k}').action(f)\nchild_process.exec(\"make{k}\")\n"),
    ("ws/h{k}.ts", "ws.on('connection', f)\n@WebSocketGateway(80{k})\nconst s = new WebSocket('wss://host/live{k}');\nio('ws://h')\nuseWebSocket(\"/plain{k}\")\nws.connect(url)\n"),
    ("ws/i{k}.ex", "channel \"room{k}\", Room\nuse Phoenix.Channel\nsocket '/s{k}', S\n"),
    ("ev/j{k}.ts", "bus.emit('made{k}', x);\nstore.dispatch({type: 1});\nbus.on('made{k}', f)\n@EventPattern(\"p{k}\")\neventBridge.putEvents('no')\nx.subscribe(f)\nel.addEventListener( 'click{k}' )\n"),
    ("ev/k{k}.ex", "def handle_event(\"x\", p, s)\npublish('done{k}')\n.trigger(\"t{k}\")\n"),
    ("gq/l{k}.ts", "const A = gql`\n  query Get{k} { a }`;\nconst B = gql`mutation Set{k} { b }`;\nuseQuery(A)\nclient.mutate(B)\nuseQuery(C); useMutation(D)\n"),
    ("gq/m{k}.ts", "useLazyQuery(X)\nrequest(u)\n"),
    ("gq/n{k}.py", "@strawberry.type\nclass Q{k}: pass\nclass O(graphene.ObjectType):\n  pass\n"),
    ("gq/o{k}.ts", "@Resolver(() => U{k})\n@Query(returns => 1)\n@ResolveField()\nconst t = `type Query { a: Int }`\n"),
    ("rpc/p{k}.proto", "syntax = \"proto3\";\nservice Order{k} {\n  rpc Get (A) returns (B);\n  rpc  Put(A) returns (B);\n}\nmessage A {}\n  service Empty{\n}\n"),
    ("rpc/q{k}.go", "c := pb.NewOrder{k}ServiceClient(conn)\nd := NewClient(x)\ne := billing{k}Svc.NewClient(y)\nf := Stub(z); g := Pay{k}Stub(q)\n"),
    ("db/r{k}.py", "import psycopg\nr = redis.Redis()\ns = sqlalchemy.create_engine('sqlite://{k}')\nfrom smtplib import SMTP\n"),
    ("db/s{k}.ts", "new MongoClient(u); mongoose.connect(v); new S3Client({});\nimport { Storage } from '@google-cloud/storage';\nResend()\n"),
    ("srv/t{k}.ts", "app.get('/items/:id', f).post( \"/items{k}\", g);\nrouter.delete(`/x{k}`)\naxios.get('/no')\nthis.http.put('/no')\napp.all('nolead', f)\napp.options('/" + "z" * 260 + "')\n"),
    ("web{k}/app/api/users/[id]/route.ts", "export async function GET() {}\nexport const POST = f\n"),
    ("web{k}/pages/api/[...slug].js", "export default f\n"),
    ("web{k}/pages/api/index.ts", "const x = 1\n"),
    ("kit{k}/src/routes/shop/[id]/+server.ts", "export function DELETE() {}\nexport const PATCH = 1\n"),
    ("kit{k}/src/routes/+server.js", "export default 1\n"),
    ("nest/u{k}.ts", "@Get('early')\n@Controller('cats{k}')\nclass A {\n  @Get(':id')\n  a() {}\n  @Post()\n  b() {}\n}\n@Controller()\nclass B {\n  @Put('/x/')\n  c() {}\n}\n"),
    ("ui/v{k}.tsx", "export default function Card{k}() { return <Box/>; }\nconst useThing{k} = () => 1;\nexport function useother() {}\n<Route exact path=\"/home{k}\" />\nconst r = [{ path: 'list{k}' }];\nclass Panel extends C {}\n"),
    ("ui/w{k}.js", "function Plain{k}() {}\nfunction useBare() {}\n"),
    ("ui/x{k}.component.ts", "@Component({selector: 'a'})\nexport class Main{k}Component {}\n@Injectable()\nclass Api{k} {}\n@Pipe({name: 'p'})\nexport class Fmt {}\nexport class Auth{k}Guard {}\nconst routes = [{ path: 'a{k}' }, { path: '/b' }];\n"),
    ("ui/Shown{k}.vue", "<template/>\n<script>\nconst Other{k} = defineComponent({})\nexport function useCart{k}() {}\nconst r = { path: '/v{k}' }\n</script>\n"),
    ("other/y{k}.txt", "app.get('/not/source')\n"), ("node_modules/z{k}.js", "bus.emit('no')\n"), ("pkg/.hid/a{k}.py", "x = 1\n"), ("pkg/build/b{k}.go", "package b\n"), ("pkg/c{k}.kt", "class K{k}\n"),
]
_TEMPLATES = _values(TEMPLATES, "path, source")


def _rows(spark: SparkSession, d: str, rows: list[tuple], columns: tuple[str, ...]) -> DataFrame:
    """Each template for each supplier; columns that aren't text stay as they are."""
    lits = F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(columns, r, strict=True)]) for r in rows])
    own = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("k"), F.explode(lits).alias("t"))
    return own.select(*[F.replace(f"t.{c}", F.lit("{k}"), F.col("k")).alias(c) if isinstance(rows[0][i], str) else F.col(f"t.{c}") for i, c in enumerate(columns)])


def _files(spark: SparkSession, d: str, rows: list[tuple] = TEMPLATES) -> DataFrame:
    return SF.describe(_rows(spark, d, rows, ("path", "source")))


_LANG = " ".join(f"WHEN '{e}' THEN '{lang}'" for e, lang in SF.LANGUAGES.items())
_RAW = f"SELECT replace(path, '{{k}}', s_suppkey::VARCHAR) AS path, replace(source, '{{k}}', s_suppkey::VARCHAR) AS source FROM supplier, {_TEMPLATES} t"
_F = f"""WITH raw AS ({_RAW}), f AS (SELECT path, CASE WHEN contains(path, '.component.ts') THEN 'angular' ELSE CASE regexp_extract(path, '\\.([^./]+)$', 1) {_LANG} END END AS lang, source FROM raw
  WHERE NOT regexp_matches(path, '(^|/)(\\.|(node_modules|vendor|__pycache__|target|dist|build)(/|$))')),
fs AS (SELECT * FROM f WHERE lang IS NOT NULL), n AS (SELECT * FROM fs WHERE lang <> 'proto'),
ll AS (SELECT path, lang, string_split_regex(source, '\\r?\\n') AS l FROM fs), lines AS (SELECT path, lang, trim(unnest(l), chr(32) || chr(9)) AS line, generate_subscripts(l, 1) AS no FROM ll)
"""


def _lit_sql(rest: str, longest: int) -> str:
    pattern = """'^\\s*(?:"([^"]*)"|''([^'']*)'')'"""
    found = f"(regexp_extract({rest}, {pattern}, 1) || regexp_extract({rest}, {pattern}, 2))"
    return f"(CASE WHEN {found} <> '' AND strlen({found}) <= {longest} THEN {found} END)"


_REST = "substr(source, strpos(source, p) + length(p))"


def _fact_sql(hits: str, kind: str, prefix: str, confidence: int) -> str:
    return f"SELECT DISTINCT path, {KIND[kind]} AS kind, name, '{prefix}' || name AS qname, {confidence} AS confidence FROM ({hits}) WHERE name IS NOT NULL"


def _hits_sql(rows, columns: str, name: str) -> str:
    return f"SELECT path, {name} AS name FROM n JOIN {_values(list(rows), columns)} ON contains(source, p)"


_SOCKET = "(CASE WHEN regexp_matches({x}, '^wss?://[^/]*/') THEN regexp_extract({x}, '^wss?://[^/]*(/.*)$', 1) ELSE {x} END)"


def _files_query(name: str, f, sql: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        files = _files(spark, d)
        return f(files if "proto" in name or name.startswith(("s1", "x18")) else files.where("lang <> 'proto'")).select(*_COLUMNS.get(name, ("path", "kind", "name", "qname", "confidence")))

    query(name, _F + sql)(run)


_COLUMNS = {"s1_s2_describe": ("path", "lang", "module_qname")}
for _n in ("x14a_express", "x14b_next", "x14c_kit", "x14d_nest"):
    _COLUMNS[_n] = ("path", "method", "route")
_COLUMNS["x14_a13_routes"] = ("path", "name", "methods")
_COLUMNS["x11_proto_services"] = ("path", "name", "qname", "methods")

_files_query("s1_s2_describe", lambda f: f, "SELECT path, lang, replace(regexp_replace(path, '\\.[^./]*$', ''), '/', '::') AS module_qname FROM fs")
_files_query("x1_queue_consumers", X.queue_consumers, _fact_sql(_hits_sql(XP.QUEUE_CONSUMERS, "p, fw", f"coalesce({_lit_sql(_REST, 128)}, fw)"), "queue_consumer", "queue_consumer:", 1))
_files_query("x2_queue_producers", X.queue_producers, _fact_sql(_hits_sql(XP.QUEUE_PRODUCERS, "p, fw", f"coalesce({_lit_sql(_REST, 128)}, fw)"), "queue_producer", "queue_producer:", 1))
for _n, _p in (("queue_consumers", XP.QUEUE_CONSUMERS), ("queue_producers", XP.QUEUE_PRODUCERS), ("cli_invocations", [(p, None) for p in XP.CLI_INVOCATIONS])):
    _COLUMNS[f"x3_raw_{_n}"] = ("path", "pattern", "framework")
    _files_query(f"x3_raw_{_n}", lambda f, w=_n: X.raw_hits(f, w), f"SELECT path, p AS pattern, cast(fw AS VARCHAR) AS framework FROM n JOIN {_values(list(_p), 'p, fw')} ON contains(source, p)")
_after = lambda mark: f"substr(line, strpos(line, '{mark}') + {len(mark)})"
_CLI = f"""SELECT path, coalesce(CASE WHEN contains(line, 'cobra.Command') AND contains(line, 'Use:') THEN {_lit_sql(_after('Use:'), 64)} END, CASE WHEN starts_with(line, '@click.command(') THEN {_lit_sql(_after('@click.command('), 64)} END,
  CASE WHEN contains(line, '.command(') THEN {_lit_sql(_after('.command('), 64)} END, CASE WHEN contains(line, '#[command(name') THEN {_lit_sql("regexp_extract(line, 'name[^=]*=(.*)$', 1)", 64)} END) AS name FROM lines WHERE lang <> 'proto'"""
_files_query("x4_cli_commands", X.cli_commands, _fact_sql(_CLI, "cli_command", "cli:", 2))
_MARKS = "|".join(sorted((p.replace("(", "\\(").replace(".", "\\.") for p in XP.CLI_INVOCATIONS), key=len, reverse=True))
_files_query("x5_cli_invocations", X.cli_invocations, _fact_sql(f"SELECT path, {_lit_sql('q', 64)} AS name FROM (SELECT path, unnest(regexp_extract_all(source, '(?:{_MARKS})\\s*(\"[^\"]*\"|''[^'']*'')', 1)) AS q FROM n)", "cli_invocation", "cli_invoke:", 1))
_files_query("x6_socket_handlers", X.socket_handlers, _fact_sql(_hits_sql([(p,) for p in XP.SOCKET_HANDLERS], "p", f"coalesce({_SOCKET.format(x=_lit_sql(_REST, 256))}, CASE WHEN regexp_matches(p, 'Gateway|Channel|Cable') THEN 'default' ELSE 'ws' END)"), "ws_handler", "ws:", 1))
_files_query("x7_socket_clients", X.socket_clients, _fact_sql(_hits_sql([(p,) for p in XP.SOCKET_CLIENTS], "p", f"coalesce({_SOCKET.format(x=_lit_sql(_REST, 256))}, 'ws')"), "ws_client", "ws_client:", 1))
_EVENT = "coalesce(CASE WHEN named THEN " + _lit_sql(_REST, 128) + " END, regexp_replace(trim(p, '.'), '\\(+$', ''))"
_files_query("x8_event_emitters", X.event_emitters, _fact_sql(_hits_sql(XP.EVENT_EMITTERS, "p, named", _EVENT), "event_emitter", "event_emit:", 0))
_files_query("x8_event_handlers", X.event_handlers, _fact_sql(_hits_sql(XP.EVENT_HANDLERS, "p, named", _EVENT), "event_handler", "event_handle:", 0))
_TAGS = ("gql`", "gql(`", 'gql("', "graphql(`", 'graphql("')
_BODY = "\\s*(?:query|mutation|subscription) (\\w+)"
_OPERATION = "nullif(coalesce(" + ", ".join(f"CASE WHEN contains(source, '{t}') THEN regexp_extract(substr(source, strpos(source, '{t}') + {len(t)}), '^{_BODY}', 1) END" for t in _TAGS) + "), '')"
_CALL = "CASE " + " ".join(f"WHEN contains(line, '{p}') THEN '{p.rstrip('(')}'" for p in XP.GRAPHQL_OPERATIONS) + " END"
_files_query("x9_graphql_operations", X.graphql_operations, f""", o AS (SELECT path, {_OPERATION} AS op FROM n), c AS (SELECT DISTINCT l.path, coalesce(op, {_CALL}) AS name FROM lines l JOIN o ON o.path = l.path WHERE {_CALL} IS NOT NULL),
t AS (SELECT DISTINCT path, unnest(regexp_extract_all(source, 'gql`{_BODY}', 1)) AS name FROM n), e AS (SELECT path, name, 1 AS confidence FROM c UNION ALL SELECT path, name, 2 FROM t WHERE (path, name) NOT IN (SELECT path, name FROM c))
SELECT path, {KIND['graphql_operation']} AS kind, name, 'graphql_op:' || name AS qname, confidence FROM e""")
_CLEAN = [("@Query(", "Query"), ("@Mutation(", "Mutation"), ("@Subscription(", "Subscription"), ("@Resolver(", "Resolver"), ("@ResolveField(", "ResolveField"), ("type Query {", "Query"), ("type Mutation {", "Mutation"), ("type Subscription {", "Subscription"), ("@strawberry.type", "strawberry.type"), ("@strawberry.mutation", "strawberry.mutation"), ("ObjectType):", "ObjectType"), ("graphene.ObjectType", "ObjectType")]
_files_query("x10_graphql_resolvers", X.graphql_resolvers, _fact_sql(_hits_sql(_CLEAN, "p, named", "named"), "graphql_resolver", "graphql_resolver:", 1))
_files_query("x11_proto_services", lambda f: X.grpc_services(f.where("lang = 'proto'")), """, s AS (SELECT *, CASE WHEN starts_with(line, 'service ') THEN nullif(trim(string_split(substr(line, 9), '{')[1]), '') END AS own FROM lines WHERE lang = 'proto'),
w AS (SELECT path, line, last_value(own IGNORE NULLS) OVER (PARTITION BY path ORDER BY no ROWS UNBOUNDED PRECEDING) AS name FROM s)
SELECT path, name, 'grpc:' || name AS qname, count(*) FILTER (regexp_matches(line, '^rpc +[^( ]')) AS methods FROM w WHERE name IS NOT NULL GROUP BY ALL""")
_TOKEN = "regexp_extract(substr(line, 1, strpos(line, p) - 1), '(\\w*)$', 1)"
_files_query("x12_grpc_clients", X.grpc_clients, _fact_sql(f"SELECT path, CASE WHEN length(t) >= 2 THEN t END AS name FROM (SELECT path, regexp_replace(CASE WHEN {_TOKEN} LIKE '%Service' THEN {_TOKEN}[:-8] ELSE regexp_replace({_TOKEN}, 'Svc$', '') END, '^$', '') AS t FROM lines JOIN {_values([(p,) for p in XP.GRPC_CLIENTS], 'p')} ON contains(line, p) WHERE lang <> 'proto')", "grpc_client", "grpc_client:", 1))
_files_query("x13_data_sources", X.data_sources, f"SELECT path, arg_min(kind, i) AS kind, name, 'data_source:' || name AS qname, 1 AS confidence FROM n JOIN {_values([(i, p, k, v) for i, (p, k, v) in enumerate(XP.DATA_SOURCES)], 'i, p, kind, name')} ON contains(source, p) GROUP BY path, name")
_VERB = "\\.(get|post|put|patch|delete|options|head|all)\\(\\s*[\"''`](/[^\"''`]*)[\"''`]"
_EXPRESS = f"SELECT DISTINCT path, upper(m) AS method, r AS route FROM (SELECT path, unnest(regexp_extract_all(line, '{_VERB}', 1)) AS m, unnest(regexp_extract_all(line, '{_VERB}', 2)) AS r FROM lines WHERE lang <> 'proto' AND NOT regexp_matches(line, 'axios|fetch\\(|http\\.|client\\.|this\\.http|request\\(')) WHERE strlen(r) <= 256"
_EXPORT = "regexp_extract_all(source, 'export\\s+(?:async\\s+)?(?:function|const)\\s+(GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\\b', 1)"
_EXPORTS = f"unnest(CASE WHEN len({_EXPORT}) > 0 THEN list_distinct({_EXPORT}) WHEN contains(source, 'export default') THEN ['GET'] ELSE [] END) AS method"
_BRACKET = "regexp_replace({}, '\\[(?:\\.{{2,3}})?([^\\]]*)\\]', ':\\1', 'g')"
_NEXT_PATH = "coalesce(nullif(regexp_extract(path, '(?:^|/)app(/api/.*?)/?route\\.[jt]sx?$', 1), ''), nullif(regexp_extract(path, '(?:^|/)pages(/api/.*?)(?:/index)?\\.[jt]sx?$', 1), ''))"
_NEXT = f"SELECT path, {_EXPORTS}, {_BRACKET.format(f"rtrim({_NEXT_PATH}, '/')")} AS route FROM n WHERE {_NEXT_PATH} IS NOT NULL"
_KIT_PATH = "regexp_extract(path, '(?:^|/)routes(/.*?)/?\\+server\\.[jt]s$', 1)"
_KIT = f"SELECT path, {_EXPORTS}, {_BRACKET.format(f"CASE WHEN {_KIT_PATH} IN ('', '/') THEN '/' ELSE rtrim({_KIT_PATH}, '/') END")} AS route FROM n WHERE regexp_matches(path, '(?:^|/)routes/(?:.*/)?\\+server\\.[jt]s$')"
_NEST_TEXT = "regexp_extract(line, '@{}\\(\\s*[\"''`]([^\"''`]*)[\"''`]', 1)"
_NEST_VERBS = "(?:Get|Post|Put|Patch|Delete|Options|Head|All)"
_NEST = f"SELECT DISTINCT path, upper(verb) AS method, '/' || array_to_string(list_filter(string_split(prefix || '/' || own, '/'), lambda s: s <> ''), '/') AS route FROM (SELECT path, regexp_extract(line, '@({_NEST_VERBS[3:-1]})\\(', 1) AS verb, {_NEST_TEXT.format(_NEST_VERBS)} AS own, last_value(CASE WHEN contains(line, '@Controller(') THEN {_NEST_TEXT.format('Controller')} END IGNORE NULLS) OVER (PARTITION BY path ORDER BY no ROWS UNBOUNDED PRECEDING) AS prefix FROM lines WHERE lang <> 'proto') WHERE verb <> '' AND prefix IS NOT NULL"
_files_query("x14a_express", X.express_routes, _EXPRESS)
_files_query("x14b_next", X.next_routes, _NEXT)
_files_query("x14c_kit", X.kit_routes, _KIT)
_files_query("x14d_nest", X.nest_routes, _NEST)
_files_query("x14_a13_routes", lambda f: X.backend_routes(f).withColumn("methods", F.array_join("methods", ",")), f"SELECT path, route AS name, array_to_string(list_sort(list(DISTINCT method)), ',') AS methods FROM ({_EXPRESS} UNION ALL {_NEXT} UNION ALL {_KIT} UNION ALL {_NEST}) GROUP BY path, route")
_DECLARED = "(?m)^\\s*(?:export\\s+)?(?:default\\s+)?"
_all = lambda pattern, files="n": f"SELECT path, unnest(regexp_extract_all(source, '{pattern}', 1)) AS name FROM {files}"
_PATH = "(?:<Route\\b[^>]*?\\bpath=\\{?|\\bpath:\\s*)[\"''`]([^\"''`]*)[\"''`]"
_ROUTER = _fact_sql(f"SELECT path, CASE WHEN starts_with(name, '/') THEN name ELSE '/' || name END AS name FROM ({_all(_PATH)})", "route", "GET ", 1)
_JSX = "(SELECT * FROM n WHERE regexp_matches(source, '<[A-Z]\\w*|</\\w+>|/>'))"
_files_query("x15_react", X.react_facts, " UNION ALL ".join([_fact_sql(_all(_DECLARED + "(?:function|const|class)\\s+([A-Z]\\w*)", _JSX), "component", "component:", 1), _fact_sql(_all(_DECLARED + "(?:function|const)\\s+(use[A-Z]\\w*)"), "hook", "hook:", 1), _ROUTER]))
_ANGULAR = _values([("ui/x{k}.component.ts", "component", "Main{k}Component", 2), ("ui/x{k}.component.ts", "service", "Api{k}", 2), ("ui/x{k}.component.ts", "pipe", "Fmt", 2), ("ui/x{k}.component.ts", "guard", "Auth{k}Guard", 1)], "path, kind, name, confidence")
_KINDS = "CASE kind " + " ".join(f"WHEN '{k}' THEN {KIND[k]}" for k in ("component", "service", "directive", "pipe", "guard")) + " END"
_files_query("x16_angular", X.angular_facts, f"SELECT replace(path, '{{k}}', s_suppkey::VARCHAR) AS path, {_KINDS} AS kind, replace(name, '{{k}}', s_suppkey::VARCHAR) AS name, kind || ':' || replace(name, '{{k}}', s_suppkey::VARCHAR) AS qname, confidence FROM supplier, {_ANGULAR} a UNION ALL {_ROUTER}")
_VUE = f"SELECT path, regexp_extract(path, '([^/]+)\\.vue$', 1) AS name FROM n WHERE path LIKE '%.vue' UNION ALL {_all('(?:const|let|var)\\s+([A-Z]\\w*)\\s*=\\s*defineComponent\\(')}"
_files_query("x17_vue", X.vue_facts, " UNION ALL ".join([_fact_sql(_VUE, "component", "component:", 1), _fact_sql(_all(_DECLARED + "(?:function|const)\\s+(use[A-Z]\\w*)"), "composable", "composable:", 1), _ROUTER]))
_GATES = [(f.__name__, lang) for langs, fs in X.BY_LANGUAGE for f in fs for lang in (langs or sorted(set(SF.LANGUAGES.values()) - {"proto"}) + ["angular"])]


@query("x18_language_gating", f"{_F} SELECT lang, count(*) AS files, count(*) FILTER (lang IN ('typescript', 'react', 'angular', 'vue')) AS back, count(*) FILTER (lang IN ('react', 'typescript')) AS react, count(*) FILTER (lang IN ('angular', 'typescript')) AS angular, count(*) FILTER (lang IN ('vue', 'typescript')) AS vue FROM fs GROUP BY lang")
def _(spark, d):
    gate = {name: [lang for f, lang in _GATES if f == name] for name in ("backend_routes", "react_facts", "angular_facts", "vue_facts")}
    count = lambda name, to: F.count_if(F.col("lang").isin(*gate[name])).alias(to)
    return _files(spark, d).groupBy("lang").agg(F.count("*").alias("files"), count("backend_routes", "back"), count("react_facts", "react"), count("angular_facts", "angular"), count("vue_facts", "vue"))


# --- parsers -------------------------------------------------------------

_LANGUAGES = (
    ("p1_python", ("py",)), ("p2_go", ("go",)), ("p3_typescript", ("ts",)), ("p4_java_kotlin", ("java", "kt")), ("p5_csharp", ("cs",)), ("p6_php", ("php",)), ("p7_rust", ("rs",)), ("p8_ruby", ("rb",)), ("p9_swift", ("swift",)),
    ("p10_c_cpp", ("cpp",)), ("p11_scala", ("scala",)), ("p12_clojure", ("clj",)), ("p13_dart", ("dart",)), ("p14_elixir", ("ex",)), ("p15_solidity", ("sol",)), ("p16_terraform", ("tf",)), ("p17_vue", ("vue",)),
)


def _said(tag: str, *columns: str):
    return F.when(F.col("tag") == tag, F.concat_ws(" ", F.lit(tag), *[F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in columns]))


def parsed_facts(files: DataFrame) -> DataFrame:
    """``path`` and ``fact`` of every parsed file, positions and source texts left out."""
    rows = build.parse_files(files).where("NOT (tag = 'cell' AND cell_type IN (1, 3))")
    fact = F.coalesce(
        _said("node", "kind", "qname", "parent", "confidence"), _said("edge", "category", "src", "dst", "confidence"), _said("import", "form", "module", "name", "alias", "level"),
        _said("call", "src", "q_form", "base", "name"), _said("ref", "src", "q_form", "base", "name"), _said("cell", "cell_type", "qname", "text"),
    )
    return rows.select("path", fact.alias("fact"))


def _parser_query(name: str, ends: tuple[str, ...]) -> None:
    own = [x for x in PARSED if x[0].rsplit(".", 1)[1] in ends]
    rows = _values([(p, p.rsplit(".", 1)[0].replace("/", "::"), f) for p, _, facts in own for f in facts], "path, module, fact")
    key = "s_suppkey::VARCHAR"
    query(name, f"SELECT replace(path, '{{k}}', {key}) AS path, replace(replace(fact, '~', module), '{{k}}', {key}) AS fact FROM supplier, {rows} t")(lambda spark, d: parsed_facts(_files(spark, d, [x[:2] for x in own])))


for _name, _ends in _LANGUAGES:
    _parser_query(_name, _ends)


@query("s6_parse_one", "SELECT * FROM (VALUES ('x::y', 1), ('x::y::K', 2), ('x::y::K::go', 4), ('GET /a', 5)) t(qname, kind)")
def _(spark, d):
    return build.parse_one(spark, "class K:\n    @app.get('/a')\n    def go(self): pass\n", "x/y.py").select("qname", "kind")


# --- build ---------------------------------------------------------------

_TREE = [
    ("r{k}/shop/util.py", "def slug(text):\n    return text\n"),
    ("r{k}/shop/people.py", "from .util import slug\nfrom r{k}.shop import util as u\n\nclass Person:\n    def save(self):\n        slug('x')\n        self.check()\n        u.slug('y')\n    def check(self):\n        other.thing()\n"),
    ("r{k}/shop/tests/test_util.py", "from r{k}.shop.util import slug\n"),
    ("r{k}/back/server.go", "package back\n\nfunc Start(r *Router) {\n\tapi := r.Group(\"/api{k}\")\n\tapi.GET(\"/users/:id\", show)\n}\n"),
    ("r{k}/back/show.go", "package back\n\nfunc show() {\n\thelp()\n}\n\nfunc help() {}\n"),
    ("r{k}/front/api.ts", "import { Http } from './http';\nexport class Api {\n  load(id: string) {\n    this.http.get(`/api{k}/users/${id}`);\n  }\n}\n"),
    ("r{k}/jobs/work.py", "@celery.task\ndef run(): pass\nrun.delay('celery')\n"),
]
_BUILT = [
    (3, "~shop::people", "~shop::util::slug", 2, False), (3, "~shop::people", "~shop::util", 2, False), (3, "~shop::tests::test_util", "~shop::util::slug", 2, False),
    (4, "~shop::people::Person::save", "~shop::util::slug", 2, False), (4, "~shop::people::Person::save", "~shop::util::slug", 2, False), (4, "~shop::people::Person::save", "~shop::people::Person::check", 2, False),
    (4, "~back::show", "~back::help", 2, False), (9, "route:/api{k}/users/:id", "~back::show", 2, False), (4, "~front::api::Api::load", "endpoint:GET:/api{k}/users/${id}", 1, False),
    (10, "endpoint:GET:/api{k}/users/${id}", "route:/api{k}/users/:id", 1, True), (7, "~shop::tests::test_util", "~shop::util", 2, True),
]


@query("b6_b8_build", f"SELECT category, replace(replace(a, '~', 'r' || k || '::'), '{{k}}', k) AS a, replace(replace(b, '~', 'r' || k || '::'), '{{k}}', k) AS b, confidence, cross_stack FROM (SELECT s_suppkey::VARCHAR AS k FROM supplier), {_values(_BUILT, 'category, a, b, confidence, cross_stack')} t UNION ALL SELECT 12, 'queue_producer:celery', 'queue_consumer:celery', 1, true")
def _(spark, d):
    g = build.build(spark, _files(spark, d, _TREE))
    names = g.nodes.select("id", "qname").distinct()
    e = g.edges.where("category NOT IN (1, 2)").join(names.withColumnsRenamed({"id": "src", "qname": "a"}), "src").join(names.withColumnsRenamed({"id": "dst", "qname": "b"}), "dst")
    return e.select("category", "a", "b", "confidence", F.col("is_cross").alias("cross_stack"))


@query("b1_merge", "SELECT id, arg_max(kind, ord) AS kind, arg_max(name, ord) AS name, arg_min(confidence, ord) AS confidence FROM (SELECT o_custkey AS id, o_orderkey AS ord, (o_orderkey % 7)::INTEGER AS kind, o_orderpriority AS name, (o_orderkey % 3)::INTEGER AS confidence FROM orders) GROUP BY id")
def _(spark, d):
    orders = spark.read.parquet(f"{d}/orders.parquet")
    facts = orders.selectExpr("o_custkey AS id", "o_orderkey AS ord", "cast(o_orderkey % 7 AS int) AS kind", "o_orderpriority AS name", "o_orderpriority AS qname", "cast(NULL AS bigint) AS parent_id", "cast(o_orderkey % 3 AS int) AS confidence")
    return resolve.merge_nodes(facts).select("id", "kind", "name", "confidence")


# --- store ---------------------------------------------------------------


def _keyed(n: DataFrame, e: DataFrame) -> dict[str, DataFrame]:
    cells = n.select(F.col("kind").cast("string").alias("graph_key"), F.col("id").alias("node_id"), F.lit(2).alias("cell_type"), F.lit("text").alias("tag"), F.col("name").alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(0).alias("ord"))
    return {"nodes": n.withColumn("graph_key", F.col("kind").cast("string")), "edges": e.withColumns({"graph_key": F.col("category").cast("string"), "is_cross": F.col("category") >= 10}), "cells": cells}


def _stored(n: DataFrame, e: DataFrame) -> str:
    path = f"{shared_dir(n.sparkSession)}/store-{uuid4().hex}"
    store.write(_keyed(n, e), path)
    return path


@graph("k1_s9_store", "SELECT 'nodes' AS part, kind::VARCHAR AS graph_key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edges', category::VARCHAR, count(*) FROM edges GROUP BY category UNION ALL SELECT 'cells', kind::VARCHAR, count(*) FROM nodes GROUP BY kind")
def _(n, e):
    path = _stored(n, e)
    return n.sparkSession.read.parquet(f"{path}/_manifest").select(F.col("table").alias("part"), "graph_key", F.col("rows").alias("n")) if store.verify(n.sparkSession, path).isEmpty() else n.limit(0)


@graph("s7_s8_read", "SELECT id, kind, name, qname, confidence FROM nodes")
def _(n, e):
    return store.read(n.sparkSession, _stored(n, e))["nodes"].select("id", "kind", "name", "qname", "confidence")


@graph("s10_s12_k3_edges", "SELECT src, dst, category, category >= 10 AS cross_stack FROM edges")
def _(n, e):
    path, spark = _stored(n, e), n.sparkSession
    return store.edges(spark, path, False).withColumn("cross_stack", F.lit(False)).unionByName(store.edges(spark, path, True).withColumn("cross_stack", F.lit(True)))


@graph("s11_point_lookup", f"SELECT id, kind, qname FROM nodes WHERE id = {C + 7}")
def _(n, e):
    return store.node(n.sparkSession, _stored(n, e), C + 7).select("id", "kind", "qname")


@graph("k4_hash", "SELECT kind::VARCHAR AS graph_key, count(*) AS n, true AS same, true AS repeated_differs FROM nodes GROUP BY kind")
def _(n, e):
    own = n.withColumn("graph_key", F.col("kind").cast("string"))
    a, b = store.fingerprint(own), store.fingerprint(own.orderBy(F.desc("id"))).select("graph_key", F.col("content_hash").alias("again"))
    c = store.fingerprint(own.unionByName(own)).select("graph_key", F.col("content_hash").alias("twice"))
    return a.join(b, "graph_key").join(c, "graph_key").select("graph_key", F.col("rows").alias("n"), (F.col("content_hash") == F.col("again")).alias("same"), (F.col("content_hash") != F.col("twice")).alias("repeated_differs"))


@graph("k5_k7_upsert", "SELECT id AS node_id, CASE WHEN kind = 102 THEN 'new' ELSE name END AS text FROM nodes")
def _(n, e):
    path, spark = _stored(n, e), n.sparkSession
    cells = store.read(spark, path)["cells"].withColumn("graph_key", F.col("graph_key").cast("string"))
    new = cells.where("graph_key = '102'").withColumn("text", F.lit("new"))
    store.replace_partitions(store.upsert_cell(cells.where("graph_key = '102'"), n, new), path, "cells")
    return store.read(spark, path)["cells"].select("node_id", "text")


@graph("k6_remove", "SELECT id AS node_id FROM nodes WHERE kind <> 103")
def _(n, e):
    cells = _keyed(n, e)["cells"]
    return store.remove_cell(cells, cells.where("graph_key = '103'").select("node_id", "cell_type"))[0].select("node_id")


@graph("k8_json", "SELECT to_json({'id': id, 'kind': kind, 'name': name, 'qname': qname, 'confidence': confidence})::VARCHAR AS value FROM nodes UNION ALL SELECT to_json({'from': src, 'to': dst, 'category': category})::VARCHAR FROM edges")
def _(n, e):
    return store.nodes_json(n).unionByName(store.edges_json(e))


# --- text projection -----------------------------------------------------

_ABBREVIATED = "CASE WHEN {q} = 'ASIA::CHINA' THEN 'AC' WHEN starts_with({q}, 'ASIA::CHINA::') THEN 'AC' || substr({q}, 12) WHEN {q} = 'ASIA' THEN 'As' WHEN starts_with({q}, 'ASIA::') THEN 'As' || substr({q}, 5) ELSE {q} END"
_KNOWN = [("ASIA::CHINA", "AC"), ("ASIA", "As")]


@graph("d2_o5_scopes", "SELECT prefix, n, greatest(0, n * (strlen(prefix) - s) - (strlen(prefix) + s + 3)) AS saving FROM (SELECT prefix, n, CASE WHEN contains(prefix, '::') THEN len(string_split(prefix, '::')) ELSE 2 END AS s FROM (SELECT array_to_string(string_split(qname, '::')[1:-2], '::') AS prefix, count(*) AS n FROM nodes WHERE contains(qname, '::') GROUP BY prefix HAVING count(*) >= 3 AND length(prefix) >= 10)) ORDER BY saving DESC, prefix LIMIT 25")
def _(n, e):
    return textproj.scope_savings(n).orderBy(F.desc("saving"), "prefix").limit(textproj.SCOPES)


@graph("d4_abbreviate", f"SELECT id, {_ABBREVIATED.format(q='qname')} AS short FROM nodes")
def _(n, e):
    return n.select("id", textproj.abbreviate(F.col("qname"), _KNOWN).alias("short"))


@graph("d5_f5_topology", f", m AS (SELECT id, CASE WHEN kind = 105 THEN 5 ELSE kind END AS kind, {_ABBREVIATED.format(q='qname')} AS short FROM nodes WHERE kind <> 106) SELECT DISTINCT a.short || CASE WHEN a.kind IN (5, 9) THEN ' *' ELSE '' END || ' > ' || coalesce(b.short, '@unresolved#' || lower(to_hex(dst))) AS line FROM edges JOIN m a ON a.id = src LEFT JOIN m b ON b.id = dst WHERE category IN (4, 9, 10)")
def _(n, e):
    own = n.where("kind <> 106").withColumn("kind", F.when(F.col("kind") == 105, 5).otherwise(F.col("kind")))
    return textproj.topology(own, e, _KNOWN)


_BLOCKS = f"""SELECT id, pos, line FROM (
SELECT id, 0 AS pos, '[' || {_ABBREVIATED.format(q='qname')} || ']' AS line FROM nodes WHERE kind < 105
UNION ALL SELECT id, 1, ':kind       Node' FROM nodes WHERE kind < 105
UNION ALL SELECT id, 2, ':confidence ' || CASE confidence WHEN 1 THEN 'medium' ELSE 'weak' END FROM nodes WHERE kind < 105 AND confidence <> 2
UNION ALL SELECT id, 3, ':doc        ' || name FROM nodes WHERE kind IN (101, 102, 103)
UNION ALL SELECT id, 3, ':position   a/' || name || '.py:3-' || kind FROM nodes WHERE kind = 104
UNION ALL SELECT id, 4, '' FROM nodes WHERE kind < 105)"""


@graph("d6_d8_blocks", f", b AS ({_BLOCKS}) SELECT id, cast(row_number() OVER (PARTITION BY id ORDER BY pos) - 1 AS INTEGER) AS pos, line FROM b")
def _(n, e):
    own = n.where("kind < 105")
    position = F.concat(F.lit('{"file": "a/'), "name", F.lit('.py", "start_line": 3, "end_line": '), F.col("kind").cast("string"), F.lit("}"))
    cells = own.select(F.col("id").alias("node_id"), F.when(F.col("kind") == 104, 3).otherwise(2).alias("cell_type"), F.when(F.col("kind") == 104, position).otherwise(F.col("name")).alias("text"), F.lit(None).cast("binary").alias("bytes"), F.lit(0).alias("ord"))
    return textproj.node_lines(own, cells, _KNOWN, None, 2).select("id", "pos", "line")


# --- tools, statistics, functions ----------------------------------------


@graph("q1_find_node", "SELECT id, qname FROM (SELECT id, qname, CASE WHEN name = 'asia::' THEN 0 WHEN contains(qname, 'asia::') THEN 1 WHEN contains(lower(qname), 'asia::') THEN 2 END AS p FROM nodes) WHERE p IS NOT NULL ORDER BY p, qname, id LIMIT 1")
def _(n, e):
    return tools.find_node(n, "asia::").select("id", "qname")


@graph("q6_trace", f"SELECT step, id, tier, coalesce(lag(tier) OVER (ORDER BY step) <> tier, false) AS changed FROM (SELECT * FROM (VALUES (0, {C + 1}), (1, (SELECT dst FROM edges WHERE src = {C + 1} AND category = 1))) t(step, id)) JOIN (SELECT id, 'service' AS tier FROM nodes) USING (id)")
def _(n, e):
    end = n.where(F.col("id") == C + 1).first()["parent_id"]
    return tools.trace(n, e, C + 1, end).select("step", "id", "tier", "changed")


@graph("a9_t9_scores", f", s AS (SELECT id, 1.0 / (1 + kind) AS a, CASE WHEN kind = 102 THEN NULL ELSE 1.0 / (2 + kind) END AS b FROM nodes WHERE kind < 104) SELECT (SELECT round(sum(abs(a - coalesce(b, 0))), 6) FROM s) AS moved, (SELECT round(sum(coalesce(b, 0)), 6) FROM s) AS total FROM (SELECT 1)")
def _(n, e):
    own = n.where("kind < 104")
    a, b = own.select("id", (1.0 / (1 + F.col("kind"))).alias("score")), own.where("kind <> 102").select("id", (1.0 / (2 + F.col("kind"))).alias("score"))
    scored = rank.score_of(b, own.select("id")).agg(F.round(F.sum("score"), 6).alias("total"))
    return rank.moved(a, b).select(F.round("moved", 6).alias("moved")).join(scored, how="cross")


@graph("q9_status", "SELECT 'kind' AS what, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'confidence', confidence, count(*) FROM nodes GROUP BY confidence UNION ALL SELECT 'nodes', 0, count(*) FROM nodes UNION ALL SELECT 'edges', 0, count(*) FROM edges")
def _(n, e):
    s = tools.status(n, e)
    out = s["kinds"].select(F.lit("kind").alias("what"), F.col("kind").alias("key"), "n").unionByName(s["confidence"].select(F.lit("confidence").alias("what"), F.col("confidence").alias("key"), "n"))
    for c in ("nodes", "edges"):
        out = out.unionByName(s["counts"].select(F.lit(c).alias("what"), F.lit(0).alias("key"), F.col(c).alias("n")))
    return out


@graph("q9_f9_view", f", r AS (SELECT dst AS id FROM edges WHERE src = {105 * K + 1}) SELECT DISTINCT r.id, n.kind, r.id IN (SELECT dst FROM edges WHERE category = 1) AS child FROM r JOIN nodes n ON n.id = r.id WHERE r.id <> {105 * K + 1}")
def _(n, e):
    return tools.view(n, e, 105 * K + 1, 1).select("id", "kind", "child")


@graph("q5_flow", f", r(id, depth) AS (SELECT cast({R + 1} AS BIGINT), 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.id WHERE r.depth < 2) SELECT id, min(depth) AS depth FROM r WHERE id <> {R + 1} GROUP BY id", True)
def _(n, e):
    back = e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "category")
    name = n.where(F.col("id") == R + 1).first()["qname"]
    return tools.flow(n, back, name, 2)


@query("o7_s13_sweep", "SELECT 'slow' AS list, s_name AS repo FROM (SELECT s_name FROM supplier WHERE s_suppkey % 50 > 30 ORDER BY s_suppkey % 50 DESC, s_name LIMIT 30) UNION ALL SELECT 'empty', s_name FROM supplier WHERE s_suppkey % 2 = 0 AND s_suppkey < 10 UNION ALL SELECT 'cross', s_name FROM (SELECT s_name FROM supplier WHERE s_nationkey > 0 ORDER BY s_nationkey DESC, s_name LIMIT 30)")
def _(spark, d):
    path = f"{shared_dir(spark)}/sweep-{uuid4().hex}"
    rows = spark.read.parquet(f"{d}/supplier.parquet").selectExpr("s_name AS repo_spec", "s_suppkey % 2 = 0 AS ok", "cast(s_suppkey % 50 AS double) AS elapsed_s", "1.0D AS size_mb", "cast(if(s_suppkey < 10, 5, 500) AS bigint) AS node_count", "1L AS edge_count", "cast(s_nationkey AS bigint) AS cross_edge_count")
    rows.write.json(path)
    df = stats.sweep(spark, path)
    named = lambda x, n: x.select(F.lit(n).alias("list"), F.col("repo_spec").alias("repo"))
    return named(stats.slowest(df), "slow").unionByName(named(stats.near_empty(df), "empty")).unionByName(named(stats.most_crossed(df), "cross"))


@query("j21_misses", "SELECT n_name AS repo, kind, 0::BIGINT AS n FROM nation, (VALUES ('a'), ('b')) t(kind) WHERE NOT EXISTS (SELECT 1 FROM supplier WHERE s_nationkey = n_nationkey AND kind = 'a')")
def _(spark, d):
    nation, supplier = spark.read.parquet(f"{d}/nation.parquet"), spark.read.parquet(f"{d}/supplier.parquet")
    found = supplier.join(nation, supplier["s_nationkey"] == nation["n_nationkey"]).select(F.col("n_name").alias("repo"), F.lit("a").alias("kind"))
    return stats.misses(found, nation.select(F.col("n_name").alias("repo"), F.explode(F.array(F.lit("a"), F.lit("b"))).alias("kind")))


def _or(tests: list[str]) -> str:
    return "(" + " OR ".join(tests) + ")"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


_REACT = _or([f"contains(source, {_quoted(m)})" for m in P.REACT_MARKS])
_ANGULAR_FILE = _or([f"ends_with(path, '{x}')" for x in P.ANGULAR_ENDS] + [f"contains(source, '{m}')" for m in P.ANGULAR_MARKS])


@query("fn_sniffers", f"{_F} SELECT path, {_REACT} AS react, {_ANGULAR_FILE} AS angular, cast(len(string_split(regexp_replace(source, '\\n$', ''), chr(10))) AS INTEGER) AS n_lines FROM fs")
def _(spark, d):
    return _files(spark, d).select("path", P.is_react(F.col("source")).alias("react"), P.is_angular(F.col("path"), F.col("source")).alias("angular"), P.line_count(F.col("source")).alias("n_lines"))


@query("f6_entry_kinds", f"SELECT cast(id AS BIGINT) AS id FROM {_N} n WHERE kind IN (5, 11, 13, 15, 17, 19, 21)")
def _(spark, d):
    return tools.entry_points(_nodes(spark, d)).select("id")


@graph("f7_zero_weights", f", m AS (SELECT src, dst, w / sum(w) OVER (PARTITION BY src) AS p FROM (SELECT src, dst, count(*) AS w FROM edges WHERE category <> 4 GROUP BY ALL)) SELECT dst AS id, round(0.5 * p, 6) AS score FROM m WHERE src = {105 * K + 1} UNION ALL SELECT {105 * K + 1}, 0.5")
def _(n, e):
    config = rank.ActivationConfig(weights={4: 0.0}, top_k=None)
    return rank.ppr(n, e, [105 * K + 1], config, rounds=1)[0].select("id", F.round("score", 6).alias("score"))


@graph("u3_a14_adjacent", f"SELECT DISTINCT id FROM (SELECT dst AS id FROM edges WHERE src = {C + 1} UNION ALL SELECT src FROM edges WHERE dst = {C + 1})")
def _(n, e):
    return traverse.both_ways(e, C + 1).select("id").distinct()


@graph("a19_impact_tiers", f", r(id, depth) AS (SELECT cast({R + 1} AS BIGINT), 0 UNION SELECT e.src, r.depth + 1 FROM r JOIN edges e ON e.dst = r.id WHERE r.depth < 2) SELECT 'service' AS tier, count(DISTINCT id) AS n FROM r WHERE id <> {R + 1} HAVING count(*) > 1", True)
def _(n, e):
    return tools.impact(n, e, R + 1, "up", 2).groupBy("tier").agg(F.count("*").alias("n"))
