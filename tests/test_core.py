"""Fixture trees and tables: expected facts, negatives, round trips, invariants."""

import json
import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from structgraph import ids, queries
from structgraph.extract import facts as X
from structgraph.functions import paths as P
from structgraph.operators import post, rank, stack, traverse
from structgraph.parse.facts import Facts
from structgraph.plans import build, stats, textproj, tools
from structgraph.registries import CATEGORY, KIND
from structgraph.session import spread
from structgraph.sources import store
from structgraph.sources.files import describe, walk
from structgraph.streaming import refresh

TREE = {
    "shop/util.py": "def slug(text):\n    return text.lower()\n",
    "shop/people.py": "from .util import slug\nfrom shop import util as u\n\n\nclass Person:\n    \"\"\"A person.\"\"\"\n\n    def save(self):\n        slug('x')\n        self.check()\n        u.slug('y')\n\n    def check(self):\n        other.thing()\n",
    "shop/broken.py": "def fine():\n    pass\n\nclass Half:\n    def half(self:\n",
    "shop/tests/test_util.py": "from shop.util import slug\n",
    "back/server/server.go": 'package server\n\nimport "back/users"\n\nfunc Start(r *Router) {\n\tapi := r.Group("/api")\n\tapi.GET("/users/:id", users.Show)\n\tapi.POST("/users", create)\n}\n',
    "back/server/make.go": "package server\n\nfunc create() {\n\thelp()\n}\n",
    "back/server/help.go": "package server\n\nfunc help() {}\n",
    "front/api.ts": "import { Http } from './http';\nexport class Api {\n  load(id: string) {\n    this.http.get(`/api/users/${id}`);\n    return fetch('/users', { method: 'POST' });\n  }\n}\n",
    "node_modules/x.js": "function no() {}\n",
    ".hidden/y.py": "x = 1\n",
    "jobs/worker.py": "@celery.task\ndef run():\n    redis.Redis()\n\nrun.delay('celery')\n",
    "proto/order.proto": "service Order {\n  rpc Get (A) returns (B);\n  rpc Put (A) returns (B);\n}\n",
    "bad/latin.py": b"x = '\xff\xfe'\n",
}


@pytest.fixture(scope="module")
def graph(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("tree")
    for path, text in TREE.items():
        os.makedirs(os.path.dirname(f"{root}/{path}"), exist_ok=True)
        with open(f"{root}/{path}", "wb") as f:
            f.write(text if isinstance(text, bytes) else text.encode())
    return str(root), build.generate(spark, str(root))


def links(g, category, cross=None):
    n = g.nodes.select("id", "qname").distinct()
    e = g.edges.where(F.col("category") == CATEGORY[category])
    e = e if cross is None else e.where(F.col("is_cross") == cross)
    rows = e.join(n.withColumnsRenamed({"id": "src", "qname": "a"}), "src").join(n.withColumnsRenamed({"id": "dst", "qname": "b"}), "dst").select("a", "b", "confidence").collect()
    return {(r["a"], r["b"], r["confidence"]) for r in rows}


def test_walk_skips_and_names(spark, graph):
    got = {r["path"]: (r["lang"], r["module_qname"]) for r in walk(spark, graph[0]).collect()}
    assert set(got) == set(TREE) - {"node_modules/x.js", ".hidden/y.py", "bad/latin.py"}
    assert got["shop/util.py"] == ("python", "shop::util") and got["front/api.ts"][0] == "typescript"


def test_python_calls(graph):
    got = {(a, b) for a, b, _ in links(graph[1], "calls") if a.startswith("shop")}
    assert got == {("shop::people::Person::save", "shop::util::slug"), ("shop::people::Person::save", "shop::people::Person::check")}
    save = [1 for a, b, _ in links(graph[1], "calls") if b == "shop::util::slug"]
    assert save and graph[1].unresolved_calls.where("base = 'other' AND name = 'thing'").count() == 1


def test_partial_facts_of_a_broken_file(graph):
    names = {r["qname"] for r in graph[1].nodes.where("qname like 'shop::broken%'").collect()}
    assert {"shop::broken::fine", "shop::broken::Half", "shop::broken::Half::half"} <= names


def test_go_packages_and_routes(graph):
    assert ("back::server::create", "back::server::help", 2) in links(graph[1], "calls")
    assert ("route:/api/users", "back::server::create", 2) in links(graph[1], "handled_by")
    assert graph[1].nodes.where("qname = 'back::server' AND kind = 1").count() == 1


def test_http_links_across_stacks(graph):
    got = links(graph[1], "http_calls")
    assert ("endpoint:GET:/api/users/${id}", "route:/api/users/:id", 1) in got
    assert not any(a == "endpoint:POST:/users" for a, *_ in got)  # only the endpoint's own segments are dropped
    assert links(graph[1], "http_calls", False) == set()


def test_other_links_and_facts(graph):
    g = graph[1]
    assert ("queue_producer:celery", "queue_consumer:celery", 1) in links(g, "queue_flows")
    assert ("shop::tests::test_util", "shop::util", 2) in links(g, "tests")
    assert ("jobs::worker", "data_source:redis", 1) in links(g, "accesses_data")
    assert g.nodes.where(f"kind = {KIND['grpc_service']} AND qname = 'grpc:Order'").count() == 1
    weak = {r["qname"]: r["confidence"] for r in g.nodes.collect()}
    assert weak["shop::tests::test_util"] == 0 and weak["shop::util"] == 2


def test_every_call_is_resolved_or_not(spark, graph):
    files = walk(spark, graph[0])
    asked = build.parse_files(files).where("tag = 'call'").count()
    assert links(graph[1], "calls") and graph[1].edges.where("category = 4 AND NOT is_cross").count() + graph[1].unresolved_calls.count() >= asked


def test_store_round_trip_and_corruption(spark, graph, tmp_path):
    g, path = graph[1], f"{tmp_path}/store"
    store.write(g.tables(), path)
    back = store.read(spark, path)
    assert back["nodes"].count() == g.nodes.count() and back["edges"].count() == g.edges.count()
    cells = g.cells.cache()
    node = cells.where("cell_type = 3").first()["node_id"]
    new = spark.createDataFrame([("x", node, 3, "text", "moved", None, 0), ("x", node, 12, "text", "env", None, 0)], cells.schema)
    up = store.upsert_cell(cells, g.nodes, new)
    assert up.where(F.col("node_id") == node).where("cell_type = 12").count() == 1 and up.count() == cells.count() + 1
    with pytest.raises(KeyError):
        store.upsert_cell(cells, g.nodes, new.withColumn("node_id", F.lit(5).cast("long")))
    left, hit = store.remove_cell(up, new.select("node_id", "cell_type"))
    assert hit and left.where(F.col("node_id") == node).where("cell_type in (3, 12)").count() == 0
    assert not store.remove_cell(cells, spark.createDataFrame([(5, 5)], "node_id long, cell_type int"))[1]
    g.nodes.limit(3).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("graph_key").parquet(f"{path}/nodes")
    with pytest.raises(ValueError):
        store.read(spark, path)
    assert store.nodes_json(g.nodes).first()["value"].startswith('{"id":')


def _rows(spark, *rows):
    return spark.createDataFrame(rows, "graph_key string, id long, n int")


def test_store_integrity(spark, tmp_path):
    path = f"{tmp_path}/s"
    table = _rows(spark, ("a", 1, 2), ("a", 1, 2), ("b", 3, 4))
    store.write({"nodes": table}, path)
    assert store.read(spark, path)["nodes"].count() == 3 and store.verify(spark, path).isEmpty()
    hashes = lambda *rows: store.fingerprint(_rows(spark, *rows)).first()["content_hash"]
    assert hashes(("a", 1, 2), ("a", 1, 2)) != hashes(("a", 99, 2), ("a", 99, 2)) and hashes(("a", 1, 2), ("a", 3, 4)) == hashes(("a", 3, 4), ("a", 1, 2))
    shutil.move(f"{path}/nodes/graph_key=b", f"{tmp_path}/b")
    with pytest.raises(ValueError, match="partition b"):
        store.read(spark, path)
    shutil.move(f"{tmp_path}/b", f"{path}/nodes/graph_key=b")
    # a partition derived from the store itself, replaced: the rest stays, the store verifies
    back = store.read(spark, path)["nodes"]
    store.replace_partitions(back.where("graph_key = 'b'").select("graph_key", "id", (F.col("n") + 1).alias("n")), path, "nodes")
    assert {(r["graph_key"], r["id"], r["n"]) for r in store.read(spark, path)["nodes"].collect()} == {("a", 1, 2), ("b", 3, 5)}
    assert [r["n"] for r in store.node(spark, path, 3).collect()] == [5] and store.node(spark, path, 4).isEmpty()
    # a crash after the old store was moved aside
    shutil.move(path, f"{path}.old")
    assert store.read(spark, path)["nodes"].count() == 3 and not os.path.exists(f"{path}.old")
    store.write({"nodes": table.limit(1)}, path)
    assert store.read(spark, path)["nodes"].count() == 1 and not os.path.exists(f"{path}.old")


def test_dense_text(graph):
    g = graph[1]
    text = [r["line"] for r in textproj.dense_text(g.nodes, g.edges, g.cells).collect()]
    assert text[0] == "[LEGEND]" and "[TOPOLOGY]" in text and "[shop::util::slug]" in text
    assert any(" * > " in x and "api/users" in x for x in text) and any(x.startswith(":position   shop/people.py:") for x in text)
    assert ":files      help.go, make.go, server.go" in text or any(x.startswith(":files      ") and x.count(".go") == 3 for x in text)
    assert textproj.alias("a::bc", set()) == "AB" and textproj.alias("a::bc", {"AB"}) == "ABc" and textproj.alias("a::bc", {"AB", "ABc"}) == "AB2"
    assert textproj.alias("server", set()) == "Se" and textproj.alias("s", set()) == "Sx"


def test_dense_text_line_by_line(spark):
    kinds = {1: (1, "m::alpha::beta"), 2: (3, "m::alpha::beta::f"), 3: (3, "m::alpha::beta::g"), 4: (3, "m::alpha::beta::h"), 5: (5, "route:/x"), 6: (99, "odd")}
    n = spark.createDataFrame([(i, k, q, 1 if i == 5 else 2) for i, (k, q) in kinds.items()], "id long, kind int, qname string, confidence int")
    e = spark.createDataFrame([(5, 2, 9), (2, 3, 4), (2, 3, 4), (3, 255, 10), (77, 2, 4), (2, 4, 1)], "src long, dst long, category int")
    c = spark.createDataFrame([(2, 1, "fn f() {\n}", None, 0), (2, 3, '{"file": "a/b.rs", "start_line": 3, "end_line": 9}', None, 1), (3, 3, '{"file":"b.rs","start_line":7,"end_line":7}', None, 0), (4, 14, None, bytearray(5), 0), (4, 2, "x" * 130, None, 1), (1, 1, "x", None, 0), (1, 1, "y", None, 1), (1, 3, '{"file":"q/a.rs"}', None, 2), (1, 3, '{"file":"b.rs"}', None, 3), (1, 2, "doc", None, 4)], "node_id long, cell_type int, text string, bytes binary, ord int")
    got = [r["line"] for r in textproj.dense_text(n, e, c).collect()]
    assert got == [
        "[LEGEND]", "> depends    * entry point    @ external", "", "[SCOPES]", "MAB = m::alpha::beta", "", "[DEFAULTS]", ":confidence strong", "", "[TOPOLOGY]",
        "MAB::f > MAB::g", "MAB::g > @unresolved#ff", "route:/x * > MAB::f", "",
        "[MAB]", ":kind       Module", ":files      a.rs, b.rs", ":doc        doc", "",
        "[MAB::f]", ":kind       Function", ":code       fn f() {…", ":position   a/b.rs:3-9", "",
        "[MAB::g]", ":kind       Function", ":position   b.rs:7", "",
        "[MAB::h]", ":kind       Function", ":vector     <5 bytes>", ":doc        " + "x" * 120 + "…", "",
        "[odd]", ":kind       Node", "", "[route:/x] *", ":kind       Route", ":confidence medium", "",
    ]


def test_chains_and_paths_have_no_bound(spark):
    n = spark.createDataFrame([(i, i - 1 if i else None) for i in range(13)] + [(50, 51), (51, 50)], "id long, parent_id long")
    got = {(r["id"], r["ancestor"], r["distance"]) for r in traverse.parent_chain(n).collect()}
    assert {x for x in got if x[0] < 50} == {(i, j, i - j) for i in range(13) for j in range(i)}
    assert {x for x in got if x[0] >= 50} == {(50, 51, 1), (50, 50, 2), (51, 50, 1), (51, 51, 2)}
    e = spark.createDataFrame([(i, i + 1, 1) for i in range(70)] + [(70, 0, 1)], "src long, dst long, category int").unionByName(spark.createDataFrame([(100 + i, 101 + i, 1) for i in range(70)], "src long, dst long, category int"))
    assert traverse.shortest_path(e, 100, 170) == list(range(100, 171)) and traverse.shortest_path(e, 0, 69) == [0, 70, 69]
    assert traverse.shortest_path(e, 0, 170) is None


def test_sweep_lists(spark, tmp_path):
    rows = [{"repo_spec": f"r{i}", "ok": i != 3, "elapsed_s": 10.0 * i, "size_mb": 1.0, "node_count": 40 * i, "edge_count": i, "cross_edge_count": i % 3} for i in range(6)]
    with open(f"{tmp_path}/s.jsonl", "w") as f:
        f.writelines(json.dumps(r) + "\n" for r in rows)
    df = stats.sweep(spark, f"{tmp_path}/s.jsonl")
    assert [r["repo_spec"] for r in stats.slowest(df).collect()] == ["r5", "r4"]
    assert [r["repo_spec"] for r in stats.near_empty(df).collect()] == ["r0", "r1", "r2"]
    assert [r["repo_spec"] for r in stats.most_crossed(df).collect()] == ["r2", "r5", "r1", "r4"]


def test_tools(spark, graph):
    n, e = graph[1].nodes, graph[1].edges
    assert tools.find_node(n, "slug").first()["qname"] == "shop::util::slug"
    assert tools.find(n, "PERSON").count() == 1 and tools.find(n, "nothing there").count() == 0
    slug = tools.find_node(n, "slug").first()["id"]
    people = {r["qname"] for r in tools.impact(n, e, slug).collect()}
    assert "shop::people::Person::save" in people
    end = tools.find_node(n, "check").first()["id"]
    steps = tools.trace(n, e, slug, end).orderBy("step").collect()
    assert steps[0]["id"] == slug and steps[-1]["id"] == end and len(steps) == 3
    assert traverse.shortest_path(e, slug, 12345) is None and traverse.shortest_path(e, slug, slug) == [slug]
    assert tools.activate(n, e, "save, check", 5).count() <= 5
    assert tools.flow(n, e, "users").count() >= 1 and set(tools.status(n, e)) == {"counts", "kinds", "confidence"}
    whole = tools.status(n, e, graph[1].cells)
    assert [r["line"] for r in whole["preview"].collect()][0] == "[LEGEND]" and whole["preview"].count() == 30
    assert "route:/api/users/:id" not in {r["key"] for r in whole["flows"].collect()} and whole["flows"].count() >= 1


def test_resolvers_and_parsers_can_be_added(spark, monkeypatch):
    n = spark.createDataFrame([(1, 11, "A", "grpc:A", 1, None, 1, 1), (2, 12, "A", "grpc_client:A.Go", 2, None, 1, 2)], "id long, kind int, name string, qname string, confidence int, parent_id long, repo long, ord long")
    none = spark.createDataFrame([], "node_id long, method string")
    own = {"mine": lambda nodes, _: nodes.select("id", F.col("id").alias("dst"), F.lit(99).alias("category"), "confidence").withColumnRenamed("id", "src")}
    assert {(r["src"], r["dst"], r["category"]) for r in stack.all_links(n, none, stack.RESOLVERS | own).collect()} == {(2, 1, 11), (1, 1, 99), (2, 2, 99)}
    monkeypatch.setitem(build.PARSERS, "go", lambda path, source, module: Facts(path, module + "::mine", source))
    files = describe(spark.createDataFrame([("a.go", "package a\nfunc F() {}\n")], "path string, source string"))
    assert [r["qname"] for r in build.parse_files(files).where("tag = 'node'").collect()] == ["a::mine"]
    assert spark.range(1).select(ids.hex_hash(F.lit("abc"))).first()[0] == "44bc2cf5ad770999"


def test_ppr_against_numpy(spark):
    edges = [(1, 2, 4), (1, 3, 1), (2, 4, 4), (3, 4, 4), (4, 4, 4), (4, 5, 9), (1, 2, 4), (6, 1, 6)]
    n = spark.createDataFrame([(i,) for i in range(1, 8)], "id long")
    e = spark.createDataFrame(edges, "src long, dst long, category int")
    w = np.zeros((8, 8))
    for a, b, c in edges:
        w[a, b] += rank.WEIGHTS[c]
    p = np.divide(w, w.sum(1, keepdims=True), where=w.sum(1, keepdims=True) > 0, out=np.zeros_like(w))
    start = np.zeros(8)
    start[1] = 1
    v = start
    for _ in range(100):
        v = 0.5 * start + 0.5 * (p.T @ v + v[p.sum(1) == 0].sum() * start)
    scores, made = rank.ppr(n, e, [1, 1, 99], rank.ActivationConfig(top_k=None))
    got = {r["id"]: r["score"] for r in scores.collect()}
    assert made < 50 and sum(got.values()) == pytest.approx(1, abs=1e-5)
    assert all(got.get(i, 0) == pytest.approx(v[i], abs=1e-5) for i in range(1, 8))
    assert rank.ppr(n, e, [99])[1] == 0 and rank.top(scores, 2).count() == 2
    none = rank.ActivationConfig(weights={4: 0.0}, default_weight=0.0, top_k=None)
    assert [r["id"] for r in rank.ppr(n, e, [1], none)[0].collect()] == [1]


def test_depth_is_fewest_hops(spark):
    e = spark.createDataFrame([(1, 2, 1), (2, 3, 1), (1, 3, 1), (3, 1, 1), (3, 4, 2)], "src long, dst long, category int")
    seed = spark.createDataFrame([(1,)], "id long")
    assert {(r["id"], r["depth"]) for r in traverse.reach(e, seed, 5).collect()} == {(2, 1), (3, 1), (4, 2)}
    assert {r["id"] for r in traverse.reach(e, seed, 5, follow=(1,)).collect()} == {2, 3}


def test_path_functions(spark):
    rows = [("/a/:id//{x}/", "/a/{}/{}"), ("", "/"), ("a/${b}", "/a/{}"), ("/", "/")]
    df = spark.createDataFrame(rows, "p string, want string")
    assert all(r[0] == r[1] for r in df.select(P.normalise_http_path(F.col("p")), "want").collect())
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(P.relative_module(F.lit("a::b::c"), F.lit("x.y"), F.lit(2))) == "a::x::y"
    assert one(P.socket_path(F.lit("wss://h/x"))) == "/x" and one(P.socket_path(F.lit("wss://h"))) == "wss://h"
    assert one(P.bracket_params(F.lit("/a/[id]/[...rest]"))) == "/a/:id/:rest"
    assert one(P.common_prefix(F.array(*map(F.lit, "abc")), F.array(*map(F.lit, "abd")))) == 2


def test_extractors(spark):
    src = {
        "a.ts": "app.get('/x/:id', f);\napp.post('/x/:id', f);\naxios.get('/no');\nconst s = new WebSocket('ws://h/live');\nuseQuery(gql`query Me { a }`);\nbus.emit('made');\nfunction useThing() { return <Box/>; }\nfunction Card() {}\n",
        "app/api/users/[id]/route.ts": "export async function GET() {}\nexport const POST = 1;\n",
        "src/routes/+server.ts": "export default 1;\n",
        "n.ts": "@Controller('cats')\nclass C {\n@Get(':id')\nx() {}\n@Post()\ny() {}\n}\n",
        "c.go": "cmd := &cobra.Command{Use: \"tool\"}\nexec.Command(\"git\", \"x\")\nc := pb.NewOrderServiceClient(conn)\nws.on('connection', f)\n",
    }
    files = describe(spark.createDataFrame(list(src.items()), "path string, source string"))
    routes = {(r["path"], r["name"], tuple(r["methods"])) for r in X.backend_routes(files).collect()}
    assert routes == {("a.ts", "/x/:id", ("GET", "POST")), ("app/api/users/[id]/route.ts", "/api/users/:id", ("GET", "POST")), ("src/routes/+server.ts", "/", ("GET",)), ("n.ts", "/cats/:id", ("GET",)), ("n.ts", "/cats", ("POST",))}
    every = {(r["path"], r["qname"]) for r in X.extract_all(files).collect()}
    assert {("a.ts", "ws_client:/live"), ("a.ts", "graphql_op:Me"), ("a.ts", "event_emit:made"), ("a.ts", "hook:useThing"), ("a.ts", "component:Card"), ("c.go", "cli:tool"), ("c.go", "cli_invoke:git"), ("c.go", "ws:ws"), ("c.go", "grpc_client:NewOrder")} <= every


LANGUAGES = {
    "A.java": ("import a.b.C;\npublic class A {\n  @GetMapping(\"/x\")\n  public String go(int k) { return help(k); }\n}\n", {"A::A", "A::A::go", "GET /x"}),
    "a.cs": ("namespace N {\n  public class C {\n    [HttpGet(\"y\")]\n    public int Run() { return 1; }\n  }\n}\n", {"a::N", "a::N::C", "a::N::C::Run", "GET y"}),
    "a.php": ("<?php\nuse A\\B\\C;\nclass K {\n  function f() { $this->g(); }\n}\nRoute::get('/p', x);\n", {"a::K", "a::K::f", "GET /p"}),
    "a.rs": ("use crate::m::f;\nstruct S;\nimpl S {\n  fn go(&self) { f(); }\n}\nfn top() {}\n", {"a::S", "a::S::go", "a::top"}),
    "a.rb": ("class K\n  def go\n    help()\n  end\nend\n", {"a::K", "a::K::go"}),
    "a.swift": ("struct S {\n  func go() {}\n}\napp.get(\"a\", \":b\") { r in 1 }\n", {"a::S", "a::S::go", "GET /a/b"}),
    "a.cpp": ("#include \"x.h\"\nnamespace n {\nclass K {\n  int go(int a) { return 1; }\n};\n}\n", {"a::n", "a::n::K", "a::n::K::go"}),
    "a.scala": ("object O {\n  def go() = { 1 }\n}\ntrait T\n", {"a::O", "a::O::go", "a::T"}),
    "a.clj": ("(ns a (:require [b.c :as c]))\n(defn go [x] (c/f x))\n(GET \"/k\" [] 1)\n", {"a::go", "GET /k"}),
    "a.dart": ("import 'x.dart';\nclass K {\n  int go(int a) { return 1; }\n}\n", {"a::K", "a::K::go"}),
    "a.ex": ("defmodule M do\n  def go(x) do\n    x\n  end\nend\n", {"a::M", "a::M::go"}),
    "a.sol": ("contract K {\n  event E(uint a);\n  function go() public { }\n}\n", {"a::K", "a::K::go", "a::K::E"}),
    "a.tf": ("resource \"t\" \"r\" {\n}\nmodule \"m\" {\n  source = \"./x\"\n}\n", {"a::r", "a::m"}),
    "a.vue": ("<template/>\n<script>\nfunction go() {}\n</script>\n", {"a::go"}),
}


def test_other_languages(spark):
    files = describe(spark.createDataFrame([(p, s) for p, (s, _) in LANGUAGES.items()], "path string, source string"))
    got = {}
    for r in build.parse_files(files).where("tag = 'node'").collect():
        got.setdefault(r["path"], set()).add(r["qname"])
    for p, (_, want) in LANGUAGES.items():
        assert want <= got[p], (p, got[p])


ROUTES = {
    "R.java": (
        '@RequestMapping("/v1")\npublic class R {\n  @PostMapping(value = "/x", consumes = {"a", "b"})\n  @Deprecated\n  public String go(@PathVariable("id") int k) { return ""; }\n  @GET\n  @Path("/j")\n  public String jax() { return ""; }\n  @GetMapping("/none")\n  String abstractOne();\n  public void after() { }\n}\n',
        {("ANY", "/v1", "R::R"), ("POST", "/x", "R::R::go"), ("GET", "/j", "R::R::jax"), ("GET", "/none", None)},
    ),
    "r.cs": (
        '[Route("api")]\npublic class C {\n  [HttpGet("y"), Authorize]\n  public int Run() { return 1; }\n  [HttpDelete]\n  public int Gone() { return 1; }\n  public void Use(App app) {\n    app.MapPut("/m", F);\n  }\n}\n',
        {("ANY", "api", "r::C"), ("GET", "y", "r::C::Run"), ("DELETE", "/", "r::C::Gone"), ("PUT", "/m", "r::C::Use")},
    ),
    "r.php": (
        "<?php\nclass K {\n  #[Route('/a/{id}', requirements: ['id' => '[0-9]'], methods: ['GET', 'POST'])]\n  public function f() { }\n  #[Route('/b')]\n  public function g() { }\n}\nRoute::get('/p', x);\n",
        {("GET", "/a/{id}", "r::K::f"), ("POST", "/a/{id}", "r::K::f"), ("ANY", "/b", "r::K::g"), ("GET", "/p", None)},
    ),
    "r.rs": (
        '#[get("/z")]\nfn z() {}\nfn app() { Router::new().route("/p", get(a).post(b)).route("/q/:id", target(delete(c))) }\n',
        {("GET", "/z", "r"), ("GET", "/p", None), ("POST", "/p", None), ("DELETE", "/q/:id", None)},
    ),
    "config/routes.rb": (
        "Rails.application.routes.draw do\n  root 'home#index'\n  get 'users', to: 'users#index'\n  resources :posts\n  resource :profile\nend\n",
        {("GET", "/", None), ("GET", "/users", None), ("ANY", "/posts", None), ("ANY", "/profile", None)},
    ),
    "r.scala": (
        'object O {\n  val s = HttpRoutes.of[IO] {\n    case GET -> Root / "users" / IntVar(id) => Ok(1)\n    case POST -> Root / "users" / name => Ok(1)\n    case DELETE -> Root => Ok(1)\n  }\n  val t = path("admin") { get { 1 } }\n}\n',
        {("GET", "/users/:id", None), ("POST", "/users/:name", None), ("DELETE", "/", None), ("ANY", "/admin", None)},
    ),
}


def test_routes_have_all_verbs_and_handlers(spark):
    files = describe(spark.createDataFrame([(p, s) for p, (s, _) in ROUTES.items()], "path string, source string"))
    facts = build.parse_files(files)
    # a node per verb and path, the verb as its cell, the handler as an edge
    cells = {(r["path"], r["qname"], r["text"]) for r in facts.where("tag = 'cell' AND cell_type = 5").collect()}
    edges = {(r["path"], r["src"], r["dst"]) for r in facts.where("tag = 'edge' AND category = 9").collect()}
    for p, (_, want) in ROUTES.items():
        assert {c for c in cells if c[0] == p} == {(p, f"{v} {route}", v) for v, route, _ in want}, p
        assert {e for e in edges if e[0] == p} == {(p, f"{v} {route}", h) for v, route, h in want if h}
    line = describe(spark.createDataFrame([("e.ts", "app.route('/a').get('/a', f).post('/b', g);\n")], "path string, source string"))
    assert {(r["method"], r["route"]) for r in X.express_routes(line).collect()} == {("GET", "/a"), ("POST", "/b")}


def test_statistics(spark):
    df = spark.createDataFrame([(float(i),) for i in range(10)] + [(None,)], "v double")
    assert tuple(stats.spread(df, "v").first()) == (0, 4.5, 9, 9, 10)
    assert stats.kind_name(F.lit(1)) is not None
    found = spark.createDataFrame([("r", "route")], "repo string, kind string")
    want = spark.createDataFrame([("r", "route"), ("r", "hook")], "repo string, kind string")
    assert [r["kind"] for r in stats.misses(found, want).collect()] == ["hook"]


def test_refresh(spark, tmp_path):
    src = f"{tmp_path}/in"
    for i, rows in enumerate(([("a.py", "x = 1"), ("b.py", "y = 1")], [("a.py", "x = 2"), ("b.py", None)])):
        spark.createDataFrame(rows, refresh.SCHEMA).coalesce(1).write.mode("append").parquet(src)
        stream = spark.readStream.schema(refresh.SCHEMA).parquet(src)
        refresh.follow(stream, f"{tmp_path}/t", f"{tmp_path}/c").awaitTermination()
    assert {tuple(r) for r in refresh.current(spark, f"{tmp_path}/t").collect()} == {("a.py", "x = 2")}


def test_registered_queries_have_columns(spark):
    assert set(queries.oracle_sql()) <= set(queries.queries())
    for name in ("j11_http_links", "j13_queue_links", "j20_tests"):
        assert queries.queries()[name](spark, "/root/testdata/sf0.001").columns == ["src", "dst", "category", "confidence"]


def _most_rows(df):
    """The most rows that an operator of a plan gave, and the result."""
    spark, key = df.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        df = df.select("*")
        rows, todo, most = df.collect(), [df._jdf.queryExecution().executedPlan()], 0
    finally:
        spark.conf.set(key, was)
    while todo:
        plan = todo.pop()
        counted = plan.metrics().get("numOutputRows")
        most = max(most, counted.get().value() if counted.isDefined() else 0)
        todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return most, rows


def test_many_tests_and_modules_of_one_name(spark):
    n, qnames = 400, []
    for i in range(n):
        qnames += [f"r{i}::shop::util", f"r{i}::shop::tests::test_util", f"r{i % 7}::deep{i}::util"]
    rows = [(i + 1, 1, q, (i * 7919) % 500) for i, q in enumerate([*qnames, "util", "test_util", "x::util_test", "r1::shop::tests::util"])]
    nodes = spark.createDataFrame(rows, "id long, kind int, qname string, ord long")
    most, found = _most_rows(post.test_edges(nodes))
    shared = lambda a, b: len(os.path.commonprefix([a.split("::")[:-1], b.split("::")[:-1]]))
    want = set()
    for i, _, q, _ in rows:
        if q.split("::")[-1] in ("test_util", "util_test"):
            met = sorted((-shared(q, m), o, j) for j, _, m, o in rows if m.split("::")[-1] == "util")
            want |= {(i, j, 7, 2) for s, _, j in met[:3] if s == met[0][0]}
    assert sorted(map(tuple, found)) == sorted(want)
    assert most < 20 * len(rows)  # all pairs are 320,000


def test_small_files_share_frames_and_tasks(spark):
    import pandas as pd

    files = pd.DataFrame([(f"a{i}.py", "python", "def f(): pass\n", f"a{i}") for i in range(5000)], columns=["path", "lang", "source", "module_qname"])
    frames = list(build._frames(iter([files[:2500], files[2500:]]), build.PARSERS))
    assert len(frames) < 10 and sum((f["tag"] == "node").sum() for f in frames) == 10_000
    assert list(build._frames(iter([files[:0]]), build.PARSERS)) == []
    one = spark.createDataFrame(files).coalesce(1)
    assert spread(one, "path").rdd.getNumPartitions() > spark.sparkContext.defaultParallelism


def test_wild_sockets_are_dealt_out(spark):
    names = [(18, f"ws_client:/c{i}/") for i in range(300)] + [(17, "ws:default")] * 200 + [(18, "ws_client:WS/"), (17, "ws:/ws"), (17, "ws:/a/C7"), (18, "ws_client:default"), (17, "ws:/zz")]
    rows = [(i + 1, kind, q, i % 3) for i, (kind, q) in enumerate(names)]
    nodes = spark.createDataFrame(rows, "id long, kind int, qname string, confidence int")
    own = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    was = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        found = stack.socket_links(nodes).withColumn("task", F.spark_partition_id()).toPandas()
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
    norm = lambda q: q.split(":", 1)[1].strip("/").lower()
    meet = lambda k, m: k == "ws" or m in ("ws", "default") or k.endswith(m) or m.endswith(k)
    want = [(i, j, 14, min(c, d)) for i, kind, k, c in rows if kind == 18 for j, other, m, d in rows if other == 17 and meet(norm(k), norm(m))]
    assert sorted(found[["src", "dst", "category", "confidence"]].itertuples(index=False, name=None)) == sorted(want)
    assert found.groupby("task").size().max() < len(want) / 4
