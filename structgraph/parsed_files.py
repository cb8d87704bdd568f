"""Authored files and the facts that parsing them must give, a parse of each read against its text line by line.

``{k}`` stands for a key, ``~`` for the file's module.  A fact is ``node kind
qname parent confidence``, ``edge category source target confidence``, ``import
form module name alias level``, ``call source form base name``, ``ref`` likewise
or ``cell type qname text`` (``-``: none).
"""

PARSED = [
    ('py{k}/app/people.py', 'from .util import slug as s\nimport app.util\nfrom . import other\n\nclass Person{k}(Base):\n    """Doc."""\n    def save(self):\n        s(\'x\')\n        self.check()\n        app.go()\n        a.b.c()\n    def check(self):\n        def inner():\n            deep()\n        return inner\n\n@app.get(\'/p{k}\')\ndef show(): pass\n\n@bp.route(\'/m\', methods=[\'POST\', \'put\'])\ndef many(): pass\n\nurlpatterns = [path(\'old/\', show)]\n', (
        'node 1 ~ - 2',
        'import symbol util slug s 1',
        'import module app.util - - 0',
        'import symbol  other - 1',
        'node 2 ~::Person{k} ~ 2',
        'edge 1 ~ ~::Person{k} 2',
        'cell 2 ~::Person{k} Doc.',
        'node 4 ~::Person{k}::save ~::Person{k} 2',
        'edge 1 ~::Person{k} ~::Person{k}::save 2',
        'call ~::Person{k}::save bare - s',
        'call ~::Person{k}::save self - check',
        'call ~::Person{k}::save attribute app go',
        'call ~::Person{k}::save complex a.b c',
        'node 4 ~::Person{k}::check ~::Person{k} 2',
        'edge 1 ~::Person{k} ~::Person{k}::check 2',
        'node 3 ~::Person{k}::check::inner ~::Person{k}::check 2',
        'edge 1 ~::Person{k}::check ~::Person{k}::check::inner 2',
        'call ~::Person{k}::check::inner bare - deep',
        'node 3 ~::show ~ 2',
        'edge 1 ~ ~::show 2',
        'node 5 GET /p{k} - 2',
        'cell 5 GET /p{k} GET',
        'edge 9 GET /p{k} ~::show 2',
        'node 3 ~::many ~ 2',
        'edge 1 ~ ~::many 2',
        'node 5 POST /m - 2',
        'cell 5 POST /m POST',
        'edge 9 POST /m ~::many 2',
        'node 5 PUT /m - 2',
        'cell 5 PUT /m PUT',
        'edge 9 PUT /m ~::many 2',
        'call ~ bare - path',
        'node 5 ANY old/ - 1',
        'cell 5 ANY old/ ANY',
    )),
    ('go{k}/srv/main.go', 'package srv\n\nimport (\n\t"fmt"\n\tu "go{k}/users"\n)\n\ntype Server struct{}\ntype Door interface{}\n\nfunc (s *Server) Open() {\n\ts.Close()\n\tu.Find()\n}\n\nfunc Start{k}(r *R) {\n\tapi := r.Group("/api/")\n\tv := api.Group("v1")\n\tv.GET("/x/:id", u.Show)\n\tapi.POST("/y", create)\n\thelp(1)\n}\n', (
        'node 1 ~ - 2',
        'node 8 ~::Server ~ 2',
        'edge 1 ~ ~::Server 2',
        'node 7 ~::Door ~ 2',
        'edge 1 ~ ~::Door 2',
        'node 4 ~::Server::Open ~::Server 2',
        'edge 1 ~::Server ~::Server::Open 2',
        'node 3 ~::Start{k} ~ 2',
        'edge 1 ~ ~::Start{k} 2',
        'import module fmt - - 0',
        'import module go{k}/users - u 0',
        'call ~::Server::Open self - Close',
        'call ~::Server::Open attribute u Find',
        'call ~::Start{k} attribute r Group',
        'call ~::Start{k} attribute api Group',
        'call ~::Start{k} attribute v GET',
        'call ~::Start{k} attribute api POST',
        'call ~::Start{k} bare - help',
        'node 5 route:/api/v1/x/:id ~ 2',
        'cell 5 route:/api/v1/x/:id {"method": "GET", "handler": null, "file": "go{k}/srv/main.go", "line": 19}',
        'ref route:/api/v1/x/:id attribute u Show',
        'node 5 route:/api/y ~ 2',
        'cell 5 route:/api/y {"method": "POST", "handler": null, "file": "go{k}/srv/main.go", "line": 20}',
        'ref route:/api/y bare - create',
    )),
    ('ts{k}/a.ts', "import def, { one, two as t } from './lib';\nimport * as ns from '../n/s';\nimport 'side';\nexport class Api{k} {\n  load(id: string) {\n    this.http.get(`/u/${id}`);\n    one();\n    this.load(id);\n    return fetch('/p{k}', { method: 'POST' });\n  }\n}\ninterface Shape {}\nexport const go = async () => { ns.call(); };\nfunction old() { t(); }\n", (
        'node 1 ~ - 2',
        'node 2 ~::Api{k} ~ 2',
        'edge 1 ~ ~::Api{k} 2',
        'node 4 ~::Api{k}::load ~::Api{k} 2',
        'edge 1 ~::Api{k} ~::Api{k}::load 2',
        'node 7 ~::Shape ~ 2',
        'edge 1 ~ ~::Shape 2',
        'node 3 ~::go ~ 2',
        'edge 1 ~ ~::go 2',
        'node 3 ~::old ~ 2',
        'edge 1 ~ ~::old 2',
        'import module ../n/s - ns 0',
        'import symbol ./lib default def 0',
        'import symbol ./lib one - 0',
        'import symbol ./lib two t 0',
        'import module side - - 0',
        'call ~::Api{k}::load complex http get',
        'call ~::Api{k}::load bare - one',
        'call ~::Api{k}::load self - load',
        'call ~::Api{k}::load bare - fetch',
        'call ~::go attribute ns call',
        'call ~::old bare - t',
        'node 9 endpoint:GET:/u/${id} ~ 1',
        'cell 6 endpoint:GET:/u/${id} {"method": "GET", "path": "/u/${id}", "file": "ts{k}/a.ts", "line": 6, "confidence": 1}',
        'edge 4 ~::Api{k}::load endpoint:GET:/u/${id} 1',
        'node 9 endpoint:POST:/p{k} ~ 2',
        'cell 6 endpoint:POST:/p{k} {"method": "POST", "path": "/p{k}", "file": "ts{k}/a.ts", "line": 9, "confidence": 2}',
        'edge 4 ~::Api{k}::load endpoint:POST:/p{k} 2',
    )),
    ('java{k}/A.java', 'import a.b.C;\nimport static d.e.*;\n\n@RequestMapping("/base{k}")\npublic class A extends B {\n  @GetMapping("/x")\n  public String go(int k) { return help(k); }\n  @POST\n  @Path("/j")\n  public void jax() { this.go(1); other.run(); }\n  interface In {}\n  enum E { P }\n}\n', (
        'node 1 ~ - 2',
        'node 2 ~::A ~ 2',
        'edge 1 ~ ~::A 2',
        'node 4 ~::A::go ~::A 2',
        'edge 1 ~::A ~::A::go 2',
        'node 4 ~::A::jax ~::A 2',
        'edge 1 ~::A ~::A::jax 2',
        'node 7 ~::A::In ~::A 2',
        'edge 1 ~::A ~::A::In 2',
        'node 10 ~::A::E ~::A 2',
        'edge 1 ~::A ~::A::E 2',
        'import module d.e - - 0',
        'import symbol a.b C - 0',
        'call ~::A::go bare - help',
        'call ~::A::jax self - go',
        'call ~::A::jax attribute other run',
        'node 5 ANY /base{k} - 2',
        'cell 5 ANY /base{k} ANY',
        'edge 9 ANY /base{k} ~::A 2',
        'node 5 GET /x - 2',
        'cell 5 GET /x GET',
        'edge 9 GET /x ~::A::go 2',
        'node 5 POST /j - 2',
        'cell 5 POST /j POST',
        'edge 9 POST /j ~::A::jax 2',
    )),
    ('kt{k}/K.kt', 'import a.b.D as E\nclass K{k} {\n  fun run(x: Int) { E.go() }\n}\nfun top() {\n  routing {\n    get("/k{k}") { call() }\n  }\n}\n', (
        'node 1 ~ - 2',
        'node 2 ~::K{k} ~ 2',
        'edge 1 ~ ~::K{k} 2',
        'node 4 ~::K{k}::run ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::run 2',
        'node 3 ~::top ~ 2',
        'edge 1 ~ ~::top 2',
        'import symbol a.b D E 0',
        'call ~::K{k}::run attribute E go',
        'call ~::top bare - get',
        'call ~::top bare - call',
        'node 5 GET /k{k} - 1',
        'cell 5 GET /k{k} GET',
    )),
    ('cs{k}/C.cs', 'using A.B.C;\nnamespace N.M {\n  public class K{k} {\n    [HttpGet("x")]\n    public int Run(int a) { return Help(a); }\n    [HttpPost]\n    public void Put() { this.Run(1); }\n  }\n  public struct S {}\n  interface I {}\n}\n', (
        'node 1 ~ - 2',
        'node 6 ~::N.M ~ 2',
        'edge 2 ~ ~::N.M 2',
        'node 2 ~::N.M::K{k} ~::N.M 2',
        'edge 1 ~::N.M ~::N.M::K{k} 2',
        'node 4 ~::N.M::K{k}::Run ~::N.M::K{k} 2',
        'edge 1 ~::N.M::K{k} ~::N.M::K{k}::Run 2',
        'node 4 ~::N.M::K{k}::Put ~::N.M::K{k} 2',
        'edge 1 ~::N.M::K{k} ~::N.M::K{k}::Put 2',
        'node 8 ~::N.M::S ~::N.M 2',
        'edge 1 ~::N.M ~::N.M::S 2',
        'node 7 ~::N.M::I ~::N.M 2',
        'edge 1 ~::N.M ~::N.M::I 2',
        'import symbol A.B C - 0',
        'call ~::N.M::K{k}::Run bare - Help',
        'call ~::N.M::K{k}::Put self - Run',
        'node 5 GET x - 2',
        'cell 5 GET x GET',
        'edge 9 GET x ~::N.M::K{k}::Run 2',
        'node 5 POST / - 2',
        'cell 5 POST / POST',
        'edge 9 POST / ~::N.M::K{k}::Put 2',
    )),
    ('php{k}/a.php', "<?php\nnamespace App;\nuse A\\B\\C as D;\nclass K{k} {\n  #[Route('/a', methods: ['GET', 'POST'])]\n  public function f() { $this->g(); D::make(); help(); }\n  private function g() { }\n}\nRoute::get('/p{k}', x);\nRoute::apiResource('/r', y);\n", (
        'node 1 ~ - 2',
        'node 6 ~::App ~ 2',
        'edge 2 ~ ~::App 2',
        'node 2 ~::K{k} ~ 2',
        'edge 1 ~ ~::K{k} 2',
        'node 4 ~::K{k}::f ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::f 2',
        'node 4 ~::K{k}::g ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::g 2',
        'import symbol A.B C D 0',
        'call ~::K{k}::f self - g',
        'call ~::K{k}::f attribute D make',
        'call ~::K{k}::f bare - help',
        'call ~ attribute Route get',
        'call ~ attribute Route apiResource',
        'node 5 GET /a - 2',
        'cell 5 GET /a GET',
        'edge 9 GET /a ~::K{k}::f 2',
        'node 5 POST /a - 2',
        'cell 5 POST /a POST',
        'edge 9 POST /a ~::K{k}::f 2',
        'node 5 GET /p{k} - 1',
        'cell 5 GET /p{k} GET',
        'node 5 GET /r - 1',
        'cell 5 GET /r GET',
        'node 5 POST /r - 1',
        'cell 5 POST /r POST',
        'node 5 PUT /r - 1',
        'cell 5 PUT /r PUT',
        'node 5 PATCH /r - 1',
        'cell 5 PATCH /r PATCH',
        'node 5 DELETE /r - 1',
        'cell 5 DELETE /r DELETE',
    )),
    ('rs{k}/a.rs', 'use crate::m::{f, g as h};\nuse std::io;\nstruct S{k};\nenum E { A }\ntrait T {}\nimpl S{k} {\n  fn go(&self) { f(); self.go(); h::x(); }\n}\n#[get("/z{k}")]\nfn top() { Router::new().route("/p", get(a).post(b)) }\n', (
        'node 1 ~ - 2',
        'node 8 ~::S{k} ~ 2',
        'edge 1 ~ ~::S{k} 2',
        'node 10 ~::E ~ 2',
        'edge 1 ~ ~::E 2',
        'node 7 ~::T ~ 2',
        'edge 1 ~ ~::T 2',
        'node 4 ~::S{k}::go ~::S{k} 2',
        'edge 1 ~::S{k} ~::S{k}::go 2',
        'node 3 ~::top ~ 2',
        'edge 1 ~ ~::top 2',
        'import symbol crate.m f - 0',
        'import symbol crate.m g h 0',
        'call ~::S{k}::go bare - f',
        'call ~::S{k}::go self - go',
        'call ~::S{k}::go attribute h x',
        'call ~::top complex ) route',
        'call ~::top bare - get',
        'call ~::top complex ) post',
        'node 5 GET /z{k} - 2',
        'cell 5 GET /z{k} GET',
        'edge 9 GET /z{k} ~ 2',
        'node 5 GET /p - 1',
        'cell 5 GET /p GET',
        'node 5 POST /p - 1',
        'cell 5 POST /p POST',
    )),
    ('rb{k}/config/routes.rb', "require 'lib/x'\nroot 'home#index'\nget 'users{k}', to: 'u#i'\nmatch '/any', via: :all\nresources :posts\n", (
        'node 1 ~ - 2',
        'import module lib/x - - 0',
        'node 5 GET /users{k} - 2',
        'cell 5 GET /users{k} GET',
        'node 5 ANY /any - 2',
        'cell 5 ANY /any ANY',
        'node 5 ANY /posts - 1',
        'cell 5 ANY /posts ANY',
        'node 5 GET / - 2',
        'cell 5 GET / GET',
    )),
    ('rb{k}/k.rb', 'module Mod\n  class K{k}\n    def go\n      self.run(1)\n      help(2)\n    end\n  end\nend\n', (
        'node 1 ~ - 2',
        'node 6 ~::Mod ~ 2',
        'edge 2 ~ ~::Mod 2',
        'node 2 ~::Mod::K{k} ~::Mod 2',
        'edge 1 ~::Mod ~::Mod::K{k} 2',
        'node 4 ~::Mod::K{k}::go ~::Mod::K{k} 2',
        'edge 1 ~::Mod::K{k} ~::Mod::K{k}::go 2',
        'call ~::Mod::K{k}::go self - run',
        'call ~::Mod::K{k}::go bare - help',
    )),
    ('sw{k}/a.swift', 'import Vapor\nstruct S{k} {\n  func go() { help(1); self.go() }\n}\nactor Act {}\nenum E {}\nprotocol P {}\nfunc top() {}\napp.get("a{k}", ":b") { r in 1 }\n', (
        'node 1 ~ - 2',
        'node 8 ~::S{k} ~ 2',
        'edge 1 ~ ~::S{k} 2',
        'node 4 ~::S{k}::go ~::S{k} 2',
        'edge 1 ~::S{k} ~::S{k}::go 2',
        'node 2 ~::Act ~ 2',
        'edge 1 ~ ~::Act 2',
        'node 10 ~::E ~ 2',
        'edge 1 ~ ~::E 2',
        'node 7 ~::P ~ 2',
        'edge 1 ~ ~::P 2',
        'node 3 ~::top ~ 2',
        'edge 1 ~ ~::top 2',
        'import module Vapor - - 0',
        'call ~::S{k}::go bare - help',
        'call ~::S{k}::go self - go',
        'call ~ attribute app get',
        'node 5 GET /a{k}/b - 1',
        'cell 5 GET /a{k}/b GET',
    )),
    ('cc{k}/a.cpp', '#include "x/y.h"\n#include <vector>\nnamespace n {\nclass K{k} {\n  int go(int a) { return help(a); }\n};\nenum class E { A };\n}\nint main(int c) { return 0; }\n', (
        'node 1 ~ - 2',
        'node 6 ~::n ~ 2',
        'edge 2 ~ ~::n 2',
        'node 2 ~::n::K{k} ~::n 2',
        'edge 1 ~::n ~::n::K{k} 2',
        'node 4 ~::n::K{k}::go ~::n::K{k} 2',
        'edge 1 ~::n::K{k} ~::n::K{k}::go 2',
        'node 10 ~::n::E ~::n 2',
        'edge 1 ~::n ~::n::E 2',
        'node 3 ~::main ~ 2',
        'edge 1 ~ ~::main 2',
        'import module x/y.h - - 0',
        'call ~::n::K{k}::go bare - help',
    )),
    ('sc{k}/a.scala', 'package p.q\nimport a.b.C\nobject O{k} {\n  def go(x: Int) = { help(x) }\n}\ntrait T\nclass R { val s = path("admin{k}") { get { 1 } }\n  case GET -> Root / "u" / IntVar(id) => Ok(1)\n}\n', (
        'node 1 ~ - 2',
        'node 2 ~::O{k} ~ 2',
        'edge 1 ~ ~::O{k} 2',
        'node 4 ~::O{k}::go ~::O{k} 2',
        'edge 1 ~::O{k} ~::O{k}::go 2',
        'node 7 ~::T ~ 2',
        'edge 1 ~ ~::T 2',
        'node 2 ~::R ~ 2',
        'edge 1 ~ ~::R 2',
        'import module p.q - - 0',
        'import module a.b.C - - 0',
        'call ~::O{k}::go bare - help',
        'call ~ bare - path',
        'call ~ bare - IntVar',
        'call ~ bare - Ok',
        'node 5 ANY /admin{k} - 1',
        'cell 5 ANY /admin{k} ANY',
        'node 5 GET /u/:id - 1',
        'cell 5 GET /u/:id GET',
    )),
    ('clj{k}/a.clj', '(ns a (:require [b.c :as c] [d.e]))\n(defn go{k} [x] (let [y (c/f x)] (help y) (.close x)))\n(defprotocol P)\n(defrecord Rec [a])\n(GET "/k{k}" [] 1)\n["/r" {:get h}]\n', (
        'node 1 ~ - 2',
        'node 3 ~::go{k} ~ 2',
        'edge 1 ~ ~::go{k} 2',
        'node 7 ~::P ~ 2',
        'edge 1 ~ ~::P 2',
        'node 8 ~::Rec ~ 2',
        'edge 1 ~ ~::Rec 2',
        'import module b.c - c 0',
        'import module d.e - - 0',
        'call ~::go{k} attribute c f',
        'call ~::go{k} bare - help',
        'call ~::go{k} self - close',
        'node 5 GET /k{k} - 1',
        'cell 5 GET /k{k} GET',
        'node 5 GET /r - 1',
        'cell 5 GET /r GET',
    )),
    ('da{k}/a.dart', "import 'x.dart' as x;\nclass K{k} {\n  int go(int a) { return x.help(a); }\n}\nenum E { a }\nfinal r = GoRoute(path: '/g{k}');\n", (
        'node 1 ~ - 2',
        'node 2 ~::K{k} ~ 2',
        'edge 1 ~ ~::K{k} 2',
        'node 4 ~::K{k}::go ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::go 2',
        'node 10 ~::E ~ 2',
        'edge 1 ~ ~::E 2',
        'import module x.dart - x 0',
        'call ~::K{k}::go attribute x help',
        'node 5 ANY /g{k} - 1',
        'cell 5 ANY /g{k} ANY',
    )),
    ('ex{k}/a.ex', 'defmodule App.Router{k} do\n  use Phoenix.Router\n  alias App.Repo, as: R\n  scope "/api", App do\n    get "/u{k}", U, :index\n    scope "v1/" do\n      resources "/posts", P\n    end\n  end\n  get "/top", T, :x\n  def go(x) do\n    R.insert(x)\n  end\nend\n', (
        'node 1 ~ - 2',
        'node 6 ~::App.Router{k} ~ 2',
        'edge 2 ~ ~::App.Router{k} 2',
        'node 3 ~::App.Router{k}::go ~::App.Router{k} 2',
        'edge 1 ~::App.Router{k} ~::App.Router{k}::go 2',
        'import module Phoenix.Router - - 0',
        'import module App.Repo - R 0',
        'call ~::App.Router{k}::go attribute R insert',
        'node 5 GET /api/u{k} - 1',
        'cell 5 GET /api/u{k} GET',
        'node 5 GET /api/v1/posts - 1',
        'cell 5 GET /api/v1/posts GET',
        'node 5 POST /api/v1/posts - 1',
        'cell 5 POST /api/v1/posts POST',
        'node 5 PUT /api/v1/posts - 1',
        'cell 5 PUT /api/v1/posts PUT',
        'node 5 PATCH /api/v1/posts - 1',
        'cell 5 PATCH /api/v1/posts PATCH',
        'node 5 DELETE /api/v1/posts - 1',
        'cell 5 DELETE /api/v1/posts DELETE',
        'node 5 GET /top - 1',
        'cell 5 GET /top GET',
    )),
    ('so{k}/a.sol', 'import "./x.sol";\ncontract K{k} {\n  event Sent(uint a);\n  struct S { uint a; }\n  function go() public { help(1); }\n}\nlibrary L {}\ninterface I {}\n', (
        'node 1 ~ - 2',
        'node 2 ~::K{k} ~ 2',
        'edge 1 ~ ~::K{k} 2',
        'node 3 ~::K{k}::Sent ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::Sent 2',
        'node 8 ~::K{k}::S ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::S 2',
        'node 4 ~::K{k}::go ~::K{k} 2',
        'edge 1 ~::K{k} ~::K{k}::go 2',
        'node 6 ~::L ~ 2',
        'edge 2 ~ ~::L 2',
        'node 7 ~::I ~ 2',
        'edge 1 ~ ~::I 2',
        'import module ./x.sol - - 0',
        'call ~::K{k}::go bare - help',
    )),
    ('tf{k}/a.tf', 'resource "aws_x" "r{k}" {\n}\ndata "aws_y" "d" {\n}\nmodule "m" {\n  source = "./mod"\n}\nvariable "v" {\n}\noutput "o" {\n}\n', (
        'node 1 ~ - 2',
        'node 8 ~::r{k} ~ 2',
        'edge 1 ~ ~::r{k} 2',
        'node 8 ~::d ~ 2',
        'edge 1 ~ ~::d 2',
        'node 6 ~::m ~ 2',
        'edge 2 ~ ~::m 2',
        'node 3 ~::v ~ 2',
        'edge 1 ~ ~::v 2',
        'node 3 ~::o ~ 2',
        'edge 1 ~ ~::o 2',
        'import module ./mod - - 0',
    )),
    ('vue{k}/A.vue', "<template><b/></template>\n<script>\nimport { x } from './x'\nfunction go{k}() { x() }\n</script>\n", (
        'node 1 ~ - 2',
        'node 3 ~::go{k} ~ 2',
        'edge 1 ~ ~::go{k} 2',
        'import symbol ./x x - 0',
        'call ~::go{k} bare - x',
    )),
]
