"""Facts of other languages from rules: declarations by pattern, nesting by brackets, indentation or ``end``.

A recognised subset, partial on broken files.  A language is a row of rules:
how comments look, which patterns declare which kinds, how imports, calls and
routes look.  Scopes are found on text whose strings and comments are blank.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass, field

from structgraph.parse.facts import Facts

_NOT_CALLS = frozenset("if for while switch catch return function new await typeof sizeof match fn func def class when unless elif else do with and or not in is super this self defmodule defp end async import".split())


@dataclass
class Language:
    #: (kind, pattern with the name in group "n"); methods are functions inside a type.
    declares: tuple[tuple[str, str], ...]
    #: (form, pattern with groups m, and n or a where there are such)
    imports: tuple[tuple[str, str], ...] = ()
    #: (pattern with groups v and p, confidence, handler); v may be missing (ANY); the handler is
    #: the declaration that follows ("next"), the one around it ("inside"), the "module", or missing
    routes: tuple[tuple, ...] = ()
    comment: str = r"//[^\n]*|/\*[\s\S]*?\*/"
    own: tuple[str, ...] = ("this", "self")
    nesting: str = "braces"
    calls: bool = True
    #: how calls look: name and bracket, the same behind a base only, or the head of a list
    call_form: str = "bracket"
    separator: str = "."
    only_routes_in: str = ""
    verbs: dict[str, str] = field(default_factory=dict)


_C_CLASS = (("class", r"\b(?:class|record)\s+(?P<n>[A-Z_]\w*)"), ("interface", r"\binterface\s+(?P<n>\w+)"), ("enum", r"\benum\s+(?:class\s+)?(?P<n>\w+)"))
_TYPED_FN = r"(?m)^[ \t]*(?:(?:public|private|protected|internal|static|final|abstract|override|virtual|async|inline|const|constexpr|open|suspend|sealed|synchronized)\s+)*(?!return\b|new\b|else\b|throw\b|fun\b)[\w<>\[\],.?:*&]+(?:[ \t]*[*&]+[ \t]*|[ \t]+)(?P<n>\w+)\s*\([^;{}()]*(?:\([^()]*\)[^;{}()]*)*\)\s*(?:const\s*|noexcept\s*|override\s*|throws\s+[\w., ]+)*\{"
_MAP = r"""(?m)\.(?P<v>get|post|put|patch|delete|head|options)\(\s*["'](?P<p>/[^"']*)["']"""
LANGUAGES: dict[str, Language] = {
    "go": Language(
        declares=(("struct", r"\btype\s+(?P<n>\w+)\s+struct\b"), ("interface", r"\btype\s+(?P<n>\w+)\s+interface\b"), ("function", r"(?m)^func\s+(?P<n>\w+)\s*[\[(]"), ("receiver", r"(?m)^func\s*\(\s*(?P<r>\w*)\s*\*?(?P<t>\w+)(?:\[[^\]]*\])?\s*\)\s*(?P<n>\w+)\s*\(")),
        imports=(("module", r"""(?m)^\s*(?:import\s+)?(?:(?P<a>\w+)\s+)?"(?P<m>[\w./-]+)"\s*$"""),), separator="/",
    ),
    "typescript": Language(
        declares=(("class", r"\bclass\s+(?P<n>\w+)"), ("interface", r"\binterface\s+(?P<n>\w+)"), ("function", r"\bfunction\s*\*?\s*(?P<n>\w+)\s*[<(]"), ("function", r"\b(?:const|let|var)\s+(?P<n>\w+)\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=\n{]+)?=>|\w+\s*=>)"), ("member", r"(?m)^[ \t]+(?:(?:public|private|protected|static|async|readonly|override|get|set)\s+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b|constructor\b(?!\())(?P<n>\w+)\s*(?:<[^>]*>)?\([^(){};]*\)\s*(?::[^{;\n]+)?\{")),
        imports=(("module", r"""\bimport\s+\*\s+as\s+(?P<a>\w+)\s+from\s+["'](?P<m>[^"']+)["']"""), ("default", r"""\bimport\s+(?P<a>\w+)\s*(?:,\s*\{[^}]*\})?\s*from\s+["'](?P<m>[^"']+)["']"""), ("list", r"""\bimport\s+(?:type\s+)?(?:\w+\s*,\s*)?\{(?P<l>[^}]*)\}\s*from\s+["'](?P<m>[^"']+)["']"""), ("module", r"""(?m)^\s*import\s+["'](?P<m>[^"']+)["']""")),
        separator="/",
    ),
    "java": Language(
        declares=(*_C_CLASS, ("function", r"\bfun\s+(?:<[^>]*>\s*)?(?:\w+\.)?(?P<n>\w+)\s*\("), ("function", _TYPED_FN)),
        imports=(("module", r"(?m)^\s*import\s+(?:static\s+)?(?P<m>[\w.]+)\.\*"), ("symbol", r"(?m)^\s*import\s+(?:static\s+)?(?P<m>[\w.]+)\.(?P<n>\w+)(?:\s+as\s+(?P<a>\w+))?\s*;?\s*$")),
        routes=((r"""@(?P<v>Get|Post|Put|Patch|Delete|Head|Options|Request)(?:Mapping)?\(\s*(?:(?:value|path)\s*=\s*)?\{?\s*"(?P<p>[^"]*)\"""", 2, "next"), (r"""@(?P<v>Controller|Path)\(\s*(?:value\s*=\s*)?"(?P<p>[^"]*)\"""", 2, "next"), (r"""\b(?P<v>get|post|put|patch|delete|head|options)\(\s*"(?P<p>/[^"]*)"\s*\)\s*\{""", 1), (r"""\.(?P<v>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS)\(\s*"(?P<p>[^"]*)\"""", 1)),
    ),
    "csharp": Language(
        declares=(("package", r"\bnamespace\s+(?P<n>[\w.]+)"), ("struct", r"\bstruct\s+(?P<n>\w+)"), *_C_CLASS, ("function", _TYPED_FN)),
        imports=(("symbol", r"(?m)^\s*using\s+(?P<m>[\w.]+)\.(?P<n>\w+)\s*;"),),
        routes=((r"""\[Http(?P<v>Get|Post|Put|Patch|Delete|Head|Options)\b(?:\(\s*"(?P<p>[^"]*)")?""", 2, "next"), (r"""\[Route\(\s*"(?P<p>[^"]*)\"""", 2, "next"), (r"""\.Map(?P<v>Get|Post|Put|Patch|Delete|Head|Options)\(\s*"(?P<p>[^"]*)\"""", 1, "inside")),
    ),
    "php": Language(
        declares=(("package", r"\bnamespace\s+(?P<n>[\w\\]+)"), *_C_CLASS, ("function", r"\bfunction\s+&?(?P<n>\w+)\s*\(")),
        imports=(("symbol", r"(?m)^\s*use\s+\\?(?P<m>[\w\\]+)\\(?P<n>\w+)(?:\s+as\s+(?P<a>\w+))?\s*;"),),
        routes=((r"""#\[(?P<v>Route)\(\s*(?:path:\s*)?['"](?P<p>[^'"]*)['"]""", 2, "next"), (r"""\bRoute::(?P<v>get|post|put|patch|delete|options|any)\(\s*['"](?P<p>[^'"]*)['"]""", 1), (r"""\bRoute::(?P<v>resource|apiResource)\(\s*['"](?P<p>[^'"]*)['"]""", 1)),
        comment=r"//[^\n]*|/\*[\s\S]*?\*/|#(?!\[)[^\n]*", own=("$this", "self", "static"), separator="\\",
    ),
    "rust": Language(
        declares=(("struct", r"\bstruct\s+(?P<n>\w+)"), ("enum", r"\benum\s+(?P<n>\w+)"), ("interface", r"\btrait\s+(?P<n>\w+)"), ("impl", r"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>, ]+\s+for\s+)?(?P<n>\w+)"), ("function", r"\bfn\s+(?P<n>\w+)")),
        imports=(("symbol", r"(?m)^\s*(?:pub\s+)?use\s+(?P<m>(?:crate|super)(?:::\w+)*)::(?P<n>\w+)(?:\s+as\s+(?P<a>\w+))?\s*;"), ("list", r"(?m)^\s*(?:pub\s+)?use\s+(?P<m>(?:crate|super)(?:::\w+)*)::\{(?P<l>[^}]*)\}")),
        routes=((r"""#\[(?P<v>get|post|put|patch|delete|head|options)\(\s*"(?P<p>[^"]*)\"""", 2, "module"), (r"""\.(?P<v>route)\(\s*"(?P<p>[^"]*)\"""", 1)), separator="::",
    ),
    "ruby": Language(
        declares=(("class", r"(?m)^\s*class\s+(?P<n>[A-Z]\w*)"), ("package", r"(?m)^\s*module\s+(?P<n>[A-Z]\w*)"), ("function", r"(?m)^\s*def\s+(?:self\.)?(?P<n>\w+[?!=]?)")),
        imports=(("module", r"""(?m)^\s*require(?:_relative)?\s+['"](?P<m>[^'"]+)['"]"""),),
        routes=((r"""(?m)^\s*(?P<v>get|post|put|patch|delete|match)(?:\s+|\s*\(\s*)['"](?P<p>[^'"]+)['"]""", 2), (r"""(?m)^\s*(?P<v>resources?)(?:\s+|\s*\(\s*):(?P<p>\w+)""", 1), (r"""(?m)^\s*(?P<v>root)\b(?=\s*[('":\w])(?!\s*=)""", 2)),
        comment=r"#[^\n]*", own=("self",), nesting="end", separator="/", only_routes_in="routes.rb",
    ),
    "swift": Language(
        declares=(("class", r"\b(?:class|actor)\s+(?!func\b)(?P<n>[A-Z]\w*)"), ("struct", r"\bstruct\s+(?P<n>\w+)"), ("enum", r"\benum\s+(?P<n>\w+)"), ("interface", r"\bprotocol\s+(?P<n>\w+)"), ("function", r"\bfunc\s+(?P<n>\w+)")),
        imports=(("module", r"(?m)^\s*import\s+(?P<m>\w+)"),), routes=((r"""\.(?P<v>get|post|put|patch|delete)\((?P<p>(?:\s*"[^"]*"\s*,?)+)""", 1),),
    ),
    "c_cpp": Language(
        declares=(("package", r"\bnamespace\s+(?P<n>\w+)"), ("class", r"(?<!enum )\b(?:class|struct)\s+(?P<n>\w+)\s*(?:final\s*)?(?::[^{;]*)?\{"), ("enum", r"\benum\s+(?:class\s+)?(?P<n>\w+)"), ("function", _TYPED_FN)),
        imports=(("module", r"""(?m)^\s*#\s*include\s+"(?P<m>[^"]+)\""""),), separator="/",
    ),
    "scala": Language(
        declares=(("class", r"\b(?:class|object)\s+(?P<n>\w+)"), ("interface", r"\btrait\s+(?P<n>\w+)"), ("function", r"\bdef\s+(?P<n>\w+)")),
        imports=(("module", r"(?m)^\s*(?:import|package)\s+(?P<m>[\w.]+)"),), routes=((r"""\bpath\(\s*"(?P<p>[^"]*)\"""", 1), (r"""\b(?P<v>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS) -> Root(?P<s>(?:\s*/\s*(?:"[^"]*"|(?:Int|Long|UUID|IntPath|LongPath)Var\b(?:\s*\([^)]*\))?|[A-Za-z_]\w*))*)""", 1)),
    ),
    "clojure": Language(
        declares=(("function", r"\((?:defn-?|def|defmacro)\s+(?:\^\S+\s+)?(?P<n>[\w*+!?<>=-]+)"), ("interface", r"\(defprotocol\s+(?P<n>\w+)"), ("struct", r"\(def(?:record|type)\s+(?P<n>\w+)")),
        imports=(("module", r"\[(?P<m>[\w.-]+\.[\w.-]+)(?:\s+:as\s+(?P<a>[\w-]+))?"),), routes=((r"""\((?P<v>GET|POST|PUT|PATCH|DELETE|ANY)\s+"(?P<p>[^"]*)\"""", 1), (r"""\[\s*"(?P<p>/[^"]*)"\s*\{\s*:(?P<v>get|post|put|patch|delete)""", 1)),
        comment=r";[^\n]*", nesting="parens", call_form="list",
    ),
    "dart": Language(
        declares=(*_C_CLASS, ("function", _TYPED_FN)), imports=(("module", r"""(?m)^\s*import\s+['"](?P<m>[^'"]+)['"](?:\s+as\s+(?P<a>\w+))?"""),),
        call_form="selector", routes=((r"""\bGoRoute\(\s*path:\s*['"](?P<p>[^'"]*)['"]""", 1), (_MAP, 1)), separator="/",
    ),
    "elixir": Language(
        declares=(("package", r"\bdefmodule\s+(?P<n>[\w.]+)"), ("interface", r"\bdefprotocol\s+(?P<n>[\w.]+)"), ("function", r"(?m)^\s*defp?\s+(?P<n>\w+[?!]?)"), ("struct", r"(?m)^\s*(?P<n>defstruct)\b")),
        imports=(("module", r"(?m)^\s*(?:import|alias|use|require)\s+(?P<m>[\w.]+)(?:,\s*as:\s*(?P<a>\w+))?"),),
        comment=r"#[^\n]*", nesting="end",
    ),
    "solidity": Language(
        declares=(("class", r"\bcontract\s+(?P<n>\w+)"), ("interface", r"\binterface\s+(?P<n>\w+)"), ("package", r"\blibrary\s+(?P<n>\w+)"), ("enum", r"\benum\s+(?P<n>\w+)"), ("struct", r"\bstruct\s+(?P<n>\w+)"), ("function", r"\bfunction\s+(?P<n>\w+)"), ("event", r"\bevent\s+(?P<n>\w+)")),
        imports=(("module", r"""(?m)^\s*import\s+(?:\{[^}]*\}\s*from\s+)?["'](?P<m>[^"']+)["']"""),), separator="/",
    ),
    "terraform": Language(
        declares=(("struct", r"""(?m)^\s*(?:resource|data)\s+"(?P<t>[^"]+)"\s+"(?P<n>[^"]+)\""""), ("package", r"""(?m)^\s*module\s+"(?P<n>[^"]+)\""""), ("function", r"""(?m)^\s*(?:variable|output)\s+"(?P<n>[^"]+)\"""")),
        imports=(("module", r"""(?m)^\s*source\s*=\s*"(?P<m>[^"]+)\""""),), comment=r"#[^\n]*|//[^\n]*", calls=False, separator="/",
    ),
}
_TYPES = ("class", "struct", "interface", "enum")
_STRING = r""""(?:\\.|[^"\\\n])*"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"""
_REST = {"resource": ("GET", "POST", "PUT", "PATCH", "DELETE"), "apiResource": ("GET", "POST", "PUT", "PATCH", "DELETE")}


def _blank(text: str, pattern: str) -> str:
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def _end(code: str, at: int, nesting: str) -> int:
    """Where the scope that a declaration at ``at`` opens ends."""
    if nesting == "end":
        start = code.rfind("\n", 0, at) + 1
        lead = re.match(r"[ \t]*", code[start:])[0]
        found = re.compile(rf"(?m)^{lead}end\b").search(code, at)
        return found.end() if found else len(code)
    opener, closer = ("(", ")") if nesting == "parens" else ("{", "}")
    i = at if nesting == "parens" else code.find(opener, at)
    stop = code.find(";", at)
    if i < 0 or (nesting == "braces" and 0 <= stop < i):
        return stop if stop >= 0 else len(code)
    depth = 0
    for m in re.compile(r"[()]" if nesting == "parens" else r"[{}]").finditer(code, i):
        depth += 1 if m[0] == opener else -1
        if not depth:
            return m.end()
    return len(code)


def parse(path: str, source: str, module: str, lang: str) -> Facts:
    if lang == "vue":
        found = re.search(r"<script[^>]*>([\s\S]*?)</script>", source)
        body = found[1] if found else ""
    else:
        body = source
    rules = LANGUAGES["typescript" if lang in ("react", "angular", "vue") else lang]
    out = Facts(path, module, source)
    text = _blank(body, rules.comment) if lang not in ("typescript", "react", "angular", "vue", "go") else _blank(body, rf"(?:(?<=\s)|^)//[^\n]*|/\*[\s\S]*?\*/")
    code = _blank(text, _STRING) if lang != "terraform" else text
    line = lambda at: body.count("\n", 0, at) + 1
    # declarations with the span of their scope, outer ones first
    found = []
    for kind, pattern in rules.declares:
        for m in re.finditer(pattern, code):
            if m["n"] not in _NOT_CALLS or kind in ("package", "impl"):
                found.append([m.start(), _end(code, m.start() if rules.nesting == "parens" else m.end() - (m[0].endswith("{")), rules.nesting), kind, m])
    begins = sorted(x[0] for x in found)
    for x in found:
        if rules.nesting == "braces":
            # another declaration before the brace: this one has no body
            later = bisect_right(begins, x[3].end())
            opener = code.find("{", x[3].end() - (x[3][0].endswith("{")))
            if later < len(begins) and begins[later] < opener and x[1] > begins[later]:
                x[1] = x[3].end()
    found.sort(key=lambda x: (x[0], -x[1]))
    scopes: list[tuple[int, int, str, str]] = []
    types: dict[str, str] = {}
    seen: set[tuple[str, str]] = set()
    owners: list[tuple[int, int, str, str]] = []
    places: list[tuple[int, str]] = []
    for at, end, kind, m in found:
        while scopes and scopes[-1][1] <= at:
            scopes.pop()
        _, _, parent, inside = scopes[-1] if scopes else (0, 0, module, "module")
        name = "__struct__" if m["n"] == "defstruct" else m["n"]
        qname = f"{parent}::{name}"
        if kind == "impl":
            scopes.append((at, end, types.get(name, module), "class" if name in types else "module"))
            continue
        if kind == "receiver":
            parent = types.get(m["t"], module)
            kind, qname = "method", f"{parent}::{name}"
        elif kind == "event":
            kind = "function"
        elif kind in ("function", "member"):
            if kind == "member" and inside != "class":
                continue
            kind = "method" if inside in _TYPES or (inside == "package" and lang == "solidity") else "function"
        own = "class" if kind in _TYPES else kind
        if kind in _TYPES or kind in ("function", "method"):
            places.append((m.start("n"), qname))
        if (qname, kind) not in seen:
            seen.add((qname, kind))
            out.entity(kind, name, qname, parent, line(at), line(max(at, end - 1)), category=2 if kind == "package" else 1)
        if kind in _TYPES:
            types[name] = qname
        scopes.append((at, end, qname, own))
        if kind in ("function", "method"):
            owners.append((at, end, qname, m.groupdict().get("r") or ""))
    _imports(out, rules, text)
    if rules.call_form == "list":
        _list_calls(out, code, owners)
    elif rules.calls:
        _calls(out, rules, code, module, owners, [x[3].start("n") for x in found])
    _routes(out, rules, text, code, path, lang, line, sorted(places), owners)
    if lang == "go":
        _go_routes(out, text, line)
    if lang == "elixir":
        _phoenix_routes(out, text, line)
    if lang in ("typescript", "react", "angular", "vue"):
        _endpoints(out, text, module, owners, line)
    return out


def _imports(out: Facts, rules: Language, text: str) -> None:
    for form, pattern in rules.imports:
        for m in re.finditer(pattern, text):
            g = m.groupdict()
            base = g["m"] if rules.separator == "/" else g["m"].replace(rules.separator, ".")
            if form == "list":
                for part in g["l"].split(","):
                    if p := re.fullmatch(r"\s*(?:type\s+)?(\w+)(?:\s+as\s+(\w+))?\s*", part):
                        out.add("import", form="symbol", module=base, name=p[1], alias=p[2], level=0)
            elif form == "default":
                out.add("import", form="symbol", module=base, name="default", alias=g["a"], level=0)
            elif form == "symbol":
                out.add("import", form="symbol", module=base, name=g["n"], alias=g.get("a"), level=0)
            else:
                out.add("import", form="module", module=base, alias=g.get("a"), level=0)


def _owner(owners: list[tuple[int, int, str, str]], at: int, module: str) -> tuple[str, str]:
    best = max((o for o in owners if o[0] <= at < o[1]), default=None, key=lambda o: o[0])
    return (best[2], best[3]) if best else (module, "")


#: Heads of lists that are no calls.
_FORMS = frozenset("def defn defn- defmacro let if when do fn loop cond case ns require defprotocol defrecord deftype".split())


def _list_calls(out: Facts, code: str, owners: list[tuple[int, int, str, str]]) -> None:
    """Heads of lists inside functions: ``a/b`` is an attribute, ``.m`` a method of its own."""
    for m in re.finditer(r"\(\s*(?P<n>[^\s()\[\]{}\"';`~@^#,:][^\s()\[\]{}\"';`~@^,]*)", code):
        src = _owner(owners, m.start(), "")[0]
        head = m["n"]
        if not src or head in _FORMS or head[0].isdigit():
            continue
        base, slash, name = head.partition("/")
        if slash and base and name:
            out.call(src, "attribute", base, name)
        elif head.startswith(".") and len(head) > 1:
            out.call(src, "self", None, head[1:])
        else:
            out.call(src, "bare", None, head)


def _calls(out: Facts, rules: Language, code: str, module: str, owners: list[tuple[int, int, str, str]], declared: list[int]) -> None:
    names = set(declared)
    pattern = re.compile(r"(?:(?P<b>\$?\w+|[)\]])\s*(?:\.|->|::|\?\.)\s*)?(?P<n>[A-Za-z_]\w*[?!]?)\s*\(")
    for m in pattern.finditer(code):
        if m["n"] in _NOT_CALLS or m.start("n") in names:
            continue
        src, receiver = _owner(owners, m.start(), module)
        base = m["b"]
        before = code[max(0, m.start() - 80) : m.start()].rstrip()
        if base is None:
            if before.endswith("@") or re.search(r"#\[$|^[ \t]*\[$", before.rsplit("\n", 1)[-1]):  # an annotation
                continue
            if before.endswith("."):
                out.call(src, "complex", None, m["n"])
            elif rules.call_form != "selector":
                out.call(src, "bare", None, m["n"])
        elif base in rules.own or (receiver and base == receiver):
            out.call(src, "self", None, m["n"])
        elif base in ")]" or before.endswith((".", "->")):
            out.call(src, "complex", base, m["n"])
        else:
            out.call(src, "attribute", base, m["n"])


def _flat(code: str) -> str:
    """``code`` with what is inside brackets blank."""
    opened: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in re.finditer(r"[()]", code):
        if m[0] == "(":
            opened.append(m.start())
        elif opened:
            spans.append((opened.pop(), m.end()))
    out, at = [], 0
    for a, b in sorted(spans):
        if a >= at:
            out += [code[at:a], " " * (b - a)]
            at = b
    return "".join([*out, code[at:]])


def _args_end(code: str, m: re.Match) -> int:
    """The end of the call or annotation that ``m`` begins."""
    at = m[0].find("(")
    return _end(code, m.start() + at, "parens") if at >= 0 else m.end()


def _routes(out: Facts, rules: Language, text: str, code: str, path: str, lang: str, line, places: list[tuple[int, str]], owners: list[tuple[int, int, str, str]]) -> None:
    if rules.only_routes_in and not path.endswith(rules.only_routes_in):
        return
    flat = _flat(code) if any("next" in r for r in rules.routes) else code
    for pattern, confidence, *by in rules.routes:
        for m in re.finditer(pattern, text):
            g = m.groupdict()
            verb, route = (g.get("v") or "ANY"), g.get("p") or "/"
            if lang == "swift":
                route = "/" + "/".join(p.lstrip(":") for p in re.findall(r'"([^"]*)"', route))
            elif "s" in g:
                route = "".join("/" + (p[1:-1] if p[0] == '"' else ":id" if re.match(r"(?:Int|Long|UUID|IntPath|LongPath)Var\b", p) else ":" + p) for p in re.findall(r"""/\s*("[^"]*"|\w+)""", g["s"])) or "/"
            elif lang in ("ruby", "scala") and not route.startswith("/"):
                route = "/" + route
            end, handler, many = m.end(), None, (verb.upper(),)
            if by == ["module"]:
                handler = out.module
            elif by == ["inside"]:
                handler = _owner(owners, m.start(), "")[0] or None
            elif by == ["next"]:
                end = _args_end(code, m)
                at, name = next((x for x in places if x[0] >= end), (len(code), None))
                handler = name if not re.search(r"[{};]", flat[end:at]) else None
            if lang == "php" and verb in _REST:
                many = _REST[verb]
            elif verb == "route":
                said = code[m.end() : _args_end(code, m)]
                many = tuple(v.upper() for v in ("get", "post", "put", "patch", "delete", "head", "options") if re.search(rf"(?<!\w){v}\(", said))
            elif verb == "Route":
                said = re.search(r"methods:\s*\[([^\]]*)\]", text[m.end() : end])
                many = tuple(v.upper() for v in re.findall(r"""['"](\w+)['"]""", said[1])) if said else ()
                many = many or ("ANY",)
            elif verb == "Path":
                # the verb is another annotation of the same declaration
                start = max(flat.rfind(c, 0, m.start()) for c in "{};") + 1
                said = flat[start : at if handler else end]
                many = (next((v for v in ("GET", "POST", "PUT", "DELETE") if re.search(rf"@{v}\b", said)), "ANY"),)
            elif verb == "root":
                many = ("GET",)
            elif verb in ("match", "any", "resources", "resource", "Request", "Controller"):
                many = ("ANY",)
            for v in many:
                out.route(v, route, handler, confidence, line(m.start()))


def _phoenix_routes(out: Facts, text: str, line) -> None:
    """Verbs below ``scope`` blocks, whose paths add up; every ``end`` closes a scope, if one is open."""
    scopes: list[str] = []
    seen: set[tuple[str, str]] = set()
    word = re.compile(r"""(?<![\w.:])(?:(?P<s>scope)\b(?P<r>[^\n]*?)(?= do\b)|(?P<e>end)\b|(?P<v>get|post|put|patch|delete|head|options|resources)\b[^\n"]*"(?P<p>[^"\n]*)\")""")
    for m in word.finditer(text):
        if m["s"]:
            found = re.search(r'"([^"\n]*)"', m["r"])
            scopes.append(found[1] if found else "")
        elif m["e"]:
            if scopes:
                scopes.pop()
        else:
            parts = [x if x.startswith("/") else "/" + x for x in (*(s.rstrip("/") for s in scopes if s), m["p"]) if x or x == m["p"]]
            route = "".join(parts)
            for v in ("GET", "POST", "PUT", "PATCH", "DELETE") if m["v"] == "resources" else (m["v"].upper(),):
                if (v, route) not in seen:
                    seen.add((v, route))
                    out.route(v, route, None, 1, line(m.start()))


def _joined(prefix: str, path: str) -> str:
    return "/" + "/".join(s for s in f"{prefix}/{path}".split("/") if s)


def _go_routes(out: Facts, text: str, line) -> None:
    """Groups carry their prefix; a bare or selector handler is an unresolved reference."""
    groups: dict[str, str] = {}
    both = re.compile(r"""(?P<x>\w+)\s*:?=\s*(?P<g>\w+)\.Group\(\s*"(?P<q>[^"]*)"|(?P<r>\w+)\.(?P<v>GET|POST|PUT|PATCH|DELETE|HEAD|OPTIONS|Get|Post|Put|Patch|Delete)\(\s*"(?P<p>[^"]*)"(?:\s*,\s*(?P<h>[\w.]+)\s*\))?""")
    for m in both.finditer(text):
        if m["x"]:
            groups[m["x"]] = _joined(groups.get(m["g"], ""), m["q"])
            continue
        route = _joined(groups.get(m["r"], ""), m["p"])
        out.route(m["v"].upper(), route, None, 2, line(m.start()), by_path=True)
        if m["h"]:
            base, _, name = m["h"].rpartition(".")
            out.add("ref", src=f"route:{route}", q_form="attribute" if base else "bare", base=base or None, name=name, category=9)


def _endpoints(out: Facts, text: str, module: str, owners: list[tuple[int, int, str, str]], line) -> None:
    """HTTP calls of clients: member clients always, others if imported; ``fetch`` with its method."""
    imported = set(re.findall(r"\bimport\s+(?:\*\s+as\s+)?(\w+)", text)) | {n for part in re.findall(r"\bimport\s+(?:\w+\s*,\s*)?\{([^}]*)\}", text) for n in re.findall(r"(\w+)\s*(?:,|$)", part)}
    arg = r"""(?P<a>"[^"\n]*"|'[^'\n]*'|`[^`]*`|\w+\([^()]*\)|[\w.]+)"""
    for m in re.finditer(rf"(?:(?P<t>this\.\w+)|(?P<b>\b\w+))\.(?P<v>get|post|put|patch|delete)(?:<[^()]*>)?\(\s*{arg}", text):
        if m["t"] or m["b"] in imported:
            _endpoint(out, m["v"].upper(), m["a"], _owner(owners, m.start(), module)[0], line(m.start()), 0)
    for m in re.finditer(rf"""\bfetch\(\s*{arg}(?P<o>\s*,\s*(?:\{{[^}}]*\}}|[^)]+))?""", text):
        verb = re.search(r"""method:\s*["'](\w+)["']""", m["o"] or "")
        opaque = int(bool(m["o"]) and not m["o"].lstrip(", \n\t").startswith("{"))
        _endpoint(out, verb[1].upper() if verb else "GET", m["a"], _owner(owners, m.start(), module)[0], line(m.start()), opaque)


def _endpoint(out: Facts, verb: str, arg: str, caller: str, at: int, lower: int) -> None:
    if arg[0] in "\"'":
        path, confidence = arg[1:-1], 2
    elif arg[0] == "`":
        path, confidence = arg[1:-1], 1 if "${" in arg else 2
    elif inner := re.search(r"""\(\s*["'`]([^"'`]*)""", arg):
        path, confidence = inner[1], 0
    else:
        path, confidence = "<unresolved>", 0
    out.endpoint(verb, path, caller, max(0, confidence - lower), at)
