"""Facts of Python files from the syntax tree; broken files fall back to a line scan."""

from __future__ import annotations

import ast
import re

from structgraph.parse.facts import Facts

_VERBS = ("get", "post", "put", "patch", "delete", "head", "options")


def parse(path: str, source: str, module: str) -> Facts:
    out = Facts(path, module, source)
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError):
        return _scan(out, source)
    out.doc(module, ast.get_docstring(tree))
    _body(out, tree.body, module, None, source)
    return out


def _text(node: ast.AST) -> str | None:
    return node.value if isinstance(node, ast.Constant) and isinstance(node.value, str) else None


def _body(out: Facts, body: list[ast.stmt], owner: str, inside: str | None, source: str) -> None:
    """``inside`` is the kind of the owner that isn't a module."""
    for node in body:
        if isinstance(node, ast.ClassDef):
            out.entity("class", node.name, f"{owner}::{node.name}", owner, node.lineno, node.end_lineno)
            out.doc(f"{owner}::{node.name}", ast.get_docstring(node))
            _body(out, node.body, f"{owner}::{node.name}", "class", source)
        elif isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef)):
            name = f"{owner}::{node.name}"
            out.entity("method" if inside == "class" else "function", node.name, name, owner, node.lineno, node.end_lineno)
            out.doc(name, ast.get_docstring(node))
            _decorators(out, node, name)
            for inner in node.body:
                _calls(out, inner, name)
            _body(out, [x for x in _nested(node) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef))], name, "function", source)
        elif isinstance(node, ast.Import):
            for a in node.names:
                out.add("import", form="module", module=a.name, alias=a.asname, level=0)
        elif isinstance(node, ast.ImportFrom):
            for a in node.names:
                out.add("import", form="symbol", module=node.module or "", name=a.name, alias=a.asname, level=node.level)
        else:
            _calls(out, node, owner)
            _body(out, [x for x in ast.iter_child_nodes(node) if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef, ast.Import, ast.ImportFrom))], owner, inside, source)


def _nested(node: ast.AST) -> list[ast.AST]:
    found: list[ast.AST] = []
    for x in ast.iter_child_nodes(node):
        if isinstance(x, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            found.append(x)
        else:
            found += _nested(x)
    return found


def _calls(out: Facts, node: ast.AST, owner: str) -> None:
    if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
        return
    if isinstance(node, ast.Call):
        f = node.func
        if isinstance(f, ast.Name):
            out.call(owner, "bare", None, f.id)
            if f.id in ("path", "re_path", "url") and node.args and (route := _text(node.args[0])) is not None:
                out.route("ANY", route, None, 1, node.lineno)
        elif isinstance(f, ast.Attribute) and isinstance(f.value, ast.Name):
            out.call(owner, *(("self", None) if f.value.id in ("self", "cls") else ("attribute", f.value.id)), f.attr)
        elif isinstance(f, ast.Attribute):
            out.call(owner, "complex", ast.unparse(f.value)[:120], f.attr)
    for x in ast.iter_child_nodes(node):
        _calls(out, x, owner)


def _decorators(out: Facts, node: ast.FunctionDef | ast.AsyncFunctionDef, name: str) -> None:
    for d in node.decorator_list:
        if not (isinstance(d, ast.Call) and isinstance(d.func, ast.Attribute) and d.args and (route := _text(d.args[0])) is not None):
            continue
        if d.func.attr in _VERBS:
            out.route(d.func.attr.upper(), route, name, 2, d.lineno)
        elif d.func.attr == "route":
            given = next((k.value for k in d.keywords if k.arg == "methods"), None)
            verbs = [t for e in getattr(given, "elts", []) if (t := _text(e))] or ["GET"]
            for v in verbs:
                out.route(v.upper(), route, name, 2, d.lineno)


def _scan(out: Facts, source: str) -> Facts:
    """What a line scan by indentation finds."""
    stack: list[tuple[int, str, str]] = [(-1, out.module, "module")]
    for i, line in enumerate(source.split("\n"), 1):
        if m := re.match(r"(\s*)(?:async\s+)?(class|def)\s+(\w+)", line):
            depth = len(m[1].expandtabs(8))
            while stack[-1][0] >= depth:
                stack.pop()
            _, owner, kind = stack[-1]
            own = "class" if m[2] == "class" else "method" if kind == "class" else "function"
            out.entity(own, m[3], f"{owner}::{m[3]}", owner, i, i)
            stack.append((depth, f"{owner}::{m[3]}", own))
        elif m := re.match(r"\s*import\s+([\w.]+)(?:\s+as\s+(\w+))?", line):
            out.add("import", form="module", module=m[1], alias=m[2], level=0)
        elif m := re.match(r"\s*from\s+(\.*)([\w.]*)\s+import\s+(\w+)(?:\s+as\s+(\w+))?", line):
            out.add("import", form="symbol", module=m[2], name=m[3], alias=m[4], level=len(m[1]))
    return out
