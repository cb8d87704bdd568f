"""The fact stream of a file: rows of one schema with a tag."""

from __future__ import annotations

import json
from typing import Any

from structgraph.registries import KIND

SCHEMA = (
    "tag string, path string, module string, ord long, kind int, name string, qname string, parent string, confidence int, "
    "src string, dst string, category int, form string, alias string, level int, q_form string, base string, cell_type int, text string"
)
COLUMNS = [c.split()[0] for c in SCHEMA.split(", ")]


class Facts:
    """Collects rows; tags are node, edge, import, call, ref and cell (entities are named by qname)."""

    def __init__(self, path: str, module: str, source: str) -> None:
        self.path, self.module, self.rows = path, module, []
        last = source.count("\n") + 1
        self.entity("module", module.rsplit("::", 1)[-1], module, None, 1, last)
        self.add("cell", qname=module, cell_type=1, text=source)

    def add(self, tag: str, **row: Any) -> None:
        self.rows.append({"tag": tag, "path": self.path, "ord": len(self.rows), **{"module": self.module}, **row} if tag != "import" else {"tag": tag, "path": self.path, "ord": len(self.rows), "src": self.module, **row})

    def entity(self, kind: str, name: str, qname: str, parent: str | None, first: int, last: int | None, confidence: int = 2, category: int = 1) -> None:
        self.add("node", kind=KIND[kind], name=name, qname=qname, parent=parent, confidence=confidence)
        self.add("cell", qname=qname, cell_type=3, text=json.dumps({"file": self.path, "start_line": first, "end_line": last or first}))
        if parent:
            self.add("edge", src=parent, dst=qname, category=category, confidence=2)

    def doc(self, qname: str, text: str | None) -> None:
        if text:
            self.add("cell", qname=qname, cell_type=2, text=text)

    def call(self, src: str, form: str, base: str | None, name: str) -> None:
        self.add("call", src=src, q_form=form, base=base, name=name)

    def route(self, method: str, path: str, handler: str | None, confidence: int, line: int, by_path: bool = False) -> None:
        """A node per verb and path with the verb as its cell, or (``by_path``) one per path with a cell of each verb."""
        if by_path:
            qname, parent = f"route:{path}", self.module
            cell = json.dumps({"method": method, "handler": handler, "file": self.path, "line": line})
        else:
            qname, parent, cell = f"{method} {path}", None, method
        self.add("node", kind=KIND["route"], name=path if by_path else qname, qname=qname, parent=parent, confidence=confidence)
        self.add("cell", qname=qname, cell_type=5, text=cell)
        if handler:
            self.add("edge", src=qname, dst=handler, category=9, confidence=confidence)

    def endpoint(self, method: str, path: str, caller: str, confidence: int, line: int) -> None:
        qname = f"endpoint:{method}:{path}"
        self.add("node", kind=KIND["endpoint"], name=f"{method} {path}", qname=qname, parent=self.module, confidence=confidence)
        self.add("cell", qname=qname, cell_type=6, text=json.dumps({"method": method, "path": path, "file": self.path, "line": line, "confidence": confidence}))
        self.add("edge", src=caller, dst=qname, category=4, confidence=confidence)
