"""Column functions on paths, qualified names and literals (all in the engine)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from structgraph.registries import NONCRITICAL


def _segments(path: Column) -> Column:
    return F.filter(F.split(F.trim(path), "/"), lambda s: s != "")


def normalise_http_path(path: Column) -> Column:
    """``/a/:id//{x}/`` and ``/a/${y}/z`` to ``/a/{}/{}`` and ``/a/{}/z``; an empty path is ``/``."""
    free = lambda s: s.startswith(":") | (s.startswith("{") & s.endswith("}")) | s.contains("${")
    return F.concat(F.lit("/"), F.array_join(F.transform(_segments(path), lambda s: F.when(free(s), F.lit("{}")).otherwise(s)), "/"))


def module_qname(path: Column) -> Column:
    """A path without its last extension, ``::`` between parts."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./\\]*$", ""), r"[/\\]", "::")


def extension(path: Column) -> Column:
    return F.regexp_extract(path, r"\.([^./\\]+)$", 1)


def noncritical(qname: Column) -> Column:
    return F.arrays_overlap(F.split(F.lower(qname), "::"), F.array(*map(F.lit, NONCRITICAL))) & ~qname.startswith("route:")


def is_test(qname: Column) -> Column:
    low = F.lower(qname)
    return low.rlike(r"::(tests|test|__tests__|spec)::|^(tests|test|spec)::") | F.element_at(F.split(low, "::"), -1).rlike(r"^test_|_test$|_spec$|\.test$|\.spec$")


def strip_test_affix(name: Column) -> Column:
    """One affix off, the prefix first."""
    return F.when(name.rlike("^test_"), F.regexp_replace(name, "^test_", "")).otherwise(F.regexp_replace(name, r"(_test|_spec|\.test|\.spec)$", ""))


def common_prefix(a: Column, b: Column) -> Column:
    """How many leading elements of two arrays are equal."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first = F.array_position(same, False)
    return F.when(first == 0, F.size(same)).otherwise(first - 1).cast("int")


def parents(qname: Column) -> Column:
    parts = F.split(qname, "::")
    return F.slice(parts, 1, F.size(parts) - 1)


def relative_module(base: Column, path: Column, level: Column) -> Column:
    """The module that a relative import means: ``level`` parts off the importer's name, then the path."""
    parts = F.split(base, "::")
    kept = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - level, F.lit(0)))
    return F.array_join(F.concat(kept, F.when(path == "", F.array().cast("array<string>")).otherwise(F.split(path, r"\."))), "::")


def bracket_params(path: Column) -> Column:
    return F.regexp_replace(path, r"\[(?:\.{2,3})?([^\]]*)\]", ":$1")


def socket_path(url: Column) -> Column:
    """The path after ``ws(s)://host``; a url without one as it is."""
    rest = F.regexp_extract(url, r"^wss?://[^/]*(/.*)$", 1)
    return F.when(rest != "", rest).otherwise(url)


def leading_literal(rest: Column, longest: int) -> Column:
    """The string literal that a text starts with, blanks aside (null: none, empty or too long)."""
    found = F.regexp_extract(rest, r"""^\s*(?:"([^"]*)"|'([^']*)')""", 1)
    found = F.concat(found, F.regexp_extract(rest, r"""^\s*(?:"([^"]*)"|'([^']*)')""", 2))
    return F.when((found != "") & (F.octet_length(found) <= longest), found)


def literal_after(source: Column, pattern: Column, longest: int) -> Column:
    """The string literal right after the first occurrence of ``pattern``."""
    at = F.instr(source, pattern)
    return F.when(at > 0, leading_literal(F.substr(source, at + F.length(pattern), F.length(source)), longest))


def endpoint_method(qname: Column) -> Column:
    return F.upper(F.regexp_extract(qname, "^endpoint:([^:]*):", 1))


def endpoint_path(qname: Column) -> Column:
    return F.regexp_extract(qname, "^endpoint:[^:]*:(.*)$", 1)


def preview(text: Column, longest: int = 120) -> Column:
    """The first line, ``…`` behind it where more lines or characters follow."""
    line = F.regexp_replace(F.substring_index(text, "\n", 1), r"\r$", "")
    more = text.contains("\n") | (F.length(line) > longest)
    return F.concat(F.substr(line, F.lit(1), F.lit(longest)), F.when(more, F.lit("…")).otherwise(F.lit("")))


def compact_position(json: Column) -> Column:
    """``file:a-b`` of a position (``file:a`` where it ends on its first line); what is missing is empty or 0."""
    f, a, b = (F.get_json_object(json, f"$.{x}") for x in ("file", "start_line", "end_line"))
    a, b = (F.coalesce(x.try_cast("long"), F.lit(0)) for x in (a, b))
    return F.concat(F.coalesce(f, F.lit("")), F.lit(":"), a.cast("string"), F.when(b > a, F.concat(F.lit("-"), b.cast("string"))).otherwise(F.lit("")))


# What marks a file as one of a framework.
REACT_MARKS = ("from 'react'", 'from "react"', "from 'react-", "require('react')", "useState", "useEffect", "</>")
ANGULAR_ENDS = (".component.ts", ".service.ts", ".module.ts", ".guard.ts", ".pipe.ts", ".directive.ts")
ANGULAR_MARKS = ("@Component", "@Injectable", "@NgModule")


def _any(tests: list[Column]) -> Column:
    return F.array_contains(F.array(*tests), True)


def is_react(source: Column) -> Column:
    return _any([source.contains(m) for m in REACT_MARKS])


def is_angular(path: Column, source: Column) -> Column:
    return _any([path.endswith(e) for e in ANGULAR_ENDS] + [source.contains(m) for m in ANGULAR_MARKS])


def line_count(source: Column) -> Column:
    """Lines of a text; a line end at the end begins none."""
    return F.when(source == "", 0).otherwise(F.size(F.split(F.regexp_replace(source, r"\n$", ""), "\n")))
