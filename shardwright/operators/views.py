"""Table views as their file defines them: names, filters and columns are read from the file's text and become DataFrame
expressions. What the reader doesn't know is an error, not a view that shows too much."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ViewError(ValueError):
    """The file says something that has no meaning here."""


#: Filters by their type: what they say of a property and a value. Missing properties count as empty.
FILTERS = {
    "is": lambda c, v: c == v,
    "isNot": lambda c, v: c != v,
    "contains": lambda c, v: F.contains(c, F.lit(v)),
    "startsWith": lambda c, v: c.startswith(v),
    "isEmpty": lambda c, _: c == "",
    "isNotEmpty": lambda c, _: c != "",
}
#: Properties of the file itself, and the columns that hold them.
FILE_PROPERTIES = {"file.name": "stem", "file.path": "rel", "file.folder": "collection"}


@dataclass
class View:
    name: str
    filters: list[tuple[str, str, str]] = field(default_factory=list)
    columns: list[str] = field(default_factory=list)
    sort: list[tuple[str, bool]] = field(default_factory=list)


def _scalar(text: str) -> str:
    text = text.strip()
    if len(text) > 1 and text[0] == text[-1] and text[0] in "\"'":
        return text[1:-1]
    return re.sub(r"\s+#.*$", "", text)


def _tree(lines: list[tuple[int, str]], at: int, depth: int):
    """Nested maps and lists by indentation: (value, place of the next line). Values are strings."""
    if lines[at][1].startswith("- "):
        out: list = []
        while at < len(lines) and lines[at][0] == depth and lines[at][1].startswith("- "):
            rest = lines[at][1][2:]
            if re.match(r"[\w.]+:(\s|$)", rest):
                lines[at] = (depth + 2, rest)
                value, at = _tree(lines, at, depth + 2)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
        return out, at
    found: dict = {}
    while at < len(lines) and lines[at][0] == depth and not lines[at][1].startswith("- "):
        m = re.match(r"([\w.]+):(?:\s+(.*))?$", lines[at][1])
        if not m:
            raise ViewError(f"not a key: {lines[at][1]}")
        key, rest = m[1], (m[2] or "").strip()
        if key in found:
            raise ViewError(f"twice: {key}")
        at += 1
        if rest and not rest.startswith("#"):
            found[key] = [] if rest == "[]" else _scalar(rest)
        elif at < len(lines) and (lines[at][0] > depth or lines[at][0] == depth and lines[at][1].startswith("- ")):
            found[key], at = _tree(lines, at, lines[at][0])
        else:
            found[key] = ""
    return found, at


def parse_views(text: str) -> list[View]:
    """The views of a file, in order."""
    lines = [(len(x) - len(x.lstrip(" ")), x.strip()) for x in text.splitlines() if x.strip() and not x.strip().startswith("#")]
    if not lines:
        return []
    tree, end = _tree(lines, 0, lines[0][0])
    if end != len(lines):
        raise ViewError(f"not at this depth: {lines[end][1]}")
    if not isinstance(tree, dict) or set(tree) - {"views"}:
        raise ViewError("a file has views, nothing else")
    return [_view(v) for v in tree["views"] or []]


def _view(v: dict) -> View:
    if unknown := set(v) - {"type", "name", "filter", "order", "sort", "columns"}:
        raise ViewError(f"unknown in a view: {', '.join(sorted(unknown))}")
    if v.get("type") != "table":
        raise ViewError(f"no such kind of view: {v.get('type')}")
    filters = []
    for f in v.get("filter") or []:
        if f.get("type") not in FILTERS or f.get("valueType", "text") != "text" or set(f) - {"type", "property", "valueType", "value"}:
            raise ViewError(f"no such filter: {f}")
        filters.append((f["type"], f["property"], f.get("value", "")))
    sort = [(s["property"], s.get("direction", "ASC").upper() == "DESC") for s in v.get("sort") or []]
    columns = [c["property"] if isinstance(c, dict) else c for c in v.get("columns") or v.get("order") or []]
    return View(v.get("name", ""), filters, columns, sort)


def _property(records: DataFrame, name: str) -> Column:
    name = FILE_PROPERTIES.get(name, name)
    if name not in records.columns:
        raise ViewError(f"no such property: {name}")
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def compiled(view: View, records: DataFrame) -> DataFrame:
    """The records that a view shows: filters all hold, columns in its order, sorted if it says so."""
    out = records
    for kind, name, value in view.filters:
        out = out.where(FILTERS[kind](_property(records, name), value))
    if view.sort:
        out = out.orderBy(*(F.desc(FILE_PROPERTIES.get(n, n)) if down else F.asc(FILE_PROPERTIES.get(n, n)) for n, down in view.sort))
    return out.select(*(_property(records, c).alias(c.removeprefix("file.")) for c in view.columns))
