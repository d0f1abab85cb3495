"""Small functions on references, paths and source text, as columns where rows pass through them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The types that hold a schema inside a graph, and the labels that rules know their changes by.
META_TYPES = ["meta/EntityType", "meta/EdgeType", "meta/Struct", "meta/TaxonomyTerm", "meta/ValidationRule", "meta/Policy"]
DEFINING = ["meta/EntityType", "meta/EdgeType", "meta/Struct"]
BASE_TYPES = ["string", "int", "float", "decimal", "bool", "timestamp", "date", "duration", "bytes", "node-ref", "edge-ref", "document-ref", "external-ref", "selector"]
LANGUAGES = {
    "rs": "rust",
    "ts": "typescript",
    "tsx": "typescript",
    "js": "javascript",
    "jsx": "javascript",
    "py": "python",
    "toml": "toml",
    "yaml": "yaml",
    "yml": "yaml",
    "md": "markdown",
    "sh": "shell",
    "json": "json",
}


def bare(ref: str) -> str:
    return ref.split("@", 1)[0]


def bare_col(ref: Column) -> Column:
    return F.substring_index(ref, "@", 1)


def is_meta_col(type_ref: Column) -> Column:
    return F.coalesce(bare_col(type_ref).isin(META_TYPES), F.lit(False))


def sugar_verbs_col(kind: Column, type_ref: Column, attributes: Column) -> Column:
    """Labels of an operation on a schema node: define-type, set-policy or deprecate-term."""
    t = bare_col(type_ref)
    label = F.when(t.isin(DEFINING), "define-type").when(t == "meta/Policy", "set-policy")
    label = label.when((t == "meta/TaxonomyTerm") & (F.get_json_object(attributes, "$.status") == "deprecated"), "deprecate-term")
    return F.when((kind == "node") & label.isNotNull(), F.array(label)).otherwise(F.array().cast("array<string>"))


def glob_regex(pattern: str) -> str:
    """A glob in which a star stands for any run of characters, slashes too, and all else for itself."""
    return "(?s)^" + ".*".join(re.escape(p) for p in re.split(r"\*+", pattern)) + r"\z"


def glob_col(text: Column, pattern: str) -> Column:
    return F.coalesce(text.rlike(glob_regex(pattern)), F.lit(False))


def glob_match(pattern: str, text: str) -> bool:
    return re.search(glob_regex(pattern).replace(r"\z", r"\Z"), text) is not None


def language_col(path: Column) -> Column:
    """Language by what follows a path's last dot (the whole path without one); null for others."""
    table = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return F.try_element_at(table, F.substring_index(path, ".", -1))


def kind_col(ref: Column) -> Column:
    return F.when(F.instr(ref, ":") > 0, F.substring_index(ref, ":", 1))


def id_col(ref: Column) -> Column:
    return F.when(F.instr(ref, ":") > 0, F.expr("substring(%s, instr(%s, ':') + 1)" % ((ref._jc.toString(),) * 2)))


def short_col(hash_: Column) -> Column:
    return F.substring(F.regexp_replace(hash_, "^sha256:", ""), 1, 12)


def folder_name(graph_id: str) -> str:
    return re.sub(r"[^A-Za-z0-9._-]", "-", graph_id)


def type_expr_errors(expr: str, structs: set[str] = frozenset()) -> list[str]:
    """Everything wrong with an attribute type: base types, structs, enum<a|b>, list<T>, map<string,T>."""
    expr = expr.strip()
    if expr in BASE_TYPES or expr in structs:
        return []
    m = re.fullmatch(r"(enum|list|map)<(.*)>", expr, re.S)
    if not m:
        return [f"unknown attribute type {expr!r}"]
    kind, inner = m.groups()
    if kind == "list":
        return type_expr_errors(inner, structs)
    if kind == "enum":
        symbols = [s.strip() for s in inner.split("|")]
        few = [f"enum needs at least two symbols: {expr}"] if len(symbols) < 2 else []
        return few + [f"enum symbol {s!r} must be nonempty [A-Za-z0-9._-]" for s in symbols if not re.fullmatch(r"[A-Za-z0-9._-]+", s)]
    depth = 0
    for i, c in enumerate(inner):
        depth = max(0, depth + (c == "<") - (c == ">"))
        if c == "," and not depth:
            key = inner[:i].strip()
            return ([f"map keys must be string, got {key}"] if key != "string" else []) + type_expr_errors(inner[i + 1 :], structs)
    return [f"map type needs key and value: {expr}"]


# How items of source files begin, and how far they may be indented.
ITEM = re.compile(r"(?:(?:pub |pub\(crate\) )?(fn)|(?:pub )?(struct|enum|trait)) (\w+)")
INDENT = 4
_MARK = re.compile("[{};]")


def items(text: str) -> list[tuple[str, str, int, int, str]]:
    """(kind, name, first line, last line, body) of each item; lines from 1; the body is what follows the first line.

    An item ends on the line where its braces close, or at a semicolon before
    any brace; one that never ends goes on to the last line.
    """
    lines = [x.removesuffix("\r") for x in text.split("\n")]
    if lines and not lines[-1]:
        lines.pop()
    marks = [(n, m[0]) for n, line in enumerate(lines) for m in _MARK.finditer(line)]
    first = {}
    for k, (n, _) in enumerate(marks):
        first.setdefault(n, k)
    out, at = [], len(marks)
    for n in range(len(lines) - 1, -1, -1):
        at = first.get(n, at)
        bare_line = lines[n].lstrip()
        m = ITEM.match(bare_line)
        if m and len(lines[n]) - len(bare_line) <= INDENT:
            end = _end(marks, at, len(lines) - 1)
            out.append((m[1] or m[2], m[3], n + 1, end + 1, "\n".join(lines[n + 1 : end + 1])))
    return out[::-1]


def _end(marks: list[tuple[int, str]], at: int, last: int) -> int:
    depth, opened, closed = 0, False, None
    for n, c in marks[at:]:
        if closed is not None and n != closed:
            return closed
        if c == ";":
            if not opened and not depth:
                return n
            continue
        depth += 1 if c == "{" else -1
        opened = opened or c == "{"
        closed = n if opened and depth <= 0 else None
    return last if closed is None else closed
