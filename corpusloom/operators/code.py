"""Python sources as tables: imports, symbols, references, hints, spans.

One Arrow-batched pass parses each file with the standard library and emits a nested
row; the tables are projections of it. Nothing but that pass runs Python.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.paths import path_order

ARG = "struct<name:string,annotation:string>"
FIELDS = {
    "imports": "array<struct<module:string,alias:string,line:int>>",
    "from_imports": "array<struct<module:string,name:string,alias:string,line:int,level:int>>",
    "symbols": f"array<struct<name:string,kind:string,line:int,parent_class:string,args:array<{ARG}>>>",
    "bases": "array<struct<class_name:string,base:string,ord:int>>",
    "refs": "array<struct<source_symbol:string,name:string,kind:string,line:int,evidence:array<string>>>",
    "assigns": "array<struct<scope:string,name:string,target:string,line:int>>",
    "params": "array<struct<scope:string,name:string,annotation:string,line:int>>",
    "spans": "array<struct<name:string,kind:string,parent_class:string,start_line:int,end_line:int>>",
}
SCHEMA = "path string, content_hash string, " + ", ".join(f"{k} {v}" for k, v in FIELDS.items()) + ", error string"
_FUNCTION = (ast.FunctionDef, ast.AsyncFunctionDef)


def dotted(node: ast.AST | None) -> str | None:
    """a.b.c of a chain of attributes on a name."""
    names = []
    while isinstance(node, ast.Attribute):
        names.append(node.attr)
        node = node.value
    if not isinstance(node, ast.Name):
        return None
    return ".".join([node.id, *reversed(names)])


def _arguments(a: ast.arguments) -> list[ast.arg]:
    return [x for x in (*a.posonlyargs, *a.args, a.vararg, *a.kwonlyargs, a.kwarg) if x is not None]


def _signature(node) -> list[dict]:
    return [{"name": a.arg, "annotation": ast.unparse(a.annotation) if a.annotation else None} for a in _arguments(node.args)]


class _Usage:
    """References and hints, found with an explicit stack of (node, parent, scope)."""

    def __init__(self, tree: ast.AST):
        self.refs, self.assigns, self.params = set(), set(), set()
        stack = [(tree, None, "")]
        while stack:
            node, parent, scope = stack.pop()
            inner, children = self.visit(node, parent, scope)
            stack.extend((c, node, inner) for c in children)

    def visit(self, node, parent, scope):
        """Records of one node; the scope and the nodes to go on with."""
        if isinstance(node, (*_FUNCTION, ast.ClassDef)):
            inner = f"{scope}.{node.name}" if scope else node.name
            if isinstance(node, ast.ClassDef):
                for base in filter(None, map(dotted, node.bases)):
                    self.refs.add((scope or None, base, "attribute" if "." in base else "name", node.lineno, ("base_class",)))
            else:
                for a in _arguments(node.args):
                    kind = dotted(a.annotation)
                    if kind and a.arg != "self":
                        self.params.add((inner, a.arg, kind, node.lineno))
            return inner, node.body
        if isinstance(node, ast.Assign):
            value = dotted(node.value.func if isinstance(node.value, ast.Call) else node.value)
            if value is None:
                return scope, ()  # what is assigned here isn't looked into
            for t in node.targets:
                if isinstance(t, ast.Name):
                    self.assigns.add((scope or None, t.id, value, node.lineno))
                elif scope and isinstance(t, ast.Attribute) and isinstance(t.value, ast.Name) and t.value.id == "self":
                    self.assigns.add((scope, f"self.{t.attr}", value, node.lineno))
        self.use(node, parent, scope or None)
        return scope, ast.iter_child_nodes(node)

    def use(self, node, parent, scope):
        called = isinstance(parent, ast.Call) and parent.func is node
        if isinstance(node, ast.Name) and isinstance(node.ctx, ast.Load):
            if not called and not (isinstance(parent, ast.Attribute) and parent.value is node):
                self.refs.add((scope, node.id, "name", node.lineno, ()))
        elif isinstance(node, ast.Attribute) and isinstance(node.ctx, ast.Load):
            if not called and not isinstance(parent, ast.Attribute) and dotted(node):
                self.refs.add((scope, dotted(node), "attribute", node.lineno, ("ast_attribute",)))
        elif isinstance(node, ast.Call) and dotted(node.func):
            self.refs.add((scope, dotted(node.func), "call", node.lineno, ()))


def parse(source: str) -> dict:
    """All tables of one file; a file that can't be parsed has an error and no rows."""
    out = {k: [] for k in FIELDS} | {"error": None}
    try:
        tree = ast.parse(source or "")
    except (SyntaxError, ValueError, TypeError, RecursionError) as e:
        return out | {"error": f"{type(e).__name__}: {e}"}
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out["imports"] += [{"module": a.name, "alias": a.asname, "line": node.lineno} for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out["from_imports"] += [{"module": node.module or "", "name": a.name, "alias": a.asname, "line": node.lineno, "level": node.level} for a in node.names]

    def add(node, kind: str, cls: str | None = None) -> None:
        out["symbols"].append({"name": node.name, "kind": kind, "line": node.lineno, "parent_class": cls, "args": [] if kind == "class" else _signature(node)})
        start = node.lineno if kind == "class" else min([node.lineno, *(d.lineno for d in node.decorator_list)])
        out["spans"].append({"name": node.name, "kind": kind, "parent_class": cls, "start_line": start, "end_line": node.end_lineno})

    for node in tree.body:
        if isinstance(node, _FUNCTION):
            add(node, "function")
        elif isinstance(node, ast.ClassDef):
            add(node, "class")
            out["bases"] += [{"class_name": node.name, "base": ast.unparse(b), "ord": i} for i, b in enumerate(node.bases)]
            for item in node.body:
                if isinstance(item, _FUNCTION):
                    add(item, "method", node.name)
    used = _Usage(tree)
    order = lambda rows: sorted(rows, key=lambda r: tuple((x is not None, x) for x in r))
    out["refs"] = [dict(zip(("source_symbol", "name", "kind", "line", "evidence"), (*r[:4], list(r[4])), strict=True)) for r in order(used.refs)]
    out["assigns"] = [dict(zip(("scope", "name", "target", "line"), r, strict=True)) for r in order(used.assigns)]
    out["params"] = [dict(zip(("scope", "name", "annotation", "line"), r, strict=True)) for r in order(used.params)]
    return out


def analyse(files: DataFrame) -> DataFrame:
    """One row per file (path, source): content_hash, nested tables and error."""
    hashed = files.select("path", F.sha2(F.coalesce("source", F.lit("")), 256).alias("content_hash"), "source")
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    arrow = to_arrow_schema(_parse_datatype_string(SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"path": p, "content_hash": h, **parse(s)} for p, h, s in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return hashed.mapInArrow(run, SCHEMA)


def require_parsed(analysis: DataFrame) -> DataFrame:
    """The strict mode: the first file with an error is raised."""
    bad = analysis.where("error is not null").select("path", "error").orderBy("path").head(1)
    if bad:
        raise SyntaxError(f"{bad[0].path}: {bad[0].error}")
    return analysis


def rows_of(analysis: DataFrame, field: str) -> DataFrame:
    """(path, pos, fields...) of one nested table."""
    return analysis.select("path", F.posexplode(field).alias("pos", "x")).select("path", "pos", "x.*")


def symbols(analysis: DataFrame) -> DataFrame:
    """All symbols in their total order: path, line, name."""
    return rows_of(analysis, "symbols").drop("pos").orderBy("path", F.coalesce("line", F.lit(0)), "name")


def find_symbols(table: DataFrame, name: str, kind: str | None = None) -> DataFrame:
    if kind is not None and kind not in ("class", "function", "method"):
        raise ValueError(f"unknown kind: {kind}")
    found = table.where(F.col("name") == name)
    return found if kind is None else found.where(F.col("kind") == kind)


def import_terms(analysis: DataFrame) -> DataFrame:
    """(path, imports): module, name and alias words of a file, as one text."""
    a = F.transform("imports", lambda x: F.concat_ws(" ", x["module"], x["alias"]))
    b = F.transform("from_imports", lambda x: F.concat_ws(" ", x["module"], x["name"], x["alias"]))
    return analysis.select("path", F.array_join(F.concat(a, b), " ").alias("imports"))


def document_parts(analysis: DataFrame, files: DataFrame) -> DataFrame:
    """What is embedded of each file: (path, imports, functions, classes, methods, source)."""
    named = lambda kind: F.transform(F.filter("symbols", lambda s: s["kind"] == kind), lambda s: s["name"])
    modules = F.array_distinct(F.concat(F.transform("imports", lambda x: x["module"]), F.transform("from_imports", lambda x: x["module"])))
    parts = analysis.select("path", modules.alias("imports"), named("function").alias("functions"), named("class").alias("classes"), named("method").alias("methods"))
    return parts.join(files.select("path", "source"), "path")


def span_text(files: DataFrame, spans: DataFrame) -> DataFrame:
    """spans with their text and tokens; lines end at \\r\\n, \\r or \\n."""
    lines = files.select("path", F.split("source", "(?<=\n)|(?<=\r)(?!\n)", -1).alias("_lines"))
    part = F.array_join(F.slice("_lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "")
    found = spans.join(lines, "path").withColumn("text", part).drop("_lines")
    return found.withColumn("tokens", F.greatest(F.lit(1), F.ceil(F.length("text") / 4)).cast("bigint"))


def in_path_order(table: DataFrame) -> DataFrame:
    return table.orderBy(path_order(F.col("path")))
