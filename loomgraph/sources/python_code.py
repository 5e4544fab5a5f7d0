"""Python files as classes, methods and call sites, through the standard library's own parser."""

from __future__ import annotations

import ast
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = "path string, kind string, owner string, name string, start_line int, end_line int, line int, detail string"


def _text(node: ast.AST | None) -> str | None:
    return ast.unparse(node) if node is not None else None


def rows_of(path: str, text: str) -> list[tuple[Any, ...]]:
    """Tagged rows of one file: its imports, classes, functions and calls. A file that isn't valid gives one row of kind
    ``error``."""
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return [(path, "error", None, type(e).__name__, None, None, None, None)]
    out: list[tuple[Any, ...]] = []
    # an explicit stack: sources may nest deeper than Python recurses
    stack: list[tuple[ast.AST, str]] = [(tree, "")]
    while stack:
        node, owner = stack.pop()
        inner = owner
        if isinstance(node, ast.ClassDef):
            inner = f"{owner}.{node.name}".lstrip(".")
            detail = {"bases": [_text(b) for b in node.bases], "decorators": [_text(d) for d in node.decorator_list]}
            out.append((path, "class", owner or None, node.name, node.lineno, node.end_lineno, node.lineno, json.dumps(detail)))
        elif isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef):
            inner = f"{owner}.{node.name}".lstrip(".")
            args = [*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs]
            detail = {"parameters": [a.arg for a in args], "types": [_text(a.annotation) for a in args], "returns": _text(node.returns), "decorators": [_text(d) for d in node.decorator_list]}
            out.append((path, "function", owner or None, node.name, node.lineno, node.end_lineno, node.lineno, json.dumps(detail)))
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.attr if isinstance(f, ast.Attribute) else f.id if isinstance(f, ast.Name) else None
            if name:
                detail = {"receiver": _text(f.value) if isinstance(f, ast.Attribute) else None, "arguments": len(node.args) + len(node.keywords)}
                out.append((path, "call", owner or None, name, None, None, node.lineno, json.dumps(detail)))
        elif isinstance(node, ast.Import):
            out += [(path, "import", None, a.name, None, None, node.lineno, None) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out += [(path, "import", None, f"{'.' * node.level}{node.module or ''}.{a.name}".rstrip("."), None, None, node.lineno, None) for a in node.names]
        stack += [(child, inner) for child in reversed(list(ast.iter_child_nodes(node)))]
    return out


def parse(files: DataFrame) -> DataFrame:
    """Tagged rows of files (path, text); a narrow step with one parse per file."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.int32()] * 3 + [pa.string()]
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            got = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in rows_of(p, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=names)

    return files.select("path", "text").mapInArrow(run, ROWS)


def classes(rows: DataFrame) -> DataFrame:
    """(path, full_name, name, bases, stereotypes) with the roles that bases and decorators give."""
    d = F.from_json("detail", "bases array<string>, decorators array<string>")
    c = rows.filter("kind = 'class'").withColumn("d", d)
    is_a = lambda p: F.exists("d.bases", lambda b: b.rlike(p))
    kinds = F.array_compact(F.array(F.when(F.exists("d.decorators", lambda x: x.rlike(r"(^|\.)dataclass\b")), F.lit("dataclass")), F.when(is_a(r"(^|\.)Model$"), F.lit("django_model")), F.when(is_a(r"View(Set)?$"), F.lit("django_view"))))
    return c.select("path", F.concat_ws(".", "owner", "name").alias("full_name"), "name", "d.bases", F.when(F.size(kinds) > 0, kinds).otherwise(F.array(F.lit("generic"))).alias("stereotypes"))


def functions(rows: DataFrame) -> DataFrame:
    """(path, owner, name, start_line, end_line, parameters, role): roles by decorators, and for methods named as a verb of a
    subclass of a view."""
    d = F.from_json("detail", "parameters array<string>, decorators array<string>")
    f = rows.filter("kind = 'function'").withColumn("d", d)
    deco = lambda p: F.exists("d.decorators", lambda x: x.rlike(p))
    role = F.when(deco(r"\.route\("), "flask_route").when(deco(r"\.(get|post|put|delete|patch|head|options)\("), "fastapi_route")
    views = classes(rows).filter(F.array_contains("stereotypes", "django_view")).select("path", F.col("full_name").alias("owner"), F.lit(True).alias("view")).distinct()
    f = f.join(views, ["path", "owner"], "left")
    role = role.when(F.col("view") & F.col("name").isin("get", "post", "put", "patch", "delete", "head", "options"), "django_handler")
    return f.select("path", "owner", "name", "start_line", "end_line", "d.parameters", role.alias("role"))


def calls(rows: DataFrame) -> DataFrame:
    d = F.from_json("detail", "receiver string, arguments int")
    return rows.filter("kind = 'call'").withColumn("d", d).select("path", F.col("owner").alias("caller"), F.col("name").alias("callee_name"), "line", "d.receiver", F.col("d.arguments").alias("argument_count"))
