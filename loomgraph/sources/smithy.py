"""Interface definitions of services: shapes, operations, services, by headers and matching braces."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_HEADER = re.compile(r"^[ \t]*(structure|union|operation|service|resource|enum|intEnum|list|map|string|integer|long|boolean|timestamp|blob|document)\s+(\w+)([^\n{]*)", re.M)
_MEMBER = re.compile(r"((?:@[\w#.]+(?:\([^)]*\))?\s*)*)([\w$]+)\s*:\s*=?\s*([\w.#$]+)?")
_HTTP = re.compile(r'@http\(((?:"(?:\\.|[^"\\])*"|[^)"])*)\)')


_MARK = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|[{}]')


def _span(text: str, at: int) -> tuple[int, int]:
    """The places of the brace at or after ``at`` and of the one that closes it; strings and comments don't count."""
    start = text.find("{", at)
    if start < 0:
        return len(text), len(text)
    depth = 0
    for m in _MARK.finditer(text, start):
        if m[0] == "{":
            depth += 1
        elif m[0] == "}":
            depth -= 1
            if not depth:
                return start, m.start()
    return start, len(text)


def _block(text: str, at: int) -> str:
    start, end = _span(text, at)
    return text[start + 1 : end]


def shapes_of(path: str, text: str) -> list[tuple[Any, ...]]:
    """(path, namespace, kind, name, members, detail) of each shape of a file; members as JSON."""
    namespace = (re.search(r"^\s*namespace\s+([\w.]+)", text, re.M) or [None, ""])[1]
    out, last = [], 0  # all between the shape before and a header are the header's traits
    for m in _HEADER.finditer(text):
        if m.start() < last:
            continue  # within the shape before
        kind, name = m[1], m[2]
        line_end = text.find("\n", m.end())
        has_body = "{" in text[m.start() : line_end if line_end >= 0 else len(text)]
        start, end = _span(text, m.start()) if has_body else (m.end(), m.end())
        body, traits, last = text[start + 1 : end], text[last : m.start()], end
        members = [{"name": x[2], "target_shape": x[3], "required": "@required" in (x[1] or "")} for x in _MEMBER.finditer(body)] if kind in ("structure", "union") else []
        detail: dict[str, Any] = {}
        if kind == "operation":
            for part in ("input", "output"):
                p = re.search(rf"\b{part}\s*:(=?)\s*([\w.#]+)?", body)
                if p and p[1]:
                    inline = f"{name}{part.capitalize()}"
                    detail[part] = inline
                    inner = [{"name": x[2], "target_shape": x[3], "required": "@required" in (x[1] or "")} for x in _MEMBER.finditer(_block(body, p.start()))]
                    out.append((path, namespace, "structure", inline, json.dumps(inner), "{}"))
                elif p:
                    detail[part] = p[2]
            detail["errors"] = re.findall(r"\w+", (re.search(r"\berrors\s*:\s*\[([^\]]*)\]", body) or [None, ""])[1])
            http = _HTTP.search(traits)
            if http:
                detail["http_method"] = (re.search(r'method\s*:\s*"(\w+)"', http[1]) or [None, None])[1]
                detail["uri"] = (re.search(r'uri\s*:\s*"([^"]*)"', http[1]) or [None, None])[1]
        if kind == "service":
            detail["operations"] = re.findall(r"[\w.#]+", (re.search(r"\boperations\s*:\s*\[([^\]]*)\]", body) or [None, ""])[1])
        out.append((path, namespace, kind, name, json.dumps(members), json.dumps(detail)))
    return out


def parse(files: DataFrame) -> DataFrame:
    """Shapes of files (path, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            got = [r for p, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for r in shapes_of(p, t or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], pa.string()) for i in range(6)], names=["path", "namespace", "kind", "name", "members", "detail"])

    shapes = files.select("path", "text").mapInArrow(run, "path string, namespace string, kind string, name string, members string, detail string")
    return shapes.withColumn("members", F.from_json("members", "array<struct<name:string,target_shape:string,required:boolean>>"))


def operations(shapes: DataFrame) -> DataFrame:
    """Operations with the service that lists them."""
    d = F.from_json("detail", "input string, output string, errors array<string>, http_method string, uri string")
    ops = shapes.filter("kind = 'operation'").withColumn("d", d).select("namespace", "name", "d.*")
    of = shapes.filter("kind = 'service'").select(F.col("name").alias("service"), F.explode(F.from_json("detail", "operations array<string>")["operations"]).alias("name"))
    return ops.join(of.withColumn("name", F.regexp_extract("name", r"(\w+)$", 1)), "name", "left")


def handlers(operations_: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(operation, source_id): classes that implement the interface made for an operation or its service."""
    ends = F.regexp_replace(F.substring_index("target", ".", -1), "Operation(Async)?$", "")
    i = inheritance.withColumn("stem", ends)
    by_op = i.filter(F.col("target").rlike("Operation(Async)?$")).join(operations_.select(F.col("name").alias("stem"), F.col("name").alias("operation")), "stem")
    by_service = i.join(operations_.select(F.col("service").alias("stem"), F.col("name").alias("operation")), "stem")
    return by_op.select("operation", "source_id").unionByName(by_service.select("operation", "source_id")).distinct()
