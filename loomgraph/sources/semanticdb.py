"""SemanticDB documents, which the Scala compiler writes, as symbols, calls and inheritance.

The files are protocol buffers of a published schema; the few fields that are needed are read straight from the wire. Calls are
references to methods, each given to the method whose definition begins last before it. Defined results: bytes that are no such
document give what was read up to there; local symbols and references outside of any method are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids

# Numbers of the schema's kinds and roles.
KINDS = {3: "method", 10: "object", 13: "class", 14: "trait", 18: "interface", 20: "field", 21: "constructor"}
REFERENCE, DEFINITION = 1, 2
#: Parents that every class has.
EVERYONES = ("scala/AnyRef#", "java/lang/Object#", "scala/Any#")
ROWS = "uri string, kind string, symbol string, name string, parents array<string>, line int, column_no int, role int"


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 0x7F) << shift
        at += 1
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, Any]]:
    """(number, value) of a message's fields: numbers as int, all else as bytes."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            n, at = _varint(data, at)
            if at + n > len(data):
                return
            value, at = data[at : at + n], at + n
        elif kind in (1, 5):
            n = 8 if kind == 1 else 4
            value, at = data[at : at + n], at + n
        else:
            return
        yield tag >> 3, value


def _text(value: bytes) -> str:
    return value.decode("utf-8", "replace")


def _parents(signature: bytes) -> list[str]:
    """The symbols of the parents in a class' signature."""
    out = []
    for n, class_ in fields(signature):
        if n == 1:
            for m, parent in fields(class_):
                if m == 2:
                    out += [_text(s) for k, ref in fields(parent) if k == 2 for j, s in fields(ref) if j == 2]
    return [p for p in out if p not in EVERYONES]


def rows_of(data: bytes) -> list[tuple[Any, ...]]:
    """Symbols and occurrences of all documents of a file."""
    out: list[tuple[Any, ...]] = []
    try:
        for n, document in fields(data):
            if n != 1:
                continue
            parts = list(fields(document))
            uri = next((_text(v) for k, v in parts if k == 2), "")
            for k, v in parts:
                if k == 5:
                    s = dict(fields(v))
                    kind = KINDS.get(s.get(3, 0))
                    if kind and 1 in s:
                        out.append((uri, kind, _text(s[1]), _text(s.get(5, b"")), _parents(s[17]) if 17 in s else [], None, None, None))
                elif k == 6:
                    s = dict(fields(v))
                    place = dict(fields(s[1])) if 1 in s else {}
                    symbol = _text(s.get(2, b""))
                    if symbol and not symbol.startswith("local"):
                        out.append((uri, "occurrence", symbol, None, None, place.get(1, 0) + 1, place.get(2, 0) + 1, s.get(3, 0)))
    except (IndexError, TypeError, AttributeError):
        pass
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all SemanticDB files below a folder."""
    return parse(spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.semanticdb").load(folder).select("content"))


def parse(files: DataFrame) -> DataFrame:
    """Rows of files (content); a narrow step."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.list_(pa.string())] + [pa.int32()] * 3
        names = [c.split()[0] for c in ROWS.split(", ")]
        for batch in batches:
            got = [r for b in batch.column(0).to_pylist() for r in rows_of(b or b"")]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in got], k) for i, k in enumerate(kinds)], names=names)

    return files.select("content").mapInArrow(run, ROWS)


def _dotted(symbol: Any) -> Any:
    """``a/b/C#m().`` as ``a.b.C.m``."""
    return F.trim(F.regexp_replace(F.regexp_replace(symbol, r"\(\+?\d*\)", ""), r"[/#.`]+", "."), F.lit("."))


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """classes, methods, edges and inheritance of a graph from :func:`parse`'s rows."""
    defined = rows.filter(f"kind = 'occurrence' and role = {DEFINITION}").groupBy("symbol").agg(F.min(F.struct("line", "uri")).alias("at"))
    known = rows.filter("kind <> 'occurrence'").dropDuplicates(["symbol"]).join(defined, "symbol", "left")
    full = _dotted(F.col("symbol"))
    c = known.filter(F.col("kind").isin("class", "trait", "object", "interface")).select("symbol", full.alias("full_name"), "name", F.coalesce("at.uri", "uri").alias("file_path"), F.col("at.line").alias("start_line"), "parents", "kind")
    classes = c.select(ids.class_id("full_name", "file_path").alias("id"), F.regexp_replace("full_name", r"\.?[^.]*$", "").alias("package_name"), "name", "full_name", "file_path", "start_line", F.array("kind").alias("stereotypes"), F.lit("scala").alias("language"))
    m = known.filter(F.col("kind").isin("method", "constructor")).select("symbol", _dotted(F.regexp_replace("symbol", r"[^#/.]+\.$", "")).alias("class_full_name"), F.col("name").alias("method_name"), F.coalesce("at.uri", "uri").alias("file_path"), F.col("at.line").alias("start_line"))
    m = m.withColumn("id", ids.digest("method::", F.col("symbol"), "::", F.col("file_path")))
    calls = rows.filter(f"kind = 'occurrence' and role = {REFERENCE}").join(m.select("symbol", F.col("id").alias("dst")), "symbol").select("uri", "line", "column_no", "dst")
    # the method that begins last before the call: only starts are known, so the nearest one of the file's
    starts = m.filter("start_line is not null").select(F.col("file_path").alias("uri"), "start_line", F.col("id").alias("method_id")).distinct()
    at = calls.select("uri", "line").distinct()
    marks = at.select("uri", "line", F.lit(None).cast("string").alias("method_id"), F.lit(1).alias("kind")).unionByName(starts.select("uri", F.col("start_line").alias("line"), "method_id", F.lit(0).alias("kind")))
    last = F.last("method_id", ignorenulls=True).over(Window.partitionBy("uri").orderBy("line", "kind", "method_id").rowsBetween(Window.unboundedPreceding, 0))
    caller = marks.withColumn("src", last).filter("kind = 1 and src is not null").select("uri", "line", "src")
    edges = calls.join(caller, ["uri", "line"]).select(ids.call_id("src", "line", "column_no", "dst").alias("callsite_id"), "src", "dst", "line")
    inheritance = c.select(ids.class_id("full_name", "file_path").alias("source_id"), F.col("full_name").alias("source"), F.posexplode("parents").alias("n", "p")).select("source_id", "source", _dotted(F.col("p")).alias("target"), F.when(F.col("n") == 0, "extends").otherwise("implements").alias("relation"))
    return {"classes": classes, "methods": m.drop("symbol"), "edges": edges, "inheritance": inheritance}
