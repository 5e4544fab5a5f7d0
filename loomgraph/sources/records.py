"""Records that a compiler or type checker wrote, as JSON lines with the kind of each in ``_type``: the tables of a graph.

Calls come with what the compiler resolved them to, so the cascade need not run over them again."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_STRINGS = "array<string>"
#: The fields of each kind; a missing list is empty, a missing text null.
FIELDS: Mapping[str, Mapping[str, str]] = {
    "class": {"id": "string", "package_name": "string", "name": "string", "full_name": "string", "file_path": "string", "start_line": "int", "end_line": "int", "modifiers": _STRINGS, "annotations": _STRINGS, "extends": "string", "implements": _STRINGS, "imports": _STRINGS, "stereotypes": _STRINGS},
    "method": {"id": "string", "class_id": "string", "class_full_name": "string", "method_name": "string", "return_type": "string", "parameter_types": _STRINGS, "parameter_names": _STRINGS, "signature": "string", "file_path": "string", "start_line": "int", "end_line": "int", "source": "string", "annotations": _STRINGS, "local_variable_types": "map<string,string>", "field_reads": _STRINGS, "field_writes": _STRINGS, "is_endpoint": "boolean", "http_method": "string", "route": "string", "controller_route": "string", "full_route": "string", "framework_role": "string"},
    "field": {"id": "string", "class_id": "string", "name": "string", "type_name": "string", "modifiers": _STRINGS, "file_path": "string", "line": "int"},
    "callsite": {"id": "string", "caller_method_id": "string", "callee_name": "string", "receiver": "string", "argument_count": "int", "file_path": "string", "line": "int", "column": "int", "text": "string", "receiver_type_raw": "string", "receiver_type_normalized": "string", "receiver_resolution_source": "string", "receiver_type": "string", "resolved_candidates": _STRINGS, "resolution_status": "string", "resolution_reason": "string", "candidate_count": "int"},
    "inheritance_edge": {"id": "string", "source_class_id": "string", "source_class": "string", "target_class": "string", "relation": "string"},
    "resolved_call_edge": {"id": "string", "callsite_id": "string", "caller_method_id": "string", "callee_method_id": "string"},
}
DEFAULTS = {"resolution_status": "unresolved", "resolution_reason": "", "text": "", "source": ""}


def read(spark: SparkSession, files: str, language: str = "typescript") -> dict[str, DataFrame]:
    """The tables (by kind) in files of JSON lines; lines that are no JSON or of unknown kind are left out."""
    return tables(spark.read.text(files).select(F.col("value")), language)


def tables(lines: DataFrame, language: str = "typescript") -> dict[str, DataFrame]:
    kind = F.get_json_object("value", "$._type")
    out = {}
    for name, fields in FIELDS.items():
        schema = ", ".join(f"`{c}` {t}" for c, t in fields.items())
        rows = lines.filter(kind == name).select(F.from_json("value", schema).alias("r")).select("r.*").filter("id is not null")
        cols = []
        for c, t in fields.items():
            default = F.array().cast(t) if t == _STRINGS else F.create_map().cast(t) if t.startswith("map") else F.lit(False) if t == "boolean" else F.lit(0) if c in ("argument_count", "candidate_count") else F.lit(DEFAULTS[c]) if c in DEFAULTS else None
            cols.append((F.coalesce(c, default) if default is not None else F.col(c)).alias(c))
        out[name] = rows.select(*cols, *([F.lit(language).alias("language")] if name in ("class", "method") else []))
    return out
