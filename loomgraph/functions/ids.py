"""Content-hash ids of graph entities, as Column expressions: the first 16 hex digits of SHA-1."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def digest(*parts: Column | str) -> Column:
    return F.substring(F.sha1(F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))), 1, 16)


def class_id(full_name: Column | str, file_path: Column | str) -> Column:
    return digest("class::", _c(full_name), "::", _c(file_path))


def module_class_id(path: Column | str) -> Column:
    return digest("module:", _c(path))


def signature(class_name: Column | str, method: Column | str, parameters: Column | str) -> Column:
    return F.concat(_c(class_name), F.lit("#"), _c(method), F.lit("("), F.array_join(_c(parameters), ", "), F.lit(")"))


def method_id(sig: Column | str, file_path: Column | str, line: Column | str) -> Column:
    return digest("method::", _c(sig), "::", _c(file_path), "::", _c(line).cast("string"))


def call_id(caller: Column | str, line: Column | str, column: Column | str, callee: Column | str) -> Column:
    return digest("call::", _c(caller), "::", _c(line).cast("string"), ":", _c(column).cast("string"), "::", _c(callee))


def doc_chunk_id(path: Column | str, index: Column | str) -> Column:
    return digest(_c(path), "::", _c(index).cast("string"))


def payload_hash(payload: Column | str) -> Column:
    return F.substring(F.sha2(_c(payload), 256), 1, 16)


def short_name(full_name: Column | str) -> Column:
    """The last dotted segment."""
    return F.substring_index(_c(full_name), ".", -1)


def estimated_tokens(chars: Column | str) -> Column:
    """A quarter of the characters, at least one."""
    return F.greatest(F.lit(1), F.floor(_c(chars) / 4))
