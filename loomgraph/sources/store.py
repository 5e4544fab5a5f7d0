"""Sinks and ad-hoc reads: partitioned tables, upserts as new snapshots, exports, telemetry, SQL."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..operators.changes import upsert

SCHEMA_VERSION = "1"


def write_scope(df: DataFrame, path: str, partitions: Sequence[str] = ("variant", "module_id")) -> None:
    """Replace the partitions that ``df`` has rows of, and leave the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_snapshot(df: DataFrame, root: str, name: str) -> str:
    """A new folder for a new state: readers keep the old one until they are told of the new."""
    target = f"{root.rstrip('/')}/{name}"
    df.write.mode("errorifexists").parquet(target)
    return target


def upsert_snapshot(spark: SparkSession, old: str, changes: DataFrame, key: Sequence[str], root: str, name: str) -> str:
    return write_snapshot(upsert(spark.read.parquet(old), changes, key), root, name)


def write_resolution(state: DataFrame, calls: DataFrame, root: str) -> tuple[str, str]:
    """What the cascade found (callsite_id, status, candidates) as two tables below ``root``: call sites with their state, and an edge
    for each candidate, each in the variant of the call's own file (calls: callsite_id, caller_method_id, file_path). Variants
    that no call is of keep what they have."""
    variant = rules.path_variant(F.coalesce("file_path", F.lit(""))).alias("variant")
    rows = state.join(calls.select("callsite_id", "caller_method_id", variant), "callsite_id")
    edges = rows.select("callsite_id", F.col("caller_method_id").alias("src"), F.explode("candidates").alias("dst"), "variant").withColumn("id", ids.digest("edge::", F.col("callsite_id"), "::", F.col("dst")))
    sites = rows.select("callsite_id", "status", F.size("candidates").alias("candidate_count"), "candidates", "variant")
    write_scope(edges, f"{root.rstrip('/')}/edges", ["variant"])
    write_scope(sites, f"{root.rstrip('/')}/callsites", ["variant"])
    return f"{root.rstrip('/')}/edges", f"{root.rstrip('/')}/callsites"


def append_events(df: DataFrame, path: str) -> None:
    """Telemetry: append only, a day a folder."""
    df.withColumn("day", F.to_date(F.timestamp_millis("ts"))).write.mode("append").partitionBy("day").parquet(path)


def iso_times(events: DataFrame, column: str = "ts") -> DataFrame:
    """``events`` with ``<column>_iso``: epoch milliseconds as an ISO time in UTC."""
    return events.withColumn(f"{column}_iso", F.date_format(F.timestamp_millis(column), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))


def history(events: DataFrame, repository: str, limit: int = 50) -> DataFrame:
    """The last events of a repository (a report's limit)."""
    return events.filter(F.col("repository") == repository).orderBy(F.desc("ts")).limit(limit)


def checked_version(properties: dict[str, str]) -> None:
    if properties.get("version") != SCHEMA_VERSION:
        raise ValueError(f"tables of version {properties.get('version')}; this library reads {SCHEMA_VERSION}")


def read_evolving(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Tables of which later ones have more columns."""
    return spark.read.option("mergeSchema", "true").parquet(*paths)


def ad_hoc(spark: SparkSession, query: str, most: int = 2000) -> tuple[DataFrame, bool]:
    """The first rows of a query and whether there are more; only queries, and binary columns by length."""
    if not re.match(r"(?is)^\s*(?:--[^\n]*\n\s*)*(select|with|values|show|describe|explain|from|table)\b", query):
        raise ValueError("only queries are allowed")
    df = spark.sql(query)
    for f in df.schema.fields:
        if f.dataType.typeName() == "binary":
            df = df.withColumn(f.name, F.concat(F.lit("<"), F.length(f.name), F.lit(" bytes>")))
    got = df.limit(most + 1)
    more = got.count() > most
    return got.limit(most), more


def catalog(spark: SparkSession) -> DataFrame:
    """(table, column, type) of all tables and views there are."""
    rows = [(t.name, c.name, c.dataType) for t in spark.catalog.listTables() for c in spark.catalog.listColumns(t.name)]
    return spark.createDataFrame(rows, "table string, column string, type string")


def json_lines(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("value"))


def dot_lines(edges: DataFrame) -> DataFrame:
    """A line of a graph drawing for each edge, quotes escaped."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    return edges.select(F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), F.lit(";")).alias("value"))


def session_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("tool_name string, method_id string, timestamp string").json(path).withColumn("at", F.try_to_timestamp("timestamp"))
