"""The code graph as DataFrames: entity tables, call edges, inheritance edges, and the lookups over them.

Tables may hold a row several times and in several variants; :func:`latest` chooses the row that counts for each id.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..sources.tables import table
from .orphans import json_ids, key


def latest(df: DataFrame, id_: str = "id", at: str = "indexed_at") -> DataFrame:
    """One row per id: the one indexed last, ties by hash of the whole row."""
    rest = [c for c in df.columns if c != id_]
    hashable = [c for c in rest if not df.schema[c].dataType.typeName().startswith("map")]
    best = F.max_by(F.struct(*rest), F.struct(F.col(at), F.xxhash64(*hashable))).alias("_r")
    return df.groupBy(id_).agg(best).select(id_, "_r.*")


def scope(df: DataFrame, variant: str | None = None, module: str | None = None, any_module: bool = True) -> DataFrame:
    """Rows of a variant and, unless ``any_module``, of a module, where null matches null."""
    if variant is not None:
        df = df.filter(F.col("variant") == variant)
    return df if any_module else df.filter(F.col("module_id").eqNullSafe(F.lit(module)))


@dataclass(frozen=True)
class CodeGraph:
    classes: DataFrame
    methods: DataFrame
    callsites: DataFrame

    @classmethod
    def load(cls, spark: SparkSession, folder: str) -> CodeGraph:
        """The rows that count: the latest of each id, those deleted left out."""
        c, m, s = (table(spark, folder, t) for t in ("classes", "methods", "callsites"))
        return cls(latest(c).filter("deleted_at is null"), latest(m).filter("deleted_at is null"), latest(s))

    def edges(self) -> DataFrame:
        """(callsite_id, src, dst): one call edge for each candidate of a call site."""
        return call_edges(self.callsites)

    def inheritance(self) -> DataFrame:
        return inheritance_edges(self.classes)

    def nodes(self) -> DataFrame:
        """(id, node_type, name, signature, file_path, calls, called_by): methods and classes as one table; classes call nothing."""
        m = self.enriched_methods().select("id", F.lit("method").alias("node_type"), F.col("method_name").alias("name"), "signature", "file_path", "calls", "called_by")
        c = self.classes.select("id", F.lit("class").alias("node_type"), "name", F.col("full_name").alias("signature"), "file_path")
        empty = F.array().cast("array<string>")
        return m.unionByName(c, allowMissingColumns=True).withColumns({"calls": F.coalesce("calls", empty), "called_by": F.coalesce("called_by", empty)})

    def of_files(self, paths: DataFrame) -> CodeGraph:
        """The classes, methods and call sites of some files (file_path); edges follow from the call sites."""
        p = paths.select("file_path").distinct()
        part = lambda df: df.join(p, "file_path", "left_semi")
        return CodeGraph(part(self.classes), part(self.methods), part(self.callsites))

    def edges_of_files(self, paths: DataFrame) -> DataFrame:
        """Call edges whose caller lies in some files."""
        own = self.methods.join(paths.select("file_path").distinct(), "file_path", "left_semi").select(key("id").alias("src")).distinct()
        return self.edges().join(own, "src", "left_semi")

    def enriched_methods(self) -> DataFrame:
        """Methods with the sorted ids that they call and are called by."""
        e = self.edges().select("src", "dst").distinct()
        calls = e.groupBy("src").agg(F.array_sort(F.collect_set("dst")).alias("calls"))
        called = e.groupBy("dst").agg(F.array_sort(F.collect_set("src")).alias("called_by"))
        empty = F.array().cast("array<string>")
        out = self.methods.join(calls, F.col("id") == F.col("src"), "left").drop("src").join(called, F.col("id") == F.col("dst"), "left").drop("dst")
        return out.withColumns({"calls": F.coalesce("calls", empty), "called_by": F.coalesce("called_by", empty)})


def call_edges(callsites: DataFrame) -> DataFrame:
    rows = callsites.select(F.col("id").alias("callsite_id"), key("caller_method_id").alias("src"), F.explode(json_ids("resolved_candidates_json")).alias("dst"))
    return rows.withColumn("dst", key("dst")).filter("src is not null and dst is not null").distinct()


def inheritance_edges(classes: DataFrame) -> DataFrame:
    """(source_id, source, target, relation): one row for ``extends`` and one for each of ``implements``, as written."""
    one = F.when(F.trim("extends") != "", F.array(F.struct(F.trim("extends").alias("target"), F.lit("extends").alias("relation"))))
    many = F.transform(F.from_json("implements_json", "array<string>"), lambda x: F.struct(F.trim(x).alias("target"), F.lit("implements").alias("relation")))
    empty = F.array().cast("array<struct<target:string,relation:string>>")
    both = F.concat(F.coalesce(one, empty), F.coalesce(many, empty))
    return classes.select(F.col("id").alias("source_id"), F.col("full_name").alias("source"), F.explode(both).alias("e")).select("source_id", "source", F.regexp_replace("e.target", r"\s*[<\[].*$", "").alias("target"), "e.relation").filter("target <> ''").distinct()


def select_methods(methods: DataFrame, selector: str) -> DataFrame:
    """The first kind of match that there is, of id, signature, Class.method or Class#method by full name, the same by
    short name, and bare name; in one pass over the methods."""
    dotted = F.concat_ws(".", "class_full_name", "method_name")
    hashed = F.concat_ws("#", "class_full_name", "method_name")
    short = ids.short_name("class_full_name")
    kind = (
        F.when(F.col("id") == selector, 1)
        .when(F.col("signature") == selector, 2)
        .when((dotted == selector) | (hashed == selector), 3)
        .when((F.concat_ws(".", short, "method_name") == selector) | (F.concat_ws("#", short, "method_name") == selector), 4)
        .when(F.col("method_name") == selector, 5)
    )
    hits = methods.withColumn("match", kind).filter("match is not null")
    least = hits.agg(F.min("match").alias("least"))  # one row
    return hits.join(F.broadcast(least), F.col("match") == F.col("least")).drop("least")


def suggestions(methods: DataFrame, needle: str, n: int | None = 5) -> DataFrame:
    """Methods by how well their names match ``needle``: the score adds up; ties by id. ``n`` None gives all."""
    low = needle.lower()
    name, full, path = F.lower("method_name"), F.lower("class_full_name"), F.lower("file_path")
    wanted = F.array_distinct(F.array(*(F.lit(t) for t in low.replace(".", " ").replace("_", " ").split()))) if low.split() else F.array().cast("array<string>")
    have = F.array_distinct(F.concat(F.split(full, r"[._\s]+"), F.split(name, r"[_\s]+")))
    given = lambda c, points: F.when(c, points).otherwise(0)
    score = given(name.contains(low), 100) + given(ids.short_name(full).contains(low), 80) + given(full.contains(low), 60) + given(name.startswith(low), 40) + given(path.contains(low), 30)
    score = score + 10 * F.size(F.array_intersect(wanted, have))
    out = methods.select("id", "method_name", "class_full_name", "file_path", score.alias("score")).filter("score > 0")
    return out.orderBy(F.desc("score"), "id").limit(n) if n else out


def annotated(methods: DataFrame, classes: DataFrame, annotation: str) -> DataFrame:
    """Methods and classes that carry an annotation, whatever its package and arguments, or that have the role of its name."""
    norm = annotation.lstrip("@[").split("(")[0].split(".")[-1].lower()
    has = F.exists("annotations", lambda a: F.lower(rules.annotation_name(F.rtrim(a, F.lit("]")))) == norm)
    m = methods.filter(F.coalesce(has, F.lit(False)) | F.coalesce(F.lower("framework_role") == norm, F.lit(False)))
    c = classes.filter(F.coalesce(has, F.lit(False)))
    return m.select("id", F.lit("method").alias("kind"), "signature", "file_path").unionByName(c.select("id", F.lit("class").alias("kind"), F.col("full_name").alias("signature"), "file_path"))


def field_access(methods: DataFrame) -> DataFrame:
    """(field, method_id, role): readers and writers of each field, named Class#field."""
    parts = []
    for column, role in (("field_reads", "reader"), ("field_writes", "writer")):
        one = methods.select("class_full_name", F.col("id").alias("method_id"), F.explode(column).alias("f"))
        parts.append(one.select(F.concat_ws("#", "class_full_name", "f").alias("field"), "method_id", F.lit(role).alias("role")))
    return parts[0].unionByName(parts[1]).distinct()


def endpoints(methods: DataFrame) -> DataFrame:
    roles = ["http_handler", "route", "flask_route", "fastapi_route", "django_view"]
    return methods.filter(F.col("is_endpoint") | F.col("framework_role").isin(roles)).select("id", "http_method", F.coalesce("full_route", "route").alias("path"), "framework_role", "language", "signature")


def components(classes: DataFrame, methods: DataFrame) -> DataFrame:
    kinds = ["component", "service", "controller", "repository", "angular_component", "directive", "hook"]
    wanted = F.array(*(F.lit(k) for k in kinds))
    c = classes.withColumn("hit", F.array_intersect("stereotypes", wanted)).filter(F.size("hit") > 0).select("id", F.col("full_name").alias("name"), F.array_join("hit", ",").alias("kind"))
    return c.unionByName(methods.filter(F.col("framework_role").isin("component", "hook")).select("id", F.col("method_name").alias("name"), F.col("framework_role").alias("kind")))


#: Lines of a file that are joined at once.
BIN = 256


def method_at_line(methods: DataFrame, points: DataFrame, on: str = "file_path", line: str = "line") -> DataFrame:
    """For each point (a row with a path and a line) the innermost method that holds it; a range join on path and bins of lines,
    so that a long file is no product of its points and methods."""
    p = points.select(F.struct(*points.columns).alias("_point"), F.col(on).alias("_at"), F.col(line).alias("_line"), F.floor(F.col(line) / BIN).alias("_bin"))
    m = methods.filter("start_line <= end_line").select(F.col("file_path").alias("_path"), "start_line", "end_line", F.col("id").alias("method_id"))
    m = m.withColumn("_of", F.explode(F.sequence(F.floor(F.col("start_line") / BIN), F.floor(F.col("end_line") / BIN))))
    inside = p.join(m, (F.col("_at") == F.col("_path")) & (F.col("_bin") == F.col("_of")) & (F.col("_line") >= F.col("start_line")) & (F.col("_line") <= F.col("end_line")))
    best = F.min_by("method_id", F.struct(F.col("end_line") - F.col("start_line"), F.col("start_line"), F.col("method_id"))).alias("method_id")
    return inside.groupBy("_point").agg(best).select("_point.*", "method_id")


def files_methods(methods: DataFrame, paths: DataFrame) -> DataFrame:
    """Methods of the files in ``paths`` (file_path), in order of their lines."""
    return methods.join(paths.select("file_path").distinct(), "file_path", "left_semi").withColumn("position", F.row_number().over(Window.partitionBy("file_path").orderBy("start_line", "id")))


def callers_and_callees(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """Edges with the names of both ends."""
    m = methods.select("id", "signature", "file_path")
    a, b = (m.select(F.col("id").alias(s), F.col("signature").alias(f"{s}_signature"), F.col("file_path").alias(f"{s}_file")) for s in ("src", "dst"))
    return edges.join(a, "src").join(b, "dst")


def touching(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with either end among ``nodes`` (id): two semi joins instead of one join on a disjunction."""
    n = nodes.select("id").distinct()
    one = edges.join(n, F.col("src") == F.col("id"), "left_semi")
    return one.union(edges.join(n, F.col("dst") == F.col("id"), "left_semi")).distinct()


def text_window(source: Column, most_lines: int, most_chars: int | None = None) -> Column:
    """A source cut to a number of lines: the head, a mark, and the last three; then to a number of characters, with a mark."""
    lines = F.split(source, "\n")
    head = max(1, most_lines - 3)
    cut = F.concat(F.slice(lines, 1, head), F.array(F.lit("...")), F.slice(lines, -3, 3))
    out = F.when(F.size(lines) <= most_lines, source).otherwise(F.array_join(cut, "\n"))
    if most_chars is None:
        return out
    return F.when(F.length(out) <= most_chars, out).otherwise(F.concat(F.substring(out, 1, max(0, most_chars - 4)), F.lit("\n...")))


def capped_by_kind(found: DataFrame, most: int, order: str = "signature") -> DataFrame:
    """``found`` with at most so many rows of each kind, in order, and ``omitted``, how many of the kind are left out (a report's
    limit); the rows kept are chosen by aggregation, not by sorting a kind in one task."""
    total = found.groupBy("kind").agg(F.count("*").alias("_n"))
    kinds = [r["kind"] for r in total.select("kind").collect()]  # method and class
    parts = [found.filter(F.col("kind").eqNullSafe(F.lit(k))).orderBy(order, "id").limit(most) for k in kinds]
    if not parts:
        return found.withColumn("omitted", F.lit(0).cast("long"))
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole.join(F.broadcast(total), "kind").select(*found.columns, F.greatest(F.lit(0), F.col("_n") - most).alias("omitted"))
