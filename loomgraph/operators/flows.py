"""Reports that follow calls: stack traces, traces by category, retrieval over the graph, suggestions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ids, rules
from . import search, traversal

_JAVA = r"^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)"
_PYTHON = r'^\s*File "([^"]+)", line (\d+), in (\S+)'


def stack_frames(traces: DataFrame, id_: str = "id", text: str = "text") -> DataFrame:
    """(id, position, class, method, file, line): frames of stack traces, in order; a line number that no int holds is null."""
    lines = traces.select(F.col(id_).alias("id"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("position", "l"))
    java, python = F.col("l").rlike(_JAVA), F.col("l").rlike(_PYTHON)
    got = lines.filter(java | python)
    part = lambda p, g: F.regexp_extract("l", p, g)
    return got.select("id", "position", F.when(java, part(_JAVA, 1)).alias("class"), F.when(java, part(_JAVA, 2)).otherwise(part(_PYTHON, 3)).alias("method"), F.when(java, part(_JAVA, 3)).otherwise(F.substring_index(part(_PYTHON, 1), "/", -1)).alias("file"), F.when(java, part(_JAVA, 4)).otherwise(part(_PYTHON, 2)).try_cast("int").alias("line"))


def matched_frames(frames: DataFrame, methods: DataFrame) -> DataFrame:
    """Frames with ``status`` (matched, ambiguous, unmatched) and the method: by class, name and file name; of several the one
    whose lines hold the frame's."""
    base = F.substring_index(F.translate("file_path", "\\", "/"), "/", -1)
    m = methods.select(F.col("id").alias("method_id"), F.col("class_full_name").alias("mclass"), F.col("method_name").alias("method"), base.alias("file"), "start_line", "end_line")
    j = frames.join(m, ["method", "file"], "left").filter(F.col("method_id").isNull() | F.col("class").isNull() | (F.col("mclass") == F.col("class")))
    inside = (F.col("line") >= F.col("start_line")) & (F.col("line") <= F.col("end_line"))
    g = j.groupBy("id", "position").agg(F.count_distinct("method_id").alias("n"), F.count_distinct(F.when(inside, F.col("method_id"))).alias("k"), F.min("method_id").alias("any"), F.min(F.when(inside, F.col("method_id"))).alias("held"))
    out = frames.join(g, ["id", "position"], "left")
    status = F.when((F.col("n") == 1) | (F.col("k") == 1), "matched").when(F.col("n") > 1, "ambiguous").otherwise("unmatched")
    return out.select("id", "position", "class", "method", "file", "line", status.alias("status"), F.when(F.col("k") == 1, F.col("held")).when(F.col("n") == 1, F.col("any")).alias("method_id"))


def anchors(matched: DataFrame) -> DataFrame:
    """The first frame of each trace that is one of our methods."""
    return matched.filter("status = 'matched'").groupBy("id").agg(F.min_by("method_id", "position").alias("method_id"), F.min("position").alias("position"))


def trace_category(callee: Column, receiver: Column, receiver_type: Column, status: Column, candidates: Column, business: Sequence[str] = ("service", "repository", "controller", "handler", "processor", "manager")) -> Column:
    """What a call is in a trace: observability, utility, internal, external, unresolved or framework."""
    low, kind = F.lower(F.coalesce(receiver, F.lit(""))), F.lower(F.coalesce(receiver_type, F.lit("")))
    log = low.rlike(r"^(log|logger|_log|metrics?|tracer)\b") | F.lower(callee).rlike("log|metric")
    useful = callee.isin(rules.NOISY_NAMES) | kind.rlike(r"(string|list|map|set|optional|collection)$")
    ours = kind.rlike("|".join(business))
    flag = lambda c: F.coalesce(c, F.lit(False))
    return (
        F.when(flag(log), "observability").when(flag(useful), "utility")
        .when(flag(status.startswith("resolved")), F.when(ours, "business_internal").otherwise("probable_internal"))
        .when(flag((status == "ambiguous_type") & (candidates > 0)), "probable_internal")
        .when(flag(status == "external_library"), "external_library")
        .when(flag(status.startswith("unresolved")), F.when(ours, "unresolved_business").otherwise("unknown"))
        .otherwise("framework")
    )


def traced(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(src, dst, depth, lines): edges walked from the roots, each pair once with the lines of its calls (edges: src, dst, line)."""
    nodes = traversal.levels(edges.select("src", "dst"), roots, depth)
    e = edges.join(nodes.filter(F.col("depth") < depth).select(F.col("id").alias("src"), "depth"), "src")
    return e.groupBy("src", "dst", "depth").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def graph_retrieval(methods: DataFrame, edges: DataFrame, terms: Sequence[str], seeds: int = 10, hops: int = 2, most: int = 50) -> DataFrame:
    """(id, depth, score): the best text hits and what lies within some hops of them, by hop, then score (a report's limit)."""
    hits = search.bm25(methods, terms, search.METHOD_COLUMNS).orderBy("score", "id").limit(seeds)
    around = traversal.levels(traversal.both_ways(edges), hits.select("id"), hops)
    scored = around.join(hits.select("id", "score"), "id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    return scored.orderBy("depth", "score", "id").limit(most)


def next_steps(flow: DataFrame, ranks: DataFrame, most: int = 15) -> DataFrame:
    """Suggested methods: primary before supporting before utility, then by rank (a report's limit)."""
    order = F.when(F.col("tier") == "primary", 0).when(F.col("tier") == "supporting", 1).otherwise(2)
    return flow.join(ranks.select("id", "rank", "tier"), "id").withColumn("order", order).orderBy("order", F.desc("rank"), "id").limit(most)


def excluded(methods: DataFrame, rules_: DataFrame) -> DataFrame:
    """Methods with ``out``: whether a rule (kind: signature, package, regex or selector; pattern; include) excludes them. An
    include overrides excludes; a bare selector counts only if it names one method. Rules are a short list given by hand."""
    shorts = methods.groupBy("method_name").agg(F.count_distinct("id").alias("named"))
    m = methods.join(shorts, "method_name", "left")
    hit_in, hit_out = F.lit(False), F.lit(False)
    for r in rules_.collect():  # configuration, a handful of rows
        c = {"signature": F.col("signature") == r["pattern"], "package": F.col("class_full_name").contains(r["pattern"]), "regex": F.col("signature").rlike(r["pattern"]), "selector": (F.concat_ws(".", ids.short_name("class_full_name"), "method_name") == r["pattern"]) | ((F.col("method_name") == r["pattern"]) & (F.col("named") == 1))}[r["kind"]]
        c = F.coalesce(c, F.lit(False))
        if r["include"]:
            hit_in = hit_in | c
        else:
            hit_out = hit_out | c
    return m.withColumn("out", hit_out & ~hit_in).select(*methods.columns, "out")


def tier_history(log: DataFrame) -> DataFrame:
    """(tier, n, pct) of the expansions in a session log (seq, tool_name, method_id, tier), each with the flow it came from."""
    n = log.filter("tool_name = 'method_source' and tier is not null").groupBy("tier").agg(F.count("*").alias("n"))
    return n.withColumn("pct", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 1))
