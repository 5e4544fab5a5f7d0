"""Aggregations over a code graph and over evaluation results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut
from ..functions import ids


def resolution_class(status: Column) -> Column:
    return F.when(status.startswith("resolved"), "resolved").when(status == "external_library", "external").otherwise("unresolved")


def percent(part: Column, whole: Column) -> Column:
    return F.round(100.0 * part / whole, 1)


def graph_health(callsites: DataFrame) -> DataFrame:
    """One row: calls resolved, external, unresolved, and their percentages."""
    c = resolution_class(F.col("resolution_status"))
    sums = callsites.agg(F.count("*").alias("total"), *(F.count_if(c == k).alias(k) for k in ("resolved", "external", "unresolved")))
    return sums.select("*", *(percent(F.col(k), F.col("total")).alias(f"{k}_pct") for k in ("resolved", "external", "unresolved")))


def health_by(callsites: DataFrame) -> DataFrame:
    """Counts by status and by reason in one pass: a row for each of either, the other null."""
    return callsites.groupingSets([["resolution_status"], ["resolution_reason"]], "resolution_status", "resolution_reason").agg(F.grouping_id().alias("level"), F.count("*").alias("calls")).select(F.when(F.col("level") == 1, "status").otherwise("reason").alias("kind"), F.coalesce("resolution_status", "resolution_reason", F.lit("")).alias("name"), "calls")


def unresolved_diagnosis(callsites: DataFrame, top: int = 5, samples: int = 10) -> DataFrame:
    """For each unresolved status: calls, those in tests, the most frequent reasons, and sample texts (the least ones)."""
    rows = callsites.filter(resolution_class(F.col("resolution_status")) == "unresolved")
    totals = rows.groupBy("resolution_status").agg(F.count("*").alias("calls"), F.count_if(F.col("variant") == "test").alias("in_tests"))
    reasons = rows.groupBy("resolution_status", "resolution_reason").agg(F.count("*").alias("n"))
    ranked = reasons.withColumn("r", F.row_number().over(Window.partitionBy("resolution_status").orderBy(F.desc("n"), "resolution_reason"))).filter(F.col("r") <= top)
    reasons = ranked.groupBy("resolution_status").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "resolution_reason", "n"))), lambda x: F.concat(x["resolution_reason"], F.lit("="), x["n"])), ",").alias("reasons"))
    texts = rows.groupBy("resolution_status", "callee_name").agg(F.count("*").alias("n"))
    least = texts.withColumn("r", F.row_number().over(Window.partitionBy("resolution_status").orderBy("callee_name"))).filter(F.col("r") <= samples)
    least = least.groupBy("resolution_status").agg(F.array_join(F.array_sort(F.collect_list("callee_name")), ",").alias("samples"))
    return totals.join(reasons, "resolution_status").join(least, "resolution_status")


def framework_summary(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(kind, name, n): roles, stereotypes, languages and endpoints."""
    parts = [
        methods.filter("framework_role is not null").select(F.lit("role").alias("kind"), F.col("framework_role").alias("name")),
        classes.select(F.lit("stereotype").alias("kind"), F.explode("stereotypes").alias("name")),
        methods.filter("language is not null").select(F.lit("language").alias("kind"), F.col("language").alias("name")),
        methods.filter("is_endpoint").select(F.lit("endpoint").alias("kind"), F.coalesce("http_method", F.lit("")).alias("name")),
    ]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy("kind", "name").agg(F.count("*").alias("n"))


def joined_set(c: Column | str, separator: str = ",") -> Column:
    """The distinct values, sorted, as one text."""
    return F.array_join(F.array_sort(F.collect_set(c)), separator)


def caller_counts(edges: DataFrame, wanted: DataFrame | None = None) -> DataFrame:
    """(id, callers): call edges into each method, or into those ``wanted`` (id)."""
    e = edges if wanted is None else edges.join(wanted.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    return e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))


def file_dependents(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(file, caller_file, calls, methods): who calls into each file, itself included."""
    m = methods.select("id", "file_path", "method_name")
    into = edges.join(m.select(F.col("id").alias("dst"), F.col("file_path").alias("file"), F.col("method_name").alias("called")), "dst")
    full = into.join(m.select(F.col("id").alias("src"), F.col("file_path").alias("caller_file")), "src")
    return full.groupBy("file", "caller_file").agg(F.count("*").alias("calls"), joined_set("called").alias("methods"))


def file_dependencies(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """(file, callee_file, calls, methods): what each file calls in others."""
    turned = file_dependents(edges, methods)
    return turned.filter("file <> caller_file").select(F.col("caller_file").alias("file"), F.col("file").alias("callee_file"), "calls", "methods")


def inheritance_dependencies(inheritance: DataFrame, classes: DataFrame) -> DataFrame:
    """(file, target, relation, target_file): what the classes of each file extend or implement, each once, with the file of the
    target where it is in the graph."""
    c = classes.select("id", "full_name", "file_path").filter("file_path is not null")
    own = inheritance.join(c.select(F.col("id").alias("source_id"), F.col("file_path").alias("file")).distinct(), "source_id").select("file", "target", "relation").distinct()
    known = c.groupBy(F.col("full_name").alias("target")).agg(F.min("file_path").alias("target_file"))
    return own.join(known, "target", "left").select("file", "target", "relation", "target_file")


def dependency_totals(calls: DataFrame, inherited: DataFrame) -> DataFrame:
    """(file, files): how many other files each file depends on, by calls or inheritance."""
    other = calls.select("file", F.col("callee_file").alias("to")).unionByName(inherited.select("file", F.col("target_file").alias("to")))
    return other.filter("to is not null and to <> file").groupBy("file").agg(F.count_distinct("to").alias("files"))


def resolved_callees(edges: DataFrame, callsites: DataFrame, methods: DataFrame) -> DataFrame:
    """(src, dst, signature, lines, calls, priority): the calls of each method grouped by target; names that only move
    data come last."""
    from ..functions.rules import LOW_PRIORITY_PARTS

    c = callsites.select(F.col("id").alias("callsite_id"), "line")
    m = methods.select(F.col("id").alias("dst"), "signature")
    grouped = edges.join(c, "callsite_id").join(m, "dst").groupBy("src", "dst", "signature").agg(F.array_join(F.array_sort(F.collect_set("line")), ",").alias("lines"), F.count("*").alias("calls"))
    low = F.exists(F.array(*(F.lit(p) for p in LOW_PRIORITY_PARTS)), lambda p: F.col("signature").contains(p))
    return grouped.withColumn("priority", F.when(low, 2).otherwise(0))


def unresolved_calls(callsites: DataFrame) -> DataFrame:
    """Unresolved calls of each method by name, receiver and reason; fluent ones by name and reason only."""
    from ..functions.rules import FLUENT_NAMES

    fluent = F.col("callee_name").isin(FLUENT_NAMES)
    rows = callsites.filter(resolution_class(F.col("resolution_status")) == "unresolved")
    return rows.groupBy("caller_method_id", "callee_name", F.when(~fluent, F.col("receiver")).alias("receiver"), "resolution_reason", fluent.alias("fluent")).agg(F.count("*").alias("calls"))


def hotspots(callsites: DataFrame, methods: DataFrame, limit: int | None = 50) -> DataFrame:
    """Methods with most calls that are not resolved, with the reasons (a report's limit)."""
    rows = callsites.filter(~F.col("resolution_status").startswith("resolved"))
    m = methods.select(F.col("id").alias("caller_method_id"), "class_full_name", "method_name")
    out = rows.join(m, "caller_method_id").groupBy("class_full_name", "method_name").agg(F.count("*").alias("unresolved_calls"), joined_set("resolution_reason").alias("reasons"))
    return out.orderBy(F.desc("unresolved_calls"), "class_full_name", "method_name").limit(limit) if limit else out


def untraceable(callsites: DataFrame) -> DataFrame:
    rows = callsites.filter(~F.col("resolution_status").startswith("resolved"))
    return rows.groupBy("callee_name", "resolution_reason").agg(F.min("receiver_type_raw").alias("receiver_type_raw"), F.count("*").alias("cnt"))


def missing_targets(inheritance: DataFrame, classes: DataFrame) -> DataFrame:
    """Inheritance edges whose target is no class here, with how many edges name that target."""
    known = classes.select(F.col("full_name").alias("target")).distinct()
    out = inheritance.join(known, "target", "left_anti")
    return out.withColumn("target_refs", F.count("*").over(Window.partitionBy("target")))


def name_collisions(classes: DataFrame) -> DataFrame:
    """Short names that several classes share."""
    rows = classes.groupBy(ids.short_name("full_name").alias("short_name")).agg(F.count_distinct("full_name").alias("n"), joined_set("full_name").alias("full_names"))
    return rows.filter("n > 1")


def profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, populated, missing, blank, longest) of text columns, in one pass."""
    aggs = []
    for c in columns:
        aggs += [F.count(c).alias(f"{c}|populated"), F.count_if(F.col(c).isNull()).alias(f"{c}|missing"), F.count_if(F.trim(c) == "").alias(f"{c}|blank"), F.max(F.length(c)).alias(f"{c}|longest")]
    wide = df.agg(*aggs)
    parts = F.array(*(F.struct(F.lit(c).alias("column"), *(F.col(f"`{c}|{k}`").cast("long").alias(k) for k in ("populated", "missing", "blank", "longest"))) for c in columns))
    return wide.select(F.explode(parts).alias("p")).select("p.*")


def length_mismatches(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """(left, right, rows, mismatches): rows of which two array columns, of names and types say, aren't equally long."""
    length = lambda c: F.coalesce(F.size(c), F.lit(0))
    wide = df.agg(F.count("*").alias("rows"), *(F.count_if(F.greatest(length(a), F.lit(0)) != F.greatest(length(b), F.lit(0))).alias(f"m{i}") for i, (a, b) in enumerate(pairs)))
    parts = F.array(*(F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col("rows"), F.col(f"m{i}").alias("mismatches")) for i, (a, b) in enumerate(pairs)))
    return wide.select(F.explode(parts).alias("p")).select("p.*")


def histogram(df: DataFrame, column: str) -> DataFrame:
    """(value, n, pct) of a column."""
    n = df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))  # one row
    return n.withColumn("_k", F.lit(1)).join(F.broadcast(total.withColumn("_k", F.lit(1))), "_k").select("value", "n", percent(F.col("n"), F.col("total")).alias("pct"))


def file_hits(ranked: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query, wanted, hit): whether a result of a query (query, path) is the wanted file (query, path), ends with it at a slash,
    or has its base name."""
    base = lambda c: F.substring_index(c, "/", -1)
    w = wanted.select("query", F.col("path").alias("wanted"), base(F.col("path")).alias("_base")).distinct()
    r = ranked.select("query", F.col("path"), base(F.col("path")).alias("_base")).distinct()
    j = w.join(r, ["query", "_base"], "left")
    full = (F.col("path") == F.col("wanted")) | F.col("path").endswith(F.concat(F.lit("/"), F.col("wanted"))) | F.col("wanted").endswith(F.concat(F.lit("/"), F.col("path")))
    return j.groupBy("query", "wanted").agg(F.max(F.when(F.coalesce(full, F.lit(False)), 2).when(F.col("path").isNotNull(), 1).otherwise(0)).alias("_h")).select("query", "wanted", F.element_at(F.array(F.lit("none"), F.lit("basename"), F.lit("path")), F.col("_h") + 1).alias("hit"))


def token_stats(methods: DataFrame) -> DataFrame:
    """By file: methods, characters and estimated tokens of sources."""
    chars = F.length(F.coalesce("source", F.lit("")))
    return methods.groupBy("file_path").agg(F.count("*").alias("methods"), F.sum(chars).alias("chars"), F.sum(ids.estimated_tokens(chars)).alias("tokens"), F.floor(F.avg(ids.estimated_tokens(chars))).alias("mean_tokens"))


def context_proof(edges: DataFrame, methods: DataFrame) -> DataFrame:
    """By method: tokens of its callees' sources against those of the whole files they lie in."""
    m = methods.select(F.col("id").alias("dst"), "file_path", ids.estimated_tokens(F.length(F.coalesce("source", F.lit("")))).alias("tokens"))
    files = m.groupBy("file_path").agg(F.sum("tokens").alias("file_tokens"))
    called = edges.select("src", "dst").distinct().join(m, "dst")
    context = called.groupBy("src").agg(F.sum("tokens").alias("context_tokens"))
    whole = called.select("src", "file_path").distinct().join(files, "file_path").groupBy("src").agg(F.sum("file_tokens").alias("files_tokens"))
    return context.join(whole, "src").withColumn("saved_pct", percent(F.col("files_tokens") - F.col("context_tokens"), F.col("files_tokens")))


def line_estimate(methods: DataFrame) -> DataFrame:
    fit = (F.col("end_line") >= F.col("start_line")) & (F.col("start_line") > 0)
    return methods.groupBy("language").agg(F.sum(F.when(fit, F.col("end_line") - F.col("start_line") + 1).otherwise(0)).alias("lines"))


def nearest_rank(values: Column, share: float) -> Column:
    """The value at index floor(n * share) of the sorted values, not interpolated."""
    ordered = F.array_sort(values)
    return F.element_at(ordered, F.least(F.size(ordered), F.floor(F.size(ordered) * share).cast("int") + 1))


def ranked(df: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    """``df`` with ``rank``, from 1, of each row within its group. A group may hold most of all rows: rows are parted by range
    of group and order, each part is sorted by itself, and only the parts' sizes are summed within a group."""
    parted = cut(df.repartitionByRange(F.col(by), *order)).withColumn("_p", F.spark_partition_id())
    sizes = parted.groupBy(F.col(by).alias("_by"), F.col("_p").alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select("_by", "_part", before.alias("_before"))
    inside = parted.withColumn("_r", F.row_number().over(Window.partitionBy(by, "_p").orderBy(*order)))
    j = inside.join(sizes, F.col(by).eqNullSafe(F.col("_by")) & (F.col("_p") == F.col("_part")))
    return j.select(*df.columns, (F.col("_r") + F.col("_before")).alias("rank"))


def latency_summary(df: DataFrame, by: str, value: str) -> DataFrame:
    """(by, n, mean, p50, p95): exact nearest ranks. Equal values are counted first; what is left is summed in parts by range, as
    in :func:`ranked`, so no group is sorted by one task."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(by).alias("_by"), F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    parted = cut(counts.repartitionByRange("_by", "_v")).withColumn("_p", F.spark_partition_id())
    sizes = parted.groupBy(F.col("_by").alias("_of"), F.col("_p").alias("_part")).agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy("_of")
    sizes = sizes.select("_of", "_part", F.coalesce(F.sum("_n").over(w.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(w).alias("_all"))
    inside = parted.withColumn("_sum", F.sum("_c").over(Window.partitionBy("_by", "_p").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    j = inside.join(sizes, F.col("_by").eqNullSafe(F.col("_of")) & (F.col("_p") == F.col("_part")))
    at = lambda s: F.min(F.when(F.col("_sum") + F.col("_before") > F.least(F.floor(F.col("_all") * s), F.col("_all") - 1), F.col("_v")))
    return j.groupBy(F.col("_by").alias(by)).agg(F.sum("_c").alias("n"), (F.sum(F.col("_c") * F.col("_v")) / F.sum("_c")).alias("mean"), at(0.5).alias("p50"), at(0.95).alias("p95"))


def set_scores(found: Column, true: Column) -> Column:
    """Struct of precision, recall, hallucinated share and drift of two sets; empty against empty scores 1."""
    both = F.size(F.array_intersect(found, true))
    f, t = F.size(F.array_distinct(found)), F.size(F.array_distinct(true))
    union = F.size(F.array_union(found, true))
    return F.struct(
        F.when(f == 0, F.when(t == 0, 1.0).otherwise(0.0)).otherwise(both / f).alias("precision"),
        F.when(t == 0, 1.0).otherwise(both / t).alias("recall"),
        F.when(f == 0, 0.0).otherwise((f - both) / f).alias("hallucinated"),
        F.when(union == 0, 0.0).otherwise((union - both) / union).alias("drift"),
    )


def reciprocal_rank(ranked: DataFrame, relevant: DataFrame, on: Sequence[str] = ("query", "item")) -> DataFrame:
    """(query, rank, reciprocal, recall) of ranked results (query, item, rank) against relevant pairs (query, item)."""
    hit = ranked.join(relevant.select(*on).distinct(), list(on)).groupBy(on[0]).agg(F.min("rank").alias("rank"), F.count_distinct(on[1]).alias("hits"))
    want = relevant.groupBy(on[0]).agg(F.count_distinct(on[1]).alias("wanted"))
    out = want.join(hit, on[0], "left")
    return out.select(on[0], "rank", F.coalesce(1.0 / F.col("rank"), F.lit(0.0)).alias("reciprocal"), (F.coalesce("hits", F.lit(0)) / F.col("wanted")).alias("recall"))


def win_loss(a: DataFrame, b: DataFrame, key: str, passed: str) -> DataFrame:
    """One row: cases passed by both, only the first, only the second, neither; cases of either side count."""
    j = a.select(key, F.col(passed).alias("_a")).join(b.select(key, F.col(passed).alias("_b")), key, "full_outer")
    x, y = F.coalesce("_a", F.lit(False)), F.coalesce("_b", F.lit(False))
    return j.agg(F.count_if(x & y).alias("both"), F.count_if(x & ~y).alias("only_a"), F.count_if(~x & y).alias("only_b"), F.count_if(~x & ~y).alias("neither"))


def majority_root(df: DataFrame, path: str) -> DataFrame:
    """The most frequent first directory, if more than half of the paths have it."""
    root = F.substring_index(F.regexp_replace(F.translate(path, "\\", "/"), r"^\./", ""), "/", 1)
    counts = df.groupBy(root.alias("root")).agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy())).filter("share > 0.5")


def majority_ancestor(df: DataFrame, path: str) -> DataFrame:
    """(root, n, share): the longest directory that more than half of the paths lie in; none where there is no such directory."""
    parts = F.split(F.regexp_replace(F.translate(F.col(path), "\\", "/"), r"^(?:\./)+", ""), "/")
    own = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(own), F.lit(1))), lambda i: F.array_join(F.slice(own, 1, i), "/"))
    total = df.filter(F.col(path).isNotNull()).count()
    counts = df.filter(F.col(path).isNotNull()).filter(F.size(own) > 0).select(F.explode(above).alias("root")).groupBy("root").agg(F.count("*").alias("n"))
    most = counts.filter(2 * F.col("n") > total)  # nested directories only: at most one of each depth
    return most.orderBy(F.desc(F.length("root"))).limit(1).select("root", "n", (F.col("n") / F.lit(max(1, total))).alias("share"))
