"""Reports on flows and graphs: traces by mode, mind maps, summaries of what is uncertain, roll-ups of evaluations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from . import lookups, traversal

# What a call's text shows it to be about.
OBSERVED = ("log.", "logger.", "markers.", "metricsclient.", "statsdclient.", "counter.", "metrics.", "recordexecutiontime", "logsetnames")
USEFUL_NAMES = ("orelse", "map", "stream", "collect", "get", "ispresent", "filter", "flatmap", "emptylist", "emptyset", "emptymap", "currenttimemillis", "getclass", "getsimplename", "and")
USEFUL_TYPES = ("optional", "collections", "list", "map", "set", "stringutils", "collectionutils", "stream")
BUSINESS = ("controller", "service", "component", "repository", "processor", "client", "container", "ranking")
FIRST = ("service", "repository", "controller", "component", "processor")


def _has(c: Column, parts: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, (c.contains(p) for p in parts))


def call_category(callee: Column, receiver: Column, receiver_type: Column, status: Column, candidates: Column) -> Column:
    """What a call is in a flow: observability, utility, business_internal, probable_internal, external_library,
    unresolved_business, unknown or framework. ``candidates`` is their number."""
    name, r, ty, s = (F.coalesce(x, F.lit("")) for x in (callee, receiver, receiver_type, status))
    text = F.lower(F.trim(F.concat_ws(".", r, name), F.lit(".")))
    kinds = F.lower(F.concat_ws(" ", ty, r))
    watched = _has(text, OBSERVED) | F.lower(name).contains("log") | F.lower(name).contains("metric")
    useful = F.lower(name).isin(*USEFUL_NAMES) | _has(kinds, USEFUL_TYPES)
    ours = _has(F.lower(F.concat_ws(" ", ty, r, name)), BUSINESS)
    return (
        F.when(watched, "observability").when(useful, "utility")
        .when(s.startswith("resolved"), F.when(ours, "business_internal").otherwise("probable_internal"))
        .when((s == "ambiguous_type") & (F.coalesce(candidates, F.lit(0)) > 0), "probable_internal")
        .when(s == "external_library", "external_library")
        .when(s.startswith("unresolved"), F.when(ours, "unresolved_business").otherwise("unknown"))
        .otherwise("framework")
    )


def call_kind(status: Column) -> Column:
    s = F.coalesce(status, F.lit(""))
    return F.when(s.startswith("resolved"), "internal").when(s == "external_library", "external").otherwise("unresolved")


def call_priority(status: Column, receiver: Column, receiver_type: Column) -> Column:
    """The order in which a flow follows calls: 0 first."""
    first = _has(F.lower(F.concat_ws(" ", F.coalesce(receiver_type, F.lit("")), F.coalesce(receiver, F.lit("")))), FIRST)
    kind = call_kind(status)
    return F.when(kind == "internal", F.when(first, 0).otherwise(1)).when(kind == "unresolved", F.when(first, 2).otherwise(3)).otherwise(4)


#: The categories of calls with a target that each mode follows.
FOLLOWED = {"compact": ("business_internal", "probable_internal"), "full": ("business_internal", "probable_internal", "unresolved_business")}


def built_flow(calls: DataFrame, roots: DataFrame, depth: int = 5, mode: str = "compact", observability: bool = False) -> DataFrame:
    """The flow from each of ``roots`` (id): root, depth, src, dst, call, category, kind, status, priority, times, lines.

    ``calls`` needs callsite_id, caller_method_id, callee_name, receiver, receiver_type, status, candidates and line. A call
    leads to its first candidate. ``compact`` follows internal calls, ``full`` also shows unresolved ones of business
    classes, ``debug`` follows and shows all. Calls between the same two methods under one name are one row with their
    lines. A method is followed from the least depth at which it is reached; rows of calls that end there have a null
    ``dst``."""
    if mode not in ("compact", "full", "debug"):
        raise ValueError("mode must be compact, full or debug")
    c = calls.select("caller_method_id", "callee_name", "receiver", "receiver_type", "status", F.get("candidates", 0).alias("dst"), F.size("candidates").alias("n"), "line")
    c = c.withColumn("category", call_category(F.col("callee_name"), F.col("receiver"), F.col("receiver_type"), F.col("status"), F.col("n")))
    c = c.withColumns({"kind": call_kind(F.col("status")), "priority": call_priority(F.col("status"), F.col("receiver"), F.col("receiver_type"))})
    watched, useful = F.col("category") == "observability", F.col("category") == "utility"
    open_ = (~watched | F.lit(observability)) & (~useful | F.lit(mode == "debug"))
    to = F.col("dst").isNotNull()
    wanted = F.lit(True) if mode == "debug" else F.col("category").isin(*FOLLOWED[mode]) | (watched & F.lit(observability))
    shown_open = (F.lit(mode in ("full", "debug")) & (F.col("category") == "unresolved_business")) | (watched & F.lit(observability))
    c = cut(c.filter(open_ & F.when(to, wanted).otherwise(shown_open)))
    edges = c.filter(to).select(F.col("caller_method_id").alias("src"), "dst").distinct()
    reach = walked_from(edges, roots, depth - 1) if depth > 0 else roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).limit(0)
    rows = reach.select("root", F.col("id").alias("caller_method_id"), (F.col("depth") + 1).alias("depth")).join(c, "caller_method_id")
    lines = F.array_sort(F.collect_list("line")).alias("lines")
    flow = rows.groupBy("root", "depth", F.col("caller_method_id").alias("src"), "dst", F.col("callee_name").alias("call")).agg(F.min("category").alias("category"), F.min("kind").alias("kind"), F.min("status").alias("status"), F.min("priority").alias("priority"), F.count("*").alias("times"), lines)
    confidence = F.when((F.col("status") == "ambiguous_type") & F.col("dst").isNotNull(), 0.75).otherwise(1.0)
    return flow.withColumn("confidence", confidence)


def walked_from(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(root, id, depth): what each root reaches within ``depth`` hops, itself included, with the least number of hops."""
    own = roots.select(F.col("id").alias("root"), "id", F.lit(0).alias("depth")).distinct()
    if depth <= 0:
        return own
    far = traversal.closure(edges, roots.select("id").distinct(), depth).filter("src <> dst").select(F.col("src").alias("root"), F.col("dst").alias("id"), "depth")
    return own.unionByName(far)


def flow_stats(flow: DataFrame, calls: DataFrame) -> DataFrame:
    """(root, steps, deduplicated, external, unresolved, observability, utility): what a flow shows and the calls of its
    methods that it leaves out, by kind; ``calls`` as for :func:`built_flow`."""
    seen = flow.select("root", F.col("src").alias("caller_method_id")).distinct()
    c = calls.select("caller_method_id", "status", F.size("candidates").alias("n"), call_category(F.col("callee_name"), F.col("receiver"), F.col("receiver_type"), F.col("status"), F.size("candidates")).alias("category"))
    kept = ~F.col("category").isin("observability", "utility")
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    rest = seen.join(c, "caller_method_id").groupBy("root").agg(count(kept & (call_kind(F.col("status")) == "external")).alias("external"), count(kept & (F.col("n") <= 0) & (call_kind(F.col("status")) == "unresolved")).alias("unresolved"), count(F.col("category") == "observability").alias("observability"), count(F.col("category") == "utility").alias("utility"))
    steps = flow.groupBy("root").agg((F.count("*") + 1).alias("steps"), F.sum(F.col("times") - 1).alias("deduplicated"))
    return steps.join(rest, "root", "left").fillna(0)


def map_tier(signature: Column) -> Column:
    """The tier of a method in a mind map, by its package."""
    s = F.lower(F.coalesce(signature, F.lit("")))
    return F.when(s.contains(".controller.") | s.contains(".service."), "primary").when(s.contains(".components.") | s.contains(".processor."), "supporting").otherwise("utility")


def mind_map(methods: DataFrame, edges: DataFrame, roots: DataFrame, depth: int, most: int | None = None, utilities: bool = True, config: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """(root, id, signature, depth, tier, position): what a root leads to, ``most`` methods of each root by depth and signature
    (a report's limit; None gives all). Methods that the configuration excludes, and utilities unless wanted, end the walk."""
    m = methods.select("id", "signature", "file_path").dropDuplicates(["id"])
    m = m.withColumn("tier", map_tier(F.col("signature")))
    out = F.lit(False)
    if config:
        out = out | lookups.excluded(F.col("signature"), F.col("file_path"), config).isNotNull()
    if not utilities:
        out = out | (F.col("tier") == "utility")
    kept = m.filter(~F.coalesce(out, F.lit(False))).select("id")
    inside = edges.select("src", "dst").distinct().join(kept.withColumnRenamed("id", "dst"), "dst", "left_semi")
    nodes = walked_from(inside, roots, depth).join(m, "id").select("root", "id", "signature", "depth", "tier")
    if most is None:
        return nodes
    one = nodes.groupBy("root").agg(F.slice(F.array_sort(F.collect_list(F.struct("depth", "signature", "id", "tier"))), 1, most).alias("n"))  # within the report's depth
    return one.select("root", F.posexplode("n").alias("position", "n")).select("root", "n.id", "n.signature", "n.depth", "n.tier", "position")


def uncertain_edges(calls: DataFrame) -> DataFrame:
    """(src, call, reason, n): calls that lead nowhere, by caller, name and reason."""
    lost = calls.filter(F.coalesce(F.size("candidates"), F.lit(0)) <= 0)
    return lost.groupBy(F.col("caller_method_id").alias("src"), F.col("callee_name").alias("call"), "reason").agg(F.count("*").alias("n"))


def uncertain_summary(edges: DataFrame, most: int = 8) -> DataFrame:
    """(call, reason, n, total, omitted): the most frequent uncertain calls (a report's limit), of how many, and how many kinds
    are left out."""
    g = cut(edges.groupBy(F.coalesce("call", F.lit("unknown")).alias("call"), F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.sum("n").alias("n")))
    total, kinds = g.agg(F.sum("n"), F.count("*")).first()
    first = g.orderBy(F.desc("n"), "call", "reason").limit(max(1, most))
    return first.withColumns({"total": F.lit(total or 0), "omitted": F.lit(max(0, kinds - max(1, most)))})


def important_unresolved(calls: DataFrame, ranks: DataFrame, most: int = 10) -> DataFrame:
    """The unresolved calls (caller_method_id, callee_name, receiver, receiver_type, candidates, line) most worth a look, by the
    tier and rank of their callers, then name and line; those that say nothing are left out (a report's limit)."""
    why = lookups.unimportant(F.col("callee_name"), F.col("receiver"), F.col("receiver_type"), F.size("candidates"))
    c = calls.filter(F.coalesce(F.size("candidates"), F.lit(0)) != 1).filter(why.isNull())
    j = c.join(ranks.select(F.col("id").alias("caller_method_id"), "tier", "rank"), "caller_method_id")
    return j.orderBy(lookups.tier_priority(F.col("tier")), F.desc("rank"), "callee_name", "line", "caller_method_id").limit(most)


def stopped_summary(stops: DataFrame) -> DataFrame:
    """(reason, n) of paths (id, reason) that ended."""
    return stops.groupBy(F.coalesce("reason", F.lit("unknown")).alias("reason")).agg(F.count("*").alias("n"))


def flow_document(nodes: DataFrame, edges: DataFrame, root: str, subflows: int = 8, depth: int = 2, utilities: bool = False) -> DataFrame:
    """(section, id, depth): a root's flow and the flows of the methods that its ranking puts next (a report's limit);
    ``nodes`` has id, signature, tier and rank."""
    spark = nodes.sparkSession
    start = spark.createDataFrame([(root,)], "id string")
    queue = lookups.expansion_queue(nodes, root, subflows, utilities).select("id")
    parts = walked_from(edges, start, depth).select(F.lit("root").alias("section"), "id", "depth")
    return parts.unionByName(walked_from(edges, queue, depth).select(F.col("root").alias("section"), "id", "depth"))


def method_context(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """(caller, target, signature, times, lines, noisy): what each method calls, the calls of one target together; targets whose
    signatures say little are marked and come last."""
    m = methods.select(F.col("id").alias("target"), "signature").dropDuplicates(["target"])
    c = calls.select(F.col("caller_method_id").alias("caller"), F.explode("candidates").alias("target"), "line").join(m, "target")
    g = c.groupBy("caller", "target", "signature").agg(F.count("*").alias("times"), F.array_sort(F.collect_set("line")).alias("lines"))
    low = F.lower(F.coalesce("signature", F.lit("")))
    return g.withColumn("noisy", _has(low, (".metrics.", ".utils.", ".constants.", ".datadog.", ".logging.", ".log.")))


# ---------------------------------------------------------------- roll-ups


def resolution_counts(calls: DataFrame) -> DataFrame:
    """One row: total, resolved (status not unresolved...), unresolved, second_pass, impl_suffix, cha."""
    s = F.coalesce("resolution_status", F.lit(""))
    lost = s.startswith("unresolved")
    flag = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    return calls.agg(F.count("*").alias("total"), flag(~lost).alias("resolved"), flag(lost).alias("unresolved"), flag(F.col("resolution_reason").startswith("second-pass")).alias("second_pass"), flag(s == "resolved_impl_suffix").alias("impl_suffix"), flag(s == "resolved_cha").alias("cha"))


def validation_report(classes: DataFrame, beans: DataFrame, edges: DataFrame, kept: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts: classes, beans, edges (with ``phantom``) before and after, removed, call sites dropped and upgraded;
    ``kept`` are call sites after, ``before`` and ``after`` (callsite_id, status) the states."""
    count = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("_k", F.lit(1))
    parts = [
        count(classes.select("full_name").distinct(), "classes"),
        count(beans, "beans"),
        edges.agg(F.count("*").alias("edges_before"), F.count_if(~F.col("phantom")).alias("edges_after"), F.count_if("phantom").alias("edges_removed")).withColumn("_k", F.lit(1)),
        count(before.join(kept, "callsite_id", "left_anti"), "callsites_dropped"),
        count(after.filter("status = 'actuator_resolved'"), "callsites_upgraded"),
    ]
    return reduce(lambda a, b: a.join(b, "_k"), parts).drop("_k")


def repository_scores(cases: DataFrame) -> DataFrame:
    """(repo, total, passed, a and b: mean recall, wins; ties) of cases (repo, winner, a_pass, b_pass, a_recall, b_recall) that both
    sides have."""
    both = cases.filter("repo <> '' and winner in ('a', 'b', 'tie')")
    wins = lambda w: F.count_if(F.col("winner") == w)
    return both.groupBy("repo").agg(F.count("*").alias("total"), F.count_if("a_pass").alias("a_passed"), F.count_if("b_pass").alias("b_passed"), F.round(F.avg(F.coalesce("a_recall", F.lit(0.0))), 4).alias("a_mean_recall"), F.round(F.avg(F.coalesce("b_recall", F.lit(0.0))), 4).alias("b_mean_recall"), wins("a").alias("a_wins"), wins("b").alias("b_wins"), wins("tie").alias("ties"))


def conditional_means(cases: DataFrame) -> DataFrame:
    """(repo, total, pass_rate, mean_recall, mean_mrr over searches, explore_recall over explorations; 0 where there are none)."""
    of = lambda c, tool: F.coalesce(F.avg(F.when(F.col("tool") == tool, F.col(c))), F.lit(0.0))
    return cases.groupBy("repo").agg(F.count("*").alias("total"), F.avg(F.col("passed").cast("double")).alias("pass_rate"), F.avg("recall").alias("mean_recall"), of("mrr", "search").alias("mean_mrr"), of("recall", "explore").alias("explore_recall"))


def merged_graphs(*graphs: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of several graphs (one of each language) together, by name, with all columns that any has."""
    out: dict[str, DataFrame] = {}
    for g in graphs:
        for name, df in g.items():
            out[name] = out[name].unionByName(df, allowMissingColumns=True) if name in out else df
    return out


def updated_event(events: DataFrame, kind: str, changes: Mapping[str, Column]) -> DataFrame:
    """``events`` (id, kind, ts, ...) with the latest of a kind changed (ties: the greatest id)."""
    last = events.filter(F.col("kind") == kind).agg(F.max_by("id", F.struct("ts", "id")).alias("_last"))  # one row
    j = events.join(F.broadcast(last), F.col("id") == F.col("_last"), "left")
    hit = F.col("_last").isNotNull()
    return j.select(*(F.when(hit, changes[c]).otherwise(F.col(c)).alias(c) if c in changes else F.col(c) for c in events.columns))
