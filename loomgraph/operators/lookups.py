"""Lookups over the code graph that answer many questions at once: selectors, members, implementations, noise.

Questions come as DataFrames, so that one pass over the graph answers all of them.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids
from ..session import cut
from . import walks
from .traversal import both_ways, closure, levels


def _keyed(methods: DataFrame) -> DataFrame:
    """(key, kind, id, ...): each method under all the names by which a selector may call it; kind 1 is the surest."""
    short = ids.short_name("class_full_name")
    names = [
        ("id", 1),
        ("signature", 2),
        (F.concat_ws(".", "class_full_name", "method_name"), 3),
        (F.concat_ws("#", "class_full_name", "method_name"), 3),
        (F.concat_ws(".", short, "method_name"), 4),
        (F.concat_ws("#", short, "method_name"), 4),
        ("method_name", 5),
    ]
    entry = F.explode(F.array(*(F.struct((F.col(n) if isinstance(n, str) else n).alias("key"), F.lit(k).alias("kind")) for n, k in names))).alias("e")
    return methods.select("id", "class_full_name", "method_name", F.coalesce("generated", F.lit(False)).alias("generated"), entry).select("e.*", "id", "class_full_name", "method_name", "generated").filter("key is not null")


def resolved_selectors(methods: DataFrame, selectors: DataFrame) -> DataFrame:
    """(selector, status, method_id, class, names) for each of ``selectors`` (selector).

    ``found``: the surest kind of match, of several the least id that isn't generated; ``generated``: the only match is;
    ``ambiguous``: several, all generated; ``class_without_method``: the class is there and doesn't declare the name
    (``names`` has those that it does); ``class``: the selector is a class; ``unknown``: none of these. ``methods`` has one
    row per id. A selector may meet very many methods; they are aggregated before anything is kept."""
    asked = selectors.select("selector").filter("selector is not null").distinct()
    hits = _keyed(methods).join(asked, F.col("key") == F.col("selector"))
    hits = hits.groupBy("selector", "kind").agg(F.min(F.when(~F.col("generated"), F.col("id"))).alias("own"), F.min("id").alias("any"), F.count_distinct("id").alias("n"))
    hits = hits.groupBy("selector").agg(F.min_by(F.struct("own", "any", "n"), "kind").alias("h"))
    owners = methods.select("class_full_name", "method_name").filter("class_full_name is not null")
    names = owners.groupBy("class_full_name").agg(F.array_sort(F.collect_set("method_name")).alias("names"))
    classes = names.select(F.explode(F.array_distinct(F.array("class_full_name", ids.short_name("class_full_name")))).alias("key"), "class_full_name", "names")
    classes = classes.groupBy("key").agg(F.min(F.struct("class_full_name", "names")).alias("c"))
    out = asked.join(hits, "selector", "left")
    part = F.when(F.instr("selector", "#") > 0, F.substring_index("selector", "#", 1)).when(F.instr("selector", ".") > 0, F.regexp_replace("selector", r"\.[^.]*$", ""))
    out = out.withColumn("part", part)
    out = out.join(classes.select(F.col("key").alias("part"), F.col("c").alias("owner")), "part", "left")
    out = out.join(classes.select(F.col("key").alias("selector"), F.col("c").alias("self")), "selector", "left")
    capital = F.regexp_replace("selector", r"^.*\.", "").rlike("^[A-Z]") & (F.instr("selector", "#") == 0)
    status = (
        F.when(F.col("h.own").isNotNull(), "found")
        .when(F.col("h.n") == 1, "generated")
        .when(F.col("h.n") > 1, "ambiguous")
        .when(capital & F.col("self").isNotNull(), "class")
        .when(F.col("owner").isNotNull(), "class_without_method")
        .otherwise("unknown")
    )
    out = out.withColumn("status", status)
    class_ = F.when(F.col("status") == "class", F.col("self")).when(F.col("status") == "class_without_method", F.col("owner"))
    return out.select("selector", "status", F.when(F.col("status").isin("found", "generated"), F.coalesce("h.own", "h.any")).alias("method_id"), class_.getField("class_full_name").alias("class"), class_.getField("names").alias("names"))


def class_members(methods: DataFrame, classes: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(class, kind, name, detail, line): methods and, where ``fields`` (class_full_name, name, type_name, line) are given,
    fields of each class that is in the graph."""
    known = classes.select(F.col("full_name").alias("class")).filter("class is not null").distinct()
    m = methods.select(F.col("class_full_name").alias("class"), F.lit("method").alias("kind"), F.col("method_name").alias("name"), F.col("signature").alias("detail"), F.col("start_line").alias("line"))
    if fields is not None:
        m = m.unionByName(fields.select(F.col("class_full_name").alias("class"), F.lit("field").alias("kind"), "name", F.col("type_name").alias("detail"), "line"))
    return m.join(known, "class", "left_semi").distinct()


def implementations(classes: DataFrame, inheritance: DataFrame, transitive: bool = False) -> DataFrame:
    """(type, implementer, distance): by short name, as clauses are written, the classes that extend or implement each type.

    Short names meet short names, so types of equal short names share their implementers. ``transitive`` follows them
    down. Short names lead into each other densely, so the result is the square of the graph: each task has the graph at
    hand and writes the rows of some implementers without storing any; a graph too large for that is walked hop by hop."""
    names = classes.select("full_name").filter("full_name is not null").distinct().withColumn("short", ids.short_name("full_name"))
    direct = inheritance.filter(F.col("relation").isin("implements", "extends")).select(ids.short_name("target").alias("type"), F.col("source").alias("implementer")).distinct()
    direct = direct.join(names.select(F.col("full_name").alias("implementer")), "implementer", "left_semi")
    if not transitive:
        return direct.select("type", "implementer", F.lit(1).alias("distance"))
    direct = cut(direct.filter("type is not null"))
    if direct.count() <= walks.AT_HAND:
        return _implementations_at_hand(direct)
    short = direct.select(F.col("type").alias("src"), ids.short_name("implementer").alias("dst")).distinct()
    reach = closure(short).unionByName(short.select("src", F.col("src").alias("dst"), F.lit(0).alias("depth")).distinct())
    down = reach.join(direct.select(F.col("type").alias("dst"), "implementer"), "dst")
    return down.groupBy(F.col("src").alias("type"), "implementer").agg((F.min("depth") + 1).alias("distance"))


def _implementations_at_hand(direct: DataFrame) -> DataFrame:
    """All (type, implementer, distance) that follow from ``direct`` (type, implementer); no type meets another in a join.

    Each task walks up from some implementers and returns their rows type by type, for as many implementers at once as are
    walked together. So each name stands in runs or comes again soon, and the names of a task fit a Parquet dictionary: the
    result, which is all that is stored, takes less than a byte a row. All implementers of one type at a time would be
    written out in full."""
    import pyarrow as pa

    spark = direct.sparkSession
    rows = direct.select("type", "implementer", ids.short_name("implementer").alias("short")).toArrow()
    types, shorts = rows.column("type").to_pylist(), rows.column("short").to_pylist()
    names, (of, below) = walks.coded(types, shorts)
    implementers, (who,) = walks.coded(rows.column("implementer").to_pylist())
    by = np.argsort(who, kind="stable")  # each implementer's clauses stand together
    ends = np.searchsorted(who[by], np.arange(len(implementers)), side="right")
    sources = np.unique(of)
    tasks = [(i, j, k, n) for i, j in walks.parts(implementers, walks.A_TASK) for k, n in walks.parts([names[s] for s in sources])]
    shared = spark.sparkContext.broadcast((walks.Graph(len(names), below, of), of[by], ends, pa.array([names[s] for s in sources], pa.string()), sources, pa.array(implementers, pa.string()), tasks))

    def run(batches: Iterator) -> Iterator:
        graph, clauses, ends, types, sources, implementers, tasks = shared.value
        for batch in batches:
            for first, last, low, high in (tasks[x] for x in batch.column(0).to_pylist()):
                for i in range(first, last, graph.together):
                    own = range(i, min(last, i + graph.together))
                    far = graph.distances([clauses[ends[x - 1] if x else 0 : ends[x]] for x in own]).T[sources[low:high]]
                    found = np.flatnonzero(far < walks.FAR)
                    for j in range(0, len(found), 65_536):
                        some = found[j : j + 65_536]
                        type_, implementer = np.divmod(some, far.shape[1])
                        yield pa.RecordBatch.from_arrays([types.take(pa.array(type_ + low)), implementers.take(pa.array(implementer + i)), pa.array(far.ravel()[some] + 1, pa.int32())], names=["type", "implementer", "distance"])

    return spark.range(0, len(tasks), 1, max(1, len(tasks))).mapInArrow(run, "type string, implementer string, distance int")


def declared_types(classes: DataFrame) -> DataFrame:
    """(short, full_name): of the classes of a short name an interface first, then an abstract class, then by full name."""
    rank = F.when(F.array_contains("stereotypes", "interface"), 0).when(F.array_contains("stereotypes", "abstract"), 1).otherwise(2)
    c = classes.filter("full_name is not null").select(ids.short_name("full_name").alias("short"), "full_name", F.coalesce(rank, F.lit(2)).alias("rank"))
    return c.groupBy("short").agg(F.min_by("full_name", F.struct("rank", "full_name")).alias("full_name"))


def implementer_methods(methods: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(method_name, arity, n, sole): methods of classes that implement something, by name and arity; ``sole`` where there is one."""
    impl = inheritance.filter("relation = 'implements'").select(F.col("source").alias("class_full_name")).distinct()
    m = methods.join(impl, "class_full_name", "left_semi")
    many = m.groupBy("method_name", F.size(F.coalesce("parameter_types", F.array().cast("array<string>"))).alias("arity")).agg(F.count_distinct("id").alias("n"), F.min("id").alias("id"))
    return many.select("method_name", "arity", "n", F.when(F.col("n") == 1, F.col("id")).alias("sole"))


def callees_in(edges: DataFrame, methods: DataFrame, ending: str) -> DataFrame:
    """Edges into methods of classes whose full name ends with ``ending``."""
    m = methods.filter(F.col("class_full_name").endswith(ending)).select(F.col("id").alias("dst"), F.col("class_full_name").alias("callee_class"), F.col("method_name").alias("callee"))
    return edges.join(m.distinct(), "dst")


def implementers_of(inheritance: DataFrame, names: DataFrame) -> DataFrame:
    """(name, source): sources of edges whose target is ``name``, or ends with a dot and its short name: two equi-joins."""
    n = names.select("name").filter("name is not null").distinct()
    exact = n.join(inheritance.select(F.col("target").alias("name"), "source"), "name")
    dotted = inheritance.filter("target like '%.%'").select(ids.short_name("target").alias("short"), "source")
    return exact.unionByName(n.withColumn("short", ids.short_name("name")).join(dotted, "short").select("name", "source")).distinct()


def focused(edges: DataFrame, nodes: DataFrame, root: DataFrame, depth: int) -> DataFrame:
    """(id): nodes less than ``depth`` hops from the roots in either direction, the whole graph where there is no root."""
    if root.isEmpty():
        return nodes.select("id").distinct()
    return levels(both_ways(edges), root, max(0, depth - 1)).select("id")


# What says that a call isn't about a program's own business.
NON_BUSINESS_PARTS = (".metrics.", ".datadog.", ".config.datadog.", ".prometheus.", ".logging.", ".log.", ".utils.", ".constants.", "metricsclient#")
NON_BUSINESS_NAMES = ("getmarker", "increment", "decrement", "recordexecutiontime", "build")
ERROR_NOISE_RECEIVERS = ("builder", "log", "Thread", "metrics")
ERROR_NOISE_NAMES = ("warn", "error", "info", "debug", "trace", "increment", "sleep", "currentThread", "interrupt")
EXCEPTION_READS = ("getMessage", "getCause", "getStackTrace")
UTILITY_TYPES = ("Optional", "Mono", "Flux", "String", "UUID", "StringBuilder")
UTILITY_PREFIXES = ("java.", "javax.", "jakarta.", "org.slf4j.", "ch.qos.logback.", "reactor.", "io.micrometer.", "net.logstash.", "org.apache.commons.")
UNIMPORTANT_NAMES = ("debug", "info", "warn", "error", "trace", "append", "appendentries", "increment", "decrement", "recordexecutiontime", "tostring", "hashcode", "getclass", "getmessage", "getsimplename", "addall", "orelse", "orelseget", "orelsethrow", "map", "flatmap", "filter", "stream", "collect")


def business_call(call: Column, signature: Column) -> Column:
    """Whether a call is about the program's own business, by its name and the signature of its target."""
    low = F.lower(F.coalesce(signature, F.lit("")))
    parts = F.exists(F.array(*map(F.lit, NON_BUSINESS_PARTS)), lambda p: F.contains(low, p))
    return ~F.coalesce(F.lower(call).isin(*NON_BUSINESS_NAMES), F.lit(False)) & ~parts


def error_noise(call: Column, receiver: Column, receiver_type: Column) -> Column:
    """Whether a call is left out of what is written about errors."""
    r, ty, c = (F.coalesce(x, F.lit("")) for x in (receiver, receiver_type, call))
    prefix = F.exists(F.array(*map(F.lit, ERROR_NOISE_RECEIVERS)), lambda p: (r == p) | r.startswith(F.concat(p, F.lit("."))) | r.startswith(F.concat(p, F.lit("("))))
    read = (r == "e") & c.isin(*EXCEPTION_READS)
    return prefix | read | F.concat_ws(" ", r, ty, c).contains("Health.Builder") | c.isin(*ERROR_NOISE_NAMES)


def unimportant(call: Column, receiver: Column, receiver_type: Column, targets: Column) -> Column:
    """Why an unresolved call isn't worth a report, null if it is; ``targets`` is the number of its possible targets."""
    c, r, ty = F.trim(F.coalesce(call, F.lit(""))), F.coalesce(receiver, F.lit("")), F.coalesce(receiver_type, F.lit(""))
    blob = F.lower(F.concat_ws(" ", r, ty))
    simple = F.substring_index(F.substring_index(ty, "<", 1), ".", -1)
    prefix = F.exists(F.array(*map(F.lit, UTILITY_PREFIXES)), lambda p: F.startswith(F.lower(ty), p))
    return (
        F.when(c == "", "empty_call")
        .when(F.lower(c).isin(*UNIMPORTANT_NAMES), F.concat(F.lit("call:"), F.lower(c)))
        .when(blob.contains("marker") | blob.contains("metrics") | blob.contains("log"), "receiver_noise")
        .when(simple.isin(*UTILITY_TYPES), F.concat(F.lit("utility_type:"), simple))
        .when(prefix, F.concat(F.lit("type_prefix:"), ty))
        .when(c.rlike("^set[A-Z]") & ((ty == "") | (F.coalesce(targets, F.lit(0)) <= 0)), "setter_chain")
    )


def excluded(signature: Column, path: Column, config: Mapping[str, Sequence[str]]) -> Column:
    """Why a configuration excludes a method, null if it doesn't: whole signatures, parts of packages, patterns of class
    names, patterns of method names, in this order."""
    class_part = F.substring_index(signature, "#", 1)
    method = F.when(signature.contains("#"), F.substring_index(F.substring_index(signature, "#", -1), "(", 1)).otherwise(signature)
    out = F.when(signature.isin(*config.get("signatures", ["\0"])), F.lit("signature"))
    for part in config.get("package_contains", ()):
        out = out.when(signature.contains(part) | F.coalesce(path.contains(part), F.lit(False)), F.lit(f"package:{part}"))
    for pattern in config.get("class_name_patterns", ()):
        out = out.when(ids.short_name(class_part).rlike(pattern) | class_part.rlike(pattern) | signature.rlike(pattern), F.lit(f"class_pattern:{pattern}"))
    for pattern in config.get("method_name_patterns", ()):
        out = out.when(method.rlike(pattern) | signature.rlike(pattern), F.lit(f"method_pattern:{pattern}"))
    return out


def spot_check(manifest: DataFrame, seed: int = 0) -> DataFrame:
    """One entry of a manifest, chosen by the hash of its path and a seed: a sampling operator that needs no sort of all."""
    return manifest.orderBy(F.xxhash64("path", F.lit(seed)), "path").limit(1)


def top_first(nodes: DataFrame, wanted: int, by: Sequence[str] = ("id",)) -> DataFrame:
    """The ``wanted`` nodes (tier, rank) of a report: those that aren't utilities by falling rank, then the others."""
    utility = F.when(F.col("tier") == "utility", 1).otherwise(0)
    return nodes.orderBy(utility, F.desc("rank"), *by).limit(max(1, wanted))


def tier_priority(tier: Column) -> Column:
    t = F.lower(F.coalesce(tier, F.lit("")))
    return F.when(t == "primary", 0).when(t == "supporting", 1).when(t == "utility", 2).otherwise(3)


def expansion_queue(nodes: DataFrame, root: str, most: int = 8, utilities: bool = False) -> DataFrame:
    """The nodes (id, signature, tier, rank) to follow next: each once, not the root, by tier, rank and signature."""
    n = nodes.filter((F.col("id") != root) & (F.lit(utilities) | (F.coalesce("tier", F.lit("unknown")) != "utility")))
    first = F.max_by(F.struct("signature", "tier", "rank"), F.col("rank")).alias("b")
    n = n.groupBy("id").agg(first).select("id", "b.*")
    return n.orderBy(tier_priority(F.col("tier")), F.desc("rank"), "signature", "id").limit(most)


def suggested_next(parts: DataFrame, most: int = 15) -> DataFrame:
    """``parts`` (id, signature, tier, rank, reason, seq): each method once, as it first came, by tier, rank and signature."""
    one = parts.filter("id is not null or signature is not null").groupBy("id", "signature").agg(F.min_by(F.struct("tier", "rank", "reason"), "seq").alias("b"))
    return one.select("id", "signature", "b.*").orderBy(tier_priority(F.col("tier")), F.desc("rank"), F.coalesce("signature", F.lit("")), "id").limit(most)
