"""Walks over call graphs and hierarchies as frontier loops: one join per hop, lineage cut as they go.

Edges are DataFrames (src, dst). Every loop stops on an empty frontier. A node's edges may be a third of all rows: the
frontier (distinct ids) is the smaller side, and adaptive execution splits skewed partitions of the edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def both_ways(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.union(reversed_edges(e)).distinct()


class _Seen:
    """What a walk has reached so far: each frontier is stored once, and all are read together; every few hops they are brought
    together, so that a long walk doesn't read ever more parts."""

    MERGED = 8

    def __init__(self, first: DataFrame) -> None:
        self.parts = [first]

    def add(self, frontier: DataFrame) -> None:
        self.parts.append(frontier)
        if len(self.parts) > self.MERGED:
            self.parts = [cut(self.all().coalesce(max(1, int(frontier.sparkSession.conf.get("spark.sql.shuffle.partitions")))))]

    def all(self) -> DataFrame:
        out = self.parts[0]
        for p in self.parts[1:]:
            out = out.unionByName(p)
        return out


def levels(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, depth): nodes within ``depth`` hops of the seeds (id) with their least number of hops; seeds have 0."""
    e = cut(edges.select("src", "dst").distinct())
    frontier, hop = cut(seeds.select("id", F.lit(0).alias("depth")).distinct()), 0
    seen = _Seen(frontier)
    while depth is None or hop < depth:
        hop += 1
        reached = e.join(frontier.select("id"), F.col("src") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct()
        frontier = cut(reached.join(seen.all(), "id", "left_anti").select("id", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def callers(edges: DataFrame, seeds: DataFrame, depth: int = 1) -> DataFrame:
    """Nodes from which the seeds are reached within ``depth`` calls, without the seeds."""
    return levels(reversed_edges(edges), seeds, max(1, depth)).filter("depth > 0")


def neighbourhood(edges: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes within ``depth`` hops in either direction, without the seeds."""
    return levels(both_ways(edges), seeds, depth).filter("depth > 0")


def subgraph(edges: DataFrame, seeds: DataFrame, depth: int) -> tuple[DataFrame, DataFrame]:
    """The nodes within ``depth`` hops in either direction, seeds included, and the edges among them."""
    nodes = levels(both_ways(edges), seeds, depth)
    inside = edges.select("src", "dst").join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi").distinct()
    return nodes, inside


def shortest_paths(edges: DataFrame, seeds: DataFrame, depth: int = 6) -> DataFrame:
    """(id, path): a shortest path from a seed to each node within ``depth`` hops; of several the least one."""
    e = cut(edges.select("src", "dst").distinct())
    frontier = cut(seeds.select("id", F.array("id").alias("path")).distinct())
    seen = _Seen(frontier)
    for _ in range(depth):
        step = e.join(frontier, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), F.concat("path", F.array("dst")).alias("path"))
        best = step.groupBy("id").agg(F.min("path").alias("path"))
        frontier = cut(best.join(seen.all().select("id"), "id", "left_anti"))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def path_edges(paths: DataFrame, calls: DataFrame) -> DataFrame:
    """(id, step, src, dst, callsite_id, line): the edges of paths (id, path) with a call for each (calls: src, dst, callsite_id,
    line), the first by line."""
    pairs = F.zip_with(F.slice("path", 1, F.greatest(F.size("path") - 1, F.lit(0))), F.slice("path", 2, F.greatest(F.size("path") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("src"), b.alias("dst")))
    steps = paths.select("id", F.posexplode(pairs).alias("step", "e")).select("id", "step", "e.src", "e.dst")
    first = calls.groupBy("src", "dst").agg(F.min_by(F.struct("callsite_id", "line"), F.struct("line", "callsite_id")).alias("c"))
    return steps.join(first, ["src", "dst"], "left").select("id", "step", "src", "dst", "c.callsite_id", "c.line")


def closure(edges: DataFrame, seeds: DataFrame | None = None, depth: int | None = None) -> DataFrame:
    """(src, dst, depth): what each seed (or each source) reaches, with the least number of hops. Cycles end by themselves."""
    e = cut(edges.select("src", "dst").distinct())
    start = e if seeds is None else e.join(seeds.select(F.col("id").alias("src")), "src", "left_semi")
    frontier, hop = cut(start.select("src", "dst", F.lit(1).alias("depth"))), 1
    seen = _Seen(frontier)
    while depth is None or hop < depth:
        hop += 1
        onward = e.select(F.col("src").alias("dst"), F.col("dst").alias("next"))
        reached = frontier.select("src", "dst").join(onward, "dst").select("src", F.col("next").alias("dst")).distinct()
        frontier = cut(reached.join(seen.all(), ["src", "dst"], "left_anti").select("src", "dst", F.lit(hop).alias("depth")))
        if frontier.isEmpty():
            break
        seen.add(frontier)
    return seen.all()


def deep_closure(edges: DataFrame) -> DataFrame:
    """What :func:`closure` gives without seeds and limit, by doubling: each round joins all that is known with itself, so that
    chains of n hops take log2(n) rounds. For hierarchies; in a dense graph the joins are larger than one hop's."""
    seen, before = cut(edges.select("src", "dst").distinct().withColumn("depth", F.lit(1))), None
    while (now := tuple(seen.agg(F.count("*"), F.sum("depth")).first())) != before:
        onward = seen.select(F.col("src").alias("dst"), F.col("dst").alias("next"), F.col("depth").alias("more"))
        longer = seen.join(onward, "dst").select("src", F.col("next").alias("dst"), (F.col("depth") + F.col("more")).alias("depth"))
        before, seen = now, cut(seen.unionByName(longer).groupBy("src", "dst").agg(F.min("depth").alias("depth")))
    return seen


def bridges(edges: DataFrame, removed: DataFrame, most: int | None = None) -> DataFrame:
    """(src, dst): edges among the nodes that stay, and those that lead from one to another over removed nodes (id) only, over
    ``most`` of them if given."""
    gone = cut(removed.select("id").distinct())
    e = cut(edges.select("src", "dst").distinct())
    starts = e.join(gone, F.col("src") == F.col("id"), "left_anti")
    done = starts.join(gone, F.col("dst") == F.col("id"), "left_anti")
    frontier = cut(starts.join(gone, F.col("dst") == F.col("id"), "left_semi"))
    seen = _Seen(frontier)
    inner = e.join(gone, F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("dst"), F.col("dst").alias("next"))
    hop = 0
    while not frontier.isEmpty() and (most is None or hop < most):
        hop += 1
        step = frontier.join(inner, "dst").select("src", F.col("next").alias("dst")).distinct()
        done = done.unionByName(step.join(gone, F.col("dst") == F.col("id"), "left_anti"))
        frontier = cut(step.join(gone, F.col("dst") == F.col("id"), "left_semi").join(seen.all(), ["src", "dst"], "left_anti"))
        seen.add(frontier)
    return done.distinct()


def degrees(edges: DataFrame) -> DataFrame:
    """(id, out, in): numbers of edges, parallel ones counted."""
    both = edges.select(F.explode(F.array(F.struct(F.col("src").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))).alias("x")).select("x.*")
    return both.groupBy("id").agg(F.sum("o").alias("out"), F.sum("i").alias("in"))


def sinks(edges: DataFrame, seeds: DataFrame, depth: int | None = None) -> DataFrame:
    """(id, sinks, entropy): how many nodes without calls of their own each seed reaches, and log2 of one more."""
    calling = edges.select(F.col("src").alias("dst")).distinct()
    ends = closure(edges, seeds, depth).join(calling, "dst", "left_anti").groupBy(F.col("src").alias("id")).agg(F.count_distinct("dst").alias("sinks"))
    out = seeds.select("id").distinct().join(ends, "id", "left").withColumn("sinks", F.coalesce("sinks", F.lit(0)))
    return out.withColumn("entropy", F.log2(F.col("sinks") + 1))


def flow_ranks(nodes: DataFrame, edges: DataFrame, entropy: DataFrame | None = None, included: DataFrame | None = None) -> DataFrame:
    """Rank, tier and confidence of the nodes (id, depth) of a flow from depth, degrees and reachable sinks."""
    n = nodes.join(degrees(edges), "id", "left").fillna(0, ["out", "in"])
    n = n.join(entropy.select("id", "entropy"), "id", "left") if entropy is not None else n.withColumn("entropy", F.lit(0.0))
    n = n.join(included.select("id").distinct().withColumn("wanted", F.lit(True)), "id", "left") if included is not None else n.withColumn("wanted", F.lit(False))
    n = n.fillna(False, ["wanted"]).fillna(0.0, ["entropy"])
    d, o, i = F.col("depth"), F.col("out"), F.col("in")
    given = lambda c, points: F.when(c, points).otherwise(0)
    rank = given(d == 0, 100) + given(d == 1, 30) + given(d == 2, 20) + given(d == 3, 10) + given(o > 0, 15) + given(o >= 2, 10) + given(i >= 2, 10) - given(o == 0, 10) - given(o >= 5, 10) + given(F.col("wanted"), 100)
    main = F.col("wanted") | ((d <= 2) & (o > 0) & (i <= 2))
    useful = (o >= 5) | (i >= 3) | (o == 0)
    tier = F.when(main, "primary").when(useful, "utility").otherwise("supporting")
    sure = F.when(main, "high").when(useful | (d <= 3), "medium").otherwise("low")
    return n.select("id", "depth", "out", "in", (rank + 10 * F.col("entropy")).alias("rank"), tier.alias("tier"), sure.alias("confidence"))


def stitched_flow(edges: DataFrame, entry: DataFrame, depth: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes with least depth, edges walked, and why the walk stopped (id, reason): max_depth, no_callees or cycle."""
    nodes = levels(edges, entry, depth)
    walked = edges.select("src", "dst").distinct().join(nodes.filter(F.col("depth") < depth).select(F.col("id").alias("src"), F.col("depth").alias("src_depth")), "src")
    walked = walked.join(nodes.select(F.col("id").alias("dst"), F.col("depth").alias("dst_depth")), "dst")
    calling = edges.select(F.col("src").alias("id")).distinct()
    stops = nodes.filter(F.col("depth") >= depth).select("id", F.lit("max_depth").alias("reason"))
    stops = stops.unionByName(nodes.filter(F.col("depth") < depth).join(calling, "id", "left_anti").select("id", F.lit("no_callees").alias("reason")))
    stops = stops.unionByName(walked.filter("dst_depth < src_depth or src = dst").select(F.col("src").alias("id"), F.lit("cycle").alias("reason")).distinct())
    return nodes, walked.select("src", "dst"), stops


def capped(nodes: DataFrame, most: int, tie: str = "id") -> DataFrame:
    """The first ``most`` nodes by depth, then by ``tie``, with the number left out (a report's limit)."""
    total = nodes.count()
    first = nodes.orderBy("depth", tie).limit(most)
    return first.withColumn("position", F.row_number().over(Window.orderBy("depth", tie))).withColumn("omitted", F.lit(max(0, total - most)))
