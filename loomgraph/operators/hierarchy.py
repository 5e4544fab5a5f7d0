"""Parent-child links to full hierarchies: root, depth, path and descendants of every node, and cycles.

Method: *tree contraction*. Each round rakes (takes off all leaves) and compresses (takes nodes with a single child out of
chains, an independent set of them chosen by hash, hanging the child on the grandparent with the sum of the steps). The
tree shrinks by a constant part each round, however deep it is. What is taken off is recorded; what it weighs (itself and
all it held) goes to its parent when raked, to the edge of its child when compressed. Once at most ``CORE`` nodes are left,
one task solves them; the records then get their root, depth, path and number of descendants in reverse order. Nodes that
no contraction takes off are cycles: all that hang on them have no end to their ancestry.

Only the nodes that still take part are carried from round to round, each round checkpointed. Defined results: a parent
that is no node itself is a root of depth 0; a node without a parent is a root; null keys are no nodes; of repeated rows
of a node the caller chooses one (:func:`class_links` takes the latest; ties by the greatest of the other fields); an
empty table has no hierarchy. Only the named columns are read.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .skew import hot_keys, left_join_unique

MOST_ROUNDS = 200
#: So many nodes are solved by one task instead of further rounds.
CORE = 16_384

_SOLVED = "node string, root string, depth long, path array<string>, below long"


def _solve_core(table: Any) -> Any:
    """Root, depth, path and descendants of the nodes of one table (node, parent, steps, via, held, hung), by walking up."""
    import pyarrow as pa

    nodes, parents, steps, via, held, hung = (table.column(c).to_pylist() for c in ("node", "parent", "steps", "via", "held", "hung"))
    place = {n: i for i, n in enumerate(nodes)}
    n, paths = len(nodes), any(v is not None for v in via)
    root: list[str | None] = [None] * n
    depth, path, state = [0] * n, [None] * n, [0] * n  # state: 0 unseen, 1 on the way, 2 solved
    order = []
    for start in range(n):
        way, at = [], start
        while at is not None and state[at] == 0:
            state[at] = 1
            way.append(at)
            at = place.get(parents[at])
        endless = at is not None and (state[at] == 1 or root[at] == "")
        for i in reversed(way):
            up = place.get(parents[i])
            if endless:
                root[i], depth[i] = "", -1
            elif up is None:
                root[i], depth[i], path[i] = parents[i], steps[i], [parents[i], *via[i], nodes[i]] if paths else None
            else:
                root[i], depth[i], path[i] = root[up], depth[up] + steps[i], [*path[up], *via[i], nodes[i]] if paths else None
            state[i] = 2
            order.append(i)
    below: list[int | None] = list(held)
    for i in reversed(order):  # children before their parents
        up = place.get(parents[i])
        if root[i] != "" and up is not None:
            below[up] += below[i] + 1 + hung[i]
    below = [None if r == "" else b for r, b in zip(root, below, strict=True)]
    strings = pa.list_(pa.string())
    return pa.table({"node": pa.array(nodes, pa.string()), "root": pa.array(root, pa.string()), "depth": pa.array(depth, pa.int64()), "path": pa.array(path, strings), "below": pa.array(below, pa.int64())})


_LIVE = ("node", "parent", "steps", "via", "held", "hung")


def _contract(links: DataFrame, paths: bool, core: int) -> tuple[list[tuple[DataFrame, DataFrame]], DataFrame]:
    """Leaves and chain nodes taken off, round by round, and what is left, solved."""
    via = F.array().cast("array<string>") if paths else F.lit(None).cast("array<string>")
    zero = F.lit(0).cast("long")
    live = links.select("node", "parent", F.lit(1).cast("long").alias("steps"), via.alias("via"), zero.alias("held"), zero.alias("hung"))
    records: list[tuple[DataFrame, DataFrame]] = []
    if links.count() <= core:
        return records, live.groupBy().applyInArrow(_solve_core, _SOLVED)
    for turn in range(MOST_ROUNDS):
        # children per node: one row per parent, partly aggregated before the shuffle
        kids = live.filter("node <> parent").groupBy(F.col("parent").alias("p")).agg(F.count("*").alias("kids"), F.min("node").alias("kid"), F.max("hung").alias("kid_hung"))
        known = live.join(kids, F.col("node") == F.col("p"), "left")
        known = cut(known.select(*_LIVE, F.coalesce("kids", F.lit(0)).alias("kids"), "kid", "kid_hung"))
        n, loops = known.agg(F.count("*"), F.count_if(F.col("node") == F.col("parent"))).first()
        if n == loops:  # any number of cycles, each shrunk to a node
            return records, known.select("node", F.lit("").alias("root"), F.lit(-1).cast("long").alias("depth"), F.lit(None).cast("array<string>").alias("path"), F.lit(None).cast("long").alias("below"))
        if n <= core:
            return records, cut(known.select(*_LIVE).groupBy().applyInArrow(_solve_core, _SOLVED))
        is_leaf = (F.col("kids") == 0) & (F.col("node") != F.col("parent"))
        leaves = known.filter(is_leaf).select(*_LIVE)
        raked = leaves.groupBy(F.col("parent").alias("raker")).agg(F.sum(F.col("held") + F.col("hung") + 1).alias("gain"))
        inner = known.filter(~is_leaf).join(raked, F.col("node") == F.col("raker"), "left")
        # a chain node, whose child is no leaf, goes if its coin shows heads and its child, which may lie in the chain too, shows tails
        coin = lambda c: F.pmod(F.xxhash64(c, F.lit(turn)), F.lit(2)) == 1  # noqa: B023, E731
        is_chain = (F.col("kids") == 1) & F.col("gain").isNull() & (F.col("node") != F.col("parent")) & coin("node") & ~coin("kid")
        chain = inner.filter(is_chain).select(*_LIVE, "kid", "kid_hung")
        records.append((leaves, chain))
        # what stays hangs on the parent of its parent if that has gone; a leaf that has gone keeps its recorded parent
        spliced = chain.select(F.col("node").alias("mid"), F.col("parent").alias("over"), F.col("steps").alias("more"), F.col("via").alias("mid_via"), (F.col("held") + F.col("hung") + 1).alias("weight"))
        rest = inner.filter(~is_chain).select(*_LIVE, "gain")
        rest = rest.join(spliced, (F.col("parent") == F.col("mid")) & (F.col("node") != F.col("parent")), "left")
        hung_via = F.concat("mid_via", F.array("mid"), "via") if paths else F.col("via")
        none = F.lit(0)
        live = rest.select(
            "node",
            F.coalesce("over", "parent").alias("parent"),
            (F.col("steps") + F.coalesce("more", none)).alias("steps"),
            F.when(F.col("mid").isNotNull(), hung_via).otherwise(F.col("via")).alias("via"),
            (F.col("held") + F.coalesce("gain", none)).alias("held"),
            (F.col("hung") + F.coalesce("weight", none)).alias("hung"),
        )
    raise RuntimeError("the contraction did not end")


def hierarchy(links: DataFrame, paths: bool = False, sizes: bool = False) -> DataFrame:
    """(node, root, depth[, path][, below]) of each node that has a parent, from ``links`` (node, parent), one row per node.

    ``path`` is the array of names from the root to the node, ``below`` the number of its descendants. Nodes on or below a
    cycle have an empty root, depth -1 and null path and descendants."""
    clean = cut(links.select("node", "parent").filter("node is not null and parent is not null"))
    hot = hot_keys(clean, "parent")  # a splice hangs one child in place of another, so no parent becomes hot later
    records, solved = _contract(clean, paths, CORE)
    none = F.lit(None).cast("array<string>")
    parts = int(links.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    for at in range(len(records) - 1, -1, -1):
        # chain nodes hang on, and hold, what went later; leaves may hang on chain nodes of their round
        for record in (records[at][1], records[at][0]):
            up = solved.select(F.col("node").alias("p"), F.col("root").alias("up_root"), F.col("depth").alias("up_depth"), F.col("path").alias("up_path"))
            got = left_join_unique(record, up, "parent", "p", hot, F.col("node"))
            below = F.col("held")
            if "kid" in record.columns and sizes:
                child = solved.select(F.col("node").alias("k"), F.col("below").alias("kid_below"))
                got = got.join(child, F.col("kid") == F.col("k"), "left")
                below = below + F.col("kid_below") + 1 + F.coalesce("kid_hung", F.lit(0))
            found = F.col("p").isNotNull()
            ends = found & (F.col("up_depth") < 0)
            path = F.when(ends, none).otherwise(F.concat(F.coalesce("up_path", F.array("parent")), F.col("via"), F.array("node"))) if paths else none
            fresh = got.select(
                "node",
                F.when(ends, F.lit("")).when(found, F.col("up_root")).otherwise(F.col("parent")).alias("root"),
                F.when(ends, F.lit(-1)).when(found, F.col("up_depth") + F.col("steps")).otherwise(F.col("steps")).cast("long").alias("depth"),
                path.alias("path"),
                F.when(~ends, below).alias("below"),
            )
            solved = solved.unionByName(fresh)
        solved = cut(solved.coalesce(parts)) if at else solved.coalesce(parts)  # unions add up partitions
    out = solved.select("node", "root", F.col("depth").cast("int").alias("depth"), *(["path"] if paths else []), *(["below"] if sizes else []))
    return out


def descendants(paths: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) from the result of :func:`hierarchy` with paths; as many rows as the depths sum up to."""
    steps = paths.filter("path is not null").select("node", F.col("path"), F.posexplode("path").alias("at", "ancestor"))
    return steps.filter("ancestor <> node").select("ancestor", F.col("node").alias("descendant"), (F.size("path") - 1 - F.col("at")).alias("distance"))


def _blank(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^\s*$"), F.lit(True))


def class_links(classes: DataFrame) -> DataFrame:
    """(node, parent) of classes by full name: the parent in ``extends``, or if that is blank the first of
    ``implements_json``; parents as written are resolved within the package, then by the imports."""
    fields = ["full_name", "package_name", "extends", "implements_json", "imports", "indexed_at", "id"]
    rows = classes.select(*fields).filter("full_name is not null")
    order = F.struct("indexed_at", "id", "extends", "implements_json", "package_name", "imports")
    last = rows.groupBy("full_name").agg(F.max(order).alias("r")).select("full_name", "r.*")
    first = F.get(F.from_json("implements_json", "array<string>"), 0)
    written = F.when(~_blank(F.col("extends")), F.col("extends")).otherwise(first)
    bare = F.regexp_replace(F.regexp_extract(written, r"^([^<\[]*)", 1), r"^[\s ]+|[\s ]+$", "")
    named = last.withColumn("text", bare).filter("text is not null and text <> ''")
    named = named.withColumn("dotted", F.instr("text", ".") > 0)
    named = named.withColumn("local", F.when(~F.col("dotted"), F.concat(F.col("package_name"), F.lit("."), F.col("text"))))
    imported = F.filter("imports", lambda x: x.endswith(F.concat(F.lit("."), F.col("text"))))
    named = named.withColumn("imported", F.when(~F.col("dotted"), F.get(imported, 0)))
    # most names are looked up once; a package's popular base class may be looked up by many, so look up distinct names
    wanted = named.filter("local is not null").select("local").distinct()
    there = wanted.join(last.select(F.col("full_name").alias("local")), "local", "left_semi").withColumn("is_there", F.lit(True))
    there = there.withColumnRenamed("local", "found")
    named = left_join_unique(named, there, "local", "found", hot_keys(named, "local"), F.col("full_name"))
    parent = F.when(F.col("dotted"), F.col("text")).when(F.col("is_there"), F.col("local")).otherwise(F.coalesce("imported", "text"))
    return named.select(F.col("full_name").alias("node"), parent.alias("parent"))
