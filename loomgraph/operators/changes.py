"""Snapshots, their differences and what follows from them: upserts, deletes, incremental updates of a code graph."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fingerprint_diff(old: DataFrame, new: DataFrame, key: str = "path", marks: Sequence[str] = ("mtime_ns", "size")) -> DataFrame:
    """(key, change): added, changed or deleted files between two manifests; unchanged ones are left out."""
    o = old.select(F.col(key).alias("k"), F.struct(*marks).alias("was"))
    n = new.select(F.col(key).alias("k2"), F.struct(*marks).alias("now"))
    j = o.join(n, F.col("k") == F.col("k2"), "full_outer")
    change = F.when(F.col("k").isNull(), "added").when(F.col("k2").isNull(), "deleted").when(F.col("was") != F.col("now"), "changed")
    return j.select(F.coalesce("k", "k2").alias(key), change.alias("change")).filter("change is not null")


def is_stale(old: DataFrame, new: DataFrame, key: str = "path", marks: Sequence[str] = ("mtime_ns", "size")) -> bool:
    return not fingerprint_diff(old, new, key, marks).isEmpty()


def column_diff(old: DataFrame, new: DataFrame, key: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Per key: whether it is only in one side, and the names of the columns that differ."""
    k = list(key)
    o = old.select(*k, F.struct(*columns).alias("_o"))
    n = new.select(*k, F.struct(*columns).alias("_n"))
    j = o.join(n, k, "full_outer")
    changed = F.array_compact(F.array(*(F.when(~F.col(f"_o.{c}").eqNullSafe(F.col(f"_n.{c}")), F.lit(c)) for c in columns)))
    side = F.when(F.col("_o").isNull(), "added").when(F.col("_n").isNull(), "removed").when(F.size(changed) > 0, "changed").otherwise("same")
    return j.select(*k, side.alias("change"), F.when(side == "changed", F.array_join(changed, ",")).otherwise("").alias("columns"))


def record_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """(signature, file_path, added, removed, shifted, edited) of methods by signature and file; only keys that are unique
    on both sides are compared in lines and source."""
    key = ["signature", "file_path"]

    def side(df: DataFrame, s: str) -> DataFrame:
        return df.groupBy(*key).agg(F.count("*").alias(f"{s}_n"), F.min("start_line").alias(f"{s}_line"), F.min(F.xxhash64(F.coalesce("source", F.lit("")))).alias(f"{s}_hash"))

    j = side(old, "o").join(side(new, "n"), key, "full_outer")
    one = (F.col("o_n") == 1) & (F.col("n_n") == 1)
    flag = lambda c: F.coalesce(c, F.lit(False))
    return j.select(*key, F.col("o_n").isNull().alias("added"), F.col("n_n").isNull().alias("removed"), flag(one & (F.col("o_line") != F.col("n_line"))).alias("shifted"), flag(one & (F.col("o_hash") != F.col("n_hash"))).alias("edited"))


def change_type(added: Column, removed: Column, shifted: Column, edited: Column) -> Column:
    """What must be done again: everything of the file, its calls, its lines, or nothing."""
    return F.when(added | removed, "structural").when(edited, "callsite_change").when(shifted, "metadata_only").otherwise("no_change")


def file_changes(diff: DataFrame) -> DataFrame:
    """(file_path, change_type) from the records of each file."""
    any_ = {c: F.max(c).alias(c) for c in ("added", "removed", "shifted", "edited")}
    f = diff.groupBy("file_path").agg(*any_.values())
    return f.select("file_path", change_type(*(F.col(c) for c in any_)).alias("change_type"))


def upsert(base: DataFrame, changes: DataFrame, key: Sequence[str]) -> DataFrame:
    """``base`` with the rows of ``changes`` in place of those of the same key; nulls match nulls."""
    k = changes.select(*(F.col(c).alias(f"_{c}") for c in key)).distinct()
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]
    return base.join(k, on, "left_anti").unionByName(changes.select(*base.columns))


def replaced_groups(base: DataFrame, rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """``base`` with all rows of the groups that ``rows`` has rows of replaced by these; nulls match nulls. So the chunks of a
    document, or the call sites of a method, are replaced together, fewer than before or more."""
    return upsert(base, rows, by)


def without_groups(base: DataFrame, gone: DataFrame, by: str) -> DataFrame:
    """``base`` without the rows whose ``by`` is among ``gone`` (a column of that name)."""
    return base.join(gone.select(by).distinct(), by, "left_anti").select(*base.columns)


def replaced_edges(edges: DataFrame, fresh: DataFrame, callers: DataFrame) -> DataFrame:
    """Call edges with those of some callers (src) replaced."""
    return without_groups(edges, callers, "src").unionByName(fresh.join(callers.select("src").distinct(), "src", "left_semi").select(*edges.columns))


def without_files(df: DataFrame, paths: DataFrame) -> DataFrame:
    return df.join(paths.select("file_path").distinct(), "file_path", "left_anti").select(*df.columns)


def without_edges_of(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges with neither end among the nodes that are gone (id)."""
    g = gone.select("id").distinct()
    return edges.join(g, F.col("src") == F.col("id"), "left_anti").join(g, F.col("dst") == F.col("id"), "left_anti")


def replaced_files(base: DataFrame, parsed: DataFrame, changed: DataFrame, failed: DataFrame) -> DataFrame:
    """``base`` with the rows of changed files (file_path) replaced by what was parsed; files that failed keep their rows."""
    done = changed.join(failed.select("file_path"), "file_path", "left_anti")
    return without_files(base, done).unionByName(parsed.join(done.select("file_path").distinct(), "file_path", "left_semi").select(*base.columns))


def reindexed(base: Mapping[str, DataFrame], parsed: Mapping[str, DataFrame], changed: DataFrame, deleted: DataFrame, failed: DataFrame) -> dict[str, DataFrame]:
    """The tables of a graph brought up to date: rows of deleted files (file_path) leave, those of changed files give way to what
    was parsed, files that could not be parsed keep theirs. ``edges`` (src, dst), if among the tables, lose those with an end
    among methods that have gone."""
    out = {n: replaced_files(without_files(df, deleted), parsed[n], changed, failed) for n, df in base.items() if n != "edges"}
    if "edges" in base:
        gone = base["methods"].select("id").distinct().join(out["methods"].select("id").distinct(), "id", "left_anti")
        out["edges"] = without_edges_of(base["edges"], gone)
    return out


def trigger(changed: DataFrame, extensions: Sequence[str] = ("java", "py", "ts", "tsx", "js", "jsx", "go", "cs", "scala", "smithy")) -> DataFrame:
    """The files of a hook's change list (path) that are sources, each once."""
    return changed.filter(F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*extensions)).select("path").distinct()


def outdated(stored: DataFrame, used: DataFrame) -> DataFrame:
    """(name): snapshots in use (name, version) that aren't the stored ones any more; a cache drops these."""
    return stored.select("name", F.col("version").alias("now")).join(used, "name").filter(~F.col("now").eqNullSafe(F.col("version"))).select("name").distinct()


def patched_lines(base: DataFrame, patch: DataFrame) -> DataFrame:
    """``base`` with start_line, end_line and source of ``patch`` (id, ...) where it has them."""
    p = patch.select(F.col("id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in ("start_line", "end_line", "source")))
    j = base.join(p, F.col("id") == F.col("_id"), "left")
    return j.select(*(F.coalesce(f"_{c}", c).alias(c) if c in ("start_line", "end_line", "source") else F.col(c) for c in base.columns))


def rescoped(resolved: DataFrame, again: DataFrame, scope: DataFrame) -> DataFrame:
    """``resolved`` with the rows of call sites in ``scope`` (callsite_id) replaced by those of ``again``."""
    s = scope.select("callsite_id").distinct()
    return resolved.join(s, "callsite_id", "left_anti").select(*resolved.columns).unionByName(again.join(s, "callsite_id", "left_semi").select(*resolved.columns))


def hash_gate(wanted: DataFrame, have: DataFrame, key: Sequence[str] = ("method_id", "model"), mark: str = "text_hash") -> DataFrame:
    """Rows whose payload hash isn't stored yet: those that must be embedded again."""
    return wanted.join(have.select(*key, mark).distinct(), [*key, mark], "left_anti")


def embedded(wanted: DataFrame, have: DataFrame, encode: Callable[[list[str]], Sequence[Sequence[float]]], batch: int = 256) -> DataFrame:
    """(method_id, model, text_hash, embedding) of the rows of ``wanted`` (method_id, model, text_hash, payload) that aren't stored yet,
    by an encoder that takes texts in batches; it runs on the executors and must be sent there whole."""
    todo = hash_gate(wanted, have).select("method_id", "model", "text_hash", "payload")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                vectors = encode([t or "" for t in part.column(3).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array([[float(x) for x in v] for v in vectors], pa.list_(pa.float32()))], names=["method_id", "model", "text_hash", "embedding"])

    return todo.mapInArrow(run, "method_id string, model string, text_hash string, embedding array<float>")


def model_in_use(vectors: DataFrame) -> DataFrame:
    """(model): the one with most vectors, ties by name."""
    return vectors.groupBy("model").agg(F.count("*").alias("n")).filter("model is not null").orderBy(F.desc("n"), "model").limit(1).select("model")


def table_fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a number that changes with the rows, whatever their order."""
    h = F.xxhash64(*columns)
    return df.agg(F.count("*").alias("rows"), F.bit_xor(h).alias("fingerprint"))


def last_seen_before(rows: DataFrame, by: str, order: Sequence[str], wanted: Column, value: str, out: str) -> DataFrame:
    """As-of by log order: each row with the value of the last row before it, in its group, for which ``wanted`` holds."""
    from pyspark.sql import Window

    w = Window.partitionBy(by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn(out, F.last(F.when(wanted, F.col(value)), ignorenulls=True).over(w))
