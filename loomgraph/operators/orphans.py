"""References to records that do not exist, maintained from change deltas.

Method: per key and period a signed count of references and of existence. A record's arrival adds one existence in its
period, its deletion takes one away in its own; references add one (their removal would take one). Sums of deltas are the
state, so a new batch of changes is merged by adding its sums to the state's. A key whose references in a period are
positive while its existence, summed up to that period, is zero is an orphan.

Defined results: keys are compared trimmed and in lower case; null and blank keys, null JSON, JSON that is no valid array
and null array elements hold no reference; rows without a period (null ``indexed_at``) refer to and make nothing; a
record deleted before it arrived never exists; repeated rows count once as a reference and never twice against existence
(a key exists while any row of it does); empty tables hold no references, or leave all of them orphans. Only the named
columns are read. A key may be referred to by a third of all rows: counts are partly aggregated before any shuffle, and
rows of keys with many references, whether these exist or not, are judged by a broadcast of those few keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

#: Rows of keys with more references in a period than this, and than a thousandth of all, aren't shuffled.
HOT_ROWS, HOT_SHARE = 100_000, 1000


def key(c: Column | str) -> Column:
    """An id in the form in which ids are compared; null if blank."""
    c = F.lower(F.trim(F.col(c) if isinstance(c, str) else c))
    return F.when(c != "", c)


def period(c: Column | str) -> Column:
    """The UTC month of a time without zone, as months since year 0 (an integer, so periods compare and sum cheaply)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) * 12 + F.month(c) - 1


def period_text(c: Column) -> Column:
    return F.concat(F.lpad(F.floor(c / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((c % 12 + 1).cast("string"), 2, "0"))


def existence_deltas(df: DataFrame, target: str, id_: str = "id", created: str = "indexed_at", deleted: str = "deleted_at") -> DataFrame:
    """(target, key, period, exists): signed changes of the number of rows of each key, summed per period."""
    rows = df.select(key(id_).alias("key"), period(created).alias("c"), period(deleted).alias("d")).filter("key is not null and c is not null")
    changes = F.array(F.struct(F.col("c").alias("period"), F.lit(1).alias("exists")), F.struct(F.greatest("c", "d").alias("period"), F.when(F.col("d").isNotNull(), -1).otherwise(0).alias("exists")))
    deltas = rows.select("key", F.explode(changes).alias("x")).select(F.lit(target).alias("target"), "key", "x.period", "x.exists")
    return deltas.groupBy("target", "key", "period").agg(F.sum("exists").alias("exists")).filter(F.col("exists") != 0)


def references(df: DataFrame, table: str, field: str, target: str, value: Column, row_id: str = "id", at: str = "indexed_at") -> DataFrame:
    """(ref_table, ref_field, target, row_id, period, key): the references in ``value``, a column of one id or an array of ids."""
    rows = df.select(F.col(row_id).alias("row_id"), period(at).alias("period"), value.alias("v"))
    if rows.schema["v"].dataType.typeName() == "array":
        rows = rows.select("row_id", "period", F.explode("v").alias("v"))
    return rows.select(F.lit(table).alias("ref_table"), F.lit(field).alias("ref_field"), F.lit(target).alias("target"), "row_id", "period", key("v").alias("key")).filter("key is not null and period is not null")


def json_ids(c: str) -> Column:
    """The strings of a JSON array; null for text that is no valid array.

    The parser alone would read a valid beginning and leave the rest, so the text must also end where the array does."""
    strict = {"allowSingleQuotes": "false", "allowUnquotedFieldNames": "false", "mode": "PERMISSIVE"}
    parsed = F.from_json(F.col(c), "array<string>", strict)
    whole = F.col(c).rlike(r'^\s*\[\s*(?:(?:"(?:[^"\\]|\\.)*"|null|true|false|-?\d[\d.eE+-]*)\s*(?:,\s*(?:"(?:[^"\\]|\\.)*"|null|true|false|-?\d[\d.eE+-]*)\s*)*)?\]\s*$')
    return F.when(whole, parsed)


def reference_deltas(refs: DataFrame) -> DataFrame:
    """(target, key, period, refs): references summed per key and period."""
    return refs.groupBy("target", "key", "period").agg(F.count("*").alias("refs"))


def merged_state(*deltas: DataFrame) -> DataFrame:
    """(target, key, period, refs, exists): the state after any number of batches of deltas or earlier states."""
    whole = None
    for d in deltas:
        part = d.select("target", "key", "period", *(F.col(c) if c in d.columns else F.lit(0).cast("long").alias(c) for c in ("refs", "exists")))
        whole = part if whole is None else whole.unionByName(part)
    return whole.groupBy("target", "key", "period").agg(F.sum("refs").alias("refs"), F.sum("exists").alias("exists"))


def orphan_keys(state: DataFrame) -> DataFrame:
    """(target, key, period, refs): keys with references in a period and no existence at its end.

    The window runs over the periods of one key: at most one row for each period that there is, however many rows refer."""
    so_far = F.sum("exists").over(Window.partitionBy("target", "key").orderBy("period").rowsBetween(Window.unboundedPreceding, 0))
    return state.withColumn("alive", so_far).filter("refs > 0 and alive <= 0").select("target", "key", "period", "refs")


def orphans(refs: DataFrame, deltas: list[DataFrame]) -> DataFrame:
    """(ref_table, ref_field, row_id, period, missing_id): each distinct orphan reference."""
    cols = ["ref_table", "ref_field", "target", "row_id", "period", "key"]
    on = ["target", "key", "period"]
    distinct = cut(refs.select(*cols).distinct())
    state = cut(merged_state(reference_deltas(distinct), *deltas))
    missing = orphan_keys(state)
    total = state.agg(F.sum("refs")).first()[0] or 0
    hot_from = max(HOT_ROWS, total // HOT_SHARE)
    if total <= hot_from:
        out = distinct.join(missing.select(*on), on, "left_semi")
    else:
        # at most HOT_SHARE keys, existing or not, as each has more than that part of all references: judged where the rows are
        hot = cut(state.filter(F.col("refs") > hot_from).select(*on))
        lost = F.broadcast(missing.join(F.broadcast(hot), on, "left_semi").select(*on))
        rest = missing.filter(F.col("refs") <= hot_from).select(*on)
        out = distinct.join(lost, on, "left_semi").unionByName(distinct.join(F.broadcast(hot), on, "left_anti").join(rest, on, "left_semi"))
    return out.select("ref_table", "ref_field", "row_id", period_text(F.col("period")).alias("period"), F.col("key").alias("missing_id"))


def code_graph_orphans(methods: DataFrame, callsites: DataFrame, classes: DataFrame) -> DataFrame:
    """Orphans of a code graph: methods without their class, call sites without their caller or candidate."""
    refs = references(methods, "methods", "class_id", "classes", F.col("class_id"))
    refs = refs.unionByName(references(callsites, "callsites", "caller_method_id", "methods", F.col("caller_method_id")))
    refs = refs.unionByName(references(callsites, "callsites", "resolved_candidates_json", "methods", json_ids("resolved_candidates_json")))
    return orphans(refs, [existence_deltas(classes, "classes"), existence_deltas(methods, "methods")])


def orphan_counts(found: DataFrame) -> DataFrame:
    """Orphans per table, field and month."""
    return found.groupBy("ref_table", "ref_field", "period").agg(F.count("*").alias("orphans"), F.count_distinct("missing_id").alias("missing_ids"))
