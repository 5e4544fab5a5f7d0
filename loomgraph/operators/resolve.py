"""Resolution of call sites to methods: a cascade of joins, each step taking what the ones before left.

Call sites need callsite_id, caller_method_id, callee_name, receiver, receiver_type (as written), argument_count (-1:
unknown) and argument_types. Popular names (a tenth of all calls may have one) meet aggregated candidate lists, one row
per key, so a join never multiplies rows; lists are capped nowhere.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..session import cut
from . import walks
from .lookups import implementer_methods
from .skew import hot_keys, left_join_unique
from .synthesis import inner_classes
from .traversal import closure, deep_closure

# Types that need no import.
LANG_TYPES = "String Integer Boolean Long Double Float Object".split()
#: Names that class-hierarchy analysis doesn't fan out over, and the most subtypes of a class over which it does.
NO_FAN_OUT = "name toString equals hashCode getClass compareTo ordinal getValue getId getType getCode getKey clone notify notifyAll wait finalize".split()
MOST_SUBTYPES = 150
#: Statuses of calls whose targets class-hierarchy analysis widens.
WIDENED = "resolved resolved_inherited resolved_via_import resolved_same_package resolved_same_class resolved_via_sole_implementation candidate_global_name_arity ambiguous_overload resolved_impl_suffix".split()
#: Names that browsers and runtimes bring along; hooks are named use and a capital.
GLOBALS = (
    "console Math JSON Promise Array Object String Number Boolean Symbol RegExp Map Set Date Error parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent "
    "fetch process Buffer setTimeout setInterval clearTimeout clearInterval useState useEffect useCallback useMemo useRef useContext useReducer useLayoutEffect "
    "useImperativeHandle useDebugValue useId useDeferredValue useTransition t i18n"
).split()
SCRIPTS = r"\.(?:ts|tsx|js|jsx|mjs)$"
#: Rounds in which receivers that are calls get the types of what these return.
CHAIN_ROUNDS = 6


def bare_type(c: Column) -> Column:
    """A type as written without generics, arrays and surrounding white space; null if blank."""
    t = F.trim(F.regexp_replace(c, r"<.*$|\[.*$|\?$", ""))
    return F.when(t != "", t)


@dataclass(frozen=True)
class Lookups:
    """One row per key with the sorted list of candidates: by class and name, by short class and name, by name and arity
    (arity -1: all of the name)."""

    by_class: DataFrame
    by_short: DataFrame
    by_name: DataFrame
    classes: DataFrame

    @classmethod
    def build(cls, methods: DataFrame, classes: DataFrame) -> Lookups:
        m = methods.select("id", F.col("class_full_name").alias("cls"), "method_name", F.size(F.coalesce("parameter_types", F.array().cast("array<string>"))).alias("arity"), F.coalesce("parameter_types", F.array().cast("array<string>")).alias("types"))
        any_arity = m.unionByName(m.withColumn("arity", F.lit(-1)))
        many = F.array_sort(F.collect_set(F.struct("id", "arity", "types"))).alias("c")
        return cls(
            m.groupBy("cls", "method_name").agg(many),
            m.groupBy(ids.short_name("cls").alias("short"), "method_name").agg(many),
            any_arity.groupBy("method_name", "arity").agg(F.array_sort(F.collect_set("id")).alias("all")),
            classes.select("full_name", "package_name", "extends", "implements_json", "imports").dropDuplicates(["full_name"]),
        )


def normalised_types(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """(caller_class, written, type, how): the full name of a type as written in a class.

    In order: a dotted name as it is; the one import that ends with it; the caller's package; the one class in a
    package imported whole (``ambiguous`` if several); the language's own types; else unqualified. Distinct pairs only."""
    p = pairs.select("caller_class", "written").distinct().withColumn("bare", bare_type(F.col("written"))).filter("bare is not null")
    own = classes.select(F.col("full_name").alias("caller_class"), F.col("package_name").alias("package"), F.coalesce("imports", F.array().cast("array<string>")).alias("imports")).dropDuplicates(["caller_class"])
    p = p.join(own, "caller_class", "left").withColumn("imports", F.coalesce("imports", F.array().cast("array<string>")))
    dotted = F.instr("bare", ".") > 0
    exact = F.get(F.filter("imports", lambda i: i.endswith(F.concat(F.lit("."), F.col("bare")))), 0)
    p = p.withColumns({"exact": F.when(~dotted, exact), "same": F.when(~dotted, F.concat_ws(".", "package", "bare"))})
    known = classes.select(F.col("full_name").alias("same"), F.lit(True).alias("same_known")).distinct()
    p = p.join(known, "same", "left")
    wild = p.select("caller_class", "written", "bare", F.explode("imports").alias("i")).filter("i like '%.*'")
    wild = wild.withColumn("full_name", F.concat(F.regexp_replace("i", r"\*$", ""), F.col("bare"))).join(classes.select("full_name").distinct(), "full_name", "left_semi")
    wild = wild.groupBy("caller_class", "written").agg(F.count_distinct("full_name").alias("wilds"), F.min("full_name").alias("wild"))
    p = p.join(wild, ["caller_class", "written"], "left")
    lang = F.col("bare").isin(LANG_TYPES)
    how = F.when(dotted, "full").when(F.col("exact").isNotNull(), "import_exact").when(F.col("same_known"), "same_package").when(F.col("wilds") > 1, "ambiguous").when(F.col("wilds") == 1, "import_wildcard").when(lang, "language").otherwise("unqualified")
    type_ = F.when(dotted, F.col("bare")).when(F.col("exact").isNotNull(), F.col("exact")).when(F.col("same_known"), F.col("same")).when(F.col("wilds") == 1, F.col("wild")).when(lang, F.concat(F.lit("java.lang."), F.col("bare"))).otherwise(F.col("bare"))
    return p.select("caller_class", "written", type_.alias("type"), how.alias("how"))


def resolved_parents(classes: DataFrame, inheritance: DataFrame) -> DataFrame:
    """``inheritance`` with targets by full name: as written if dotted or if the source has no package, else the class of
    that name in the source's package, else as :func:`normalised_types` has it."""
    full = normalised_types(inheritance.select(F.col("source").alias("caller_class"), F.col("target").alias("written")), classes)
    own = classes.select(F.col("full_name").alias("source"), F.col("package_name").alias("package")).dropDuplicates(["source"])
    known = classes.select(F.col("full_name").alias("local"), F.lit(True).alias("local_known")).distinct()
    t = inheritance.join(full.select(F.col("caller_class").alias("source"), F.col("written").alias("target"), "type"), ["source", "target"], "left").join(own, "source", "left")
    short = (F.instr("target", ".") == 0) & (F.coalesce("package", F.lit("")) != "")
    t = t.withColumn("local", F.when(short, F.concat_ws(".", "package", "target"))).join(known, "local", "left")
    target = F.when(F.col("local_known"), F.col("local")).when(short, F.coalesce("type", "target")).otherwise(F.col("target"))
    return t.withColumn("target", target).select(*inheritance.columns)


def ancestors(classes: DataFrame, inheritance: DataFrame, depth: int | None = None) -> DataFrame:
    """(cls, ancestor, distance, rank): all supertypes by full name (see :func:`resolved_parents`), up to the roots unless
    ``depth`` is given; among equals the extended one comes first."""
    e = inheritance.select(F.col("source").alias("src"), F.col("target").alias("dst"))
    known = classes.select(F.col("full_name").alias("dst")).distinct()
    direct = inheritance.select(F.col("source").alias("src"), F.col("target").alias("dst"), F.when(F.col("relation") == "extends", 0).otherwise(1).alias("rank"))
    e = e.join(known, "dst", "left_semi")
    up = deep_closure(e) if depth is None else closure(e, depth=depth)
    first = direct.groupBy("src", "dst").agg(F.min("rank").alias("rank"))
    return up.filter("src <> dst").join(first, ["src", "dst"], "left").select(F.col("src").alias("cls"), F.col("dst").alias("ancestor"), F.col("depth").alias("distance"), F.coalesce("rank", F.lit(1)).alias("rank"))


def _fitting(candidates: Column, count: Column, types: Column) -> Column:
    """Candidates of the right arity, then of equal short types where both are known; narrowing that leaves none is undone."""
    short = lambda t: F.substring_index(F.regexp_replace(t, r"<.*$", ""), ".", -1)
    arity = F.filter(candidates, lambda c: (count < 0) | (c["arity"] == count))
    same = F.filter(arity, lambda c: F.forall(F.zip_with(c["types"], types, lambda p, a: p.isNull() | a.isNull() | (short(p) == short(a))), lambda x: x))
    narrowed = F.when(F.size(arity) > 1, F.when(F.size(same) > 0, same).otherwise(arity)).otherwise(arity)
    return F.transform(narrowed, lambda c: c["id"])


def resolve(calls: DataFrame, methods: DataFrame, classes: DataFrame, inheritance: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(callsite_id, status, candidates, type, n) of each call site, ``type`` being the receiver's by full name.

    Without receiver: the caller's class, its ancestors (the nearest that declares the name), then all methods of that name
    and arity, or of that name if the number of arguments isn't known. With receiver: the sole implementation of an interface,
    the class itself, its ancestors, an inner class of its last two names, a class of that short name (kept as ambiguous),
    else unresolved where the class is known and external where it isn't. A dotted receiver without a type gets that of the
    last field of the chain (see :func:`dotted_types`); where no type is found, the only method of that name and arity among
    all classes that implement something is taken."""
    look = Lookups.build(methods, classes)
    written, inheritance = inheritance, cut(resolved_parents(look.classes, inheritance))
    caller = methods.select(F.col("id").alias("caller_method_id"), F.col("class_full_name").alias("caller_class")).dropDuplicates(["caller_method_id"])
    c = calls.select("callsite_id", "caller_method_id", "callee_name", "receiver", F.col("receiver_type").alias("written"), F.coalesce("argument_count", F.lit(-1)).alias("n"), F.coalesce("argument_types", F.array().cast("array<string>")).alias("given"))
    c = c.join(caller, "caller_method_id", "left")
    own = F.coalesce(F.col("receiver").isin("this", "self", "super"), F.lit(False)) | (F.col("receiver").isNull() & F.col("written").isNull())
    types = normalised_types(c.filter(~own).select("caller_class", "written"), look.classes)
    c = c.join(types, ["caller_class", "written"], "left").withColumns({"own": own, "type": F.when(own, F.col("caller_class")).otherwise(F.col("type"))})
    if "local_variable_types" in methods.columns or fields is not None:
        chained = dotted_types(c.filter("type is null and receiver like '%.%'"), methods, look.classes, inheritance, fields)
        c = c.join(chained, "callsite_id", "left").withColumns({"type": F.coalesce("type", "chained"), "how": F.when(F.col("chained").isNotNull(), "dotted_field_chain").otherwise(F.col("how"))}).drop("chained")
    c = cut(c)

    pairs = c.select(F.col("type").alias("cls"), F.col("callee_name").alias("method_name")).filter("cls is not null").distinct()
    kinds: dict[str, DataFrame] = {"exact": pairs.join(look.by_class, ["cls", "method_name"])}
    up = ancestors(look.classes, inheritance)
    inherited = pairs.join(up, "cls").join(look.by_class.withColumnRenamed("cls", "ancestor"), ["ancestor", "method_name"])
    kinds["inherited"] = inherited.groupBy("cls", "method_name").agg(F.min_by("c", F.struct("distance", "rank", "ancestor")).alias("c"))
    # receivers of unqualified types meet the names that implementers wrote, the others full names
    below = inheritance.unionByName(written).filter("relation = 'implements'").groupBy(F.col("target").alias("cls")).agg(F.count_distinct("source").alias("k"), F.min("source").alias("sole")).filter("k = 1")
    kinds["impl"] = pairs.join(below, "cls").join(look.by_class.withColumnRenamed("cls", "sole"), ["sole", "method_name"])
    parts = F.split("cls", r"\.")
    nested = pairs.filter("cls like '%.%'").withColumns({"outer": F.try_element_at(parts, F.lit(-2)), "inner": F.try_element_at(parts, F.lit(-1))}).join(inner_classes(look.classes), ["outer", "inner"])
    kinds["nested"] = nested.join(look.by_class.withColumnRenamed("cls", "full_name"), ["full_name", "method_name"])
    kinds["by_short"] = pairs.withColumn("short", ids.short_name("cls")).join(look.by_short, ["short", "method_name"])
    # one row of each kind for a pair, brought together by one aggregation
    none = pairs.select("cls", "method_name", F.lit("").alias("kind"), F.lit(None).cast(look.by_class.schema["c"].dataType).alias("c"))
    rows = reduce(lambda a, b: a.unionByName(b), (df.select("cls", "method_name", F.lit(k).alias("kind"), "c") for k, df in kinds.items()), none)
    facts = rows.groupBy("cls", "method_name").agg(*(F.first(F.when(F.col("kind") == k, F.col("c")), ignorenulls=True).alias(k) for k in kinds))
    known = look.classes.select(F.col("full_name").alias("cls"), F.lit(True).alias("known"))
    facts = facts.join(known, "cls", "left")
    # a name like get may stand in a tenth of all calls: such keys are spread
    c = c.withColumn("_fact", F.concat_ws("\u0001", "type", "callee_name"))
    facts = facts.withColumn("_key", F.concat_ws("\u0001", "cls", "method_name"))
    r = left_join_unique(c, facts, "_fact", "_key", hot_keys(c, "_fact"), F.col("callsite_id")).drop("method_name", "_fact", "_key")
    # only calls on the own class look at all methods of a name: the others don't meet the long lists
    wanted = F.when(F.col("own"), F.concat_ws("\u0001", "callee_name", F.greatest("n", F.lit(-1)).cast("string")))
    named = look.by_name.filter("method_name is not null").select(F.concat_ws("\u0001", "method_name", F.col("arity").cast("string")).alias("gname"), "all")
    hot = hot_keys(c.select(wanted.alias("_wanted")), "_wanted")
    r = left_join_unique(r.withColumn("_wanted", wanted), named, "_wanted", "gname", hot, F.col("callsite_id")).drop("_wanted")

    dispatch = implementer_methods(methods, written)
    every = dispatch.groupBy("method_name").agg(F.sum("n").alias("n"), F.max("sole").alias("sole")).select("method_name", F.lit(-1).alias("arity"), F.when(F.col("n") == 1, F.col("sole")).alias("sole"))
    dispatch = dispatch.select("method_name", "arity", "sole").unionByName(every).filter("sole is not null")
    lost = F.when(~F.col("own") & F.col("type").isNull(), F.col("callee_name"))
    r = r.join(dispatch.select(F.col("method_name").alias("dname"), F.col("arity").alias("darity"), "sole"), (lost == F.col("dname")) & (F.greatest("n", F.lit(-1)) == F.col("darity")), "left")

    fit = {k: F.coalesce(_fitting(F.col(k), F.col("n"), F.col("given")), F.array().cast("array<string>")) for k in ("exact", "inherited", "impl", "nested", "by_short")}
    r = r.withColumns({f"{k}_fit": v for k, v in fit.items()})
    size = lambda k: F.size(f"{k}_fit")
    how = F.col("how")
    steps: list[tuple[Column, Column | str, Column]] = [
        (F.col("own") & (size("exact") == 1), "resolved_same_class", F.col("exact_fit")),
        (F.col("own") & (size("exact") > 1), "ambiguous_overload", F.col("exact_fit")),
        (F.col("own") & (size("inherited") > 0), "resolved_inherited", F.col("inherited_fit")),
        (F.col("own") & (F.size("all") == 1), "candidate_global_name_arity", F.col("all")),
        (F.col("own") & (F.size("all") > 1), "ambiguous_global_name_arity", F.col("all")),
        (F.col("own"), "unresolved_method", F.array().cast("array<string>")),
        (how == "ambiguous", "ambiguous_type", F.array().cast("array<string>")),
        (size("impl") == 1, "resolved_via_sole_implementation", F.col("impl_fit")),
        (size("exact") == 1, F.when(how.isin("import_exact", "import_wildcard"), "resolved_via_import").when(how == "same_package", "resolved_same_package").otherwise("resolved_exact"), F.col("exact_fit")),
        (size("exact") > 1, "ambiguous_overload", F.col("exact_fit")),
        (size("inherited") > 0, "resolved_inherited", F.col("inherited_fit")),
        (size("nested") == 1, "resolved_exact", F.col("nested_fit")),
        (size("nested") > 1, "ambiguous_overload", F.col("nested_fit")),
        (size("by_short") > 0, "ambiguous_type", F.col("by_short_fit")),
        (F.col("type").isNotNull() & (F.size("by_short") > 0), "ambiguous_type", F.transform("by_short", lambda x: x["id"])),
        (F.coalesce(F.col("known"), F.lit(False)), "unresolved_method", F.array().cast("array<string>")),
        (F.col("sole").isNotNull(), "resolved_interface_dispatch_fallback", F.array("sole")),
        (F.col("type").isNull(), "unresolved_receiver", F.array().cast("array<string>")),
    ]
    status, found = None, None
    for cond, s, list_ in steps:
        s = F.lit(s) if isinstance(s, str) else s
        cond = F.coalesce(cond, F.lit(False))
        status = F.when(cond, s) if status is None else status.when(cond, s)
        found = F.when(cond, list_) if found is None else found.when(cond, list_)
    return r.select("callsite_id", status.otherwise("external_library").alias("status"), found.otherwise(F.array().cast("array<string>")).alias("candidates"), "type", "n")


def inherited_fields(fields: DataFrame, classes: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(cls, name, type_name, owner): the fields that a class has, its own or those of its nearest superclass."""
    f = fields.groupBy(F.col("class_full_name").alias("owner"), "name").agg(F.min("type_name").alias("type_name"))
    up = ancestors(classes, resolved_parents(classes, inheritance.filter("relation = 'extends'"))).select("cls", F.col("ancestor").alias("owner"), "distance")
    have = f.withColumns({"cls": F.col("owner"), "distance": F.lit(0)}).unionByName(up.join(f, "owner"))
    return have.groupBy("cls", "name").agg(F.min_by(F.struct("type_name", "owner"), F.struct("distance", "owner")).alias("b")).select("cls", "name", "b.*")


def dotted_types(calls: DataFrame, methods: DataFrame, classes: DataFrame, inheritance: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(callsite_id, chained): the full name of the type of receivers ``a.b.c``: ``a`` is ``this``, a local variable, a parameter
    or a field of the caller's class (calls: callsite_id, caller_method_id, caller_class, receiver), and each further name a
    field of the type before it, inherited ones too. A type outside of the graph ends the chain there; an unknown name, with
    null. One join for each name of the longest chain."""
    none, empty = F.lit(None).cast("map<string,string>"), F.array().cast("array<string>")
    has = lambda c: F.col(c) if c in methods.columns else (none if c == "local_variable_types" else empty)
    tables = methods.select(F.col("id").alias("caller_method_id"), has("local_variable_types").alias("local"), F.when(F.size(F.coalesce(has("parameter_names"), empty)) == F.size(F.coalesce(has("parameter_types"), empty)), F.map_from_arrays(F.coalesce(has("parameter_names"), empty), F.coalesce(has("parameter_types"), empty))).alias("params")).dropDuplicates(["caller_method_id"])
    known = classes.select(F.col("full_name").alias("type"), F.lit(True).alias("inside")).distinct()
    own = inherited_fields(fields, classes, inheritance) if fields is not None else None
    typed = None
    if own is not None:
        full = normalised_types(own.select(F.col("owner").alias("caller_class"), F.col("type_name").alias("written")), classes)
        own = own.join(full.select(F.col("caller_class").alias("owner"), F.col("written").alias("type_name"), F.col("type").alias("field_type")), ["owner", "type_name"], "left")
        typed = cut(own.select("cls", "name", F.coalesce("field_type", "type_name").alias("field_type")))
    c = calls.select("callsite_id", "caller_method_id", "caller_class", F.split("receiver", r"\.").alias("parts")).join(tables, "caller_method_id", "left")
    first = F.get("parts", 0)
    c = c.withColumn("written", F.coalesce(F.try_element_at("local", first), F.try_element_at("params", first)))
    full = normalised_types(c.filter("written is not null").select("caller_class", "written"), classes)
    c = c.join(full, ["caller_class", "written"], "left").withColumn("type", F.when(first == "this", F.col("caller_class")).otherwise(F.col("type")))
    if typed is not None:
        c = c.withColumn("name", first).join(typed.withColumnRenamed("cls", "caller_class"), ["caller_class", "name"], "left").withColumn("type", F.coalesce("type", "field_type")).drop("name", "field_type")
    c = cut(c.select("callsite_id", "parts", "type").filter("type is not null"))
    done, at = None, 1
    while True:
        c = c.join(known, "type", "left")
        over = (F.size("parts") <= at) | F.col("inside").isNull()
        ended = c.filter(over).select("callsite_id", F.col("type").alias("chained"))
        done = ended if done is None else done.unionByName(ended)
        rest = c.filter(~over)
        if typed is None or rest.isEmpty():
            return done
        rest = rest.withColumn("name", F.get("parts", at)).join(typed.withColumnRenamed("cls", "type"), ["type", "name"])
        c, at = cut(rest.select("callsite_id", "parts", F.col("field_type").alias("type"))), at + 1


def edges_of(resolved: DataFrame) -> DataFrame:
    return resolved.select("callsite_id", F.explode("candidates").alias("dst"))


def dynamic_cascade(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """The cascade for languages without declared types: receiver, name and arity (the first method by id); name and arity
    (all); an arity one less, else one more (the first); the name (the first)."""
    m = methods.select("id", ids.short_name("class_full_name").alias("short"), "method_name", F.size("parameter_types").alias("arity"))
    keyed = m.groupBy(F.lower("short").alias("r"), "method_name", "arity").agg(F.min("id").alias("one"))
    by_arity = m.groupBy("method_name", "arity").agg(F.array_sort(F.collect_set("id")).alias("all"), F.min("id").alias("one"))
    by_name = m.groupBy("method_name").agg(F.min("id").alias("any"))
    c = calls.select("callsite_id", F.col("callee_name").alias("method_name"), F.lower("receiver").alias("r"), F.coalesce("argument_count", F.lit(-1)).alias("arity"))
    c = c.join(keyed.withColumnRenamed("one", "first"), ["r", "method_name", "arity"], "left").join(by_arity.select("method_name", "arity", "all"), ["method_name", "arity"], "left")
    for step, name in ((-1, "less"), (1, "more")):
        near = by_arity.select("method_name", (F.col("arity") - step).alias("arity"), F.col("one").alias(name))
        c = c.join(near, ["method_name", "arity"], "left")
    c = c.join(by_name, "method_name", "left")
    status = F.when(F.col("first").isNotNull(), "resolved_receiver").when(F.col("all").isNotNull(), "resolved_arity").when(F.coalesce("less", "more").isNotNull(), "resolved_close_arity").when(F.col("any").isNotNull(), "resolved_name_only").otherwise("unresolved")
    found = F.when(F.col("first").isNotNull(), F.array("first")).when(F.col("all").isNotNull(), F.col("all")).when(F.coalesce("less", "more").isNotNull(), F.array(F.coalesce("less", "more"))).when(F.col("any").isNotNull(), F.array("any")).otherwise(F.array().cast("array<string>"))
    return c.select("callsite_id", status.alias("status"), found.alias("candidates"))


def hierarchy_fan_out(resolved: DataFrame, methods: DataFrame, inheritance: DataFrame, calls: DataFrame | None = None, most: int = MOST_SUBTYPES, depth: int | None = None, statuses: Sequence[str] | None = None) -> DataFrame:
    """``resolved`` (callsite_id, status, candidates[, type, n]) widened by the methods of that name of all subtypes.

    Starting points are the class of the first candidate of calls (of some ``statuses`` if given) and the receiver's class of
    calls whose class has no such method. Names that every class has, and classes of more than ``most`` subtypes, are left
    alone. Of each subtype the methods of the right arity count, or all of the name where none has it. Targets of
    ``inheritance`` are full names (see :func:`resolved_parents`); ``calls`` (callsite_id, callee_name) is needed for calls
    without candidates."""
    m = methods.select("id", F.col("class_full_name").alias("cls"), "method_name", F.size(F.coalesce("parameter_types", F.array().cast("array<string>"))).alias("arity") if "parameter_types" in methods.columns else F.lit(-1).alias("arity")).dropDuplicates(["id"])
    e = inheritance.select(F.col("target").alias("src"), F.col("source").alias("dst"))
    down = (deep_closure(e) if depth is None else closure(e, depth=depth)).filter("src <> dst").select(F.col("src").alias("cls"), F.col("dst").alias("sub"))
    few = down.groupBy("cls").agg(F.count("*").alias("k")).filter(F.col("k") <= most).select("cls")
    down = down.join(few, "cls", "left_semi")
    r = resolved if "n" in resolved.columns else resolved.withColumns({"n": F.lit(-1), "type": F.lit(None).cast("string")})
    first = r.filter((F.size("candidates") > 0) & (F.lit(True) if statuses is None else F.col("status").isin(*statuses)))
    start = first.select("callsite_id", "n", F.get("candidates", 0).alias("id")).join(m.select("id", "cls", "method_name"), "id").select("callsite_id", "n", "cls", "method_name")
    if calls is not None:
        lost = r.filter("status = 'unresolved_method' and type is not null").join(calls.select("callsite_id", F.col("callee_name").alias("method_name")), "callsite_id")
        start = start.unionByName(lost.select("callsite_id", "n", F.col("type").alias("cls"), "method_name"))
    start = start.filter(~F.col("method_name").isin(NO_FAN_OUT))
    # by class, name and number of arguments: many calls ask the same
    asked = start.select("cls", "method_name", "n").distinct()
    over = asked.join(down, "cls").join(m.select(F.col("id").alias("sub_id"), F.col("cls").alias("sub"), "method_name", "arity"), ["sub", "method_name"])
    fits = (F.col("n") < 0) | (F.col("arity") == F.col("n"))
    per = over.groupBy("cls", "method_name", "n", "sub").agg(F.collect_set(F.when(fits, F.col("sub_id"))).alias("fit"), F.collect_set("sub_id").alias("all"))
    more = per.groupBy("cls", "method_name", "n").agg(F.array_distinct(F.flatten(F.collect_list(F.when(F.size("fit") > 0, F.col("fit")).otherwise(F.col("all"))))).alias("more"))
    out = r.join(start.join(more, ["cls", "method_name", "n"]).select("callsite_id", "more"), "callsite_id", "left")
    wider = F.array_sort(F.array_union("candidates", F.coalesce("more", F.array().cast("array<string>"))))
    grown = F.col("more").isNotNull()
    return out.select("callsite_id", F.when(grown, "resolved_cha").otherwise(F.col("status")).alias("status"), F.when(grown, wider).otherwise(F.col("candidates")).alias("candidates"))


def relaxed(lost: DataFrame, methods: DataFrame, classes: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(callsite_id, status, candidates) of calls (callsite_id, type, callee_name, n) whose class has no fitting method: those of
    the nearest ancestor that declares the name with any arity, or of classes of the short name of a parent that isn't in
    the graph."""
    look = Lookups.build(methods, classes)
    known = look.classes.select(F.col("full_name").alias("cls")).distinct()
    parents = resolved_parents(look.classes, inheritance)
    up = ancestors(look.classes, parents).select("cls", "ancestor", F.col("distance"), "rank").unionByName(known.select("cls", F.col("cls").alias("ancestor"), F.lit(0).alias("distance"), F.lit(0).alias("rank")))
    asked = lost.select(F.col("type").alias("cls"), F.col("callee_name").alias("method_name")).distinct().join(known, "cls", "left_semi")
    at = asked.join(up, "cls")
    named = at.join(look.by_class.select(F.col("cls").alias("ancestor"), "method_name", "c"), ["ancestor", "method_name"])
    outside = parents.join(known.select(F.col("cls").alias("target")), "target", "left_anti").select(F.col("source").alias("ancestor"), ids.short_name("target").alias("short"), F.when(F.col("relation") == "extends", 0).otherwise(1).alias("order"))
    short = at.join(outside, "ancestor").join(look.by_short, ["short", "method_name"])
    found = named.select("cls", "method_name", "distance", F.lit(0).alias("way"), "rank", "ancestor", "c").unionByName(short.select("cls", "method_name", "distance", F.lit(1).alias("way"), F.col("order").alias("rank"), F.col("short").alias("ancestor"), "c"))
    best = found.groupBy("cls", "method_name").agg(F.min_by("c", F.struct("distance", "way", "rank", "ancestor")).alias("c"))
    r = lost.select("callsite_id", F.col("type").alias("cls"), F.col("callee_name").alias("method_name"), "n").join(best, ["cls", "method_name"])
    fit = F.filter("c", lambda x: (F.col("n") < 0) | (x["arity"] == F.col("n")))
    ids_ = F.array_sort(F.array_distinct(F.transform(F.when(F.size(fit) > 0, fit).otherwise(F.col("c")), lambda x: x["id"])))
    return r.select("callsite_id", F.when(F.size(ids_) == 1, "resolved_inherited").otherwise("ambiguous_overload").alias("status"), ids_.alias("candidates"))


def known_globals(calls: DataFrame, resolved: DataFrame) -> DataFrame:
    """``resolved`` with calls of script files on names that browsers, runtimes and hooks bring along made external."""
    c = calls.select("callsite_id", "callee_name", F.trim(F.coalesce("receiver", F.lit(""))).alias("r"), "file_path")
    j = resolved.join(c, "callsite_id", "left")
    bare = F.col("r") == ""
    open_ = F.col("status").isin("unresolved_receiver", "unresolved") | ((F.col("status") == "unresolved_method") & bare)
    hit = open_ & F.col("file_path").rlike(SCRIPTS) & (F.col("r").isin(GLOBALS) | (bare & (F.col("callee_name").isin(GLOBALS) | F.col("callee_name").rlike("^use[A-Z]"))))
    return j.withColumn("status", F.when(F.coalesce(hit, F.lit(False)), "external_library").otherwise(F.col("status"))).select(*resolved.columns)


def _replaced(base: DataFrame, better: DataFrame) -> DataFrame:
    """``base`` with the rows of ``better`` (callsite_id, status, candidates, ...) in place of its own."""
    b = better.select(F.col("callsite_id").alias("_id"), *(F.col(c).alias(f"_{c}") for c in better.columns if c != "callsite_id"))
    j = base.join(b, F.col("callsite_id") == F.col("_id"), "left")
    new = F.col("_id").isNotNull()
    return j.select(*(F.when(new, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c != "callsite_id" and c in better.columns else F.col(c) for c in base.columns))


def resolve_all(calls: DataFrame, methods: DataFrame, classes: DataFrame, inheritance: DataFrame, fields: DataFrame | None = None, rounds: int = CHAIN_ROUNDS) -> DataFrame:
    """(callsite_id, status, candidates): the whole cascade. After :func:`resolve`: receivers that are themselves calls, in
    rounds until nothing changes; names that are there everywhere; ancestors once more, less strictly; implementations
    by suffix; class-hierarchy analysis. ``calls`` also needs text, line, column_no and file_path."""
    state = cut(resolve(calls, methods, classes, inheritance, fields))
    for _ in range(rounds):
        types = chain_receivers(calls, state.join(calls.select("callsite_id"), "callsite_id"), methods)
        stuck = state.filter("status = 'unresolved_receiver'").select("callsite_id")
        again = cut(types.join(stuck, "callsite_id", "left_semi"))
        if again.isEmpty():
            break
        retyped = calls.drop("receiver_type").join(again, "callsite_id")
        state = cut(_replaced(state, resolve(retyped, methods, classes, inheritance, fields)))
    state = known_globals(calls, state)
    lost = state.filter("status = 'unresolved_method' and type is not null").join(calls.select("callsite_id", "callee_name"), "callsite_id")
    state = cut(_replaced(state, relaxed(lost, methods, classes, inheritance)))
    if fields is not None:
        state = cut(_replaced(state, by_impl_suffix(calls, state, methods, classes, fields)))
    full = cut(resolved_parents(classes.select("full_name", "package_name", "imports").dropDuplicates(["full_name"]), inheritance))
    return hierarchy_fan_out(state, methods, full, calls, statuses=WIDENED)


def by_impl_suffix(calls: DataFrame, state: DataFrame, methods: DataFrame, classes: DataFrame, fields: DataFrame) -> DataFrame:
    """(callsite_id, status, candidates) of calls without receiver type on a field of type X, from the only class XImpl."""
    caller = methods.select(F.col("id").alias("caller_method_id"), "class_full_name").dropDuplicates(["caller_method_id"])
    stuck = state.filter("status = 'unresolved_receiver'").select("callsite_id", "n")
    c = calls.filter("receiver not like '%.%' and rtrim(receiver) not like '%)'").select("callsite_id", "caller_method_id", "callee_name", "receiver").join(stuck, "callsite_id").join(caller, "caller_method_id")
    f = fields.groupBy("class_full_name", F.col("name").alias("receiver")).agg(F.min("type_name").alias("receiver_type"))
    hits = implementation_suffix(c.join(f, ["class_full_name", "receiver"]), classes, methods)
    arity = methods.select(F.col("id").alias("dst"), F.size(F.coalesce("parameter_types", F.array().cast("array<string>"))).alias("arity")).dropDuplicates(["dst"])
    j = hits.join(arity, "dst").join(stuck, "callsite_id")
    fits = (F.col("n") < 0) | (F.col("arity") == F.col("n"))
    g = j.groupBy("callsite_id").agg(F.array_sort(F.collect_set(F.when(fits, F.col("dst")))).alias("fit"), F.array_sort(F.collect_set("dst")).alias("all"))
    found = F.when(F.size("fit") > 0, F.col("fit")).otherwise(F.col("all"))
    return g.select("callsite_id", F.when(F.size(found) == 1, "resolved_impl_suffix").otherwise("ambiguous_overload").alias("status"), found.alias("candidates"))


def embedded_cascade(calls: DataFrame, methods: DataFrame, classes: DataFrame, embeds: DataFrame) -> DataFrame:
    """The cascade for languages with embedding: a bare call goes to the functions of its package's module classes, a call on
    a type of short name to the classes of that name, or else to what they embed (embeds: source full name, target short
    name), nearest first. Calls need callsite_id, package_name, callee_name, receiver, receiver_type (short). What classes
    reach isn't stored: each task has the graph at hand and gives the nearest classes only, unless the graph is too large."""
    m = methods.select("id", F.col("class_full_name").alias("cls"), F.col("method_name").alias("callee_name"))
    names = classes.select(F.col("full_name").alias("cls"), F.col("name").alias("short"), "package_name", F.coalesce(F.array_contains("stereotypes", "module"), F.lit(False)).alias("module")).distinct()
    bare = calls.filter("receiver is null").join(names.filter("module").select("package_name", "cls"), "package_name").join(m, ["cls", "callee_name"]).select("callsite_id", "id")
    typed = calls.filter("receiver is not null and receiver_type is not null").withColumn("short", ids.short_name("receiver_type"))
    asked = typed.select("short", "callee_name").distinct()
    owned = names.select("short", "cls").filter("short is not null and cls is not null").distinct()
    into = embeds.select(F.col("source").alias("cls"), ids.short_name("target").alias("short")).filter("cls is not null and short is not null").distinct()
    declared = m.select("callee_name", "cls").distinct().join(owned.select("cls").distinct(), "cls", "left_semi").join(asked.select("callee_name").distinct(), "callee_name", "left_semi")
    owned, into, declared = cut(owned), cut(into), cut(declared)
    if max(df.count() for df in (owned, into, declared)) <= walks.AT_HAND:
        near = _nearest_at_hand(asked, owned, into, declared).join(m, ["cls", "callee_name"]).groupBy("short", "callee_name").agg(F.collect_set("id").alias("ids"))
    else:
        inner = into.join(owned.withColumnRenamed("cls", "dst"), "short").select(F.col("cls").alias("src"), "dst").distinct()
        reach = deep_closure(inner).select(F.col("src").alias("owner"), F.col("dst").alias("cls"), F.col("depth"))
        reach = owned.select(F.col("cls").alias("owner"), "cls", F.lit(0).alias("depth")).unionByName(reach.filter("owner <> cls")).distinct()
        on = asked.join(owned.select("short", F.col("cls").alias("owner")), "short").join(reach, "owner").join(m, ["cls", "callee_name"])
        near = on.groupBy("short", "callee_name", "owner", "depth").agg(F.collect_set("id").alias("ids"))
        near = near.groupBy("short", "callee_name", "owner").agg(F.min_by("ids", "depth").alias("ids")).groupBy("short", "callee_name").agg(F.flatten(F.collect_list("ids")).alias("ids"))
    found = typed.join(near, ["short", "callee_name"]).select("callsite_id", F.explode("ids").alias("id"))
    return _counted(calls, bare.unionByName(found))


def _nearest_at_hand(asked: DataFrame, owned: DataFrame, into: DataFrame, declared: DataFrame) -> DataFrame:
    """(short, callee_name, cls): for each of ``asked`` (short, callee_name) the classes that declare the name nearest to a class
    of that short name, itself first (owned: classes with their short names; into: the short names that they embed)."""
    import pyarrow as pa

    spark = asked.sparkSession
    tables = [df.toArrow() for df in (owned.select("cls", "short"), into.select("cls", "short"), declared.select("cls", "callee_name"))]
    columns = [[t.column(i).to_pylist() for i in (0, 1)] for t in tables]
    classes, (own, source, declarer) = walks.coded(*(c[0] for c in columns))
    shorts, (short_of, target) = walks.coded(columns[0][1], columns[1][1])
    callees, (callee,) = walks.coded(columns[2][1])
    # a class leads to all of what it embeds, so a short name leads to what any of its classes embeds
    sort = lambda by, values: (values[np.argsort(by, kind="stable")], np.searchsorted(np.sort(by), np.arange(len(classes) + 1)))
    targets, target_at = sort(source, target)
    codes = np.argsort(own, kind="stable")
    named, first = own[codes], np.flatnonzero(np.diff(own[codes], prepend=-1))
    counts = np.diff(target_at)[own]
    ends = targets[np.repeat(target_at[own], counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)]
    edges = np.unique(np.repeat(short_of, counts) * max(1, len(shorts)) + ends)
    graph = walks.Graph(len(shorts), edges // max(1, len(shorts)), edges % max(1, len(shorts)))
    by_callee = np.argsort(callee, kind="stable")
    declaring, declaring_at = declarer[by_callee], np.searchsorted(callee[by_callee], np.arange(len(callees) + 1))
    shared = spark.sparkContext.broadcast((graph, targets, target_at, short_of[codes], named[first], first, {c: i for i, c in enumerate(callees)}, declaring, declaring_at, pa.array(classes, pa.string()), {c: i for i, c in enumerate(classes)}))

    def run(batches: Iterator) -> Iterator:
        graph, targets, target_at, short_of, named, first, callees, declaring, declaring_at, classes, places = shared.value
        far = np.full(len(classes), walks.FAR, np.int32)
        for batch in batches:
            wanted = []  # of each row: its names, the classes that declare them, where each name's begin, which are nearest
            for names in batch.column(1).to_pylist():
                known = [c for c in names if c in callees]
                each = [declaring[declaring_at[callees[c]] : declaring_at[callees[c] + 1]] for c in known]
                sizes = np.fromiter(map(len, each), np.int64, len(each))
                there = np.concatenate([*each, np.zeros(0, np.int64)]).astype(np.int64)
                wanted.append((known, there, np.cumsum(sizes) - sizes, sizes, np.zeros(len(there), bool)))
            owners = [(row, places[o]) for row, os in enumerate(batch.column(2).to_pylist()) if wanted[row][0] for o in os]
            for i in range(0, len(owners), graph.together):
                part = owners[i : i + graph.together]
                for (row, owner), reached in zip(part, graph.distances([targets[target_at[o] : target_at[o + 1]] for _, o in part]), strict=True):
                    far[named] = np.minimum.reduceat(reached[short_of], first)
                    far[owner] = -1
                    _, there, at, sizes, near = wanted[row]
                    distance = far[there]
                    least = np.repeat(np.minimum.reduceat(distance, at), sizes)
                    near |= (distance == least) & (distance < walks.FAR)
            for row, (known, there, _, sizes, near) in enumerate(wanted):
                if near.any():
                    of = np.repeat(np.arange(len(known)), sizes)[near]
                    yield pa.RecordBatch.from_arrays([pa.repeat(batch.column(0)[row], len(of)), pa.array(known, pa.string()).take(pa.array(of)), classes.take(pa.array(there[near]))], names=["short", "callee_name", "cls"])

    rows = asked.filter("callee_name is not null").groupBy("short").agg(F.collect_set("callee_name").alias("names")).join(owned.groupBy("short").agg(F.collect_set("cls").alias("owners")), "short")
    rows = rows.select("short", "names", "owners").repartition(max(4 * spark.sparkContext.defaultParallelism, len(shorts) // 256))
    return rows.mapInArrow(run, "short string, callee_name string, cls string")


def owner_cascade(calls: DataFrame, methods: DataFrame, classes: DataFrame) -> DataFrame:
    """The cascade for languages with types at hand: a call on a type goes to the classes of its short name, a bare call to
    its own class. Calls need callsite_id, caller_class, callee_name, receiver, receiver_type."""
    m = methods.select("id", F.col("class_full_name").alias("cls"), F.col("method_name").alias("callee_name"))
    names = classes.select(F.col("full_name").alias("cls"), ids.short_name("full_name").alias("short")).distinct()
    own = calls.filter("receiver is null").select("callsite_id", F.col("caller_class").alias("cls"), "callee_name").join(m, ["cls", "callee_name"]).select("callsite_id", "id")
    type_ = F.when(F.col("receiver") == "this", F.col("caller_class")).otherwise(bare_type(F.col("receiver_type")))
    typed = calls.filter("receiver is not null").select("callsite_id", "callee_name", ids.short_name(type_).alias("short")).filter("short is not null")
    many = names.join(m, "cls").groupBy("short", "callee_name").agg(F.collect_set("id").alias("ids"))
    found = typed.join(many, ["short", "callee_name"]).select("callsite_id", F.explode("ids").alias("id"))
    return _counted(calls, own.unionByName(found))


def _counted(calls: DataFrame, hits: DataFrame) -> DataFrame:
    g = hits.groupBy("callsite_id").agg(F.array_sort(F.collect_set("id")).alias("candidates"))
    j = calls.select("callsite_id").join(g, "callsite_id", "left").withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))
    return j.select("callsite_id", F.when(F.size("candidates") == 1, "resolved_exact").when(F.size("candidates") > 1, "resolved_ambiguous").otherwise("unresolved").alias("status"), "candidates")


# Annotations of classes that a container manages.
MANAGED = ("Service", "Repository", "Controller", "RestController", "Component", "Configuration", "Entity")


def static_beans(classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(full_name): managed classes by annotation, and what the ``@Bean`` methods of configuration classes return."""
    named = lambda c, *n: F.coalesce(F.arrays_overlap(rules.annotation_names(F.col(c)), F.array(*map(F.lit, n))), F.lit(False))
    managed = classes.filter(named("annotations", *MANAGED)).select("full_name")
    config = classes.filter(named("annotations", "Configuration")).select(F.col("full_name").alias("class_full_name")).distinct()
    made = methods.filter(named("annotations", "Bean") & (F.coalesce("return_type", F.lit("void")) != "void") & (F.col("return_type") != "")).join(config, "class_full_name", "left_semi").select(F.col("return_type").alias("full_name"))
    return managed.union(made).filter("full_name is not null").distinct()


def without_phantoms(calls: DataFrame, phantoms: DataFrame, confirmed: DataFrame) -> DataFrame:
    """(callsite_id, status) of calls (callsite_id, status, type, candidates) of which not every candidate is a phantom
    (phantoms: dst); calls without receiver whose type is confirmed (full_name) become ``actuator_resolved``."""
    lost = phantoms.select("dst").distinct()
    c = calls.select("callsite_id", F.explode("candidates").alias("dst")).join(lost.withColumn("gone", F.lit(1)), "dst", "left")
    only = c.groupBy("callsite_id").agg(F.count("*").alias("n"), F.count("gone").alias("k")).filter("n = k").select("callsite_id")
    kept = calls.join(only, "callsite_id", "left_anti").join(confirmed.select(F.col("full_name").alias("type"), F.lit(True).alias("sure")).distinct(), "type", "left")
    up = (F.col("status") == "unresolved_receiver") & F.col("sure").isNotNull()
    return kept.select("callsite_id", F.when(up, "actuator_resolved").otherwise(F.col("status")).alias("status"))


def implementation_suffix(calls: DataFrame, classes: DataFrame, methods: DataFrame) -> DataFrame:
    """(callsite_id, dst): calls on a type X for which there is exactly one class XImpl that declares the name."""
    short = classes.select("full_name", ids.short_name("full_name").alias("short")).distinct()
    impl = short.groupBy("short").agg(F.count("*").alias("k"), F.min("full_name").alias("impl")).filter("k = 1 and short like '%Impl'")
    c = calls.select("callsite_id", "callee_name", F.concat(ids.short_name(bare_type(F.col("receiver_type"))), F.lit("Impl")).alias("short"))
    m = methods.select(F.col("id").alias("dst"), F.col("class_full_name").alias("impl"), F.col("method_name").alias("callee_name"))
    return c.join(impl, "short").join(m, ["impl", "callee_name"]).select("callsite_id", "dst")


def phantom_edges(edges: DataFrame, methods: DataFrame, classes: DataFrame, confirmed: DataFrame, annotations: tuple[str, ...] = ("Service", "Component", "Repository", "Controller", "RestController", "Configuration")) -> DataFrame:
    """Edges with ``phantom``: whether they lead to a managed class that isn't among the ``confirmed`` (full_name)."""
    managed = F.exists("annotations", lambda a: F.regexp_extract(a, r"^[@\[]?(?:[\w.]*\.)?(\w+)", 1).isin(*annotations))
    suspects = classes.filter(F.coalesce(managed, F.lit(False))).select("full_name").distinct().join(confirmed, "full_name", "left_anti")
    m = methods.select(F.col("id").alias("dst"), F.col("class_full_name").alias("full_name")).join(suspects, "full_name", "left_semi").select("dst").distinct().withColumn("phantom", F.lit(True))
    return edges.join(m, "dst", "left").withColumn("phantom", F.coalesce("phantom", F.lit(False)))


def reachable_imports(edges: DataFrame, methods: DataFrame, imports: DataFrame, depth: int | None = None) -> DataFrame:
    """Edges within a module, or into a module that the caller's module imports directly or over others (src, dst modules)."""
    m = methods.select("id", "module_id").dropDuplicates(["id"])
    full = edges.join(m.select(F.col("id").alias("src"), F.col("module_id").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("module_id").alias("b")), "dst")
    reach = closure(imports, depth=depth).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    inside = full.filter("a <=> b")
    across = full.filter("not (a <=> b)").join(reach, ["a", "b"], "left_semi")
    return inside.unionByName(across).select(*edges.columns)


def chain_receivers(calls: DataFrame, resolved: DataFrame, methods: DataFrame) -> DataFrame:
    """(callsite_id, receiver_type): types of receivers that are themselves calls: the return type of the call whose text the
    receiver is, in the same caller; of several with that text, the last."""
    inner = calls.select("caller_method_id", F.col("text").alias("receiver"), F.col("callsite_id").alias("inner_id"), "line", "column_no")
    inner = inner.groupBy("caller_method_id", "receiver").agg(F.max_by("inner_id", F.struct("line", "column_no", "inner_id")).alias("inner_id"))
    linked = calls.filter("rtrim(receiver) like '%)'").select("callsite_id", "caller_method_id", "receiver").join(inner, ["caller_method_id", "receiver"]).filter("callsite_id <> inner_id")
    returns = resolved.filter(F.size("candidates") > 0).select(F.col("callsite_id").alias("inner_id"), F.get("candidates", 0).alias("id")).join(methods.select("id", "return_type").dropDuplicates(["id"]), "id").select("inner_id", "return_type")
    return linked.join(returns, "inner_id").select("callsite_id", bare_type(F.col("return_type")).alias("receiver_type")).filter("receiver_type is not null")

