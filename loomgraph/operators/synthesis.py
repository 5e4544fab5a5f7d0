"""Rows that follow from others: members that frameworks add, types of receivers, texts to embed, gaps to fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ids, rules

# Supertypes that give a repository its methods, and those methods.
REPOSITORY_TYPES = "Repository CrudRepository PagingAndSortingRepository JpaRepository MongoRepository ReactiveCrudRepository ReactiveMongoRepository ReactiveSortingRepository JpaSpecificationExecutor QuerydslPredicateExecutor".split()
CRUD_METHODS = "findById findAll save saveAll delete deleteById deleteAll existsById count flush".split()


def repository_methods(classes: DataFrame, inheritance: DataFrame) -> DataFrame:
    """(class_id, class_full_name, method_name, generated): the methods of repositories that nobody writes. The ten names are
    an array in each row; there is no join to multiply them."""
    marked = inheritance.filter(ids.short_name(F.regexp_replace("target", "<.*$", "")).isin(REPOSITORY_TYPES)).select(F.col("source_id").alias("class_id")).distinct()
    c = classes.select(F.col("id").alias("class_id"), F.col("full_name").alias("class_full_name")).join(marked, "class_id", "left_semi")
    return c.select("class_id", "class_full_name", F.explode(F.array(*(F.lit(m) for m in CRUD_METHODS))).alias("method_name"), F.lit(True).alias("generated"))


def _has(annotations: Column, *names: str) -> Column:
    return F.coalesce(F.arrays_overlap(rules.annotation_names(annotations), F.array(*(F.lit(n) for n in names))), F.lit(False))


def accessor_methods(classes: DataFrame, fields: DataFrame) -> DataFrame:
    """(class_id, method_name, parameter_types, return_type, kind): getters, setters and builder methods that class
    annotations ask for, from fields (class_id, name, type_name, modifiers)."""
    c = classes.select(F.col("id").alias("class_id"), "full_name", _has(F.col("annotations"), "Data", "Getter", "Value").alias("get"), _has(F.col("annotations"), "Data", "Setter").alias("set"), _has(F.col("annotations"), "Builder").alias("build"))
    f = fields.filter(~F.coalesce(F.array_contains("modifiers", "static"), F.lit(False))).join(c, "class_id")
    cap = F.concat(F.upper(F.substring("name", 1, 1)), F.expr("substring(name, 2)"))
    prefix = F.when(F.lower("type_name") == "boolean", F.when(F.col("type_name") == "boolean", "is").otherwise("get")).otherwise("get")
    none = F.array().cast("array<string>")
    final = F.coalesce(F.array_contains("modifiers", "final"), F.lit(False))
    made = F.array_compact(
        F.array(
            F.when(F.col("get"), F.struct(F.concat(prefix, cap).alias("method_name"), none.alias("parameter_types"), F.col("type_name").alias("return_type"), F.lit("getter").alias("kind"))),
            F.when(F.col("set") & ~final, F.struct(F.concat(F.lit("set"), cap).alias("method_name"), F.array("type_name").alias("parameter_types"), F.lit("void").alias("return_type"), F.lit("setter").alias("kind"))),
            F.when(F.col("build"), F.struct(F.col("name").alias("method_name"), F.array("type_name").alias("parameter_types"), F.concat(F.col("full_name"), F.lit("Builder")).alias("return_type"), F.lit("builder").alias("kind"))),
        )
    )
    own = f.select("class_id", F.explode(made).alias("m")).select("class_id", "m.*")
    starts = c.filter("build").select("class_id", F.explode(F.array(F.struct(F.lit("builder").alias("method_name"), none.alias("parameter_types"), F.concat("full_name", F.lit("Builder")).alias("return_type"), F.lit("builder").alias("kind")), F.struct(F.lit("build").alias("method_name"), none.alias("parameter_types"), F.col("full_name").alias("return_type"), F.lit("builder").alias("kind")))).alias("m")).select("class_id", "m.*")
    return own.unionByName(starts)


def receiver_types(calls: DataFrame, methods: DataFrame, fields: DataFrame | None = None) -> DataFrame:
    """(callsite_id, receiver_type, how): the type of a receiver by name: the class itself, a local variable, a parameter, a field."""
    m = methods.select(F.col("id").alias("caller_method_id"), F.col("class_full_name").alias("own_class"), "local_variable_types", F.map_from_arrays(F.coalesce("parameter_names", F.array().cast("array<string>")), F.coalesce("parameter_types", F.array().cast("array<string>"))).alias("parameters")).dropDuplicates(["caller_method_id"])
    c = calls.select("callsite_id", "caller_method_id", "receiver").join(m, "caller_method_id", "left")
    if fields is not None:
        f = fields.groupBy(F.col("class_full_name").alias("own_class"), F.col("name").alias("receiver")).agg(F.min("type_name").alias("field_type"))
        c = c.join(f, ["own_class", "receiver"], "left")
    else:
        c = c.withColumn("field_type", F.lit(None).cast("string"))
    name = F.regexp_replace("receiver", r"^(?:this|self)\.", "")
    own = F.col("receiver").isNull() | F.col("receiver").isin("this", "self")
    local, param = F.try_element_at("local_variable_types", name), F.try_element_at("parameters", name)
    kind = F.when(own, "same_class").when(local.isNotNull(), "local").when(param.isNotNull(), "parameter").when(F.col("field_type").isNotNull(), "field").otherwise("unknown")
    return c.select("callsite_id", F.when(own, F.col("own_class")).otherwise(F.coalesce(local, param, "field_type")).alias("receiver_type"), kind.alias("how"))


def with_hints(calls: DataFrame, hints: DataFrame) -> DataFrame:
    """Calls with the receiver types of a type checker (file_path, line, hint) where they have none."""
    h = hints.groupBy("file_path", "line").agg(F.min("hint").alias("hint"))
    return calls.join(h, ["file_path", "line"], "left").withColumn("receiver_type", F.coalesce("receiver_type", "hint")).select(*calls.columns)


def embedding_payloads(methods: DataFrame, source_chars: int = 2000) -> DataFrame:
    """(method_id, payload, text_hash): the text that is embedded for a method, white space made plain, nulls left out."""
    line = lambda label, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}: "), c))
    plain = F.trim(F.regexp_replace(F.substring("source", 1, source_chars), r"\s+", " "))
    text = F.concat_ws("\n", line("method", F.col("method_name")), line("class", F.col("class_full_name")), line("signature", F.col("signature")), line("returns", F.col("return_type")), line("parameters", F.array_join("parameter_names", ", ")), line("annotations", F.array_join("annotations", " ")), line("role", F.col("framework_role")), line("route", F.coalesce("full_route", "route")), line("source", plain))
    return methods.select(F.col("id").alias("method_id"), text.alias("payload"), ids.payload_hash(text).alias("text_hash"))


def uncovered(files: DataFrame, *parsed: DataFrame) -> DataFrame:
    """Files (file_path) of which no entity came out, to be read another way."""
    seen = None
    for p in parsed:
        one = p.select("file_path").distinct()
        seen = one if seen is None else seen.union(one)
    return files.join(seen, "file_path", "left_anti")


def inner_classes(classes: DataFrame) -> DataFrame:
    """(outer, inner, full_name): classes by their last two names; of several ``$`` wins over a dot, then the least name."""
    name = F.regexp_extract("full_name", r"(\w+)[.$](\w+)$", 1)
    inner = F.regexp_extract("full_name", r"(\w+)[.$](\w+)$", 2)
    rows = classes.select(name.alias("outer"), inner.alias("inner"), "full_name").filter("outer <> ''")
    return rows.groupBy("outer", "inner").agg(F.min_by("full_name", F.struct(F.when(F.col("full_name").contains("$"), 0).otherwise(1), F.col("full_name"))).alias("full_name"))
