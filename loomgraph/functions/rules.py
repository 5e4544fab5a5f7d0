"""Row-level rules of a code graph as Column expressions: stereotypes, endpoints, roles, variants, noise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Call names, receiver types and prefixes that say nothing about a program's own structure.
NOISY_NAMES = "debug info warn error trace isDebugEnabled isInfoEnabled map flatMap filter forEach stream collect toList isPresent orElse orElseGet orElseThrow get put add remove clear size isEmpty toString equals hashCode".split()
NOISY_TYPES = "String Boolean Integer Long Double Float Object List Map Set Collection Optional Stream Mono Flux".split()
NOISY_PREFIXES = {
    "java": ["java.", "javax.", "jakarta.", "org.slf4j.", "ch.qos.logback.", "reactor.core.publisher.", "reactor.util.", "io.micrometer."],
    "python": ["logging.", "typing.", "collections.abc.", "functools.", "itertools."],
    "typescript": ["console.", "rxjs.", "lodash.", "util."],
}
FLUENT_NAMES = "and map flatMap filter doOnNext doOnError doOnCancel doOnTerminate subscribeOn elapsed".split()
LOW_PRIORITY_PARTS = [".metrics.", ".datadog.", ".config.datadog.", ".prometheus.", ".utils.", ".model."]
LAMBDA_CALLS = "containerResponse entityId entityType getT1 getT2 getClass getMessage getSimpleName isCacheHit value".split()
LAMBDA_RECEIVERS = "p t ex e err error throwable result response item entry".split()
MAPPINGS = {"GetMapping": "GET", "PostMapping": "POST", "PutMapping": "PUT", "PatchMapping": "PATCH", "DeleteMapping": "DELETE"}
#: Fewer methods than the key: tier, most characters, most source lines, results, depth.
TIERS = [(200, "XS", 6_000, 60, 6, 5), (1_000, "S", 10_000, 50, 5, 4), (5_000, "M", 14_000, 40, 4, 4), (20_000, "L", 18_000, 30, 4, 3), (None, "XL", 22_000, 20, 3, 3)]


def annotation_name(a: Column) -> Column:
    """``@a.b.Name(args)`` is ``Name``."""
    return F.substring_index(F.substring_index(F.ltrim(a, F.lit("@[ ")), "(", 1), ".", -1)


def annotation_names(annotations: Column) -> Column:
    return F.transform(annotations, annotation_name)


def annotation_value(a: Column) -> Column:
    """The first quoted string among an annotation's arguments; null if there is none."""
    v = F.regexp_extract(a, r"\([^\"']*[\"']([^\"']*)[\"']", 1)
    return F.when(v != "", v)


def class_stereotypes(name: Column, annotations: Column, kind: Column | None = None) -> Column:
    """Sorted stereotypes: the structural kind if it isn't a class, else by annotations and suffix, else ``unknown``."""
    names = F.coalesce(annotation_names(annotations), F.array().cast("array<string>"))
    has = lambda n: F.array_contains(names, n)
    pairs = [
        (has("RestController") | has("Controller"), "controller"),
        (has("RestController"), "rest_controller"),
        (has("Service"), "service"),
        (has("Service") & has("Transactional"), "transactional_service"),
        (has("Repository"), "repository"),
        (has("Component"), "component"),
        (has("Configuration"), "configuration"),
        (has("Entity"), "entity"),
        (name.rlike("(Dto|DTO)$"), "dto"),
        (name.rlike("Tests?$"), "test"),
    ]
    found = F.array_sort(F.array_compact(F.array(*(F.when(c, F.lit(v)) for c, v in pairs))))
    found = F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("unknown")))
    if kind is None:
        return found
    structural = F.regexp_extract(kind, "^(interface|enum|record|annotation)(?:_type)?_declaration$", 1)
    return F.when(structural != "", F.array(structural)).otherwise(found)


def endpoint(method_annotations: Column, class_annotations: Column) -> Column:
    """Struct of is_endpoint, http_method, route, controller_route, full_route from mapping annotations."""
    known = F.array(*(F.lit(x) for x in (*MAPPINGS, "RequestMapping")))
    mapped = F.filter(method_annotations, lambda a: F.array_contains(known, annotation_name(a)))
    last_verb = F.try_element_at(F.filter(F.transform(mapped, lambda a: F.coalesce(*(F.when(annotation_name(a) == m, F.lit(v)) for m, v in MAPPINGS.items()), F.upper(F.nullif(F.regexp_extract(a, r"RequestMethod\.(\w+)", 1), F.lit(""))))), lambda x: x.isNotNull()), F.lit(-1))
    route = F.try_element_at(F.filter(F.transform(mapped, annotation_value), lambda x: x.isNotNull()), F.lit(-1))
    base = annotation_value(F.get(F.filter(class_annotations, lambda a: annotation_name(a) == "RequestMapping"), 0))
    whole = F.concat(F.rtrim(F.coalesce(base, F.lit("")), F.lit("/")), F.lit("/"), F.ltrim(F.coalesce(route, F.lit("")), F.lit("/")))
    full = F.when(base.isNotNull() | route.isNotNull(), F.replace(whole, F.lit("//"), F.lit("/")))
    return F.struct(F.coalesce(F.size(mapped) > 0, F.lit(False)).alias("is_endpoint"), F.when(F.size(mapped) > 0, last_verb).alias("http_method"), F.when(F.size(mapped) > 0, route).alias("route"), base.alias("controller_route"), full.alias("full_route"))


def framework_role(annotations: Column, is_endpoint: Column) -> Column:
    names = annotation_names(annotations)
    has = lambda n: F.array_contains(names, n)
    return F.when(is_endpoint, "http_handler").when(has("EventListener"), "event_listener").when(has("Scheduled"), "scheduled_task").when(has("Async"), "async_task")


def path_variant(path: Column) -> Column:
    """``test`` for paths of tests, else ``main``."""
    p = F.concat(F.lit("/"), F.translate(path, "\\", "/"))
    return F.when(p.rlike(r"/src/test/|/tests?/|/test_[^/]*\.py$|_test\.py$"), "test").otherwise("main")


def generated_path(path: Column) -> Column:
    return path.rlike("build/generated|generated-sources") & ~path.rlike("smithy4[js]")


def demoted_path(path: Column) -> Column:
    """Paths that search ranks last."""
    return path.rlike(r"\.pb\.|_generated|/generated/|mock_|/mocks/|/build/generated|generated-src|/build/classes|/out/production")


def budget(methods: Column) -> Column:
    """Struct of tier, max_chars, max_source_lines, top_n and depth for a graph of so many methods."""
    row = lambda v: F.struct(*(F.lit(x).alias(n) for n, x in zip(("tier", "max_chars", "max_source_lines", "top_n", "depth"), v, strict=True)))
    out = None
    for below, *limits in TIERS[:-1]:
        out = F.when(methods < below, row(limits)) if out is None else out.when(methods < below, row(limits))
    return out.otherwise(row(TIERS[-1][1:]))


def budget_tier(methods: Column) -> Column:
    return budget(methods).getField("tier")


def script_roles(name: Column, decorators: Column, has_markup: Column) -> Column:
    """The role of a function of a script: http_handler, component, hook or null."""
    verb = F.arrays_overlap(decorators, F.array(*map(F.lit, ("Get", "Post", "Put", "Delete", "Patch", "Options", "Head", "All"))))
    return F.when(F.coalesce(verb, F.lit(False)), "http_handler").when(F.coalesce(F.array_contains(decorators, "Component"), F.lit(False)), "component").when(name.rlike("^use[A-Z]"), "hook").when(F.coalesce(has_markup, F.lit(False)), "component")


def script_path_stereotypes(path: Column) -> Column:
    """Stereotypes of a script by its path."""
    kinds = [(r"\.service\.tsx?$|/services?/", "service"), (r"\.controller\.tsx?$|/controllers?/", "controller"), (r"\.component\.tsx?$|/components?/", "component"), ("/hooks/use[A-Z]", "hook"), ("/composables/use[A-Z]", "vue_composable")]
    return F.array_compact(F.array(*(F.when(path.rlike(p), F.lit(k)) for p, k in kinds)))


def scala_stereotypes(name: Column, kind: Column) -> Column:
    """Stereotypes by kind (trait, object, interface), else by suffix."""
    one = F.when(kind.isin("trait", "object", "interface"), kind).when(name.endswith("Controller"), "controller").when(name.endswith("Service"), "service").when(name.rlike("(Repository|Repo)$"), "repository").otherwise("unknown")
    return F.array(one)


#: Types of literals as arguments, by kind of literal.
LITERALS = {"string": "java.lang.String", "character": "char", "integer": "int", "floating": "double", "boolean": "boolean", "null": "null"}


def argument_type(text: Column, variables: Column) -> Column:
    """The type of an argument as written: of a literal by its form, of a name by ``variables`` (a map), else null."""
    a = F.trim(text)
    kind = (
        F.when(a.rlike(r'^".*"$'), "string").when(a.rlike(r"^'.{1,2}'$|^'\\u[0-9a-fA-F]{4}'$"), "character").when(a.rlike(r"^(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|[0-9][0-9_]*)[lL]?$"), "integer")
        .when(a.rlike(r"^[0-9][0-9_]*\.?[0-9_]*(?:[eE][+-]?[0-9]+)?[fFdD]?$|^\.[0-9]+"), "floating").when(a.isin("true", "false"), "boolean").when(a == "null", "null")
    )
    literal = None
    for k, v in LITERALS.items():
        literal = F.when(kind == k, v) if literal is None else literal.when(kind == k, v)
    return F.coalesce(literal, F.when(a.rlike(r"^[A-Za-z_$][\w$]*$"), F.try_element_at(variables, a)))


#: Colours and shapes of nodes in drawings.
COLOURS = {"controller": "#e76f51", "service": "#2a9d8f", "repository": "#264653", "entity": "#e9c46a", "component": "#f4a261"}


def decorations(stereotypes: Column, is_endpoint: Column, title: Column) -> Column:
    """Struct of colour, shape and title of a node."""
    colour = None
    for kind, value in COLOURS.items():
        hit = F.array_contains(stereotypes, kind)
        colour = F.when(hit, value) if colour is None else colour.when(hit, value)
    return F.struct(colour.otherwise("#999999").alias("colour"), F.when(F.coalesce(is_endpoint, F.lit(False)), "diamond").otherwise("dot").alias("shape"), title.alias("title"))


def noisy_call(callee: Column, receiver: Column, receiver_type: Column, status: Column, language: Column) -> Column:
    """Whether a call is left out of a method's context."""
    simple = F.substring_index(F.regexp_replace(receiver_type, r"<.*$", ""), ".", -1)
    any_prefix = lambda c, l: F.exists(F.array(*(F.lit(p) for p in NOISY_PREFIXES[l])), lambda p: c.startswith(p) | (c == F.rtrim(p, F.lit("."))))  # noqa: E731, E741
    by_language = lambda c: F.when(language == "python", any_prefix(c, "python")).when(language == "typescript", any_prefix(c, "typescript")).otherwise(any_prefix(c, "java"))
    external = (status == "external_library") & ~((language == "typescript") & (F.coalesce(receiver, F.lit("")) == ""))
    parts = [callee.isin(NOISY_NAMES), simple.isin(NOISY_TYPES), by_language(receiver_type), by_language(receiver), external]
    out = F.lit(False)
    for p in parts:
        out = out | F.coalesce(p, F.lit(False))
    return out


def lambda_noise(call: Column, reason: Column, receiver: Column) -> Column:
    """Whether an unresolved call is one on a lambda's own variable, or one of a few names that say nothing."""
    r = F.lower(F.trim(F.coalesce(receiver, F.lit(""))))
    starts = F.exists(F.array(*map(F.lit, LAMBDA_RECEIVERS)), lambda n: r.startswith(F.concat(n, F.lit("."))))
    return F.coalesce((reason == "unresolved_receiver") & (call.isin(LAMBDA_CALLS) | r.isin(LAMBDA_RECEIVERS) | starts), F.lit(False))


def path_matches(stored: Column, asked: Column) -> Column:
    """Equal paths, or one a suffix of the other at a slash."""
    a, b = F.translate(stored, "\\", "/"), F.translate(asked, "\\", "/")
    return (a == b) | a.endswith(F.concat(F.lit("/"), b)) | b.endswith(F.concat(F.lit("/"), a))
