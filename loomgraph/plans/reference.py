"""Queries over the code-graph tables, the documents and the events, one or more for each operator, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, rules, text
from ..operators import changes, docs, flows, resolve, rollups, search, synthesis, traversal
from ..operators import code_graph as cg
from ..session import spread
from ..sources.tables import table
from ..streaming import debounce

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- what the SQL shares

EDGES = """
edges AS (SELECT DISTINCT id AS callsite_id, lower(trim(caller_method_id)) AS src, lower(trim(c)) AS dst FROM (
  SELECT id, caller_method_id, unnest(CAST(json(resolved_candidates_json) AS VARCHAR[])) AS c FROM callsites
  WHERE json_valid(resolved_candidates_json) AND json_type(CASE WHEN json_valid(resolved_candidates_json) THEN resolved_candidates_json END) = 'ARRAY')
  WHERE trim(caller_method_id) <> '' AND trim(c) <> '')
"""
PAIRS = EDGES + ", pairs AS (SELECT DISTINCT src, dst FROM edges)"
#: One row per method, by least values, so that both engines choose alike.
METHODS = "m AS (SELECT id, min(file_path) AS file_path, min(method_name) AS method_name, min(class_full_name) AS class_full_name, min(signature) AS signature, max(length(coalesce(source, ''))) AS chars FROM methods GROUP BY id)"
INHERITANCE = r"""
inh AS (SELECT DISTINCT source_id, source, regexp_replace(target, '\s*[<\[].*$', '') AS target, relation FROM (
  SELECT id AS source_id, full_name AS source, trim(extends) AS target, 'extends' AS relation FROM classes WHERE trim(extends) <> ''
  UNION ALL SELECT id, full_name, trim(unnest(CAST(json(implements_json) AS VARCHAR[]))), 'implements' FROM classes WHERE json_valid(implements_json))
  WHERE regexp_replace(target, '\s*[<\[].*$', '') <> '')
"""


def t(spark: SparkSession, folder: str, *names: str):  # noqa: ANN201
    out = [table(spark, folder, n) for n in names]
    return out if len(out) > 1 else out[0]


def one_per_method(methods: DataFrame) -> DataFrame:
    least = [F.min(c).alias(c) for c in ("file_path", "method_name", "class_full_name", "signature")]
    return methods.groupBy("id").agg(*least, F.max(F.coalesce("source", F.lit(""))).alias("source"), F.max(F.length(F.coalesce("source", F.lit("")))).alias("chars"))


def edges_of(spark: SparkSession, folder: str) -> DataFrame:
    return cg.call_edges(t(spark, folder, "callsites"))


#: The starting points of walks: all endpoint methods.
ENDPOINTS = "(SELECT lower(trim(id)) FROM methods WHERE is_endpoint)"


def endpoints_of(spark: SparkSession, folder: str, edges: DataFrame, side: str = "src") -> DataFrame:
    """The endpoint methods that have calls of their own, or with ``dst`` those that are called."""
    ends = t(spark, folder, "methods").filter("is_endpoint").select(cg.key("id").alias("id")).distinct()
    return edges.select(F.col(side).alias("id")).distinct().join(ends, "id", "left_semi")


# ---------------------------------------------------------------- ids, projections, rules


@query("SELECT DISTINCT id, substr(sha1('class::' || full_name || '::' || file_path), 1, 16) AS class_key FROM classes WHERE full_name IS NOT NULL AND file_path IS NOT NULL")
def id_classes(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes").filter("full_name is not null and file_path is not null")
    return c.select("id", ids.class_id("full_name", "file_path").alias("class_key")).distinct()


@query("SELECT DISTINCT id, class_full_name || '#' || method_name || '(' || array_to_string(parameter_types, ', ') || ')' AS sig, substr(sha1('method::' || class_full_name || '#' || method_name || '(' || array_to_string(parameter_types, ', ') || ')::' || file_path || '::' || start_line), 1, 16) AS method_key FROM methods WHERE class_full_name IS NOT NULL AND method_name IS NOT NULL AND parameter_types IS NOT NULL AND start_line IS NOT NULL AND file_path IS NOT NULL")
def id_methods(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods").filter("class_full_name is not null and method_name is not null and parameter_types is not null and start_line is not null and file_path is not null")
    sig = ids.signature("class_full_name", "method_name", "parameter_types")
    return m.select("id", sig.alias("sig"), ids.method_id(sig, "file_path", "start_line").alias("method_key")).distinct()


@query("SELECT id, CASE WHEN regexp_matches('/' || replace(file_path, '\\', '/'), '/src/test/|/tests?/|/test_[^/]*\\.py$|_test\\.py$') THEN 'test' ELSE 'main' END AS path_variant, count(*) AS n FROM methods GROUP BY ALL")
def rule_path_variant(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "methods").groupBy("id", rules.path_variant(F.col("file_path")).alias("path_variant")).agg(F.count("*").alias("n"))


@query("SELECT annotation, count(*) AS n FROM (SELECT split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1) AS annotation FROM (SELECT unnest(annotations) AS a FROM methods)) GROUP BY ALL")
def rule_annotation_names(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods").select(F.explode(rules.annotation_names(F.col("annotations"))).alias("annotation"))
    return m.groupBy("annotation").agg(F.count("*").alias("n"))


@query("""
WITH a AS (SELECT id, name, list_transform(annotations, lambda a: split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1)) AS n FROM classes),
s AS (SELECT id, list_sort(list_filter([
  CASE WHEN list_contains(n, 'RestController') OR list_contains(n, 'Controller') THEN 'controller' END, CASE WHEN list_contains(n, 'RestController') THEN 'rest_controller' END,
  CASE WHEN list_contains(n, 'Service') THEN 'service' END, CASE WHEN list_contains(n, 'Service') AND list_contains(n, 'Transactional') THEN 'transactional_service' END,
  CASE WHEN list_contains(n, 'Repository') THEN 'repository' END, CASE WHEN list_contains(n, 'Component') THEN 'component' END, CASE WHEN list_contains(n, 'Configuration') THEN 'configuration' END,
  CASE WHEN list_contains(n, 'Entity') THEN 'entity' END, CASE WHEN name LIKE '%Dto' OR name LIKE '%DTO' THEN 'dto' END, CASE WHEN name LIKE '%Test' OR name LIKE '%Tests' THEN 'test' END], lambda x: x IS NOT NULL)) AS l FROM a)
SELECT id, CASE WHEN len(l) > 0 THEN array_to_string(l, ',') ELSE 'unknown' END AS stereotypes FROM s
""")
def rule_class_stereotypes(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return c.select("id", F.array_join(rules.class_stereotypes(F.col("name"), F.col("annotations")), ",").alias("stereotypes"))


@query(r"""
WITH o AS (SELECT id AS class_id, max(annotations) AS ca FROM classes GROUP BY id), j AS (SELECT m.id, m.annotations, o.ca FROM methods m LEFT JOIN o ON o.class_id = m.class_id),
x AS (SELECT *, list_transform(list_filter(annotations, lambda a: list_contains(['GetMapping','PostMapping','PutMapping','PatchMapping','DeleteMapping','RequestMapping'], split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1))), lambda a: a) AS mapped,
  nullif(regexp_extract(list_filter(ca, lambda a: split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1) = 'RequestMapping')[1], '\([^"'']*["'']([^"'']*)["'']', 1), '') AS base FROM j),
y AS (SELECT *, list_filter(list_transform(mapped, lambda a: nullif(regexp_extract(a, '\([^"'']*["'']([^"'']*)["'']', 1), '')), lambda v: v IS NOT NULL)[-1] AS route, list_filter(list_transform(mapped, lambda a: CASE split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1) WHEN 'GetMapping' THEN 'GET' WHEN 'PostMapping' THEN 'POST' WHEN 'PutMapping' THEN 'PUT' WHEN 'PatchMapping' THEN 'PATCH' WHEN 'DeleteMapping' THEN 'DELETE' ELSE upper(nullif(regexp_extract(a, 'RequestMethod\.(\w+)', 1), '')) END), lambda v: v IS NOT NULL)[-1] AS verb FROM x)
SELECT id, coalesce(len(mapped) > 0, false) AS is_endpoint, CASE WHEN len(mapped) > 0 THEN verb END AS http_method, CASE WHEN len(mapped) > 0 THEN route END AS route, base AS controller_route, CASE WHEN base IS NOT NULL OR route IS NOT NULL THEN replace(rtrim(coalesce(base, ''), '/') || '/' || ltrim(coalesce(route, ''), '/'), '//', '/') END AS full_route FROM y
""")
def rule_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    owner = c.groupBy(F.col("id").alias("class_id")).agg(F.max("annotations").alias("class_annotations"))
    j = m.select("id", "class_id", "annotations").join(owner, "class_id", "left")
    return j.select("id", rules.endpoint(F.col("annotations"), F.col("class_annotations")).alias("e")).select("id", "e.*")


@query("SELECT id, CASE WHEN is_endpoint THEN 'http_handler' WHEN list_contains(n, 'EventListener') THEN 'event_listener' WHEN list_contains(n, 'Scheduled') THEN 'scheduled_task' WHEN list_contains(n, 'Async') THEN 'async_task' END AS role FROM (SELECT id, is_endpoint, list_transform(annotations, lambda a: split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1)) AS n FROM methods)")
def rule_framework_roles(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "methods").select("id", rules.framework_role(F.col("annotations"), F.col("is_endpoint")).alias("role"))


@query("SELECT module_id, count(DISTINCT id) AS methods, CASE WHEN count(DISTINCT id) < 200 THEN 'XS' WHEN count(DISTINCT id) < 1000 THEN 'S' WHEN count(DISTINCT id) < 5000 THEN 'M' WHEN count(DISTINCT id) < 20000 THEN 'L' ELSE 'XL' END AS tier FROM methods GROUP BY module_id")
def rule_budget_tiers(spark: SparkSession, folder: str) -> DataFrame:
    n = t(spark, folder, "methods").groupBy("module_id").agg(F.count_distinct("id").alias("methods"))
    return n.select("module_id", "methods", rules.budget_tier(F.col("methods")).alias("tier"))


@query("SELECT callee_name, count(*) AS n FROM callsites WHERE callee_name IN ('debug','info','warn','error','trace','isDebugEnabled','isInfoEnabled','map','flatMap','filter','forEach','stream','collect','toList','isPresent','orElse','orElseGet','orElseThrow','get','put','add','remove','clear','size','isEmpty','toString','equals','hashCode') GROUP BY ALL")
def filter_noisy_names(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "callsites").filter(F.col("callee_name").isin(rules.NOISY_NAMES)).groupBy("callee_name").agg(F.count("*").alias("n"))


def _quoted(names: list[str]) -> str:
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


def _prefixed(c: str, prefixes: list[str]) -> str:
    return "(" + " OR ".join(f"starts_with({c}, '{p}') OR {c} = rtrim('{p}', '.')" for p in prefixes) + ")"


def _by_language(c: str) -> str:
    return f"CASE language WHEN 'python' THEN {_prefixed(c, rules.NOISY_PREFIXES['python'])} WHEN 'typescript' THEN {_prefixed(c, rules.NOISY_PREFIXES['typescript'])} ELSE {_prefixed(c, rules.NOISY_PREFIXES['java'])} END"


@query(f"""
WITH l AS (SELECT id, min(language) AS language FROM methods GROUP BY id), j AS (SELECT s.*, coalesce(l.language, 'java') AS language, coalesce(receiver_type_normalized, receiver_type, receiver_type_raw) AS ty FROM callsites s LEFT JOIN l ON l.id = s.caller_method_id),
n AS (SELECT caller_method_id, coalesce(callee_name IN {_quoted(rules.NOISY_NAMES)}, false) OR coalesce(split_part(regexp_replace(ty, '<.*$', ''), '.', -1) IN {_quoted(rules.NOISY_TYPES)}, false) OR coalesce({_by_language('ty')}, false) OR coalesce({_by_language('receiver')}, false)
  OR coalesce(resolution_status = 'external_library' AND NOT (language = 'typescript' AND coalesce(receiver, '') = ''), false) AS noise FROM j)
SELECT caller_method_id, count(*) FILTER (NOT noise) AS kept, count(*) FILTER (noise) AS noise FROM n GROUP BY 1
""")
def filter_context_calls(spark: SparkSession, folder: str) -> DataFrame:
    s, m = t(spark, folder, "callsites", "methods")
    lang = m.groupBy(F.col("id").alias("caller_method_id")).agg(F.min("language").alias("language"))
    j = s.join(lang, "caller_method_id", "left")
    noise = rules.noisy_call(F.col("callee_name"), F.col("receiver"), F.coalesce("receiver_type_normalized", "receiver_type", "receiver_type_raw"), F.col("resolution_status"), F.coalesce("language", F.lit("java")))
    return j.withColumn("noise", noise).groupBy("caller_method_id").agg(F.count_if(~F.col("noise")).alias("kept"), F.count_if("noise").alias("noise"))


# ---------------------------------------------------------------- selectors and filters


@query("WITH " + METHODS + ", one AS (SELECT min(method_name) AS s FROM m), h AS (SELECT m.*, CASE WHEN id = s THEN 1 WHEN signature = s THEN 2 WHEN class_full_name || '.' || method_name = s OR class_full_name || '#' || method_name = s THEN 3 WHEN split_part(class_full_name, '.', -1) || '.' || method_name = s OR split_part(class_full_name, '.', -1) || '#' || method_name = s THEN 4 WHEN method_name = s THEN 5 END AS match FROM m, one) SELECT id, match FROM h WHERE match = (SELECT min(match) FROM h)")
def select_by_name(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    name = m.agg(F.min("method_name")).first()[0] or ""
    return cg.select_methods(m, name).select("id", "match")


@query("WITH " + METHODS + r""", s AS (SELECT id, (CASE WHEN contains(lower(method_name), 'invoice') THEN 100 ELSE 0 END) + (CASE WHEN contains(split_part(lower(class_full_name), '.', -1), 'invoice') THEN 80 ELSE 0 END) + (CASE WHEN contains(lower(class_full_name), 'invoice') THEN 60 ELSE 0 END)
 + (CASE WHEN starts_with(lower(method_name), 'invoice') THEN 40 ELSE 0 END) + (CASE WHEN contains(lower(file_path), 'invoice') THEN 30 ELSE 0 END)
 + 10 * (CASE WHEN list_contains(list_concat(regexp_split_to_array(lower(class_full_name), '[._\s]+'), regexp_split_to_array(lower(method_name), '[_\s]+')), 'invoice') THEN 1 ELSE 0 END) AS score FROM m) SELECT id, score FROM s WHERE score > 0""")
def select_fuzzy(spark: SparkSession, folder: str) -> DataFrame:
    return cg.suggestions(one_per_method(t(spark, folder, "methods")), "invoice", None).select("id", "score")


@query("SELECT DISTINCT id, kind FROM (SELECT id, 'method' AS kind, annotations, framework_role FROM methods UNION ALL SELECT id, 'class', annotations, NULL FROM classes) WHERE len(list_filter(annotations, lambda a: lower(split_part(split_part(ltrim(rtrim(a, ']'), '@[ '), '(', 1), '.', -1)) = 'transactional')) > 0 OR lower(framework_role) = 'transactional'")
def select_annotated(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    return cg.annotated(m, c, "@org.x.Transactional(readOnly=true)").select("id", "kind").distinct()


@query("SELECT DISTINCT class_full_name || '#' || f AS field, id AS method_id, role FROM (SELECT class_full_name, id, unnest(field_reads) AS f, 'reader' AS role FROM methods UNION ALL SELECT class_full_name, id, unnest(field_writes), 'writer' FROM methods)")
def select_field_access(spark: SparkSession, folder: str) -> DataFrame:
    return cg.field_access(t(spark, folder, "methods").filter("class_full_name is not null"))


@query("SELECT id, http_method, coalesce(full_route, route) AS path, framework_role, language, signature FROM methods WHERE is_endpoint OR framework_role IN ('http_handler','route','flask_route','fastapi_route','django_view')")
def select_endpoints(spark: SparkSession, folder: str) -> DataFrame:
    return cg.endpoints(t(spark, folder, "methods"))


@query("SELECT id, full_name AS name, array_to_string(list_filter(stereotypes, lambda x: list_contains(['component','service','controller','repository','angular_component','directive','hook'], x)), ',') AS kind FROM classes WHERE list_has_any(stereotypes, ['component','service','controller','repository','angular_component','directive','hook']) UNION ALL SELECT id, method_name, framework_role FROM methods WHERE framework_role IN ('component','hook')")
def select_components(spark: SparkSession, folder: str) -> DataFrame:
    return cg.components(*t(spark, folder, "classes", "methods"))


@query("SELECT DISTINCT c.id AS call, arg_min(m.id, (m.end_line - m.start_line, m.start_line, m.id)) OVER (PARTITION BY c.id, c.file_path, c.line) AS method_id FROM callsites c JOIN methods m ON m.file_path = c.file_path AND c.line BETWEEN m.start_line AND m.end_line")
def join_method_at_line(spark: SparkSession, folder: str) -> DataFrame:
    m, s = t(spark, folder, "methods", "callsites")
    points = s.select(F.col("id").alias("call"), "file_path", "line").distinct()
    return cg.method_at_line(m.select("id", "file_path", "start_line", "end_line").distinct(), points).select("call", "method_id").distinct()


@query("SELECT DISTINCT id FROM methods WHERE source IS NULL OR source = ''")
def filter_no_source(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "methods").filter("source is null or source = ''").select("id").distinct()


# ---------------------------------------------------------------- joins


@query("WITH " + EDGES + ", " + METHODS + " SELECT e.callsite_id, a.signature AS src_signature, b.signature AS dst_signature FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst")
def join_edges_named(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    return cg.callers_and_callees(edges_of(spark, folder), m).select("callsite_id", "src_signature", "dst_signature")


@query("WITH " + PAIRS + " SELECT src, dst FROM pairs WHERE src IN " + ENDPOINTS + " OR dst IN " + ENDPOINTS)
def join_touching(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder).select("src", "dst").distinct()
    nodes = t(spark, folder, "methods").filter("is_endpoint").select(cg.key("id").alias("id"))
    return cg.touching(e, nodes)


@query("WITH " + INHERITANCE + " SELECT source_id, source, target, relation, count(*) OVER (PARTITION BY target) AS target_refs FROM inh i WHERE NOT EXISTS (SELECT 1 FROM classes c WHERE c.full_name = i.target)")
def join_missing_targets(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return rollups.missing_targets(cg.inheritance_edges(c), c).select("source_id", "source", "target", "relation", "target_refs")


@query("SELECT o_orderkey, o_custkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_quantity > 45)")
def join_anti(spark: SparkSession, folder: str) -> DataFrame:
    o, li = t(spark, folder, "orders", "lineitem")
    return o.join(li.filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_anti").select("o_orderkey", "o_custkey")


@query("SELECT c_custkey, c_name FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')")
def join_semi(spark: SparkSession, folder: str) -> DataFrame:
    c, o = t(spark, folder, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS after_signup FROM events")
def join_as_of(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "events")
    return changes.last_seen_before(e, "user_id", ["ts", "event_id"], F.col("event_type") == "signup", "event_id", "after_signup").select("event_id", "after_signup")


@query("SELECT p_partkey, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s <> b.s AND a.n <> b.n THEN 'changed' WHEN a.s <> b.s OR a.n <> b.n THEN 'changed' ELSE 'same' END AS change, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE concat_ws(',', CASE WHEN a.n <> b.n THEN 'p_name' END, CASE WHEN a.s <> b.s THEN 'p_size' END) END AS columns FROM part p LEFT JOIN (SELECT p_partkey AS k, p_name AS n, p_size AS s FROM part WHERE p_partkey % 10 <> 0) a ON a.k = p_partkey LEFT JOIN (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN p_name || '!' ELSE p_name END AS n, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 11 <> 0) b ON b.k = p_partkey WHERE a.k IS NOT NULL OR b.k IS NOT NULL")
def join_full_outer_diff(spark: SparkSession, folder: str) -> DataFrame:
    p = t(spark, folder, "part")
    new = p.filter("p_partkey % 11 <> 0").withColumns({"p_name": F.when(F.expr("p_partkey % 7 = 0"), F.concat("p_name", F.lit("!"))).otherwise(F.col("p_name")), "p_size": F.when(F.expr("p_partkey % 3 = 0"), F.col("p_size") + 1).otherwise(F.col("p_size"))})
    return changes.column_diff(p.filter("p_partkey % 10 <> 0"), new, ["p_partkey"], ["p_name", "p_size"])


# ---------------------------------------------------------------- aggregations


@query("WITH " + EDGES + " SELECT dst AS id, count(*) AS callers FROM edges GROUP BY dst")
def agg_caller_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.caller_counts(edges_of(spark, folder))


@query("SELECT count(*) AS total, count(*) FILTER (resolution_status LIKE 'resolved%') AS resolved, count(*) FILTER (resolution_status = 'external_library') AS external, count(*) FILTER (NOT (resolution_status LIKE 'resolved%' OR resolution_status = 'external_library')) AS unresolved, round(100.0 * count(*) FILTER (resolution_status LIKE 'resolved%') / count(*), 1) AS resolved_pct, round(100.0 * count(*) FILTER (resolution_status = 'external_library') / count(*), 1) AS external_pct, round(100.0 * count(*) FILTER (NOT (resolution_status LIKE 'resolved%' OR resolution_status = 'external_library')) / count(*), 1) AS unresolved_pct FROM callsites")
def agg_graph_health(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.graph_health(t(spark, folder, "callsites"))


@query("SELECT 'status' AS kind, coalesce(resolution_status, '') AS name, count(*) AS calls FROM callsites GROUP BY 2 UNION ALL SELECT 'reason', coalesce(resolution_reason, ''), count(*) FROM callsites GROUP BY 2")
def agg_health_by(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.health_by(t(spark, folder, "callsites"))


@query("""
WITH r AS (SELECT * FROM callsites WHERE NOT (resolution_status LIKE 'resolved%' OR resolution_status = 'external_library')),
t AS (SELECT resolution_status, count(*) AS calls, count(*) FILTER (variant = 'test') AS in_tests FROM r GROUP BY 1),
q AS (SELECT resolution_status, resolution_reason, count(*) AS n FROM r GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY resolution_status ORDER BY count(*) DESC, resolution_reason) <= 5),
s AS (SELECT DISTINCT resolution_status, callee_name FROM r QUALIFY dense_rank() OVER (PARTITION BY resolution_status ORDER BY callee_name) <= 10)
SELECT t.*, (SELECT string_agg(resolution_reason || '=' || n, ',' ORDER BY n DESC, resolution_reason) FROM q WHERE q.resolution_status = t.resolution_status) AS reasons, (SELECT string_agg(callee_name, ',' ORDER BY callee_name) FROM s WHERE s.resolution_status = t.resolution_status) AS samples FROM t
""")
def agg_unresolved(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.unresolved_diagnosis(t(spark, folder, "callsites"))


@query("SELECT kind, name, count(*) AS n FROM (SELECT 'role' AS kind, framework_role AS name FROM methods WHERE framework_role IS NOT NULL UNION ALL SELECT 'stereotype', unnest(stereotypes) FROM classes UNION ALL SELECT 'language', language FROM methods WHERE language IS NOT NULL UNION ALL SELECT 'endpoint', coalesce(http_method, '') FROM methods WHERE is_endpoint) GROUP BY ALL")
def agg_framework_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.framework_summary(*t(spark, folder, "classes", "methods"))


@query("WITH " + EDGES + ", " + METHODS + " SELECT b.file_path AS file, a.file_path AS caller_file, count(*) AS calls, string_agg(DISTINCT b.method_name, ',' ORDER BY b.method_name) AS methods FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst GROUP BY ALL")
def agg_file_dependents(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.file_dependents(edges_of(spark, folder), one_per_method(t(spark, folder, "methods")))


@query("WITH " + EDGES + ", " + METHODS + " SELECT a.file_path AS file, b.file_path AS callee_file, count(*) AS calls, string_agg(DISTINCT b.method_name, ',' ORDER BY b.method_name) AS methods FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.file_path <> b.file_path GROUP BY ALL")
def agg_file_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.file_dependencies(edges_of(spark, folder), one_per_method(t(spark, folder, "methods")))


@query("WITH " + EDGES + ", " + METHODS + ", c AS (SELECT id, min(line) AS line FROM callsites GROUP BY id) SELECT e.src, e.dst, m.signature, string_agg(DISTINCT CAST(c.line AS VARCHAR), ',' ORDER BY CAST(c.line AS VARCHAR)) AS lines, count(*) AS calls, CASE WHEN regexp_matches(m.signature, '\\.metrics\\.|\\.datadog\\.|\\.prometheus\\.|\\.utils\\.|\\.model\\.') THEN 2 ELSE 0 END AS priority FROM edges e JOIN c ON c.id = e.callsite_id JOIN m ON m.id = e.dst GROUP BY ALL")
def agg_resolved_callees(spark: SparkSession, folder: str) -> DataFrame:
    m, s = t(spark, folder, "methods", "callsites")
    return rollups.resolved_callees(edges_of(spark, folder), s.groupBy("id").agg(F.min("line").cast("string").alias("line")), one_per_method(m))


@query("SELECT caller_method_id, callee_name, CASE WHEN callee_name IN ('and','map','flatMap','filter','doOnNext','doOnError','doOnCancel','doOnTerminate','subscribeOn','elapsed') THEN NULL ELSE receiver END AS receiver, resolution_reason, callee_name IN ('and','map','flatMap','filter','doOnNext','doOnError','doOnCancel','doOnTerminate','subscribeOn','elapsed') AS fluent, count(*) AS calls FROM callsites WHERE NOT (resolution_status LIKE 'resolved%' OR resolution_status = 'external_library') GROUP BY ALL")
def agg_unresolved_groups(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.unresolved_calls(t(spark, folder, "callsites"))


@query("SELECT resolution_status, resolution_reason, count(*) AS cnt FROM callsites WHERE variant = 'validated' GROUP BY ALL")
def agg_status_reason(spark: SparkSession, folder: str) -> DataFrame:
    return cg.scope(t(spark, folder, "callsites"), "validated").groupBy("resolution_status", "resolution_reason").agg(F.count("*").alias("cnt"))


@query("WITH " + METHODS + " SELECT m.class_full_name, m.method_name, count(*) AS unresolved_calls, coalesce(string_agg(DISTINCT resolution_reason, ',' ORDER BY resolution_reason), '') AS reasons FROM callsites c JOIN m ON m.id = c.caller_method_id WHERE NOT resolution_status LIKE 'resolved%' GROUP BY ALL")
def agg_hotspots(spark: SparkSession, folder: str) -> DataFrame:
    s, m = t(spark, folder, "callsites", "methods")
    return rollups.hotspots(s, one_per_method(m), None)


@query("SELECT callee_name, resolution_reason, min(receiver_type_raw) AS receiver_type_raw, count(*) AS cnt FROM callsites WHERE NOT resolution_status LIKE 'resolved%' GROUP BY ALL")
def agg_untraceable(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.untraceable(t(spark, folder, "callsites"))


@query("SELECT split_part(full_name, '.', -1) AS short_name, count(DISTINCT full_name) AS n, string_agg(DISTINCT full_name, ',' ORDER BY full_name) AS full_names FROM classes WHERE full_name IS NOT NULL GROUP BY 1 HAVING count(DISTINCT full_name) > 1")
def agg_name_collisions(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.name_collisions(t(spark, folder, "classes").filter("full_name is not null"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS populated, count(*) - count({c}) AS missing, count(*) FILTER (trim({c}) = '') AS blank, max(length({c})) AS longest FROM callsites" for c in ("receiver", "receiver_type", "resolved_candidates_json", "resolution_status", "text")))
def agg_profile(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.profile(t(spark, folder, "callsites"), ["receiver", "receiver_type", "resolved_candidates_json", "resolution_status", "text"])


@query("SELECT file_path, count(*) AS methods, sum(length(coalesce(source, ''))) AS chars, sum(greatest(1, length(coalesce(source, '')) // 4)) AS tokens, CAST(floor(avg(greatest(1, length(coalesce(source, '')) // 4))) AS BIGINT) AS mean_tokens FROM methods GROUP BY file_path")
def agg_token_stats(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.token_stats(t(spark, folder, "methods"))


@query("WITH " + PAIRS + ", " + METHODS + ", k AS (SELECT *, greatest(1, chars // 4) AS tokens FROM m), f AS (SELECT file_path, sum(tokens) AS file_tokens FROM k GROUP BY 1), c AS (SELECT p.src, k.file_path, k.tokens FROM pairs p JOIN k ON k.id = p.dst), a AS (SELECT src, sum(tokens) AS context_tokens FROM c GROUP BY 1), b AS (SELECT src, sum(file_tokens) AS files_tokens FROM (SELECT DISTINCT src, file_path FROM c) JOIN f USING (file_path) GROUP BY 1) SELECT src, context_tokens, files_tokens, round(100.0 * (files_tokens - context_tokens) / files_tokens, 1) AS saved_pct FROM a JOIN b USING (src)")
def agg_context_proof(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods")
    longest = m.groupBy("id").agg(F.min("file_path").alias("file_path"), F.max(F.length(F.coalesce("source", F.lit("")))).alias("n"))
    return rollups.context_proof(edges_of(spark, folder), longest.select("id", "file_path", F.repeat(F.lit("x"), F.col("n")).alias("source")))


@query("SELECT language, sum(CASE WHEN end_line >= start_line AND start_line > 0 THEN end_line - start_line + 1 ELSE 0 END) AS lines FROM methods GROUP BY language")
def agg_line_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.line_estimate(t(spark, folder, "methods"))


@query("SELECT event_type, count(*) AS n, avg(value) AS mean, list_sort(list(value))[CAST(floor(count(*) * 0.5) AS INT) + 1] AS p50, list_sort(list(value))[CAST(floor(count(*) * 0.95) AS INT) + 1] AS p95 FROM events WHERE value IS NOT NULL GROUP BY event_type")
def agg_latency(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.latency_summary(t(spark, folder, "events"), "event_type", "value")


@query("SELECT count(*) FILTER (a AND b) AS both, count(*) FILTER (a AND NOT b) AS only_a, count(*) FILTER (NOT a AND b) AS only_b, count(*) FILTER (NOT a AND NOT b) AS neither FROM (SELECT coalesce(x.p, false) AS a, coalesce(y.p, false) AS b FROM (SELECT user_id, max(value) > 200 AS p FROM events WHERE event_type = 'view' GROUP BY 1) x FULL JOIN (SELECT user_id, max(value) > 200 AS p FROM events WHERE event_type = 'click' GROUP BY 1) y USING (user_id))")
def agg_win_loss(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "events")
    side = lambda k: e.filter(F.col("event_type") == k).groupBy("user_id").agg((F.max("value") > 200).alias("passed"))
    return rollups.win_loss(side("view"), side("click"), "user_id", "passed")


@query("""
WITH s AS (SELECT user_id, list(DISTINCT event_type) FILTER (ts < TIMESTAMP '2024-01-15') AS f, list(DISTINCT event_type) FILTER (ts >= TIMESTAMP '2024-01-15') AS t FROM events GROUP BY 1),
n AS (SELECT user_id, coalesce(len(f), 0) AS f, coalesce(len(t), 0) AS t, coalesce(len(list_intersect(f, t)), 0) AS b FROM s)
SELECT user_id, CASE WHEN f = 0 THEN CASE WHEN t = 0 THEN 1.0 ELSE 0.0 END ELSE b / f END AS precision, CASE WHEN t = 0 THEN 1.0 ELSE b / t END AS recall, CASE WHEN f = 0 THEN 0.0 ELSE (f - b) / f END AS hallucinated, CASE WHEN f + t - b = 0 THEN 0.0 ELSE (f + t - 2 * b) / (f + t - b) END AS drift FROM n
""")
def agg_set_scores(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "events")
    first = F.col("ts") < F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    s = e.groupBy("user_id").agg(F.collect_set(F.when(first, F.col("event_type"))).alias("f"), F.collect_set(F.when(~first, F.col("event_type"))).alias("t"))
    return s.select("user_id", rollups.set_scores(F.col("f"), F.col("t")).alias("s")).select("user_id", "s.*")


@query("WITH r AS (SELECT lang AS query, doc_id AS item, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, doc_id) AS rank FROM documents WHERE lang IS NOT NULL), w AS (SELECT lang AS query, doc_id AS item FROM documents WHERE lang IS NOT NULL AND source = 'wiki-export'), x AS (SELECT w.query, count(*) AS wanted, count(*) AS hits, min(r.rank) AS rank FROM w JOIN r USING (query, item) GROUP BY 1) SELECT query, rank, 1.0 / rank AS reciprocal, hits / wanted AS recall FROM x")
def agg_reciprocal_rank(spark: SparkSession, folder: str) -> DataFrame:
    d = t(spark, folder, "documents").filter("lang is not null").select(F.col("lang").alias("query"), F.col("doc_id").alias("item"), "n_chars", "source")
    ranked = rollups.ranked(d, "query", [F.desc("n_chars"), F.col("item")])
    return rollups.reciprocal_rank(ranked, d.filter("source = 'wiki-export'"))


@query("SELECT model, variant, count(*) AS n, count(DISTINCT method_id) AS methods FROM method_embeddings GROUP BY ALL")
def agg_model_counts(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "method_embeddings").groupBy("model", "variant").agg(F.count("*").alias("n"), F.count_distinct("method_id").alias("methods"))


# ---------------------------------------------------------------- windows and sets


@query("SELECT l_orderkey, l_linenumber, count(*) OVER (PARTITION BY l_partkey) AS same_part FROM lineitem")
def window_count(spark: SparkSession, folder: str) -> DataFrame:
    li = t(spark, folder, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.count("*").over(Window.partitionBy("l_partkey")).alias("same_part"))


@query("WITH " + METHODS + " SELECT id, row_number() OVER (PARTITION BY file_path ORDER BY start_line, id) AS position FROM (SELECT id, min(file_path) AS file_path, min(start_line) AS start_line FROM methods GROUP BY id)")
def window_file_methods(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods").groupBy("id").agg(F.min("file_path").alias("file_path"), F.min("start_line").alias("start_line"))
    return cg.files_methods(m, m.select("file_path")).select("id", "position")


@query("WITH " + PAIRS + " SELECT id FROM (SELECT src AS id FROM pairs UNION SELECT dst FROM pairs)")
def set_union(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()


@query("WITH " + PAIRS + " SELECT DISTINCT src AS id FROM pairs EXCEPT SELECT dst FROM pairs")
def set_except(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return e.select(F.col("src").alias("id")).distinct().join(e.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


# ---------------------------------------------------------------- traversal from all endpoints

REACH = "WITH RECURSIVE " + PAIRS + ", seeds AS (SELECT DISTINCT src AS id FROM pairs WHERE src IN " + ENDPOINTS + ")"


@query(REACH + ", walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT p.dst, w.depth + 1 FROM walk w JOIN pairs p ON p.src = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY id")
def graph_levels(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.levels(e, endpoints_of(spark, folder, e), 3)


@query("WITH RECURSIVE " + PAIRS + ", seeds AS (SELECT DISTINCT dst AS id FROM pairs WHERE dst IN " + ENDPOINTS + "), walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT p.src, w.depth + 1 FROM walk w JOIN pairs p ON p.dst = w.id WHERE w.depth < 3) SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0")
def graph_callers(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.callers(e, endpoints_of(spark, folder, e, "dst"), 3)


@query(REACH + ", b AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN b ON b.src = w.id WHERE w.depth < 2) SELECT id, min(depth) AS depth FROM walk GROUP BY id HAVING min(depth) > 0")
def graph_neighbourhood(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.neighbourhood(e, endpoints_of(spark, folder, e), 2)


@query(REACH + ", b AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN b ON b.src = w.id WHERE w.depth < 2) SELECT src, dst FROM pairs WHERE src IN (SELECT id FROM walk) AND dst IN (SELECT id FROM walk)")
def graph_subgraph(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.subgraph(e, endpoints_of(spark, folder, e), 2)[1]


@query(REACH + ", walk AS (SELECT id, [id] AS path FROM seeds UNION ALL SELECT p.dst, list_append(w.path, p.dst) FROM walk w JOIN pairs p ON p.src = w.id WHERE len(w.path) <= 3 AND NOT list_contains(w.path, p.dst)) SELECT id, array_to_string(path, '>') AS path FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path), path) = 1")
def graph_shortest_paths(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.shortest_paths(e, endpoints_of(spark, folder, e), 3).select("id", F.array_join("path", ">").alias("path"))


@query(REACH + ", walk AS (SELECT src, dst, 1 AS depth FROM pairs WHERE src IN " + ENDPOINTS + " UNION SELECT w.src, p.dst, w.depth + 1 FROM walk w JOIN pairs p ON p.src = w.dst WHERE w.depth < 4) SELECT src, dst, min(depth) AS depth FROM walk GROUP BY ALL")
def graph_closure(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.closure(e, endpoints_of(spark, folder, e), 4)


@query("WITH " + EDGES + " SELECT id, sum(o) AS out, sum(i) AS \"in\" FROM (SELECT src AS id, 1 AS o, 0 AS i FROM edges UNION ALL SELECT dst, 0, 1 FROM edges) GROUP BY id")
def graph_degrees(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.degrees(edges_of(spark, folder))


@query("WITH RECURSIVE " + PAIRS + ", gone AS (SELECT lower(trim(id)) AS id FROM methods WHERE generated), walk AS (SELECT src, dst FROM pairs WHERE src NOT IN (SELECT id FROM gone) UNION SELECT w.src, p.dst FROM walk w JOIN pairs p ON p.src = w.dst WHERE w.dst IN (SELECT id FROM gone)) SELECT DISTINCT src, dst FROM walk WHERE dst NOT IN (SELECT id FROM gone)")
def graph_bridges(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    gone = t(spark, folder, "methods").filter("generated").select(cg.key("id").alias("id"))
    return traversal.bridges(e, gone)


@query(REACH + ", walk AS (SELECT src, dst, 1 AS depth FROM pairs WHERE src IN " + ENDPOINTS + " UNION SELECT w.src, p.dst, w.depth + 1 FROM walk w JOIN pairs p ON p.src = w.dst WHERE w.depth < 4), e AS (SELECT src, count(DISTINCT dst) AS n FROM walk WHERE dst NOT IN (SELECT src FROM pairs) GROUP BY 1) SELECT s.id, coalesce(n, 0) AS sinks, round(log2(coalesce(n, 0) + 1), 6) AS entropy FROM seeds s LEFT JOIN e ON e.src = s.id")
def graph_sinks(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.sinks(e, endpoints_of(spark, folder, e), 4).withColumn("entropy", F.round("entropy", 6))


FLOW = REACH + ", walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT p.dst, w.depth + 1 FROM walk w JOIN pairs p ON p.src = w.id WHERE w.depth < 3), n AS (SELECT id, min(depth) AS depth FROM walk GROUP BY id)"


@query(FLOW + ", f AS (SELECT p.src, p.dst FROM pairs p JOIN n a ON a.id = p.src AND a.depth < 3 JOIN n b ON b.id = p.dst), d AS (SELECT n.id, n.depth, (SELECT count(*) FROM f WHERE f.src = n.id) AS out, (SELECT count(*) FROM f WHERE f.dst = n.id) AS inn FROM n) SELECT id, depth, out, inn AS \"in\", CAST((CASE depth WHEN 0 THEN 100 WHEN 1 THEN 30 WHEN 2 THEN 20 WHEN 3 THEN 10 ELSE 0 END) + (CASE WHEN out > 0 THEN 15 ELSE -10 END) + (CASE WHEN out >= 2 THEN 10 ELSE 0 END) + (CASE WHEN inn >= 2 THEN 10 ELSE 0 END) - (CASE WHEN out >= 5 THEN 10 ELSE 0 END) AS DOUBLE) AS rank, CASE WHEN depth <= 2 AND out > 0 AND inn <= 2 THEN 'primary' WHEN out >= 5 OR inn >= 3 OR out = 0 THEN 'utility' ELSE 'supporting' END AS tier, CASE WHEN depth <= 2 AND out > 0 AND inn <= 2 THEN 'high' WHEN out >= 5 OR inn >= 3 OR out = 0 OR depth <= 3 THEN 'medium' ELSE 'low' END AS confidence FROM d")
def graph_flow_ranks(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    nodes, walked, _ = traversal.stitched_flow(e, endpoints_of(spark, folder, e), 3)
    return traversal.flow_ranks(nodes, walked)


@query(FLOW + ", f AS (SELECT p.src, p.dst, a.depth AS da, b.depth AS db FROM pairs p JOIN n a ON a.id = p.src AND a.depth < 3 JOIN n b ON b.id = p.dst) SELECT id, 'max_depth' AS reason FROM n WHERE depth >= 3 UNION SELECT id, 'no_callees' FROM n WHERE depth < 3 AND id NOT IN (SELECT src FROM pairs) UNION SELECT src, 'cycle' FROM f WHERE db < da OR src = dst")
def graph_flow_stops(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.stitched_flow(e, endpoints_of(spark, folder, e), 3)[2]


@query("WITH " + PAIRS + " SELECT i.id, coalesce((SELECT string_agg(dst, ',' ORDER BY dst) FROM pairs WHERE src = i.id), '') AS calls, coalesce((SELECT string_agg(src, ',' ORDER BY src) FROM pairs WHERE dst = i.id), '') AS called_by FROM (SELECT DISTINCT id FROM methods QUALIFY max(indexed_at) OVER (PARTITION BY id) IS NOT NULL) i WHERE i.id IN (SELECT id FROM (SELECT id, deleted_at FROM methods QUALIFY rank() OVER (PARTITION BY id ORDER BY indexed_at DESC) = 1) GROUP BY id HAVING count(*) = count(*) FILTER (deleted_at IS NULL))")
def graph_enriched(spark: SparkSession, folder: str) -> DataFrame:
    m, s = t(spark, folder, "methods", "callsites")
    # of the rows indexed last, those of a method deleted in any of them are left out
    last = m.select("id", "indexed_at", "deleted_at").withColumn("r", F.rank().over(Window.partitionBy("id").orderBy(F.desc("indexed_at")))).filter("r = 1 and indexed_at is not null")
    alive = last.groupBy("id").agg(F.count("deleted_at").alias("gone")).filter("gone = 0").select("id")
    g = cg.CodeGraph(m, alive, s).enriched_methods()
    return g.select("id", F.array_join("calls", ",").alias("calls"), F.array_join("called_by", ",").alias("called_by"))


# ---------------------------------------------------------------- traversal from all callers


def from_all(name: str) -> str:
    return ORACLE[name].replace(f" WHERE src IN {ENDPOINTS}", "")


@query(from_all("graph_closure"))
def graph_closure_all(spark: SparkSession, folder: str) -> DataFrame:
    return traversal.closure(edges_of(spark, folder), None, 4)


@query(from_all("graph_sinks"))
def graph_sinks_all(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return traversal.sinks(e, e.select(F.col("src").alias("id")), 4).withColumn("entropy", F.round("entropy", 6))


# ---------------------------------------------------------------- text and vectors


@query(r"SELECT DISTINCT id, array_to_string(list_filter(regexp_split_to_array(lower(coalesce(signature, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''), ' ') AS tokens FROM methods")
def text_index_tokens(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "methods").select("id", F.array_join(text.index_tokens(F.col("signature")), " ").alias("tokens")).distinct()


@query()
def text_rank_tokens(spark: SparkSession, folder: str) -> DataFrame:
    names = t(spark, folder, "methods").select("method_name").distinct()
    return names.select("method_name", F.array_join(F.array_sort(text.rank_tokens(F.col("method_name"))), " ").alias("tokens"))


@query()
def text_stems(spark: SparkSession, folder: str) -> DataFrame:
    titles = t(spark, folder, "doc_chunks").filter("title is not null").select("title").distinct()
    return titles.select("title", text.without_stop_words(F.col("title")).alias("kept"))


BM25 = r"""
WITH d AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
f AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: starts_with(x, 'invoice'))) AS a, len(list_filter(w, lambda x: starts_with(x, 'retry'))) AS b FROM d),
s AS (SELECT count(*) AS n, avg(l) AS avg, count(*) FILTER (a > 0) AS na, count(*) FILTER (b > 0) AS nb FROM f),
i AS (SELECT *, CASE WHEN ln((n - na + 0.5) / (na + 0.5)) > 0 THEN ln((n - na + 0.5) / (na + 0.5)) ELSE 1e-6 END AS ia, CASE WHEN ln((n - nb + 0.5) / (nb + 0.5)) > 0 THEN ln((n - nb + 0.5) / (nb + 0.5)) ELSE 1e-6 END AS ib FROM s)
SELECT id, round(-(ia * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / avg)) + ib * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / avg))), 6) AS score, CAST(a > 0 AS INT) + CAST(b > 0 AS INT) AS terms FROM f, i WHERE a > 0 OR b > 0
"""


@query(BM25)
def search_bm25(spark: SparkSession, folder: str) -> DataFrame:
    d = spread(t(spark, folder, "documents").select("doc_id", "text"))
    return search.bm25(d, ["invoice", "retry"], ["text"], "doc_id").withColumn("score", F.round("score", 6))


def _two_phase(a: str, b: str) -> str:
    tok = lambda c: f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
    starts = lambda l, t: f"CAST(len(list_filter({l}, lambda x: starts_with(x, '{t}'))) AS DOUBLE)"  # noqa: E731, E741
    idf = lambda k: f"CASE WHEN ln((nn - {k} + 0.5) / ({k} + 0.5)) > 0 THEN ln((nn - {k} + 0.5) / ({k} + 0.5)) ELSE 1e-6 END"
    part = lambda i, f: f"{i} * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * l / av))"
    return f"""WITH m AS (SELECT id, min(method_name) AS method_name, min(class_full_name) AS class_full_name, min(signature) AS signature, max(coalesce(source, '')) AS source FROM methods GROUP BY id),
d AS (SELECT id, {tok('method_name')} AS n, list_concat(list_concat({tok('method_name')}, {tok('signature')}), list_concat({tok('class_full_name')}, {tok('source')})) AS w FROM m),
f AS (SELECT id, len(w) AS l, 10 * {starts('n', a)} AS na, 10 * {starts('n', b)} AS nb, {starts('w', a)} AS wa, {starts('w', b)} AS wb FROM d),
z AS (SELECT count(*) AS nn, avg(l) AS av, count(*) FILTER (na > 0) AS hna, count(*) FILTER (nb > 0) AS hnb, count(*) FILTER (wa > 0) AS hwa, count(*) FILTER (wb > 0) AS hwb FROM f),
i AS (SELECT *, {idf('hna')} AS ina, {idf('hnb')} AS inb, {idf('hwa')} AS iwa, {idf('hwb')} AS iwb FROM z),
r AS (SELECT id, CASE WHEN na > 0 OR nb > 0 THEN -({part('ina', 'na')} + {part('inb', 'nb')}) - 1000.0 ELSE -({part('iwa', 'wa')} + {part('iwb', 'wb')}) END AS score, CASE WHEN na > 0 OR nb > 0 THEN 'name' ELSE 'text' END AS bucket FROM f, i WHERE wa > 0 OR wb > 0)
SELECT id, round(score, 6) AS score, bucket FROM r"""


@query(_two_phase("invoice", "archive"))
def search_two_phase(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    return search.two_phase(m, ["invoice", "archive"]).select("id", F.round("score", 6).alias("score"), "bucket")


@query("WITH " + METHODS + ", p AS (SELECT *, lower(coalesce(method_name, '')) AS n, lower(coalesce(signature, '')) AS g, lower(coalesce(file_path, '')) AS f FROM m), x AS (SELECT *, CASE WHEN contains(f, '/') THEN regexp_replace(f, '/[^/]*$', '') ELSE '' END AS folder, regexp_replace(split_part(f, '/', -1), '\\.[^.]*$', '') AS file FROM p) SELECT id, CAST(round((CASE WHEN n = 'invoice' THEN 2.0 WHEN contains(n, 'invoice') THEN 1.0 ELSE 0 END) + (CASE WHEN contains(g, 'invoice') THEN 0.5 ELSE 0 END) + (CASE WHEN contains(file, 'invoice') THEN 1.5 WHEN contains(folder, 'invoice') THEN 0.5 ELSE 0 END) - (CASE WHEN regexp_matches(f, '/tests?/|tests?\\.java$') THEN 1.0 ELSE 0 END) - (CASE WHEN regexp_matches(f, '/generated/|/gen/|\\.generated\\.|_generated\\.|build/generated|target/generated') THEN 10.0 ELSE 0 END), 6) AS DOUBLE) AS score FROM x")
def search_hit_score(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    s = search.hit_score(F.lit(0.0), ["invoice"], F.col("method_name"), F.col("signature"), F.col("file_path"), F.lit(None).cast("array<string>"))
    return m.select("id", F.round(s, 6).alias("score"))


@query("SELECT id, (CAST(contains(b, 'invoice') AS INT) + CAST(contains(b, 'archive') AS INT)) AS matched FROM (SELECT id, lower(concat_ws(' ', method_name, signature, source)) AS b FROM methods) WHERE contains(b, 'invoice') OR contains(b, 'archive')")
def search_substring(spark: SparkSession, folder: str) -> DataFrame:
    return search.substring_hits(t(spark, folder, "methods"), ["invoice", "archive"])


@query("WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings)) SELECT vec_id AS id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])), 5) AS similarity FROM embeddings, q ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(e AS DOUBLE[])) DESC, vec_id LIMIT 10")
def search_dense(spark: SparkSession, folder: str) -> DataFrame:
    v = t(spark, folder, "embeddings")
    q = v.orderBy("vec_id").first()
    return search.dense_hits(v, q["embedding"], 10, "vec_id").withColumn("similarity", F.round("similarity", 5))


@query("WITH s AS (SELECT q.vec_id AS query, v.vec_id AS id, list_cosine_similarity(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])) AS c FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0) SELECT query, id, round(c, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query ORDER BY c DESC, id) <= 10")
def search_dense_all(spark: SparkSession, folder: str) -> DataFrame:
    v = t(spark, folder, "embeddings")
    return search.dense_hits_all(v, v.filter("vec_id % 20 = 0"), 10, "vec_id").withColumn("similarity", F.round("similarity", 5))


@query("WITH e AS (SELECT event_id AS id, -value AS score, CASE WHEN event_type = 'view' THEN NULL ELSE value / 1000 END AS similarity, CASE WHEN event_type = 'click' THEN 1.0 ELSE 0.0 END AS heuristic FROM events WHERE value IS NOT NULL), b AS (SELECT min(-score) AS lo, max(-score) AS hi FROM e) SELECT id, round(CASE WHEN similarity IS NULL THEN 0.8 * (-score - lo) / (hi - lo) + 0.2 * heuristic ELSE 0.6 * (-score - lo) / (hi - lo) + 0.2 * similarity + 0.2 * heuristic END, 6) AS blend FROM e, b")
def search_blend(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "events").filter("value is not null")
    hits = e.select(F.col("event_id").alias("id"), (-F.col("value")).alias("score"), F.when(F.col("event_type") != "view", F.col("value") / 1000).alias("similarity"), F.when(F.col("event_type") == "click", 1.0).otherwise(0.0).alias("heuristic"))
    return search.blended(hits).select("id", F.round("blend", 6).alias("blend"))


# ---------------------------------------------------------------- resolution


def calls_of(callsites: DataFrame) -> DataFrame:
    least = ["caller_method_id", "callee_name", "receiver", "argument_count", "text", "line", "column_no"]
    one = callsites.groupBy(F.col("id").alias("callsite_id")).agg(*(F.min(c).alias(c) for c in least), F.min("receiver_type_raw").alias("receiver_type"), F.min("argument_types").alias("argument_types"))
    return one


@query()
def resolve_cascade(spark: SparkSession, folder: str) -> DataFrame:
    m, c, s = t(spark, folder, "methods", "classes", "callsites")
    methods = m.groupBy("id").agg(*(F.min(x).alias(x) for x in ("class_full_name", "method_name", "parameter_types", "return_type")))
    return resolve.resolve(calls_of(s), methods, c, cg.inheritance_edges(c)).select("callsite_id", "status", F.array_join("candidates", ",").alias("candidates"))


@query("""
WITH m AS (SELECT id, lower(split_part(min(class_full_name), '.', -1)) AS r, min(method_name) AS name, len(min(parameter_types)) AS arity FROM methods GROUP BY id),
k AS (SELECT r, name, arity, min(id) AS first FROM m GROUP BY ALL), a AS (SELECT name, arity, list_sort(list(id)) AS "all", min(id) AS one FROM m GROUP BY ALL), n AS (SELECT name, min(id) AS anyone FROM m GROUP BY ALL),
c AS (SELECT id, min(callee_name) AS name, lower(min(receiver)) AS r, coalesce(min(argument_count), -1) AS arity FROM callsites GROUP BY id),
j AS (SELECT c.id, k.first, a."all", b.one AS less, d.one AS more, n.anyone FROM c LEFT JOIN k ON k.r = c.r AND k.name = c.name AND k.arity = c.arity LEFT JOIN a ON a.name = c.name AND a.arity = c.arity LEFT JOIN a b ON b.name = c.name AND b.arity = c.arity - 1 LEFT JOIN a d ON d.name = c.name AND d.arity = c.arity + 1 LEFT JOIN n ON n.name = c.name)
SELECT id AS callsite_id, CASE WHEN first IS NOT NULL THEN 'resolved_receiver' WHEN "all" IS NOT NULL THEN 'resolved_arity' WHEN coalesce(less, more) IS NOT NULL THEN 'resolved_close_arity' WHEN anyone IS NOT NULL THEN 'resolved_name_only' ELSE 'unresolved' END AS status,
CASE WHEN first IS NOT NULL THEN first WHEN "all" IS NOT NULL THEN array_to_string("all", ',') ELSE coalesce(less, more, anyone, '') END AS candidates FROM j
""")
def resolve_dynamic(spark: SparkSession, folder: str) -> DataFrame:
    m, s = t(spark, folder, "methods", "callsites")
    methods = m.groupBy("id").agg(*(F.min(x).alias(x) for x in ("class_full_name", "method_name", "parameter_types")))
    return resolve.dynamic_cascade(calls_of(s), methods).select("callsite_id", "status", F.array_join("candidates", ",").alias("candidates"))


@query(f"""
WITH caller AS (SELECT id, min(class_full_name) AS caller_class FROM methods GROUP BY id), own AS (SELECT full_name, min(package_name) AS package, min(coalesce(imports, [])) AS imports FROM classes WHERE full_name IS NOT NULL GROUP BY 1), known AS (SELECT DISTINCT full_name FROM classes),
p AS (SELECT DISTINCT c.caller_class, s.receiver_type_raw AS written, nullif(trim(regexp_replace(s.receiver_type_raw, '<.*$|\\[.*$|\\?$', '', 'g')), '') AS bare FROM callsites s JOIN caller c ON c.id = s.caller_method_id),
q AS (SELECT p.*, o.package, coalesce(o.imports, []) AS imports, contains(bare, '.') AS dotted FROM p LEFT JOIN own o ON o.full_name = p.caller_class WHERE bare IS NOT NULL),
w AS (SELECT caller_class, written, count(DISTINCT replace(i, '*', '') || bare) AS wilds, min(replace(i, '*', '') || bare) AS wild FROM (SELECT *, unnest(imports) AS i FROM q) WHERE i LIKE '%.*' AND replace(i, '*', '') || bare IN (SELECT full_name FROM known) GROUP BY ALL),
r AS (SELECT q.*, w.wilds, w.wild, CASE WHEN NOT dotted THEN list_filter(imports, lambda x: ends_with(x, '.' || bare))[1] END AS exact, CASE WHEN NOT dotted THEN concat_ws('.', package, bare) END AS same FROM q LEFT JOIN w ON w.caller_class IS NOT DISTINCT FROM q.caller_class AND w.written = q.written),
h AS (SELECT *, CASE WHEN dotted THEN 'full' WHEN exact IS NOT NULL THEN 'import_exact' WHEN same IN (SELECT full_name FROM known) THEN 'same_package' WHEN wilds > 1 THEN 'ambiguous' WHEN wilds = 1 THEN 'import_wildcard' WHEN bare IN {_quoted(resolve.LANG_TYPES)} THEN 'language' ELSE 'unqualified' END AS how FROM r)
SELECT caller_class, written, CASE how WHEN 'full' THEN bare WHEN 'import_exact' THEN exact WHEN 'same_package' THEN same WHEN 'import_wildcard' THEN wild WHEN 'language' THEN 'java.lang.' || bare ELSE bare END AS type, how FROM h
""")
def resolve_types(spark: SparkSession, folder: str) -> DataFrame:
    c, s, m = t(spark, folder, "classes", "callsites", "methods")
    caller = m.groupBy(F.col("id").alias("caller_method_id")).agg(F.min("class_full_name").alias("caller_class"))
    pairs = s.join(caller, "caller_method_id").select("caller_class", F.col("receiver_type_raw").alias("written"))
    looked = c.groupBy("full_name").agg(F.min("package_name").alias("package_name"), F.min("imports").alias("imports"))
    return resolve.normalised_types(pairs, looked)


@query("WITH " + EDGES + ", s AS (SELECT DISTINCT full_name FROM classes WHERE len(list_filter(annotations, lambda a: list_contains(['Service','Component','Repository','Controller','RestController','Configuration'], regexp_extract(a, '^[@\\[]?(?:[\\w.]*\\.)?(\\w+)', 1)))) > 0 AND full_name NOT LIKE '%Service'), p AS (SELECT DISTINCT id FROM methods WHERE class_full_name IN (SELECT full_name FROM s)) SELECT callsite_id, src, dst, dst IN (SELECT id FROM p) AS phantom FROM edges")
def resolve_phantoms(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    confirmed = c.filter("full_name like '%Service'").select("full_name").distinct()
    return resolve.phantom_edges(edges_of(spark, folder), m, c, confirmed)


# ---------------------------------------------------------------- changes


@query("WITH o AS (SELECT p_partkey AS k, p_size AS s FROM part WHERE p_partkey % 10 <> 0), n AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 3 = 0 THEN p_size + 1 ELSE p_size END AS s FROM part WHERE p_partkey % 11 <> 0) SELECT coalesce(o.k, n.k) AS p_partkey, CASE WHEN o.k IS NULL THEN 'added' WHEN n.k IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM o FULL JOIN n ON o.k = n.k WHERE o.k IS NULL OR n.k IS NULL OR o.s <> n.s")
def change_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    p = t(spark, folder, "part").select("p_partkey", "p_size")
    new = p.filter("p_partkey % 11 <> 0").withColumn("p_size", F.when(F.expr("p_partkey % 3 = 0"), F.col("p_size") + 1).otherwise(F.col("p_size")))
    return changes.fingerprint_diff(p.filter("p_partkey % 10 <> 0"), new, "p_partkey", ["p_size"])


@query("""
WITH o AS (SELECT signature, file_path, count(*) AS n, min(start_line) AS l, min(coalesce(source, '')) AS s FROM methods WHERE variant = 'main' GROUP BY ALL),
v AS (SELECT signature, file_path, count(*) AS n, min(start_line) AS l, min(coalesce(source, '')) AS s FROM methods WHERE variant = 'validated' GROUP BY ALL),
d AS (SELECT coalesce(o.file_path, v.file_path) AS file_path, o.n IS NULL AS added, v.n IS NULL AS removed, coalesce(o.n = 1 AND v.n = 1 AND o.l <> v.l, false) AS shifted, coalesce(o.n = 1 AND v.n = 1 AND o.s <> v.s, false) AS edited FROM o FULL JOIN v ON o.signature = v.signature AND o.file_path = v.file_path)
SELECT file_path, CASE WHEN bool_or(added OR removed) THEN 'structural' WHEN bool_or(edited) THEN 'callsite_change' WHEN bool_or(shifted) THEN 'metadata_only' ELSE 'no_change' END AS change_type FROM d GROUP BY file_path
""")
def change_records(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods")
    return changes.file_changes(changes.record_diff(m.filter("variant = 'main'"), m.filter("variant = 'validated'")))


@query("SELECT module_id, max(tool) AS tool FROM (SELECT module_id, tool FROM modules WHERE tool IS NOT NULL UNION ALL SELECT module_id, 'unknown' FROM modules WHERE tool IS NULL) GROUP BY module_id")
def change_upsert(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "modules")
    fix = m.filter("tool is null").withColumn("tool", F.lit("unknown"))
    return changes.upsert(m, fix, ["module_id"]).select("module_id", "tool")


@query("SELECT method_id, model, text_hash FROM method_embeddings WHERE variant = 'main' AND (method_id, model, text_hash) NOT IN (SELECT method_id, model, text_hash FROM method_embeddings WHERE variant = 'validated' AND method_id IS NOT NULL AND text_hash IS NOT NULL)")
def change_hash_gate(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "method_embeddings").select("method_id", "model", "text_hash", "variant")
    return changes.hash_gate(e.filter("variant = 'main'").drop("variant"), e.filter("variant = 'validated'"))


@query("SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS events FROM (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g FROM (SELECT *, CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE > ts THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g")
def stream_bursts(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "events")
    return debounce.bursts(e, "user_id", "ts", "30 minutes", what="event_type").drop("paths")


# ---------------------------------------------------------------- documents


@query("SELECT id, name FROM (SELECT DISTINCT id, unnest(regexp_extract_all(coalesce(content, ''), '\\b[A-Z][a-zA-Z0-9]{2,}\\b')) AS name FROM doc_chunks) WHERE name IN (SELECT name FROM classes UNION SELECT full_name FROM classes UNION SELECT method_name FROM methods WHERE length(method_name) > 2)")
def docs_symbol_links(spark: SparkSession, folder: str) -> DataFrame:
    d, c, m = t(spark, folder, "doc_chunks", "classes", "methods")
    return docs.symbol_links(d, docs.graph_names(c, m))


@query("WITH l AS (SELECT DISTINCT id, trim(unnest(string_split(coalesce(linked_classes, ''), ','))) AS name, source_path FROM doc_chunks), k AS (SELECT l.id, count(*) AS links, count(*) FILTER (name NOT IN (SELECT name FROM classes WHERE name IS NOT NULL)) AS gone FROM l WHERE name <> '' GROUP BY 1) SELECT id, links, gone, CASE WHEN gone = links THEN 'dropped' WHEN gone > 0 THEN 'partial' ELSE 'fresh' END AS state FROM k")
def docs_staleness(spark: SparkSession, folder: str) -> DataFrame:
    d, c = t(spark, folder, "doc_chunks", "classes")
    return docs.stale_chunks(d, c)


@query()
def docs_chunks(spark: SparkSession, folder: str) -> DataFrame:
    d = t(spark, folder, "documents").filter("text is not null")
    return docs.markdown_chunks(d.select(F.col("doc_id").cast("string").alias("path"), "text"))


@query("SELECT DISTINCT source_path AS src, id AS dst, 'holds' AS kind FROM doc_chunks UNION SELECT id, name, 'names' FROM (SELECT id, trim(unnest(string_split(coalesce(linked_classes, ''), ','))) AS name FROM doc_chunks) WHERE name IN (SELECT name FROM classes)")
def docs_graph(spark: SparkSession, folder: str) -> DataFrame:
    d, c = t(spark, folder, "doc_chunks", "classes")
    return docs.doc_graph(d, c)[1]


@query("SELECT name, count(DISTINCT id) AS n FROM (SELECT id, unnest(regexp_extract_all(content, '`(?:\\w+\\.)?([A-Za-z]\\w+)`', 1)) AS name FROM doc_chunks) WHERE name NOT IN (SELECT name FROM classes WHERE name IS NOT NULL UNION SELECT full_name FROM classes WHERE full_name IS NOT NULL UNION SELECT method_name FROM methods WHERE length(method_name) > 2) GROUP BY name")
def docs_unknown_references(spark: SparkSession, folder: str) -> DataFrame:
    d, c, m = t(spark, folder, "doc_chunks", "classes", "methods")
    return docs.unknown_references(d, docs.graph_names(c, m))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def source_json_fields(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


# ---------------------------------------------------------------- synthesis and flows


@query(r"SELECT o AS outer_name, i AS inner_name, arg_min(full_name, (CASE WHEN contains(full_name, '$') THEN 0 ELSE 1 END, full_name)) AS full_name FROM (SELECT full_name, regexp_extract(full_name, '(\w+)[.$](\w+)$', 1) AS o, regexp_extract(full_name, '(\w+)[.$](\w+)$', 2) AS i FROM classes WHERE full_name IS NOT NULL) WHERE o <> '' GROUP BY o, i")
def synth_inner_classes(spark: SparkSession, folder: str) -> DataFrame:
    return synthesis.inner_classes(t(spark, folder, "classes")).withColumnsRenamed({"outer": "outer_name", "inner": "inner_name"})


@query("WITH " + INHERITANCE + " SELECT c.id AS class_id, c.full_name AS class_full_name, unnest(['findById','findAll','save','saveAll','delete','deleteById','deleteAll','existsById','count','flush']) AS method_name, true AS generated FROM classes c WHERE c.id IN (SELECT source_id FROM inh WHERE split_part(target, '.', -1) IN ('Repository','CrudRepository','PagingAndSortingRepository','JpaRepository','MongoRepository','ReactiveCrudRepository','ReactiveMongoRepository','ReactiveSortingRepository','JpaSpecificationExecutor','QuerydslPredicateExecutor'))")
def synth_repository_methods(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return synthesis.repository_methods(c, cg.inheritance_edges(c))


@query()
def synth_receiver_types(spark: SparkSession, folder: str) -> DataFrame:
    m, s = t(spark, folder, "methods", "callsites")
    names = m.filter("parameter_names is null or size(parameter_names) = size(array_distinct(parameter_names))").filter("size(parameter_names) = size(parameter_types)")
    return synthesis.receiver_types(calls_of(s), cg.latest(names))


@query(r"""SELECT id AS method_id, concat_ws(chr(10), CASE WHEN method_name <> '' THEN 'method: ' || method_name END, CASE WHEN class_full_name <> '' THEN 'class: ' || class_full_name END, CASE WHEN signature <> '' THEN 'signature: ' || signature END, CASE WHEN return_type <> '' THEN 'returns: ' || return_type END, CASE WHEN array_to_string(parameter_names, ', ') <> '' THEN 'parameters: ' || array_to_string(parameter_names, ', ') END, CASE WHEN array_to_string(annotations, ' ') <> '' THEN 'annotations: ' || array_to_string(annotations, ' ') END, CASE WHEN framework_role <> '' THEN 'role: ' || framework_role END, CASE WHEN coalesce(full_route, route) <> '' THEN 'route: ' || coalesce(full_route, route) END, CASE WHEN trim(regexp_replace(substring(source, 1, 2000), '\s+', ' ', 'g')) <> '' THEN 'source: ' || trim(regexp_replace(substring(source, 1, 2000), '\s+', ' ', 'g')) END) AS payload FROM methods""")
def synth_payloads(spark: SparkSession, folder: str) -> DataFrame:
    return synthesis.embedding_payloads(t(spark, folder, "methods")).select("method_id", "payload")


@query(r"""SELECT doc_id AS id, n - 1 AS position, regexp_extract(l, '^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)', 1) AS class, regexp_extract(l, '^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)', 2) AS method, CAST(regexp_extract(l, '^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)', 4) AS INT) AS line
FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS l, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1) AS n FROM documents) WHERE regexp_matches(l, '^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)')""")
def flow_stack_frames(spark: SparkSession, folder: str) -> DataFrame:
    f = flows.stack_frames(t(spark, folder, "documents"), "doc_id").filter("class is not null")
    return f.select("id", "position", "class", "method", "line")


@query(r"""
WITH l AS (SELECT doc_id AS id, n - 1 AS position, l FROM (SELECT doc_id, unnest(string_split_regex(text, '\r\n|\n|\r')) AS l, generate_subscripts(string_split_regex(text, '\r\n|\n|\r'), 1) AS n FROM documents)),
j AS (SELECT id, position, regexp_extract(l, '^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)', ['c', 'm', 'f', 'n']) AS x, regexp_matches(l, '^\s*at\s+([\w.$]+)\.([\w$<>]+)\(([\w.$-]+\.\w+):(\d+)\)') AS java, regexp_extract(l, '^\s*File "([^"]+)", line (\d+), in (\S+)', ['f', 'n', 'm']) AS y, regexp_matches(l, '^\s*File "([^"]+)", line (\d+), in (\S+)') AS py FROM l),
f AS (SELECT id, position, CASE WHEN java THEN x.c END AS class, CASE WHEN java THEN x.m ELSE y.m END AS method, CASE WHEN java THEN x.f ELSE split_part(y.f, '/', -1) END AS file, CAST(CASE WHEN java THEN x.n ELSE y.n END AS INT) AS line FROM j WHERE java OR py),
k AS (SELECT f.id, f.position, count(DISTINCT m.id) AS n, count(DISTINCT CASE WHEN f.line BETWEEN m.start_line AND m.end_line THEN m.id END) AS k FROM f JOIN methods m ON m.method_name = f.method AND split_part(replace(m.file_path, '\', '/'), '/', -1) = f.file AND (f.class IS NULL OR m.class_full_name = f.class) GROUP BY ALL)
SELECT CASE WHEN n = 1 OR k = 1 THEN 'matched' WHEN n > 1 THEN 'ambiguous' ELSE 'unmatched' END AS status, count(*) AS n FROM f LEFT JOIN k USING (id, position) GROUP BY 1
""")
def flow_matched_frames(spark: SparkSession, folder: str) -> DataFrame:
    d, m = t(spark, folder, "documents", "methods")
    return flows.matched_frames(flows.stack_frames(d, "doc_id"), m).groupBy("status").agg(F.count("*").alias("n"))


@query(r"""
SELECT category, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(lower(coalesce(receiver, '')), '^(log|logger|_log|metrics?|tracer)\b') OR regexp_matches(lower(callee_name), 'log|metric') THEN 'observability'
 WHEN callee_name IN ('debug','info','warn','error','trace','isDebugEnabled','isInfoEnabled','map','flatMap','filter','forEach','stream','collect','toList','isPresent','orElse','orElseGet','orElseThrow','get','put','add','remove','clear','size','isEmpty','toString','equals','hashCode') OR regexp_matches(lower(coalesce(receiver_type, '')), '(string|list|map|set|optional|collection)$') THEN 'utility'
 WHEN resolution_status LIKE 'resolved%' THEN CASE WHEN b THEN 'business_internal' ELSE 'probable_internal' END WHEN resolution_status = 'ambiguous_type' AND candidate_count > 0 THEN 'probable_internal' WHEN resolution_status = 'external_library' THEN 'external_library'
 WHEN resolution_status LIKE 'unresolved%' THEN CASE WHEN b THEN 'unresolved_business' ELSE 'unknown' END ELSE 'framework' END AS category FROM (SELECT *, regexp_matches(lower(coalesce(receiver_type, '')), 'service|repository|controller|handler|processor|manager') AS b FROM callsites)) GROUP BY category
""")
def flow_categories(spark: SparkSession, folder: str) -> DataFrame:
    s = t(spark, folder, "callsites")
    c = flows.trace_category(F.col("callee_name"), F.col("receiver"), F.col("receiver_type"), F.col("resolution_status"), F.col("candidate_count"))
    return s.groupBy(c.alias("category")).agg(F.count("*").alias("n"))


@query(FLOW + ", c AS (SELECT id, min(line) AS line FROM callsites GROUP BY id) SELECT e.src, e.dst, n.depth, string_agg(DISTINCT CAST(c.line AS VARCHAR), ',' ORDER BY CAST(c.line AS VARCHAR)) AS lines FROM edges e JOIN n ON n.id = e.src AND n.depth < 3 JOIN c ON c.id = e.callsite_id GROUP BY ALL")
def flow_traced(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    line = t(spark, folder, "callsites").groupBy(F.col("id").alias("callsite_id")).agg(F.min("line").cast("string").alias("line"))
    return flows.traced(e.join(line, "callsite_id"), endpoints_of(spark, folder, e), 3).withColumn("lines", F.array_join("lines", ","))


@query()
def flow_graph_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    return flows.graph_retrieval(m, edges_of(spark, folder), ["invoice", "archive"]).withColumn("score", F.round("score", 6))
