"""Further queries over the code graph: selectors, members, implementations, noise, flows, roll-ups, search over a stored index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ids, rules
from ..operators import changes, docs, index, lookups, reports, resolve, rollups, search, synthesis, traversal
from ..operators import code_graph as cg
from ..session import cut
from ..sources import store
from ..streaming import debounce
from .reference import EDGES, ENDPOINTS, INHERITANCE, METHODS, PAIRS, Query, calls_of, edges_of, endpoints_of, one_per_method, t

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def joined(c: str):  # noqa: ANN201
    return F.array_join(c, ",").alias(c)


# ---------------------------------------------------------------- selectors and members

SELECTORS = "q AS (SELECT DISTINCT split_part(receiver_type, '.', -1) || '#' || callee_name AS selector FROM callsites WHERE receiver_type IS NOT NULL AND callee_name IS NOT NULL UNION SELECT DISTINCT full_name FROM classes WHERE full_name IS NOT NULL UNION SELECT DISTINCT method_name FROM methods WHERE method_name IS NOT NULL UNION SELECT DISTINCT signature FROM methods WHERE signature IS NOT NULL)"


def methods_by_id(methods: DataFrame) -> DataFrame:
    return methods.groupBy("id").agg(*(F.min(c).alias(c) for c in ("class_full_name", "method_name", "signature", "file_path", "start_line", "parameter_types", "return_type", "is_endpoint")), F.max("generated").alias("generated"))


BY_ID = "mi AS (SELECT id, min(class_full_name) AS class_full_name, min(method_name) AS method_name, min(signature) AS signature, min(file_path) AS file_path, min(start_line) AS start_line, min(parameter_types) AS parameter_types, min(return_type) AS return_type, coalesce(max(generated), false) AS generated FROM methods GROUP BY id)"


@query(f"""
WITH {SELECTORS}, {BY_ID},
n AS (SELECT id, class_full_name, method_name, generated, split_part(class_full_name, '.', -1) AS short, signature FROM mi),
k AS (SELECT id AS key, 1 AS kind, * FROM n UNION ALL SELECT signature, 2, * FROM n UNION ALL SELECT concat_ws('.', class_full_name, method_name), 3, * FROM n UNION ALL SELECT concat_ws('#', class_full_name, method_name), 3, * FROM n
  UNION ALL SELECT concat_ws('.', short, method_name), 4, * FROM n UNION ALL SELECT concat_ws('#', short, method_name), 4, * FROM n UNION ALL SELECT method_name, 5, * FROM n),
h0 AS (SELECT selector, kind, min(id) FILTER (NOT generated) AS own, min(id) AS anyone, count(DISTINCT id) AS n FROM q JOIN k ON k.key = q.selector GROUP BY selector, kind), h AS (SELECT * FROM h0 QUALIFY row_number() OVER (PARTITION BY selector ORDER BY kind) = 1),
o AS (SELECT class_full_name AS c, array_to_string(list_sort(list(DISTINCT method_name)), ',') AS names FROM mi WHERE class_full_name IS NOT NULL GROUP BY 1),
ck AS (SELECT c AS key, c, names FROM o UNION SELECT split_part(c, '.', -1), c, names FROM o),
c1 AS (SELECT * FROM ck QUALIFY row_number() OVER (PARTITION BY key ORDER BY c) = 1),
j AS (SELECT q.selector, h.own, h.anyone, h.n, s.c AS self, s.names AS self_names, p.c AS owner, p.names AS owner_names,
  regexp_matches(regexp_replace(q.selector, '^.*\\.', ''), '^[A-Z]') AND NOT contains(q.selector, '#') AS capital FROM q LEFT JOIN h USING (selector) LEFT JOIN c1 s ON s.key = q.selector
  LEFT JOIN c1 p ON p.key = CASE WHEN contains(q.selector, '#') THEN split_part(q.selector, '#', 1) WHEN contains(q.selector, '.') THEN regexp_replace(q.selector, '\\.[^.]*$', '') END),
st AS (SELECT *, CASE WHEN own IS NOT NULL THEN 'found' WHEN n = 1 THEN 'generated' WHEN n > 1 THEN 'ambiguous' WHEN capital AND self IS NOT NULL THEN 'class' WHEN owner IS NOT NULL THEN 'class_without_method' ELSE 'unknown' END AS status FROM j)
SELECT selector, status, CASE WHEN status IN ('found', 'generated') THEN coalesce(own, anyone) END AS method_id, CASE status WHEN 'class' THEN self WHEN 'class_without_method' THEN owner END AS class, CASE status WHEN 'class' THEN self_names WHEN 'class_without_method' THEN owner_names END AS names FROM st
""")
def select_many(spark: SparkSession, folder: str) -> DataFrame:
    m, c, s = t(spark, folder, "methods", "classes", "callsites")
    asked = s.filter("receiver_type is not null and callee_name is not null").select(F.concat_ws("#", ids.short_name("receiver_type"), "callee_name").alias("selector"))
    asked = asked.union(c.select("full_name")).union(m.select("method_name")).union(m.select("signature"))
    return lookups.resolved_selectors(methods_by_id(m), asked).withColumn("names", F.array_join("names", ","))


@query(f"WITH {BY_ID} SELECT DISTINCT class_full_name AS class, 'method' AS kind, method_name AS name, signature AS detail, start_line AS line FROM mi WHERE class_full_name IN (SELECT full_name FROM classes)")
def select_members(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    return lookups.class_members(methods_by_id(m), c)


@query("WITH " + INHERITANCE + " SELECT DISTINCT split_part(target, '.', -1) AS type, source AS implementer, 1 AS distance FROM inh WHERE source IN (SELECT full_name FROM classes)")
def graph_implementations(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return lookups.implementations(c, cg.inheritance_edges(c))


@query("WITH RECURSIVE " + INHERITANCE.replace("inh AS", "inh AS", 1) + ", d AS (SELECT DISTINCT split_part(target, '.', -1) AS type, source AS implementer FROM inh WHERE source IS NOT NULL), w AS (SELECT type, implementer, 1 AS distance FROM d UNION SELECT w.type, d.implementer, w.distance + 1 FROM w JOIN d ON d.type = split_part(w.implementer, '.', -1) WHERE w.distance < 120) SELECT type, implementer, min(distance) AS distance FROM w GROUP BY ALL")
def graph_implementations_transitive(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return lookups.implementations(c, cg.inheritance_edges(c), transitive=True)


@query("SELECT split_part(full_name, '.', -1) AS short, full_name FROM classes WHERE full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY split_part(full_name, '.', -1) ORDER BY CASE WHEN list_contains(stereotypes, 'interface') THEN 0 WHEN list_contains(stereotypes, 'abstract') THEN 1 ELSE 2 END, full_name) = 1")
def window_declared_types(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.declared_types(t(spark, folder, "classes"))


@query("WITH " + INHERITANCE + f", {BY_ID} SELECT method_name, len(coalesce(parameter_types, [])) AS arity, count(DISTINCT id) AS n, CASE WHEN count(DISTINCT id) = 1 THEN min(id) END AS sole FROM mi WHERE class_full_name IN (SELECT source FROM inh WHERE relation = 'implements') GROUP BY ALL")
def join_implementer_methods(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    return lookups.implementer_methods(methods_by_id(m), cg.inheritance_edges(c))


@query("WITH " + EDGES + f", {BY_ID} SELECT e.callsite_id, e.src, e.dst, m.class_full_name AS callee_class, m.method_name AS callee FROM edges e JOIN mi m ON m.id = e.dst WHERE ends_with(m.class_full_name, 'Service')")
def join_callees_in(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.callees_in(edges_of(spark, folder), methods_by_id(t(spark, folder, "methods")), "Service")


@query("WITH " + INHERITANCE + ", n AS (SELECT DISTINCT full_name AS name FROM classes WHERE full_name IS NOT NULL) SELECT n.name, i.source FROM n JOIN inh i ON i.target = n.name UNION SELECT n.name, i.source FROM n JOIN inh i ON split_part(i.target, '.', -1) = split_part(n.name, '.', -1) AND contains(i.target, '.')")
def join_implementers_of(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return lookups.implementers_of(cg.inheritance_edges(c), c.select(F.col("full_name").alias("name")))


@query("WITH RECURSIVE " + PAIRS + f", seeds AS (SELECT DISTINCT src AS id FROM pairs WHERE src IN {ENDPOINTS}), b AS (SELECT src, dst FROM pairs UNION SELECT dst, src FROM pairs), walk AS (SELECT id, 0 AS depth FROM seeds UNION SELECT b.dst, w.depth + 1 FROM walk w JOIN b ON b.src = w.id WHERE w.depth < 2) SELECT DISTINCT id FROM walk")
def graph_focused(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return lookups.focused(e, e.select(F.col("src").alias("id")), endpoints_of(spark, folder, e), 3)


# ---------------------------------------------------------------- noise

_CALLS = "c AS (SELECT id, coalesce(callee_name, '') AS call, coalesce(receiver, '') AS r, coalesce(receiver_type, '') AS ty, lower(coalesce(text, '')) AS text, resolution_status AS st, coalesce(candidate_count, 0) AS k FROM callsites)"
_LIST = "({})".format


def _in(names) -> str:  # noqa: ANN001
    return "(" + ", ".join(f"'{n}'" for n in names) + ")"


@query(f"""WITH {_CALLS} SELECT id, lower(call) NOT IN {_in(lookups.NON_BUSINESS_NAMES)} AND NOT ({' OR '.join(f"contains(text, '{p}')" for p in lookups.NON_BUSINESS_PARTS)}) AS business,
  ({' OR '.join(f"r = '{p}' OR starts_with(r, '{p}.') OR starts_with(r, '{p}(')" for p in lookups.ERROR_NOISE_RECEIVERS)}) OR (r = 'e' AND call IN {_in(lookups.EXCEPTION_READS)}) OR contains(r || ' ' || ty || ' ' || call, 'Health.Builder') OR call IN {_in(lookups.ERROR_NOISE_NAMES)} AS error_noise,
  CASE WHEN trim(call) = '' THEN 'empty_call' WHEN lower(trim(call)) IN {_in(lookups.UNIMPORTANT_NAMES)} THEN 'call:' || lower(trim(call)) WHEN regexp_matches(lower(r || ' ' || ty), 'marker|metrics|log') THEN 'receiver_noise'
    WHEN split_part(split_part(ty, '<', 1), '.', -1) IN {_in(lookups.UTILITY_TYPES)} THEN 'utility_type:' || split_part(split_part(ty, '<', 1), '.', -1) WHEN {' OR '.join(f"starts_with(lower(ty), '{p}')" for p in lookups.UTILITY_PREFIXES)} THEN 'type_prefix:' || ty
    WHEN regexp_matches(trim(call), '^set[A-Z]') AND (ty = '' OR k <= 0) THEN 'setter_chain' END AS unimportant,
  coalesce(st = 'unresolved_receiver' AND (call IN {_in(rules.LAMBDA_CALLS)} OR lower(trim(r)) IN {_in(rules.LAMBDA_RECEIVERS)} OR {' OR '.join(f"starts_with(lower(trim(r)), '{p}.')" for p in rules.LAMBDA_RECEIVERS)}), false) AS lambda_noise FROM c""")
def filter_noise(spark: SparkSession, folder: str) -> DataFrame:
    """What four filters say of each call."""
    s = t(spark, folder, "callsites")
    call, r, ty = F.col("callee_name"), F.col("receiver"), F.col("receiver_type")
    return s.select("id", lookups.business_call(F.coalesce(call, F.lit("")), F.col("text")).alias("business"), lookups.error_noise(call, r, ty).alias("error_noise"), lookups.unimportant(call, r, ty, F.col("candidate_count")).alias("unimportant"), rules.lambda_noise(F.coalesce(call, F.lit("")), F.col("resolution_status"), r).alias("lambda_noise"))


CONFIG = {"package_contains": (".core.", "/build/"), "class_name_patterns": ("Mapper$", "^com\\.brindlework"), "method_name_patterns": ("^archive", "^get")}


@query(f"""WITH {METHODS}, p AS (SELECT id, signature AS s, coalesce(file_path, '') AS f, split_part(signature, '#', 1) AS c, CASE WHEN contains(signature, '#') THEN split_part(split_part(signature, '#', -1), '(', 1) ELSE signature END AS n FROM m WHERE signature IS NOT NULL)
SELECT id, CASE WHEN contains(s, '.core.') OR contains(f, '.core.') THEN 'package:.core.' WHEN contains(s, '/build/') OR contains(f, '/build/') THEN 'package:/build/'
  WHEN regexp_matches(split_part(c, '.', -1), 'Mapper$') OR regexp_matches(c, 'Mapper$') OR regexp_matches(s, 'Mapper$') THEN 'class_pattern:Mapper$' WHEN regexp_matches(split_part(c, '.', -1), '^com\\.brindlework') OR regexp_matches(c, '^com\\.brindlework') OR regexp_matches(s, '^com\\.brindlework') THEN 'class_pattern:^com\\.brindlework'
  WHEN regexp_matches(n, '^archive') OR regexp_matches(s, '^archive') THEN 'method_pattern:^archive' WHEN regexp_matches(n, '^get') OR regexp_matches(s, '^get') THEN 'method_pattern:^get' END AS why FROM p""")
def filter_excluded(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods")).filter("signature is not null")
    return m.select("id", lookups.excluded(F.col("signature"), F.col("file_path"), CONFIG).alias("why"))


@query("SELECT id, regexp_matches(file_path, 'build/generated|generated-sources') AND NOT regexp_matches(file_path, 'smithy4[js]') AS generated_path, regexp_matches(file_path, '\\.pb\\.|_generated|/generated/|mock_|/mocks/|/build/generated|generated-src|/build/classes|/out/production') AS demoted FROM methods WHERE file_path IS NOT NULL")
def rule_generated_paths(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods").filter("file_path is not null")
    return m.select("id", rules.generated_path(F.col("file_path")).alias("generated_path"), rules.demoted_path(F.col("file_path")).alias("demoted"))


@query("""SELECT id, CASE WHEN len(list_filter(d, lambda x: list_contains(['Get','Post','Put','Delete','Patch','Options','Head','All'], x))) > 0 THEN 'http_handler' WHEN list_contains(d, 'Component') THEN 'component' WHEN regexp_matches(method_name, '^use[A-Z]') THEN 'hook' WHEN contains(source, '/>') THEN 'component' END AS role,
  array_to_string(list_filter([CASE WHEN regexp_matches(file_path, '\\.service\\.tsx?$|/services?/') THEN 'service' END, CASE WHEN regexp_matches(file_path, '\\.controller\\.tsx?$|/controllers?/') THEN 'controller' END, CASE WHEN regexp_matches(file_path, '\\.component\\.tsx?$|/components?/') THEN 'component' END, CASE WHEN regexp_matches(file_path, '/hooks/use[A-Z]') THEN 'hook' END, CASE WHEN regexp_matches(file_path, '/composables/use[A-Z]') THEN 'vue_composable' END], lambda x: x IS NOT NULL), ',') AS stereotypes
FROM (SELECT *, list_transform(annotations, lambda a: split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1)) AS d FROM methods WHERE language = 'typescript')""")
def rule_script_roles(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods").filter("language = 'typescript'")
    return m.select("id", rules.script_roles(F.col("method_name"), rules.annotation_names(F.col("annotations")), F.col("source").contains("/>")).alias("role"), F.array_join(rules.script_path_stereotypes(F.col("file_path")), ",").alias("stereotypes"))


@query("SELECT id, CASE WHEN list_contains(modifiers, 'trait') THEN 'trait' WHEN list_contains(modifiers, 'object') THEN 'object' WHEN list_contains(modifiers, 'interface') THEN 'interface' WHEN name LIKE '%Controller' THEN 'controller' WHEN name LIKE '%Service' THEN 'service' WHEN name LIKE '%Repository' OR name LIKE '%Repo' THEN 'repository' ELSE 'unknown' END AS stereotypes FROM classes WHERE language = 'scala' AND name IS NOT NULL")
def rule_scala_stereotypes(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes").filter("language = 'scala' and name is not null")
    kind = F.when(F.array_contains("modifiers", "trait"), "trait").when(F.array_contains("modifiers", "object"), "object").when(F.array_contains("modifiers", "interface"), "interface")
    return c.select("id", F.array_join(rules.scala_stereotypes(F.col("name"), kind), ",").alias("stereotypes"))


@query("""WITH p AS (SELECT id, unnest(parameter_names) AS v, local_variable_types AS l FROM methods) SELECT DISTINCT id, v, l[v] AS name_type, 'int' AS literal, 'java.lang.String' AS text, 'double' AS floating FROM p WHERE v IS NOT NULL AND l IS NOT NULL AND regexp_matches(v, '^[A-Za-z_$][A-Za-z0-9_$]*$') AND v NOT IN ('true', 'false', 'null')""")
def rule_argument_types(spark: SparkSession, folder: str) -> DataFrame:
    m = t(spark, folder, "methods").select("id", F.explode("parameter_names").alias("v"), F.col("local_variable_types").alias("l")).filter("v is not null and l is not null")
    m = m.filter(F.col("v").rlike("^[A-Za-z_$][A-Za-z0-9_$]*$") & ~F.col("v").isin("true", "false", "null"))
    of = lambda x: rules.argument_type(x, F.col("l"))
    return m.select("id", "v", of(F.col("v")).alias("name_type"), of(F.lit("0x1f")).alias("literal"), of(F.lit('"a, b"')).alias("text"), of(F.lit("1.5e3")).alias("floating")).distinct()


@query("SELECT DISTINCT id, CASE WHEN list_contains(stereotypes, 'controller') THEN '#e76f51' WHEN list_contains(stereotypes, 'service') THEN '#2a9d8f' WHEN list_contains(stereotypes, 'repository') THEN '#264653' WHEN list_contains(stereotypes, 'entity') THEN '#e9c46a' WHEN list_contains(stereotypes, 'component') THEN '#f4a261' ELSE '#999999' END AS colour, 'dot' AS shape, full_name AS title FROM classes")
def rule_decorations(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return c.select("id", rules.decorations(F.col("stereotypes"), F.lit(False), F.col("full_name")).alias("d")).select("id", "d.*").distinct()


@query("SELECT module_id, count(DISTINCT id) AS methods, " + ", ".join("CASE " + " ".join(f"WHEN count(DISTINCT id) < {row[0]} THEN " + (f"'{row[i]}'" if i == 1 else str(row[i])) for row in rules.TIERS[:-1]) + " ELSE " + (f"'{rules.TIERS[-1][i]}'" if i == 1 else str(rules.TIERS[-1][i])) + f" END AS {name}" for i, name in enumerate(("tier", "max_chars", "max_source_lines", "top_n", "depth"), 1)) + " FROM methods GROUP BY module_id")
def rule_budgets(spark: SparkSession, folder: str) -> DataFrame:
    n = t(spark, folder, "methods").groupBy("module_id").agg(F.count_distinct("id").alias("methods"))
    return n.select("module_id", "methods", rules.budget(F.col("methods")).alias("b")).select("module_id", "methods", "b.*")


# ---------------------------------------------------------------- flows

NODES = "nodes AS (SELECT id, signature, CASE WHEN contains(lower(signature), '.controller.') OR contains(lower(signature), '.service.') THEN 'primary' WHEN contains(lower(signature), '.components.') OR contains(lower(signature), '.processor.') THEN 'supporting' ELSE 'utility' END AS tier, CAST((SELECT count(*) FROM pairs WHERE dst = m.id) AS DOUBLE) AS rank FROM m WHERE signature IS NOT NULL)"


def nodes_of(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods")).filter("signature is not null").select("id", "signature")
    n = edges_of(spark, folder).select("src", "dst").distinct().groupBy(F.col("dst").alias("id")).agg(F.count("*").cast("double").alias("rank"))
    return m.join(n, "id", "left").fillna(0.0, ["rank"]).withColumn("tier", reports.map_tier(F.col("signature")))


@query("WITH " + PAIRS + ", " + METHODS + ", " + NODES + " SELECT * FROM nodes ORDER BY CASE WHEN tier = 'utility' THEN 1 ELSE 0 END, rank DESC, id LIMIT 25")
def flow_top_first(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.top_first(nodes_of(spark, folder), 25).select("id", "signature", "tier", "rank")


@query("WITH " + PAIRS + ", " + METHODS + ", " + NODES + " SELECT id, signature, tier, rank FROM nodes ORDER BY CASE tier WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 WHEN 'utility' THEN 2 ELSE 3 END, rank DESC, signature, id LIMIT 40")
def flow_expansion_queue(spark: SparkSession, folder: str) -> DataFrame:
    return lookups.expansion_queue(nodes_of(spark, folder), "", 40, utilities=True)


@query("WITH " + PAIRS + ", " + METHODS + ", " + NODES + ", p AS (SELECT id, signature, tier, rank, 'root_top_node' AS reason, 0 AS seq FROM nodes WHERE rank >= 5 UNION ALL SELECT id, signature, 'supporting', 0.0, 'possible_target_from_unresolved', 1 FROM nodes) SELECT id, signature, tier, rank, reason FROM (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY id, signature ORDER BY seq) = 1) ORDER BY CASE tier WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 WHEN 'utility' THEN 2 ELSE 3 END, rank DESC, signature, id LIMIT 15")
def flow_suggested_next(spark: SparkSession, folder: str) -> DataFrame:
    n = nodes_of(spark, folder).select("id", "signature", "tier", "rank")
    first = n.filter("rank >= 5").withColumns({"reason": F.lit("root_top_node"), "seq": F.lit(0)})
    more = n.withColumns({"tier": F.lit("supporting"), "rank": F.lit(0.0), "reason": F.lit("possible_target_from_unresolved"), "seq": F.lit(1)})
    return lookups.suggested_next(first.unionByName(more))


SITES = """
sites AS (SELECT id, lower(trim(min(caller_method_id))) AS caller, min(callee_name) AS call, min(receiver) AS receiver, min(receiver_type) AS ty, min(resolution_status) AS status, min(line) AS line FROM callsites GROUP BY id),
tg AS (SELECT callsite_id, min(dst) AS dst, count(DISTINCT dst) AS n FROM edges GROUP BY 1),
cs AS (SELECT s.*, t.dst, coalesce(t.n, 0) AS n, lower(trim(concat_ws('.', coalesce(receiver, ''), coalesce(call, '')), '.')) AS tx, lower(coalesce(ty, '') || ' ' || coalesce(receiver, '')) AS kinds, lower(coalesce(ty, '') || ' ' || coalesce(receiver, '') || ' ' || coalesce(call, '')) AS blob, coalesce(status, '') AS st FROM sites s LEFT JOIN tg t ON t.callsite_id = s.id),
cat AS (SELECT *, CASE WHEN {obs} OR contains(lower(coalesce(call, '')), 'log') OR contains(lower(coalesce(call, '')), 'metric') THEN 'observability' WHEN lower(coalesce(call, '')) IN {names} OR {types} THEN 'utility'
  WHEN starts_with(st, 'resolved') THEN CASE WHEN {biz} THEN 'business_internal' ELSE 'probable_internal' END WHEN st = 'ambiguous_type' AND n > 0 THEN 'probable_internal' WHEN st = 'external_library' THEN 'external_library'
  WHEN starts_with(st, 'unresolved') THEN CASE WHEN {biz} THEN 'unresolved_business' ELSE 'unknown' END ELSE 'framework' END AS category,
  CASE WHEN starts_with(st, 'resolved') THEN 'internal' WHEN st = 'external_library' THEN 'external' ELSE 'unresolved' END AS kind, {first} AS first FROM cs)
""".format(
    obs="(" + " OR ".join(f"contains(tx, '{p}')" for p in reports.OBSERVED) + ")",
    names=_in(reports.USEFUL_NAMES),
    types="(" + " OR ".join(f"contains(kinds, '{p}')" for p in reports.USEFUL_TYPES) + ")",
    biz="(" + " OR ".join(f"contains(blob, '{p}')" for p in reports.BUSINESS) + ")",
    first="(" + " OR ".join(f"contains(kinds, '{p}')" for p in reports.FIRST) + ")",
)


def sites_of(spark: SparkSession, folder: str) -> DataFrame:
    s = t(spark, folder, "callsites")
    one = s.groupBy(F.col("id").alias("callsite_id")).agg(*(F.min(c).alias(n) for c, n in (("caller_method_id", "caller_method_id"), ("callee_name", "callee_name"), ("receiver", "receiver"), ("receiver_type", "receiver_type"), ("resolution_status", "status"), ("resolution_reason", "reason"), ("line", "line"))))
    to = edges_of(spark, folder).groupBy("callsite_id").agg(F.array_sort(F.collect_set("dst")).alias("candidates"))
    one = one.withColumn("caller_method_id", F.lower(F.trim("caller_method_id"))).join(to, "callsite_id", "left")
    return one.withColumn("candidates", F.coalesce("candidates", F.array().cast("array<string>")))


def _built(mode: str, wanted: str, shown: str) -> str:
    return (
        "WITH RECURSIVE " + EDGES + ", " + SITES + f""",
ok AS (SELECT * FROM cat WHERE category <> 'observability' AND ({'true' if mode == 'debug' else "category <> 'utility'"}) AND CASE WHEN dst IS NOT NULL THEN {wanted} ELSE {shown} END),
e AS (SELECT DISTINCT caller AS src, dst FROM ok WHERE dst IS NOT NULL),
seeds AS (SELECT DISTINCT src AS id FROM edges WHERE src IN {ENDPOINTS}),
walk AS (SELECT id AS root, id, 0 AS depth FROM seeds UNION SELECT w.root, e.dst, w.depth + 1 FROM walk w JOIN e ON e.src = w.id WHERE w.depth < 2),
near AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL)
SELECT n.root, n.depth + 1 AS depth, o.caller AS src, o.dst, o.call, min(category) AS category, min(kind) AS kind, min(status) AS status, min(CASE kind WHEN 'internal' THEN CASE WHEN first THEN 0 ELSE 1 END WHEN 'unresolved' THEN CASE WHEN first THEN 2 ELSE 3 END ELSE 4 END) AS priority, count(*) AS times, array_to_string(list_sort(list(line)), ',') AS lines,
  CASE WHEN min(status) = 'ambiguous_type' AND o.dst IS NOT NULL THEN CAST(0.75 AS DOUBLE) ELSE CAST(1.0 AS DOUBLE) END AS confidence FROM near n JOIN ok o ON o.caller = n.id GROUP BY n.root, n.depth, o.caller, o.dst, o.call"""
    )


@query(_built("compact", "category IN ('business_internal', 'probable_internal')", "false"))
def flow_built_compact(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return reports.built_flow(sites_of(spark, folder), endpoints_of(spark, folder, e), 3).withColumn("lines", F.array_join("lines", ","))


@query(_built("full", "category IN ('business_internal', 'probable_internal', 'unresolved_business')", "category = 'unresolved_business'"))
def flow_built_full(spark: SparkSession, folder: str) -> DataFrame:
    e = edges_of(spark, folder)
    return reports.built_flow(sites_of(spark, folder), endpoints_of(spark, folder, e), 3, "full").withColumn("lines", F.array_join("lines", ","))


@query()
def flow_stats(spark: SparkSession, folder: str) -> DataFrame:
    e, s = edges_of(spark, folder), sites_of(spark, folder)
    return reports.flow_stats(cut(reports.built_flow(s, endpoints_of(spark, folder, e), 3)), s)


@query("WITH RECURSIVE " + PAIRS + ", " + METHODS + f", k AS (SELECT id, signature, CASE WHEN contains(lower(signature), '.controller.') OR contains(lower(signature), '.service.') THEN 'primary' WHEN contains(lower(signature), '.components.') OR contains(lower(signature), '.processor.') THEN 'supporting' ELSE 'utility' END AS tier, contains(signature, '.core.') OR contains(coalesce(file_path, ''), '.core.') AS out FROM m), seeds AS (SELECT DISTINCT src AS id FROM pairs WHERE src IN {ENDPOINTS}), walk AS (SELECT id AS root, id, 0 AS depth FROM seeds UNION SELECT w.root, p.dst, w.depth + 1 FROM walk w JOIN pairs p ON p.src = w.id JOIN k ON k.id = p.dst AND NOT coalesce(k.out, false) WHERE w.depth < 3), n AS (SELECT root, id, min(depth) AS depth FROM walk GROUP BY ALL) SELECT n.root, n.id, k.signature, n.depth, k.tier FROM n JOIN k ON k.id = n.id")
def flow_mind_map(spark: SparkSession, folder: str) -> DataFrame:
    e, m = edges_of(spark, folder), one_per_method(t(spark, folder, "methods"))
    return reports.mind_map(m, e, endpoints_of(spark, folder, e), 3, config={"package_contains": (".core.",)})


@query("WITH " + EDGES + ", s AS (SELECT id, lower(trim(min(caller_method_id))) AS src, min(callee_name) AS call, min(resolution_reason) AS reason FROM callsites GROUP BY id) SELECT src, call, reason, count(*) AS n FROM s WHERE id NOT IN (SELECT callsite_id FROM edges) GROUP BY ALL")
def flow_uncertain_edges(spark: SparkSession, folder: str) -> DataFrame:
    return reports.uncertain_edges(sites_of(spark, folder))


@query("WITH " + EDGES + ", s AS (SELECT id, lower(trim(min(caller_method_id))) AS src, min(callee_name) AS call, min(resolution_reason) AS reason FROM callsites GROUP BY id), g AS (SELECT coalesce(call, 'unknown') AS call, coalesce(reason, 'unknown') AS reason, count(*) AS n FROM s WHERE id NOT IN (SELECT callsite_id FROM edges) GROUP BY ALL) SELECT call, reason, n, (SELECT sum(n) FROM g) AS total, greatest(0, (SELECT count(*) FROM g) - 8) AS omitted FROM g ORDER BY n DESC, call, reason LIMIT 8")
def flow_uncertain_summary(spark: SparkSession, folder: str) -> DataFrame:
    return reports.uncertain_summary(reports.uncertain_edges(sites_of(spark, folder)))


@query("WITH RECURSIVE " + PAIRS + ", " + METHODS + ", " + NODES + f", r AS (SELECT min(src) AS id FROM pairs WHERE src IN {ENDPOINTS}), q AS (SELECT id FROM nodes WHERE id <> (SELECT id FROM r) ORDER BY CASE tier WHEN 'primary' THEN 0 WHEN 'supporting' THEN 1 WHEN 'utility' THEN 2 ELSE 3 END, rank DESC, signature, id LIMIT 8), walk AS (SELECT 'root' AS section, id, 0 AS depth FROM r UNION ALL SELECT id, id, 0 FROM q UNION ALL SELECT w.section, p.dst, w.depth + 1 FROM walk w JOIN pairs p ON p.src = w.id WHERE w.depth < 2) SELECT section, id, min(depth) AS depth FROM walk GROUP BY ALL")
def flow_document(spark: SparkSession, folder: str) -> DataFrame:
    e = cut(edges_of(spark, folder))
    root = endpoints_of(spark, folder, e).agg(F.min("id")).first()[0]
    return reports.flow_document(nodes_of(spark, folder), e, root, utilities=True)


@query("WITH " + EDGES + ", " + METHODS + ", c AS (SELECT id, lower(trim(min(caller_method_id))) AS caller, min(line) AS line FROM callsites GROUP BY id), k AS (SELECT callsite_id, dst FROM edges GROUP BY ALL) SELECT c.caller, k.dst AS target, m.signature, count(*) AS times, array_to_string(list_sort(list(DISTINCT c.line)), ',') AS lines, regexp_matches(lower(coalesce(m.signature, '')), '\\.metrics\\.|\\.utils\\.|\\.constants\\.|\\.datadog\\.|\\.logging\\.|\\.log\\.') AS noisy FROM c JOIN k ON k.callsite_id = c.id JOIN m ON m.id = k.dst GROUP BY ALL")
def flow_method_context(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    return reports.method_context(sites_of(spark, folder), m).withColumn("lines", F.array_join("lines", ","))


# ---------------------------------------------------------------- roll-ups


@query("SELECT count(*) AS total, count(*) FILTER (NOT starts_with(coalesce(resolution_status, ''), 'unresolved')) AS resolved, count(*) FILTER (starts_with(coalesce(resolution_status, ''), 'unresolved')) AS unresolved, count(*) FILTER (starts_with(resolution_reason, 'second-pass')) AS second_pass, count(*) FILTER (resolution_status = 'resolved_impl_suffix') AS impl_suffix, count(*) FILTER (resolution_status = 'resolved_cha') AS cha FROM callsites")
def agg_resolution_counts(spark: SparkSession, folder: str) -> DataFrame:
    return reports.resolution_counts(t(spark, folder, "callsites"))


@query("SELECT count(DISTINCT source_path) AS sources, count(*) AS chunks FROM doc_chunks")
def agg_distinct_sources(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "doc_chunks").agg(F.count_distinct("source_path").alias("sources"), F.count("*").alias("chunks"))


_CASES = "cases AS (SELECT o_orderpriority AS repo, CASE WHEN o_custkey % 7 = 0 THEN 'only_in_a' WHEN o_custkey % 3 = 0 THEN 'a' WHEN o_custkey % 3 = 1 THEN 'b' ELSE 'tie' END AS winner, o_custkey % 2 = 0 AS a_pass, o_orderkey % 3 = 0 AS b_pass, (o_custkey % 10) / 10.0 AS a_recall, (o_orderkey % 10) / 10.0 AS b_recall, CASE WHEN o_custkey % 5 < 2 THEN 'search' WHEN o_custkey % 5 = 2 THEN 'explore' ELSE 'other' END AS tool FROM orders)"


def cases_of(spark: SparkSession, folder: str) -> DataFrame:
    o = t(spark, folder, "orders")
    return o.selectExpr("o_orderpriority as repo", "case when o_custkey % 7 = 0 then 'only_in_a' when o_custkey % 3 = 0 then 'a' when o_custkey % 3 = 1 then 'b' else 'tie' end as winner", "o_custkey % 2 = 0 as a_pass", "o_orderkey % 3 = 0 as b_pass", "(o_custkey % 10) / 10.0D as a_recall", "(o_orderkey % 10) / 10.0D as b_recall", "case when o_custkey % 5 < 2 then 'search' when o_custkey % 5 = 2 then 'explore' else 'other' end as tool")


@query(f"WITH {_CASES} SELECT repo, count(*) AS total, count(*) FILTER (a_pass) AS a_passed, count(*) FILTER (b_pass) AS b_passed, round(avg(CAST(a_recall AS DOUBLE)), 4) AS a_mean_recall, round(avg(CAST(b_recall AS DOUBLE)), 4) AS b_mean_recall, count(*) FILTER (winner = 'a') AS a_wins, count(*) FILTER (winner = 'b') AS b_wins, count(*) FILTER (winner = 'tie') AS ties FROM cases WHERE repo <> '' AND winner IN ('a', 'b', 'tie') GROUP BY repo")
def agg_repository_scores(spark: SparkSession, folder: str) -> DataFrame:
    return reports.repository_scores(cases_of(spark, folder))


@query(f"WITH {_CASES} SELECT repo, count(*) AS total, round(avg(CAST(a_pass AS DOUBLE)), 6) AS pass_rate, round(avg(CAST(a_recall AS DOUBLE)), 6) AS mean_recall, round(coalesce(avg(CAST(b_recall AS DOUBLE)) FILTER (tool = 'search'), 0), 6) AS mean_mrr, round(coalesce(avg(CAST(a_recall AS DOUBLE)) FILTER (tool = 'explore'), 0), 6) AS explore_recall FROM cases GROUP BY repo")
def agg_conditional_means(spark: SparkSession, folder: str) -> DataFrame:
    c = cases_of(spark, folder).withColumns({"passed": F.col("a_pass"), "recall": F.col("a_recall"), "mrr": F.col("b_recall")})
    out = reports.conditional_means(c)
    return out.select("repo", "total", *(F.round(x, 6).alias(x) for x in out.columns[2:]))


@query("SELECT language, count(*) AS n FROM classes GROUP BY language UNION ALL SELECT language || '/methods', count(*) FROM methods GROUP BY language")
def set_merged_graphs(spark: SparkSession, folder: str) -> DataFrame:
    """The tables of one graph, parted by language and merged again."""
    c, m = t(spark, folder, "classes", "methods")
    java = lambda df: F.coalesce(df["language"] == "java", F.lit(False))
    whole = reports.merged_graphs({"classes": c.filter(java(c)), "methods": m.filter(java(m))}, {"classes": c.filter(~java(c)).drop("deleted_at"), "methods": m.filter(~java(m))})
    n = lambda df, name: df.groupBy(name.alias("language")).agg(F.count("*").alias("n"))
    return n(whole["classes"], F.col("language")).unionByName(n(whole["methods"], F.concat("language", F.lit("/methods"))))


@query("SELECT event_id, event_type, CASE WHEN event_id = (SELECT event_id FROM events WHERE event_type = 'click' ORDER BY ts DESC, event_id DESC LIMIT 1) THEN -1.0 ELSE value END AS value FROM events")
def window_updated_event(spark: SparkSession, folder: str) -> DataFrame:
    e = t(spark, folder, "events").selectExpr("event_id as id", "event_type as kind", "ts", "value")
    return reports.updated_event(e, "click", {"value": F.lit(-1.0)}).select(F.col("id").alias("event_id"), F.col("kind").alias("event_type"), "value")


# ---------------------------------------------------------------- resolution


@query()
def resolve_full(spark: SparkSession, folder: str) -> DataFrame:
    """The whole cascade with all its passes."""
    m, c, s = t(spark, folder, "methods", "classes", "callsites")
    methods = m.groupBy("id").agg(*(F.min(x).alias(x) for x in ("class_full_name", "method_name", "parameter_types", "parameter_names", "return_type")), F.max_by("local_variable_types", "indexed_at").alias("local_variable_types"))
    calls = calls_of(s).join(s.groupBy(F.col("id").alias("callsite_id")).agg(F.min("file_path").alias("file_path")), "callsite_id")
    return resolve.resolve_all(calls, methods, c, cg.inheritance_edges(c)).select("callsite_id", "status", F.array_join("candidates", ",").alias("candidates"))


_OWN = f"{BY_ID}, cl AS (SELECT DISTINCT full_name, split_part(full_name, '.', -1) AS short FROM classes WHERE full_name IS NOT NULL), ks AS (SELECT c.id, min(c.callee_name) AS call, min(c.receiver) AS receiver, min(c.receiver_type_raw) AS ty, min(c.caller_method_id) AS caller FROM callsites c GROUP BY c.id), kc AS (SELECT k.*, m.class_full_name AS own FROM ks k LEFT JOIN mi m ON m.id = k.caller)"


@query(f"""WITH {_OWN}, x AS (SELECT id, CASE WHEN receiver = 'this' THEN own ELSE nullif(trim(regexp_replace(ty, '<.*$|\\[.*$|\\?$', '', 'g')), '') END AS t, call, receiver, own FROM kc),
h AS (SELECT x.id, m.id AS mid FROM x JOIN mi m ON m.class_full_name = x.own AND m.method_name = x.call WHERE x.receiver IS NULL UNION SELECT x.id, m.id FROM x JOIN cl ON cl.short = split_part(x.t, '.', -1) JOIN mi m ON m.class_full_name = cl.full_name AND m.method_name = x.call WHERE x.receiver IS NOT NULL AND x.t IS NOT NULL),
g AS (SELECT id, array_to_string(list_sort(list(DISTINCT mid)), ',') AS c, count(DISTINCT mid) AS n FROM h GROUP BY 1)
SELECT x.id AS callsite_id, CASE WHEN n = 1 THEN 'resolved_exact' WHEN n > 1 THEN 'resolved_ambiguous' ELSE 'unresolved' END AS status, coalesce(g.c, '') AS candidates FROM x LEFT JOIN g USING (id)""")
def resolve_by_owner(spark: SparkSession, folder: str) -> DataFrame:
    m, c, s = t(spark, folder, "methods", "classes", "callsites")
    methods = methods_by_id(m)
    own = methods.select(F.col("id").alias("caller_method_id"), F.col("class_full_name").alias("caller_class"))
    calls = calls_of(s).join(own, "caller_method_id", "left")
    return resolve.owner_cascade(calls, methods, c.filter("full_name is not null")).select("callsite_id", "status", joined("candidates"))


@query()
def resolve_embedded(spark: SparkSession, folder: str) -> DataFrame:
    """The cascade of languages with embedding, parents taken as embedded."""
    m, c, s = t(spark, folder, "methods", "classes", "callsites")
    own = m.join(c.select(F.col("full_name").alias("class_full_name"), "package_name").dropDuplicates(["class_full_name"]), "class_full_name").groupBy(F.col("id").alias("caller_method_id")).agg(F.min("package_name").alias("package_name"))
    calls = calls_of(s).join(own, "caller_method_id", "left")
    return resolve.embedded_cascade(calls, methods_by_id(m), c, cg.inheritance_edges(c).select("source", "target")).select("callsite_id", "status", joined("candidates"))


_MANAGED = "len(list_filter(annotations, lambda a: list_contains(['Service','Repository','Controller','RestController','Component','Configuration','Entity'], split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1)))) > 0"


@query(f"SELECT DISTINCT full_name FROM classes WHERE {_MANAGED} AND full_name IS NOT NULL UNION SELECT return_type FROM methods WHERE len(list_filter(annotations, lambda a: split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1) = 'Bean')) > 0 AND coalesce(return_type, 'void') NOT IN ('void', '') AND class_full_name IN (SELECT full_name FROM classes WHERE len(list_filter(annotations, lambda a: split_part(split_part(ltrim(a, '@[ '), '(', 1), '.', -1) = 'Configuration')) > 0)")
def resolve_static_beans(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    return resolve.static_beans(c, m)


_PHANTOM = "WITH " + EDGES + ", ph AS (SELECT DISTINCT m.id FROM methods m WHERE m.class_full_name IN (SELECT full_name FROM classes WHERE len(list_filter(annotations, lambda a: list_contains(['Service','Component','Repository','Controller','RestController','Configuration'], regexp_extract(a, '^[@\\[]?(?:[\\w.]*\\.)?(\\w+)', 1)))) > 0 AND full_name NOT LIKE '%Service')), st AS (SELECT id, min(resolution_status) AS status, min(receiver_type) AS type FROM callsites GROUP BY id), gone AS (SELECT callsite_id FROM edges GROUP BY 1 HAVING bool_and(dst IN (SELECT id FROM ph))), kept AS (SELECT id AS callsite_id, CASE WHEN status = 'unresolved_receiver' AND type IN (SELECT full_name FROM classes WHERE full_name LIKE '%Service') THEN 'actuator_resolved' ELSE status END AS status FROM st WHERE id NOT IN (SELECT callsite_id FROM gone)) "


def _phantoms(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    m, c, s = t(spark, folder, "methods", "classes", "callsites")
    sure = c.filter("full_name like '%Service'").select("full_name").distinct()
    flagged = resolve.phantom_edges(edges_of(spark, folder), m, c, sure)
    state = s.groupBy(F.col("id").alias("callsite_id")).agg(F.min("resolution_status").alias("status"), F.min("receiver_type").alias("type"))
    to = edges_of(spark, folder).groupBy("callsite_id").agg(F.collect_set("dst").alias("candidates"))
    return c, sure, flagged, state.join(to, "callsite_id", "left")


@query(_PHANTOM + "SELECT * FROM kept")
def resolve_without_phantoms(spark: SparkSession, folder: str) -> DataFrame:
    _, sure, flagged, calls = _phantoms(spark, folder)
    return resolve.without_phantoms(calls, flagged.filter("phantom"), sure)


@query(_PHANTOM + "SELECT (SELECT count(DISTINCT full_name) FROM classes) + (SELECT CAST(count(*) > count(full_name) AS INT) FROM classes) AS classes, (SELECT count(DISTINCT full_name) FROM classes WHERE full_name LIKE '%Service') AS beans, (SELECT count(*) FROM edges) AS edges_before, (SELECT count(*) FROM edges WHERE dst NOT IN (SELECT id FROM ph)) AS edges_after, (SELECT count(*) FROM edges WHERE dst IN (SELECT id FROM ph)) AS edges_removed, (SELECT count(*) FROM gone) AS callsites_dropped, (SELECT count(*) FROM kept WHERE status = 'actuator_resolved') AS callsites_upgraded")
def agg_validation_report(spark: SparkSession, folder: str) -> DataFrame:
    c, sure, flagged, calls = _phantoms(spark, folder)
    after = cut(resolve.without_phantoms(calls, flagged.filter("phantom"), sure))
    return reports.validation_report(c, sure, flagged, after, calls, after)


@query("WITH m AS (SELECT id, min(module_id) AS mod FROM methods GROUP BY id), " + EDGES + ", e AS (SELECT e.callsite_id, e.src, e.dst, a.mod AS a, b.mod AS b FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst), imp AS (SELECT DISTINCT a.mod AS src, b.mod AS dst FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst WHERE a.mod LIKE '%core' AND b.mod IS NOT NULL AND a.mod <> b.mod) SELECT callsite_id, src, dst FROM e WHERE a IS NOT DISTINCT FROM b OR EXISTS (SELECT 1 FROM imp i WHERE i.src = e.a AND i.dst = e.b) OR EXISTS (SELECT 1 FROM imp i JOIN imp j ON j.src = i.dst WHERE i.src = e.a AND j.dst = e.b) OR EXISTS (SELECT 1 FROM imp i JOIN imp j ON j.src = i.dst JOIN imp k ON k.src = j.dst WHERE i.src = e.a AND k.dst = e.b)")
def resolve_reachable(spark: SparkSession, folder: str) -> DataFrame:
    """Calls within a module or into one that it imports; the imports of the core modules are those that their calls show."""
    m = t(spark, folder, "methods").groupBy("id").agg(F.min("module_id").alias("module_id"))
    e = edges_of(spark, folder)
    full = e.join(m.select(F.col("id").alias("src"), F.col("module_id").alias("a")), "src").join(m.select(F.col("id").alias("dst"), F.col("module_id").alias("b")), "dst")
    imports = full.filter("a like '%core' and b is not null and a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct()
    return resolve.reachable_imports(e, m, imports).select("callsite_id", "src", "dst")


# ---------------------------------------------------------------- search over the stored index

_indexes: dict[tuple[str, str, str], index.Index] = {}


def index_of(spark: SparkSession, folder: str, kind: str) -> index.Index:
    """The index of methods, classes or chunks of a folder, built once for each application."""
    key = (spark.sparkContext.applicationId, folder, kind)
    if key not in _indexes:
        if kind == "methods":
            _indexes[key] = index.Index.build(one_per_method(t(spark, folder, "methods")), "id", search.METHOD_COLUMNS)
        elif kind == "classes":
            _indexes[key] = index.Index.build(class_table(spark, folder), "id", index.CLASS_COLUMNS)
        else:
            _indexes[key] = index.Index.build(chunk_table(spark, folder), "id", ("title", "content", "linked_classes"))
    return _indexes[key]


def class_table(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "classes").groupBy("id").agg(*(F.min(x).alias(x) for x in ("name", "full_name", "package_name", "file_path")))


def chunk_table(spark: SparkSession, folder: str) -> DataFrame:
    return t(spark, folder, "doc_chunks").groupBy("id").agg(*(F.min(x).alias(x) for x in ("title", "content", "linked_classes")))


def _tokens(c: str) -> str:
    return f"list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


_DOCS = "d AS (SELECT id, " + ", ".join(f"{_tokens(c)} AS {k}" for c, k in zip(search.METHOD_COLUMNS, "nscb", strict=True)) + " FROM (SELECT id, min(file_path) AS file_path, min(method_name) AS method_name, min(class_full_name) AS class_full_name, min(signature) AS signature, max(coalesce(source, '')) AS source FROM methods GROUP BY id))"


@query(f"WITH {_DOCS}, w AS (SELECT id, unnest(list_concat(list_concat(n, s), list_concat(c, b))) AS term FROM d) SELECT term, count(DISTINCT id) AS documents, count(*) AS occurrences FROM w GROUP BY term")
def search_index(spark: SparkSession, folder: str) -> DataFrame:
    """The index' terms with their documents and occurrences."""
    ix = index_of(spark, folder, "methods")
    every = sum((F.col(c) for c in ix.columns[1:]), F.col(ix.columns[0]))
    return ix.postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum(every).alias("occurrences"))


def _identifier(term: str) -> str:
    idf = lambda k: f"CASE WHEN ln((nn - {k} + 0.5) / ({k} + 0.5)) > 0 THEN ln((nn - {k} + 0.5) / ({k} + 0.5)) ELSE 1e-6 END"
    part = lambda f, i: f"{i} * {f} * 2.2 / ({f} + 1.2 * (0.25 + 0.75 * l / av))"
    return f"""WITH {_DOCS},
f AS (SELECT id, len(n) + len(s) + len(c) + len(b) AS l, 10.0 * len(list_filter(n, lambda x: x = '{term}')) AS w, CAST(len(list_filter(list_concat(list_concat(n, s), list_concat(c, b)), lambda x: starts_with(x, '{term}'))) AS DOUBLE) AS p FROM d),
z AS (SELECT count(*) AS nn, avg(l) AS av, count(*) FILTER (w > 0) AS hw, count(*) FILTER (p > 0) AS hp FROM f),
i AS (SELECT *, {idf('hw')} AS iw, {idf('hp')} AS ip FROM z)
SELECT id, 'method' AS kind, round(CASE WHEN w > 0 THEN -({part('w', 'iw')}) - 1000.0 ELSE -({part('p', 'ip')}) END, 6) AS score, CASE WHEN w > 0 THEN 'name' ELSE 'text' END AS bucket FROM f, i WHERE w > 0 OR p > 0"""


@query(_identifier("archive"))
def search_identifier(spark: SparkSession, folder: str) -> DataFrame:
    return index.hits(index_of(spark, folder, "methods"), None, "archive").select("id", "kind", F.round("score", 6).alias("score"), "bucket")


@query(f"""WITH d AS (SELECT id, {_tokens('name')} AS n, {_tokens('full_name')} AS f, {_tokens('package_name')} AS p FROM (SELECT id, min(name) AS name, min(full_name) AS full_name, min(package_name) AS package_name FROM classes GROUP BY id)), q AS (SELECT (SELECT n[1] FROM d WHERE len(n) > 0 ORDER BY n[1] LIMIT 1) AS t),
f AS (SELECT id, len(n) + len(f) + len(p) AS l, 10.0 * len(list_filter(n, lambda x: x = t)) AS w FROM d, q), z AS (SELECT count(*) AS nn, avg(l) AS av, count(*) FILTER (w > 0) AS h FROM f), i AS (SELECT *, CASE WHEN ln((nn - h + 0.5) / (h + 0.5)) > 0 THEN ln((nn - h + 0.5) / (h + 0.5)) ELSE 1e-6 END AS i FROM z) SELECT id, round(-(i * w * 2.2 / (w + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM f, i WHERE w > 0""")
def search_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Classes by the first of all names."""
    ix = index_of(spark, folder, "classes")
    first = ix.postings.filter("name > 0").agg(F.min("term")).first()[0]
    return index.class_hits(ix, first or "x").withColumn("score", F.round("score", 6))


@query()
def search_plain(spark: SparkSession, folder: str) -> DataFrame:
    """A question in plain language."""
    return index.hits(index_of(spark, folder, "methods"), None, "how does the worker archive an invoice").withColumn("score", F.round("score", 6))


@query()
def search_answer(spark: SparkSession, folder: str) -> DataFrame:
    """A search as users call it."""
    m = one_per_method(t(spark, folder, "methods"))
    e = edges_of(spark, folder)
    callers = e.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("callers"))
    return index.answered(index_of(spark, folder, "methods"), index_of(spark, folder, "classes"), m, class_table(spark, folder), e, "archiveInvoice", callers=callers)


@query()
def search_explore(spark: SparkSession, folder: str) -> DataFrame:
    m = one_per_method(t(spark, folder, "methods"))
    return index.explored(index_of(spark, folder, "methods"), m, edges_of(spark, folder), "how does the worker archive an invoice")


@query(f"""WITH d AS (SELECT id, list_concat(list_concat({_tokens('title')}, {_tokens('content')}), {_tokens('linked_classes')}) AS w FROM (SELECT id, min(title) AS title, min(content) AS content, min(linked_classes) AS linked_classes FROM doc_chunks GROUP BY id)), f AS (SELECT id, len(w) AS l, CAST(len(list_filter(w, lambda x: starts_with(x, 'invoice'))) AS DOUBLE) AS a FROM d),
z AS (SELECT count(*) AS nn, avg(l) AS av, count(*) FILTER (a > 0) AS h FROM f), i AS (SELECT *, CASE WHEN ln((nn - h + 0.5) / (h + 0.5)) > 0 THEN ln((nn - h + 0.5) / (h + 0.5)) ELSE 1e-6 END AS i FROM z) SELECT id, round(-(i * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / av))), 6) AS score FROM f, i WHERE a > 0""")
def search_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return index.chunk_hits(index_of(spark, folder, "chunks"), "invoice").withColumn("score", F.round("score", 6))


@query("WITH l AS (SELECT id, unnest(string_split(coalesce(linked_classes, ''), ',')) AS n FROM doc_chunks), k AS (SELECT id, trim(n) AS n FROM l), top AS (SELECT n FROM k WHERE n <> '' GROUP BY n ORDER BY count(DISTINCT id) DESC, n LIMIT 1) SELECT DISTINCT id, CASE WHEN id IN (SELECT id FROM k WHERE n = (SELECT n FROM top)) THEN 0 ELSE 1 END AS bucket FROM doc_chunks WHERE id IN (SELECT id FROM k WHERE n = (SELECT n FROM top)) OR id IN (SELECT id FROM (SELECT id, list_concat(list_concat(" + _tokens("min(title)") + ", " + _tokens("min(content)") + "), " + _tokens("min(linked_classes)") + ") AS w FROM doc_chunks GROUP BY id) WHERE len(list_filter(w, lambda x: starts_with(x, 'invoice'))) > 0)")
def docs_merged_hits(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks linked to the class that most chunks name, then those found by text."""
    chunks = t(spark, folder, "doc_chunks")
    top = docs.linked(chunks).groupBy("name").agg(F.count_distinct("id").alias("n")).orderBy(F.desc("n"), "name").first()
    linked = docs.docs_for(chunks, top["name"] if top else "").select("id")
    return docs.merged_hits(linked, index.chunk_hits(index_of(spark, folder, "chunks"), "invoice")).select("id", "bucket")


@query("SELECT 0 AS differences")
def search_index_sync(spark: SparkSession, folder: str) -> DataFrame:
    """The index after all generated methods were edited and the deleted ones left, held against one built anew: no difference."""
    whole = t(spark, folder, "methods")
    m = one_per_method(whole)
    flags = whole.groupBy("id").agg(F.coalesce(F.max("generated"), F.lit(False)).alias("edited"), F.max("deleted_at").isNotNull().alias("gone"))
    j = m.join(flags, "id")
    now = j.withColumn("source", F.when(F.col("edited"), F.concat("source", F.lit(" edited since"))).otherwise(F.col("source"))).filter("not gone").select(*m.columns)
    ix = index_of(spark, folder, "methods").synced(now, "id", j.filter("edited or gone").select("id"))
    return ix.differences(now, "id").agg(F.count("*").alias("differences"))


# ---------------------------------------------------------------- documents and changes


@query("WITH names AS (SELECT name AS n FROM classes WHERE name IS NOT NULL UNION SELECT full_name FROM classes WHERE full_name IS NOT NULL), mn AS (SELECT method_name AS n FROM methods WHERE length(method_name) > 2), tx AS (SELECT DISTINCT id, coalesce(title, '') || ' ' || coalesce(content, '') AS t FROM doc_chunks), f AS (SELECT id, unnest(regexp_extract_all(t, '\\b([a-z][a-z0-9_]*(?:\\.[a-z][a-z0-9_]*)+\\.[A-Z][A-Za-z0-9_]*)\\b', 1)) AS q FROM tx), c AS (SELECT id, unnest(regexp_extract_all(t, '\\b([A-Z][a-zA-Z0-9]{2,})\\b', 1)) AS q FROM tx) SELECT id, split_part(q, '.', -1) AS name FROM f WHERE q IN (SELECT n FROM names) OR split_part(q, '.', -1) IN (SELECT n FROM names) UNION SELECT id, q FROM c WHERE q IN (SELECT n FROM names) OR q IN (SELECT n FROM mn)")
def docs_resource_links(spark: SparkSession, folder: str) -> DataFrame:
    chunks, c, m = t(spark, folder, "doc_chunks", "classes", "methods")
    return docs.resource_links(chunks, c.select("name").union(c.select("full_name")), m.filter(F.length("method_name") > 2).select(F.col("method_name").alias("name")))


@query("WITH o AS (SELECT * FROM methods WHERE indexed_at < TIMESTAMP '2025-01-01' AND file_path IS NOT NULL), n AS (SELECT * FROM methods WHERE file_path IS NOT NULL), del AS (SELECT DISTINCT file_path FROM classes WHERE deleted_at IS NOT NULL AND file_path IS NOT NULL), ch AS (SELECT DISTINCT file_path FROM methods WHERE indexed_at >= TIMESTAMP '2025-01-01' AND file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM del)) SELECT file_path, count(*) AS n FROM (SELECT file_path FROM o WHERE file_path NOT IN (SELECT file_path FROM del) AND file_path NOT IN (SELECT file_path FROM ch) UNION ALL SELECT file_path FROM n WHERE file_path IN (SELECT file_path FROM ch)) GROUP BY file_path")
def change_reindexed(spark: SparkSession, folder: str) -> DataFrame:
    """A graph brought up to date: files deleted since, files changed since, all others kept."""
    m, c = t(spark, folder, "methods", "classes")
    m = m.filter("file_path is not null")
    old = m.filter("indexed_at < timestamp '2025-01-01'")
    deleted = c.filter("deleted_at is not null and file_path is not null").select("file_path").distinct()
    changed = m.filter("indexed_at >= timestamp '2025-01-01'").select("file_path").distinct().join(deleted, "file_path", "left_anti")
    failed = changed.limit(0)
    out = changes.reindexed({"methods": old}, {"methods": m}, changed, deleted, failed)["methods"]
    return out.groupBy("file_path").agg(F.count("*").alias("n"))


@query("WITH f AS (SELECT DISTINCT file_path FROM methods UNION SELECT file_path FROM classes) SELECT DISTINCT file_path FROM classes WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT file_path FROM methods WHERE file_path IS NOT NULL)")
def synth_uncovered(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    return synthesis.uncovered(c.filter("file_path is not null").select("file_path").distinct(), m)


# ---------------------------------------------------------------- parts of other reports


@query("WITH " + INHERITANCE + ", o AS (SELECT DISTINCT c.file_path AS file, i.target, i.relation FROM inh i JOIN classes c ON c.id = i.source_id WHERE c.file_path IS NOT NULL), k AS (SELECT full_name, min(file_path) AS target_file FROM classes WHERE file_path IS NOT NULL GROUP BY 1) SELECT o.*, k.target_file FROM o LEFT JOIN k ON k.full_name = o.target")
def agg_inheritance_dependencies(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    return rollups.inheritance_dependencies(cg.inheritance_edges(c), c)


@query("WITH " + EDGES + ", " + METHODS + ", " + INHERITANCE.strip() + ", k AS (SELECT full_name, min(file_path) AS tf FROM classes WHERE file_path IS NOT NULL GROUP BY 1), x AS (SELECT a.file_path AS file, b.file_path AS f FROM edges e JOIN m a ON a.id = e.src JOIN m b ON b.id = e.dst UNION SELECT c.file_path, k.tf FROM inh i JOIN classes c ON c.id = i.source_id JOIN k ON k.full_name = i.target WHERE c.file_path IS NOT NULL) SELECT file, count(DISTINCT f) AS files FROM x WHERE f IS NOT NULL AND f <> file GROUP BY file")
def agg_dependency_totals(spark: SparkSession, folder: str) -> DataFrame:
    c = t(spark, folder, "classes")
    calls = rollups.file_dependencies(edges_of(spark, folder), one_per_method(t(spark, folder, "methods")))
    return rollups.dependency_totals(calls, rollups.inheritance_dependencies(cg.inheritance_edges(c), c))


@query("SELECT 'parameter_types' AS \"left\", 'parameter_names' AS \"right\", count(*) AS rows, count(*) FILTER (coalesce(len(parameter_types), 0) <> coalesce(len(parameter_names), 0)) AS mismatches FROM methods UNION ALL SELECT 'field_reads', 'field_writes', count(*), count(*) FILTER (coalesce(len(field_reads), 0) <> coalesce(len(field_writes), 0)) FROM methods")
def agg_length_mismatches(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.length_mismatches(t(spark, folder, "methods"), [("parameter_types", "parameter_names"), ("field_reads", "field_writes")])


@query("SELECT resolution_status AS value, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM callsites), 1) AS pct FROM callsites GROUP BY 1")
def agg_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return rollups.histogram(t(spark, folder, "callsites"), "resolution_status")


@query("WITH r AS (SELECT DISTINCT module_id AS query, file_path AS path, split_part(file_path, '/', -1) AS b FROM methods WHERE file_path IS NOT NULL AND module_id IS NOT NULL), w AS (SELECT DISTINCT module_id AS query, file_path AS wanted, split_part(file_path, '/', -1) AS b FROM classes WHERE file_path IS NOT NULL AND module_id IS NOT NULL) SELECT w.query, w.wanted, CASE max(CASE WHEN r.path = w.wanted OR ends_with(r.path, '/' || w.wanted) OR ends_with(w.wanted, '/' || r.path) THEN 2 WHEN r.path IS NOT NULL THEN 1 ELSE 0 END) WHEN 2 THEN 'path' WHEN 1 THEN 'basename' ELSE 'none' END AS hit FROM w LEFT JOIN r ON r.query = w.query AND r.b = w.b GROUP BY w.query, w.wanted")
def agg_file_hits(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    of = lambda df: df.filter("file_path is not null and module_id is not null").select(F.col("module_id").alias("query"), F.col("file_path").alias("path"))
    return rollups.file_hits(of(m), of(c))


@query("WITH " + EDGES + ", f AS (SELECT DISTINCT file_path FROM methods WHERE is_endpoint AND file_path IS NOT NULL), o AS (SELECT DISTINCT lower(trim(id)) AS id FROM methods WHERE file_path IN (SELECT file_path FROM f)) SELECT src, callsite_id, dst FROM edges WHERE src IN (SELECT id FROM o)")
def select_edges_of_files(spark: SparkSession, folder: str) -> DataFrame:
    c, m, s = t(spark, folder, "classes", "methods", "callsites")
    return cg.CodeGraph(c, m, s).edges_of_files(m.filter("is_endpoint and file_path is not null"))


@query("WITH h AS (SELECT DISTINCT id, kind, signature, file_path FROM (SELECT id, 'method' AS kind, signature, file_path, annotations FROM methods UNION ALL SELECT id, 'class', full_name, file_path, annotations FROM classes) WHERE len(list_filter(annotations, lambda a: lower(split_part(split_part(ltrim(rtrim(a, ']'), '@[ '), '(', 1), '.', -1)) = 'deprecated')) > 0), n AS (SELECT kind, count(*) AS n FROM h GROUP BY kind) SELECT h.id, h.kind, h.signature, h.file_path, greatest(0, n.n - 10) AS omitted FROM (SELECT * FROM h QUALIFY row_number() OVER (PARTITION BY kind ORDER BY signature NULLS FIRST, id) <= 10) h JOIN n USING (kind)")
def select_annotated_capped(spark: SparkSession, folder: str) -> DataFrame:
    m, c = t(spark, folder, "methods", "classes")
    return cg.capped_by_kind(cut(cg.annotated(m, c, "@Deprecated").distinct()), 10)


@query("WITH RECURSIVE " + EDGES + f", pairs AS (SELECT DISTINCT src, dst FROM edges), c AS (SELECT id, min(line) AS line FROM callsites GROUP BY id), seeds AS (SELECT DISTINCT src AS id FROM pairs WHERE src IN {ENDPOINTS}), walk AS (SELECT id, [id] AS path FROM seeds UNION ALL SELECT p.dst, list_append(w.path, p.dst) FROM walk w JOIN pairs p ON p.src = w.id WHERE len(w.path) <= 3 AND NOT list_contains(w.path, p.dst)), best AS (SELECT id, path FROM walk QUALIFY row_number() OVER (PARTITION BY id ORDER BY len(path), path) = 1), st AS (SELECT id, unnest(range(0, len(path) - 1)) AS step, path FROM best WHERE len(path) > 1), s2 AS (SELECT id, step, path[step + 1] AS src, path[step + 2] AS dst FROM st), f AS (SELECT e.src, e.dst, e.callsite_id, c.line FROM edges e JOIN c ON c.id = e.callsite_id QUALIFY row_number() OVER (PARTITION BY e.src, e.dst ORDER BY c.line, e.callsite_id) = 1) SELECT s2.id, s2.step, s2.src, s2.dst, f.callsite_id, f.line FROM s2 LEFT JOIN f ON f.src = s2.src AND f.dst = s2.dst")
def graph_path_edges(spark: SparkSession, folder: str) -> DataFrame:
    """The calls along a shortest path to each method."""
    e = cut(edges_of(spark, folder))
    line = t(spark, folder, "callsites").groupBy(F.col("id").alias("callsite_id")).agg(F.min("line").alias("line"))
    return traversal.path_edges(traversal.shortest_paths(e, endpoints_of(spark, folder, e), 3), e.join(line, "callsite_id"))


@query("SELECT id, strftime(make_timestamp(ts * 1000), '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS ts_iso FROM doc_chunks WHERE ts IS NOT NULL")
def source_iso_times(spark: SparkSession, folder: str) -> DataFrame:
    return store.iso_times(t(spark, folder, "doc_chunks").filter("ts is not null")).select("id", "ts_iso")


@query("WITH p AS (SELECT module_id AS repository, list_sort(list(DISTINCT file_path)) AS paths FROM methods WHERE module_id IS NOT NULL AND file_path IS NOT NULL GROUP BY 1), x AS (SELECT repository, unnest(paths) AS path, generate_subscripts(paths, 1) AS i FROM p) SELECT repository, CAST((i - 1) // 50 AS INT) AS portion, count(*) AS n, min(path) AS first FROM x GROUP BY ALL")
def stream_portions(spark: SparkSession, folder: str) -> DataFrame:
    """The files of each module as one burst of changes, in portions of fifty."""
    m = t(spark, folder, "methods").filter("module_id is not null and file_path is not null")
    burst = m.groupBy(F.col("module_id").alias("repository")).agg(F.lit(0).alias("start"), F.array_sort(F.collect_set("file_path")).alias("paths"))
    return debounce.portions(burst).select("repository", "portion", F.size("paths").alias("n"), F.get("paths", 0).alias("first"))
