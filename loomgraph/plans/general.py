"""Queries of the general data problems: orphan references (p3) and hierarchies (p5)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy as h
from ..operators import orphans as o
from ..session import cut
from ..sources.tables import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return o.code_graph_orphans(*(table(spark, folder, t) for t in ("methods", "callsites", "classes")))


def p3_counts(spark: SparkSession, folder: str) -> DataFrame:
    return o.orphan_counts(p3_found(spark, folder))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    tree = h.hierarchy(h.class_links(table(spark, folder, "classes")))
    return tree.select(F.col("node").alias("full_name"), F.col("root").alias("root_name"), "depth")


def p5_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Full path, depth, root and the number of descendants of each class that has a parent, and of each root. Classes
    without an end to their ancestry have an empty root, depth -1, and neither path nor number."""
    tree = cut(h.hierarchy(h.class_links(table(spark, folder, "classes")), paths=True, sizes=True))
    every = tree.select("node", "root", "depth", F.array_join("path", " > ").alias("path"), F.col("below").alias("n"))
    roots = tree.filter("depth > 0").groupBy("root").agg(F.count("*").alias("n")).select(F.col("root").alias("node"), "root", F.lit(0).alias("depth"), F.col("root").alias("path"), "n")
    every = every.unionByName(roots)
    return every.select(F.col("node").alias("full_name"), F.col("root").alias("root_name"), "depth", "path", F.col("n").alias("descendants"))


def p5_descendants(spark: SparkSession, folder: str) -> DataFrame:
    """Each ancestor with each of its descendants."""
    return h.descendants(h.hierarchy(h.class_links(table(spark, folder, "classes")), paths=True))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {q.__name__: q for q in (p3_found, p3_counts, p5_found, p5_paths, p5_descendants)}

_REFS = """
targets AS (
  SELECT 'classes' AS target, lower(trim(id)) AS k, indexed_at, deleted_at FROM classes WHERE indexed_at IS NOT NULL
  UNION ALL SELECT 'methods', lower(trim(id)), indexed_at, deleted_at FROM methods WHERE indexed_at IS NOT NULL),
refs AS (
  SELECT DISTINCT ref_table, ref_field, target, row_id, strftime(seen, '%Y-%m') AS period, date_trunc('month', seen) + INTERVAL 1 MONTH AS stop, lower(trim(v)) AS k FROM (
    SELECT 'methods' AS ref_table, 'class_id' AS ref_field, 'classes' AS target, id AS row_id, indexed_at AS seen, class_id AS v FROM methods
    UNION ALL SELECT 'callsites', 'caller_method_id', 'methods', id, indexed_at, caller_method_id FROM callsites
    UNION ALL SELECT 'callsites', 'resolved_candidates_json', 'methods', id, indexed_at, unnest(CAST(json(resolved_candidates_json) AS VARCHAR[])) FROM callsites WHERE json_valid(resolved_candidates_json) AND json_type(CASE WHEN json_valid(resolved_candidates_json) THEN resolved_candidates_json END) = 'ARRAY')
  WHERE v IS NOT NULL AND trim(v) <> '' AND seen IS NOT NULL),
alive AS (
  SELECT DISTINCT r.target, r.k, r.stop FROM (SELECT DISTINCT target, k, stop FROM refs) r JOIN targets t ON t.target = r.target AND t.k = r.k AND t.indexed_at < r.stop AND (t.deleted_at IS NULL OR t.deleted_at >= r.stop)),
found AS (
  SELECT ref_table, ref_field, row_id, period, k AS missing_id FROM refs r WHERE NOT EXISTS (SELECT 1 FROM alive a WHERE a.target = r.target AND a.k = r.k AND a.stop = r.stop))
"""

_LINKS = r"""
last AS (SELECT * FROM classes WHERE full_name IS NOT NULL QUALIFY row_number() OVER (PARTITION BY full_name ORDER BY indexed_at DESC NULLS LAST, id DESC NULLS LAST, extends DESC NULLS LAST, implements_json DESC NULLS LAST) = 1),
written AS (SELECT full_name, package_name, imports, trim(regexp_extract(CASE WHEN extends IS NOT NULL AND regexp_replace(extends, '\s', '', 'g') <> '' THEN extends ELSE CASE WHEN json_valid(implements_json) THEN json_extract_string(implements_json, '$[0]') END END, '^([^<\[]*)', 1), E' \t\r\n') AS text FROM last),
links AS (
  SELECT w.full_name AS node, CASE WHEN contains(w.text, '.') THEN w.text WHEN l.full_name IS NOT NULL THEN l.full_name ELSE coalesce(list_filter(w.imports, lambda x: ends_with(x, '.' || w.text))[1], w.text) END AS parent
  FROM written w LEFT JOIN last l ON l.full_name = w.package_name || '.' || w.text AND NOT contains(w.text, '.') WHERE w.text IS NOT NULL AND w.text <> ''),
climb AS (
  SELECT node, parent AS up, 1 AS depth FROM links
  UNION ALL SELECT c.node, l.parent, c.depth + 1 FROM climb c JOIN links l ON l.node = c.up WHERE c.depth < (SELECT count(*) + 1 FROM links) AND c.depth < 3000),
tops AS (SELECT node, up AS root, depth FROM climb c WHERE NOT EXISTS (SELECT 1 FROM links l WHERE l.node = c.up))
"""

ORACLE = {
    "p3_found": f"WITH {_REFS} SELECT * FROM found",
    "p3_counts": f"WITH {_REFS} SELECT ref_table, ref_field, period, count(*) AS orphans, count(DISTINCT missing_id) AS missing_ids FROM found GROUP BY ALL",
    "p5_found": f"WITH RECURSIVE {_LINKS} SELECT l.node AS full_name, coalesce(t.root, '') AS root_name, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth FROM links l LEFT JOIN tops t ON t.node = l.node",
    "p5_paths": f"""WITH RECURSIVE {_LINKS},
      ways AS (
        SELECT l.node, l.parent || ' > ' || l.node AS path FROM links l WHERE NOT EXISTS (SELECT 1 FROM links u WHERE u.node = l.parent)
        UNION ALL SELECT l.node, w.path || ' > ' || l.node FROM ways w JOIN links l ON l.parent = w.node),
      below AS (SELECT c.up, count(*) AS n FROM climb c JOIN tops t ON t.node = c.node GROUP BY 1)
      SELECT l.node AS full_name, coalesce(t.root, '') AS root_name, CAST(coalesce(t.depth, -1) AS INTEGER) AS depth, w.path, CASE WHEN t.node IS NOT NULL THEN coalesce(b.n, 0) END AS descendants
      FROM links l LEFT JOIN tops t ON t.node = l.node LEFT JOIN ways w ON w.node = l.node LEFT JOIN below b ON b.up = l.node
      UNION ALL SELECT b.up, b.up, 0, b.up, b.n FROM below b WHERE b.up NOT IN (SELECT node FROM links)""",
    "p5_descendants": f"WITH RECURSIVE {_LINKS} SELECT c.up AS ancestor, c.node AS descendant, c.depth AS distance FROM climb c JOIN tops t ON t.node = c.node",
}
