"""Trees of act elements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import references as K
from statuta.operators import trees as T
from statuta.queries import common as C
from statuta.queries import keywords as KQ


def _fixed(spark: SparkSession, d: str) -> DataFrame:
    return K.repair_relations(K.restrict_to_acts(KQ.relations(spark, d), C.acts(spark, d)), C.nodes(spark, d))


def range_reference_resolve(spark: SparkSession, d: str) -> DataFrame:
    """Elements that relations name: whole acts, single elements, and ranges in document order."""
    return T.cited_nodes(_fixed(spark, d), C.nodes(spark, d))


def tree_keyword_propagation(spark: SparkSession, d: str) -> DataFrame:
    return T.propagate_keywords(C.acts(spark, d), _fixed(spark, d), C.nodes(spark, d))


def leaf_roots(spark: SparkSession, d: str) -> DataFrame:
    return T.leaf_roots(C.nodes(spark, d))


def tree_preorder(spark: SparkSession, d: str) -> DataFrame:
    nodes = C.nodes(spark, d)
    found = T.preorder(nodes, T.leaf_roots(nodes))
    return found.select("nro", "root", "node_id", F.col("depth").cast("long").alias("depth"), "branch", F.col("seq").cast("long").alias("seq"))


def backward_references(spark: SparkSession, d: str) -> DataFrame:
    return T.backward_references(C.nodes(spark, d))


def tree_descendants(spark: SparkSession, d: str) -> DataFrame:
    """Distinct nodes below each root through ``children`` links."""
    nodes = C.nodes(spark, d)
    starts = T.leaf_roots(nodes).select("root", "nro", F.col("root").alias("node_id"))
    return T.reachable(starts, T.edges(nodes), ["root"])


EDGES = """
edge AS (SELECT c.nro, c.node_id, c.child, min(c.ord) AS ord FROM (
  SELECT nro, node_id, unnest(e.children) AS child, unnest(range(CAST(len(e.children) AS BIGINT))) AS ord FROM node) c
  JOIN node n ON n.nro = c.nro AND n.node_id = c.child GROUP BY ALL),
leafroot AS (SELECT l.nro, l.root, min(l.pos) AS pos FROM (
  SELECT nro, pos, coalesce(nullif(regexp_extract(node_id, '^([^()]*\\((?:[^()]|\\([^()]*\\))*\\))', 1), ''), node_id) AS root
  FROM node WHERE e.children IS NULL OR len(e.children) = 0) l JOIN node n ON n.nro = l.nro AND n.node_id = l.root GROUP BY l.nro, l.root)"""

_NAMED = f"""{KQ.REL},{EDGES},
spans AS (
  SELECT DISTINCT f.conceptId, f.instanceOfType, f.nro, l.pos AS a, coalesce(r.pos, 9223372036854775807) AS b
  FROM (SELECT conceptId, instanceOfType, nro, unnest(units) AS id FROM fixed WHERE units IS NOT NULL) f
  JOIN node l ON l.nro = f.nro AND l.node_id = string_split(f.id, '-')[1]
  LEFT JOIN node r ON r.nro = f.nro AND r.node_id = string_split(f.id, '-')[-1]),
named AS (
  SELECT DISTINCT f.conceptId, f.instanceOfType, f.nro, n.node_id FROM fixed f JOIN node n ON n.nro = f.nro WHERE f.units IS NULL
  UNION
  SELECT s.conceptId, s.instanceOfType, s.nro, n.node_id FROM spans s JOIN node n ON n.nro = s.nro AND n.pos BETWEEN s.a AND s.b)"""

QUERIES = {
    "range_reference_resolve": (range_reference_resolve, f"WITH {_NAMED} SELECT conceptId, instanceOfType, nro, node_id FROM named"),
    "tree_keyword_propagation": (
        tree_keyword_propagation,
        f"""WITH RECURSIVE {_NAMED},
own AS (SELECT DISTINCT k.conceptId AS conceptId, k.instanceOfType AS instanceOfType, nro FROM (SELECT nro, unnest(keywords) AS k FROM cur_a)),
got AS (
  SELECT n.conceptId, n.instanceOfType, n.nro, n.node_id FROM named n JOIN own o USING (conceptId, instanceOfType, nro)
  UNION
  SELECT g.conceptId, g.instanceOfType, g.nro, e.child FROM got g JOIN edge e ON e.nro = g.nro AND e.node_id = g.node_id)
SELECT conceptId, instanceOfType, nro, node_id FROM got""",
    ),
    "leaf_roots": (leaf_roots, f"WITH {C.CUR},{EDGES} SELECT nro, root, pos FROM leafroot"),
    "tree_preorder": (
        tree_preorder,
        f"""WITH RECURSIVE {C.CUR},{EDGES},
walk AS (
  SELECT nro, root, root AS node_id, CAST(0 AS BIGINT) AS depth, CAST(NULL AS VARCHAR) AS branch, [root] AS path, CAST([] AS BIGINT[]) AS ords FROM leafroot
  UNION ALL
  SELECT w.nro, w.root, e.child, w.depth + 1, coalesce(w.branch, e.child), list_append(w.path, e.child), list_append(w.ords, e.ord)
  FROM walk w JOIN edge e ON e.nro = w.nro AND e.node_id = w.node_id WHERE NOT list_contains(w.path, e.child))
SELECT nro, root, node_id, depth, branch, row_number() OVER (PARTITION BY nro, root ORDER BY ords) - 1 AS seq FROM walk""",
    ),
    "backward_references": (
        backward_references,
        f"""WITH {C.CUR},{EDGES}
SELECT DISTINCT nro, node_id, 'self' AS kind FROM edge WHERE node_id = child
UNION ALL
SELECT DISTINCT a.nro, a.node_id, 'three' FROM edge a JOIN edge b ON b.nro = a.nro AND b.node_id = a.child JOIN edge c ON c.nro = a.nro AND c.node_id = b.child AND c.child = a.node_id
WHERE a.node_id <> a.child AND b.node_id <> b.child""",
    ),
    "tree_descendants": (
        tree_descendants,
        f"""WITH RECURSIVE {C.CUR},{EDGES},
got AS (SELECT root, nro, root AS node_id FROM leafroot UNION SELECT g.root, g.nro, e.child FROM got g JOIN edge e ON e.nro = g.nro AND e.node_id = g.node_id)
SELECT root, nro, node_id FROM got""",
    ),
}
