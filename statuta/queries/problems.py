"""Queries of the core operators for training data: hierarchies (p1) and orphan references (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.entities import act_nodes, current_acts
from statuta.operators.hierarchy import all_descendants, broken_nodes, descendants, hierarchy, with_descendant_counts
from statuta.operators.orphans import citation_orphans, orphan_report
from statuta.session import table


def _hierarchy(spark: SparkSession, d: str) -> DataFrame:
    return hierarchy(act_nodes(current_acts(table(spark, d, "tree_acts"))))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return broken_nodes(act_nodes(current_acts(table(spark, d, "tree_acts"))))


def p1_hierarchy(spark: SparkSession, d: str) -> DataFrame:
    found = with_descendant_counts(_hierarchy(spark, d))
    return found.select(
        "nro", "node_id", "broken", "root", "depth",
        F.array_join("path", "/").alias("path"), "n_descendants",
    )


def p1_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(_hierarchy(spark, d)).withColumn("distance", F.col("distance").cast("long"))


def _whole(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The hierarchy and all pairs by any chain of links, further parents and broken descendants included."""
    nodes = act_nodes(current_acts(table(spark, d, "tree_acts")))
    found = hierarchy(nodes)
    return found, all_descendants(nodes, found)


def p1_all_descendants(spark: SparkSession, d: str) -> DataFrame:
    return _whole(spark, d)[1]


def p1_all_counts(spark: SparkSession, d: str) -> DataFrame:
    found, pairs = _whole(spark, d)
    return with_descendant_counts(found, pairs=pairs).select("nro", "node_id", "broken", "n_descendants")


def _orphans(spark: SparkSession, d: str) -> DataFrame:
    return citation_orphans(table(spark, d, "raw_questions"), table(spark, d, "keywords"), table(spark, d, "tree_acts"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return _orphans(spark, d).select("field", "owner", "act_nro", "ref_id", "reason").distinct()


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    return orphan_report(_orphans(spark, d))


ACT_SQL = """
cur_acts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC) AS rn
                 FROM tree_acts WHERE nro IS NOT NULL) WHERE rn = 1),
act_nodes AS (
  SELECT nro, unnest(map_keys(elements)) AS node_id, unnest(map_values(elements)) AS e,
         unnest(range(CAST(cardinality(elements) AS BIGINT))) AS pos
  FROM cur_acts WHERE elements IS NOT NULL)"""

EDGE_SQL = f"""{ACT_SQL},
links AS (
  SELECT nro, e.parent AS p, node_id AS c, 0 AS rank FROM act_nodes WHERE e.parent IS NOT NULL
  UNION ALL
  SELECT nro, node_id, unnest(e.children), 1 FROM act_nodes),
edges AS (
  SELECT l.nro, l.p, l.c, min(l.rank) AS rank, min(a.pos) AS p_pos
  FROM links l JOIN act_nodes a ON a.nro = l.nro AND a.node_id = l.p JOIN act_nodes b ON b.nro = l.nro AND b.node_id = l.c
  GROUP BY l.nro, l.p, l.c),
above AS (
  SELECT nro, p, c FROM edges
  UNION
  SELECT a.nro, a.p, e.c FROM above a JOIN edges e ON e.nro = a.nro AND e.p = a.c),
looped AS (SELECT DISTINCT nro, p AS node_id FROM above WHERE p = c),
broken AS (
  SELECT nro, node_id FROM looped
  UNION
  SELECT a.nro, a.c FROM above a JOIN looped l ON l.nro = a.nro AND l.node_id = a.p)"""

TREE_SQL = f"""{EDGE_SQL},
first_parent AS (
  SELECT nro, c, p FROM (SELECT *, row_number() OVER (PARTITION BY nro, c ORDER BY rank, p_pos) AS r FROM edges) WHERE r = 1),
sound AS (
  SELECT n.nro, n.node_id, f.p FROM act_nodes n LEFT JOIN first_parent f ON f.nro = n.nro AND f.c = n.node_id
  WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.nro = n.nro AND b.node_id = n.node_id)),
tree AS (
  SELECT nro, node_id, [node_id] AS path FROM sound WHERE p IS NULL
  UNION ALL
  SELECT s.nro, s.node_id, list_append(t.path, s.node_id) FROM tree t JOIN sound s ON s.nro = t.nro AND s.p = t.node_id),
pairs AS (
  SELECT nro, path[i] AS ancestor, node_id AS descendant, len(path) - i AS distance
  FROM (SELECT *, unnest(range(1, len(path))) AS i FROM tree))"""

CITATION_SQL = r"""
cur_acts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC) AS rn
                 FROM tree_acts WHERE nro IS NOT NULL) WHERE rn = 1),
seen AS (SELECT nro, min(fetched_at) AS first_seen FROM tree_acts GROUP BY nro),
keys AS (SELECT nro, unnest(map_keys(elements)) AS node_id FROM cur_acts WHERE elements IS NOT NULL),
cur_q AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC) AS rn
                 FROM raw_questions WHERE nro IS NOT NULL) WHERE rn = 1),
cur_k AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conceptId, instanceOfType ORDER BY fetched_at DESC) AS rn
                 FROM keywords WHERE conceptId IS NOT NULL AND instanceOfType IS NOT NULL) WHERE rn = 1),
qa AS (SELECT CAST(nro AS VARCHAR) AS owner, fetched_at AS cited_at, unnest(relatedActs) AS a FROM cur_q),
refs AS (
  SELECT 'raw_questions' AS tbl, 'relatedact' AS field, owner, a.nro AS act_nro, '' AS ref_id, cited_at FROM qa
  UNION ALL
  SELECT 'raw_questions', 'citation', owner, act_nro, c.id, cited_at
  FROM (SELECT owner, cited_at, a.nro AS act_nro, unnest(a.relationData) AS c FROM qa)
  UNION ALL
  SELECT 'keywords', 'unit', owner, u.nro, u.id, cited_at
  FROM (SELECT owner, cited_at, unnest(r.relationData.units) AS u
        FROM (SELECT concat_ws('_', conceptId, instanceOfType) AS owner, fetched_at AS cited_at, unnest(actRelations) AS r FROM cur_k))),
roman AS (
  SELECT DISTINCT act_nro, ref_id,
         string_split_regex(ref_id, '\([MDCLXVI]+(?:\([^)]*\))?\)') AS outside,
         regexp_extract_all(ref_id, '\(([MDCLXVI]+)(\([^)]*\))?\)', 1) AS digits,
         regexp_extract_all(ref_id, '\(([MDCLXVI]+)(\([^)]*\))?\)', 2) AS inner_part
  FROM refs WHERE field <> 'relatedact' AND ref_id IS NOT NULL AND act_nro IS NOT NULL),
arabic AS (
  SELECT act_nro, ref_id, outside, inner_part, list_transform(digits, lambda s: list_sum(list_transform(range(1, CAST(len(s) AS BIGINT) + 1), lambda i:
     CASE WHEN i < len(s) AND {val}[s[i]] < list_aggregate(list_transform(range(i + 1, i + 2), lambda j: {val}[s[j]]), 'max')
          THEN -{val}[s[i]] ELSE {val}[s[i]] END))) AS nums
  FROM roman),
joined AS (
  SELECT act_nro, ref_id, list_aggregate(list_transform(range(1, CAST(len(outside) AS BIGINT) + 1), lambda i:
     outside[i] || CASE WHEN i <= len(nums) THEN '(' || CAST(nums[i] AS BIGINT) || coalesce(inner_part[i], '') || ')' ELSE '' END), 'string_agg', '') AS t
  FROM arabic),
normal AS (
  SELECT act_nro, ref_id, replace(regexp_replace(lower(t), '(\d+)([a-zA-Z])|([a-zA-Z])(\d+)', '\1\3(\2\4)', 'g'), '@', '') AS norm FROM joined),
ends AS (
  SELECT act_nro, ref_id, 0 AS spelling, unnest(string_split(ref_id, '-')[1:2]) AS end_id FROM normal
  UNION ALL
  SELECT act_nro, ref_id, 1, unnest(string_split(norm, '-')[1:2]) FROM normal),
lost AS (
  SELECT act_nro, ref_id FROM (
    SELECT DISTINCT e.act_nro, e.ref_id, e.spelling FROM ends e
    WHERE NOT EXISTS (SELECT 1 FROM keys k WHERE k.nro = e.act_nro AND k.node_id = e.end_id))
  GROUP BY act_nro, ref_id HAVING count(*) = 2),
whole AS (SELECT act_nro, ref_id FROM normal WHERE norm = 'all()' OR ref_id = 'all()'),
orphans AS (
  SELECT * FROM (
    SELECT r.*, CASE WHEN s.nro IS NULL THEN 'missing' WHEN c.withdrawn_at <= r.cited_at THEN 'deleted'
                     WHEN s.first_seen > r.cited_at THEN 'later'
                     WHEN r.field <> 'relatedact' AND r.ref_id IS NOT NULL AND l.act_nro IS NOT NULL AND w.act_nro IS NULL THEN 'missing' END AS reason
    FROM refs r LEFT JOIN seen s ON s.nro = r.act_nro LEFT JOIN cur_acts c ON c.nro = r.act_nro
    LEFT JOIN lost l ON l.act_nro = r.act_nro AND l.ref_id = r.ref_id
    LEFT JOIN whole w ON w.act_nro = r.act_nro AND w.ref_id = r.ref_id
    WHERE r.act_nro IS NOT NULL) WHERE reason IS NOT NULL)""".replace(
    "{val}", "map {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}"
)

QUERIES = {
    "p1_found": (p1_found, f"WITH RECURSIVE {EDGE_SQL} SELECT nro, node_id FROM broken"),
    "p1_hierarchy": (
        p1_hierarchy,
        f"""WITH RECURSIVE {TREE_SQL}
SELECT t.nro, t.node_id, false AS broken, t.path[1] AS root, CAST(len(t.path) - 1 AS BIGINT) AS depth,
       array_to_string(t.path, '/') AS path, CAST(count(p.descendant) AS BIGINT) AS n_descendants
FROM tree t LEFT JOIN pairs p ON p.nro = t.nro AND p.ancestor = t.node_id GROUP BY ALL
UNION ALL SELECT nro, node_id, true, NULL, NULL, NULL, NULL FROM broken""",
    ),
    "p1_descendants": (
        p1_descendants,
        f"WITH RECURSIVE {TREE_SQL} SELECT nro, ancestor, descendant, CAST(distance AS BIGINT) AS distance FROM pairs",
    ),
    "p1_all_descendants": (
        p1_all_descendants,
        f"""WITH RECURSIVE {EDGE_SQL}
SELECT nro, p AS ancestor, c AS descendant FROM above a
WHERE NOT EXISTS (SELECT 1 FROM broken b WHERE b.nro = a.nro AND b.node_id = a.p)""",
    ),
    "p1_all_counts": (
        p1_all_counts,
        f"""WITH RECURSIVE {EDGE_SQL}
SELECT n.nro, n.node_id, b.node_id IS NOT NULL AS broken,
       CASE WHEN b.node_id IS NULL THEN CAST(count(a.c) AS BIGINT) END AS n_descendants
FROM act_nodes n LEFT JOIN above a ON a.nro = n.nro AND a.p = n.node_id
LEFT JOIN broken b ON b.nro = n.nro AND b.node_id = n.node_id GROUP BY n.nro, n.node_id, b.node_id""",
    ),
    "p5_found": (p5_found, f"WITH {CITATION_SQL} SELECT DISTINCT field, owner, act_nro, ref_id, reason FROM orphans"),
    "p5_report": (
        p5_report,
        f"""WITH {CITATION_SQL}
SELECT tbl, field, strftime(timezone('UTC', cited_at), '%Y-%m') AS month, reason, count(*) AS n, count(DISTINCT owner) AS n_owners
FROM orphans GROUP BY ALL""",
    ),
}
