"""Keyword relations and element ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions import ids
from statuta.operators import references as K
from statuta.operators.entities import keyword_relations
from statuta.queries import common as C


def relations(spark: SparkSession, d: str) -> DataFrame:
    return K.keyword_rows(keyword_relations(C.keywords(spark, d)))


def restrict_relations(spark: SparkSession, d: str) -> DataFrame:
    return K.restrict_to_acts(relations(spark, d), C.acts(spark, d)).select("conceptId", "instanceOfType", "nro")


def keyword_records(spark: SparkSession, d: str) -> DataFrame:
    """Keywords with the relations to known acts; those without any stay, with an empty list."""
    kept = K.restrict_to_acts(relations(spark, d), C.acts(spark, d))
    records = K.keyword_records(C.keywords(spark, d), kept)
    return records.select("conceptId", "instanceOfType", F.array_join(F.transform("relations", lambda r: r["nro"].cast("string")), ",").alias("acts"))


def add_missing_references(spark: SparkSession, d: str) -> DataFrame:
    return K.missing_references(C.acts(spark, d), C.keywords(spark, d), relations(spark, d))


def resolve_units(spark: SparkSession, d: str) -> DataFrame:
    units = K.unit_rows(K.restrict_to_acts(relations(spark, d), C.acts(spark, d)))
    return K.resolve_units(units, C.nodes(spark, d)).select("conceptId", "instanceOfType", "nro", "unit_id", "resolved").distinct()


def fixed_relations(spark: SparkSession, d: str) -> DataFrame:
    fixed = K.repair_relations(K.restrict_to_acts(relations(spark, d), C.acts(spark, d)), C.nodes(spark, d))
    return fixed.select("conceptId", "instanceOfType", "nro", F.array_join("units", ";").alias("units"))


def unit_resolution_counts(spark: SparkSession, d: str) -> DataFrame:
    units = K.unit_rows(K.restrict_to_acts(relations(spark, d), C.acts(spark, d)))
    r = K.resolve_units(units, C.nodes(spark, d))
    return r.agg(F.count_if(F.col("resolved").isNotNull()).alias("correct"), F.count_if(F.col("resolved").isNull()).alias("incorrect"))


def id_normalise(spark: SparkSession, d: str) -> DataFrame:
    """Normal forms of all element and unit ids."""
    every = C.nodes(spark, d).select(F.col("node_id").alias("id")).unionByName(K.unit_rows(relations(spark, d)).select(F.col("unit_id").alias("id")))
    return every.where("id IS NOT NULL").distinct().select("id", ids.normal_id(F.col("id")).alias("normal"))


def root_prefix(spark: SparkSession, d: str) -> DataFrame:
    every = C.nodes(spark, d).select(F.col("node_id").alias("id")).distinct()
    return every.select("id", ids.root_id(F.col("id")).alias("root"), F.size(ids.prefixes(F.col("id"))).cast("long").alias("levels"))


_VALUE = "map {'I': 1, 'V': 5, 'X': 10, 'L': 50, 'C': 100, 'D': 500, 'M': 1000}"
_DIGITS = f"""list_sum(list_transform(range(1, CAST(len(s) AS BIGINT) + 1), lambda i: CASE WHEN i < len(s) AND {_VALUE}[s[i]] < {_VALUE}[s[i + 1]]
THEN -{_VALUE}[s[i]] ELSE {_VALUE}[s[i]] END))"""


def normal_sql(source: str, column: str) -> str:
    """SQL tables that give the normal form of ids as ``normal(id, normal)``."""
    return rf"""
ids AS (SELECT DISTINCT {column} AS id FROM {source} WHERE {column} IS NOT NULL),
cuts AS (SELECT id, string_split_regex(id, '\([MDCLXVI]+(?:\([^)]*\))?\)') AS o,
         list_transform(regexp_extract_all(id, '\(([MDCLXVI]+)(\([^)]*\))?\)', 1), lambda s: {_DIGITS}) AS n,
         regexp_extract_all(id, '\(([MDCLXVI]+)(\([^)]*\))?\)', 2) AS i FROM ids),
arab AS (SELECT id, array_to_string(list_transform(range(1, CAST(len(o) AS BIGINT) + 1), lambda j:
         o[j] || CASE WHEN j <= len(n) THEN '(' || CAST(n[j] AS BIGINT) || coalesce(i[j], '') || ')' ELSE '' END), '') AS t FROM cuts),
normal AS (SELECT id, replace(regexp_replace(lower(t), '(\d+)([a-zA-Z])|([a-zA-Z])(\d+)', '\1\3(\2\4)', 'g'), '@', '') AS normal FROM arab)"""


REL = f"""{C.CUR},
rels AS (SELECT conceptId, instanceOfType, r, p FROM (
  SELECT conceptId, instanceOfType, unnest(actRelations) AS r, unnest(range(CAST(len(actRelations) AS BIGINT))) AS p FROM cur_k)
  QUALIFY r.nro IS NOT NULL AND row_number() OVER (PARTITION BY conceptId, instanceOfType, r.nro ORDER BY p DESC) = 1),
relk AS (SELECT conceptId, instanceOfType, r.nro AS nro, r.relationData.units AS units FROM rels WHERE r.nro IN (SELECT nro FROM cur_a)),
unit AS (SELECT conceptId, instanceOfType, nro, u.id AS unit_id, upos FROM (
  SELECT conceptId, instanceOfType, nro, unnest(units) AS u, unnest(range(CAST(len(units) AS BIGINT))) AS upos FROM relk)),{normal_sql('unit', 'unit_id')},
ends AS (
  SELECT u.nro, u.unit_id, 0 AS s, unnest(string_split(u.unit_id, '-')[1:2]) AS e, '' AS full_id FROM (SELECT DISTINCT nro, unit_id FROM unit WHERE unit_id IS NOT NULL) u
  UNION ALL
  SELECT u.nro, u.unit_id, 1, unnest(string_split(n.normal, '-')[1:2]), '' FROM (SELECT DISTINCT nro, unit_id FROM unit) u JOIN normal n ON n.id = u.unit_id),
okay AS (SELECT e.nro, e.unit_id, e.s FROM ends e LEFT JOIN node k ON k.nro = e.nro AND k.node_id = e.e GROUP BY ALL HAVING count(*) = count(k.node_id)),
res AS (SELECT o.nro, o.unit_id, CASE WHEN min(o.s) = 0 THEN o.unit_id ELSE array_to_string(string_split(any_value(n.normal), '-')[1:2], '-') END AS resolved
        FROM okay o JOIN normal n ON n.id = o.unit_id GROUP BY o.nro, o.unit_id),
resolved AS (SELECT u.*, r.resolved FROM unit u LEFT JOIN res r USING (nro, unit_id)),
fixed AS (
  SELECT conceptId, instanceOfType, nro, list(resolved ORDER BY upos) AS units FROM resolved WHERE resolved IS NOT NULL GROUP BY ALL
  UNION ALL SELECT conceptId, instanceOfType, nro, NULL FROM relk WHERE units IS NULL)"""

QUERIES = {
    "restrict_relations": (restrict_relations, f"WITH {REL} SELECT conceptId, instanceOfType, nro FROM relk"),
    "keyword_records": (
        keyword_records,
        f"""WITH {REL} SELECT k.conceptId, k.instanceOfType, coalesce(string_agg(CAST(r.nro AS VARCHAR), ',' ORDER BY r.nro), '') AS acts
FROM cur_k k LEFT JOIN relk r USING (conceptId, instanceOfType) GROUP BY k.conceptId, k.instanceOfType""",
    ),
    "add_missing_references": (
        add_missing_references,
        f"""WITH {REL}
SELECT DISTINCT a.conceptId, a.instanceOfType, a.nro, a.title, a.lawType, 'ACTUAL' AS validity FROM (
  SELECT k.conceptId AS conceptId, k.instanceOfType AS instanceOfType, nro, title, actLawType AS lawType
  FROM (SELECT nro, title, actLawType, unnest(keywords) AS k FROM cur_a)) a
JOIN cur_k c ON c.conceptId = a.conceptId AND c.instanceOfType = a.instanceOfType
WHERE NOT EXISTS (SELECT 1 FROM rels r WHERE r.conceptId = a.conceptId AND r.instanceOfType = a.instanceOfType AND r.r.nro = a.nro)""",
    ),
    "resolve_units": (resolve_units, f"WITH {REL} SELECT DISTINCT conceptId, instanceOfType, nro, unit_id, resolved FROM resolved"),
    "fixed_relations": (fixed_relations, f"WITH {REL} SELECT conceptId, instanceOfType, nro, array_to_string(units, ';') AS units FROM fixed"),
    "unit_resolution_counts": (
        unit_resolution_counts,
        f"WITH {REL} SELECT count(resolved) AS correct, count(*) - count(resolved) AS incorrect FROM resolved",
    ),
    "id_normalise": (
        id_normalise,
        f"""WITH {C.CUR},
allids AS (SELECT node_id AS x FROM node UNION ALL SELECT u.id FROM (SELECT unnest(r.relationData.units) AS u FROM (
  SELECT unnest(actRelations) AS r, conceptId, instanceOfType, unnest(range(CAST(len(actRelations) AS BIGINT))) AS p FROM cur_k)
  QUALIFY r.nro IS NOT NULL AND row_number() OVER (PARTITION BY conceptId, instanceOfType, r.nro ORDER BY p DESC) = 1)),{normal_sql('allids', 'x')}
SELECT id, normal FROM normal""",
    ),
    "root_prefix": (
        root_prefix,
        rf"""WITH {C.CUR} SELECT DISTINCT node_id AS id, coalesce(nullif(regexp_extract(node_id, '^([^()]*\((?:[^()]|\([^()]*\))*\))', 1), ''), node_id) AS root,
len(regexp_extract_all(node_id, '[^()]*\((?:[^()]|\([^()]*\))*\)')) AS levels FROM node""",
    ),
}
