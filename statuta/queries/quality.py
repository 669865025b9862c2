"""Data-quality checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.plans import quality as P
from statuta.queries import common as C
from statuta.queries import keywords as KQ
from statuta.queries import trees as TQ
from statuta.session import table


def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.distinct_counts(C.questions(spark, d), C.acts(spark, d), C.keywords(spark, d))


def bad_element_ids(spark: SparkSession, d: str) -> DataFrame:
    return P.bad_element_ids(C.nodes(spark, d))


def dangling_refs(spark: SparkSession, d: str) -> DataFrame:
    return P.questions_without_act(C.questions(spark, d), C.acts(spark, d))


def act_keyword_relations(spark: SparkSession, d: str) -> DataFrame:
    return P.acts_without_keyword_relation(C.acts(spark, d), KQ.relations(spark, d))


def elements_without_vector(spark: SparkSession, d: str) -> DataFrame:
    return P.elements_without_vector(C.nodes(spark, d), C.chunk_rows(spark, d)).select("nro", "node_id")


def vector_keywords_unknown(spark: SparkSession, d: str) -> DataFrame:
    return P.vector_keywords_unknown(C.chunk_rows(spark, d), C.acts(spark, d))


def vector_keywords_first_only(spark: SparkSession, d: str) -> DataFrame:
    """The same check against acts that list their first keyword only, so that it has something to find."""
    acts = C.acts(spark, d).select("nro", F.slice("keywords", 1, 1).alias("keywords"))
    return P.vector_keywords_unknown(C.chunk_rows(spark, d), acts)


def quality_report(spark: SparkSession, d: str) -> DataFrame:
    checks = P.all_checks(
        C.questions(spark, d), C.acts(spark, d), C.nodes(spark, d), KQ.relations(spark, d), C.chunk_rows(spark, d), table(spark, d, "vector_points")
    )
    return P.report(checks)


_OWN = "SELECT DISTINCT nro, k.conceptId AS conceptId, k.instanceOfType AS instanceOfType FROM (SELECT nro, unnest(keywords) AS k FROM cur_a)"
_LOST = f"""{_OWN[:0]}
own AS ({_OWN}),
lackrel AS (SELECT o.conceptId, o.instanceOfType, o.nro FROM own o WHERE NOT EXISTS (
  SELECT 1 FROM rels r WHERE r.conceptId = o.conceptId AND r.instanceOfType = o.instanceOfType AND r.r.nro = o.nro)),
relall AS (SELECT conceptId, instanceOfType, r.nro AS nro, r.relationData.units AS units FROM rels),
badid AS (SELECT nro, node_id, 'space' AS kind FROM node WHERE contains(node_id, ' ')
  UNION ALL SELECT DISTINCT c.nro, c.node_id, 'dangling' FROM (SELECT nro, unnest(e.children) AS node_id FROM node) c
  WHERE NOT EXISTS (SELECT 1 FROM node n WHERE n.nro = c.nro AND n.node_id = c.node_id)),
lostact AS (SELECT DISTINCT qnro AS nro, a.nro AS act FROM rel WHERE a.nro IS NOT NULL AND a.nro NOT IN (SELECT nro FROM cur_a)),
below AS (SELECT nro, root AS node_id FROM leafroot UNION SELECT b.nro, e.child FROM below b JOIN edge e ON e.nro = b.nro AND e.node_id = b.node_id),
covered AS (SELECT DISTINCT act_nro AS nro, unnest(node_ids) AS node_id FROM cur_v),
novec AS (SELECT b.nro, b.node_id FROM below b JOIN node n ON n.nro = b.nro AND n.node_id = b.node_id WHERE NOT contains(coalesce(n.e.text, ''), '(uchylony)')
  AND NOT EXISTS (SELECT 1 FROM covered c WHERE c.nro = b.nro AND c.node_id = b.node_id)),
veck AS (SELECT DISTINCT nro, k.conceptId AS conceptId, k.instanceOfType AS instanceOfType FROM (SELECT act_nro AS nro, unnest(keywords) AS k FROM cur_v)),
unkk AS (SELECT v.* FROM veck v WHERE NOT EXISTS (SELECT 1 FROM own o WHERE o.nro = v.nro AND o.conceptId = v.conceptId AND o.instanceOfType = v.instanceOfType)),
nopoint AS (SELECT act_nro, reconstruct_id FROM cur_v v WHERE NOT EXISTS (
  SELECT 1 FROM vector_points p WHERE p.coll = 'acts' AND p.act_nro = v.act_nro AND p.reconstruct_id = v.reconstruct_id))"""
_ALL = f"WITH RECURSIVE {KQ.REL.replace(' WHERE r.nro IN (SELECT nro FROM cur_a)', '')},{TQ.EDGES},{_LOST}"
_BACK = TQ.QUERIES["backward_references"][1]
_BACK = _BACK[_BACK.index("SELECT DISTINCT nro, node_id, 'self'") :]
_PART = [
    ("whole act as unit", "(SELECT 1 FROM relall WHERE len(list_filter(units, lambda u: u.id = 'all()')) > 0)"),
    ("act keyword without relation", "lackrel"),
    ("unit not found", "(SELECT 1 FROM resolved WHERE resolved IS NULL)"),
    ("bad element id", "badid"),
    ("backward reference", f"({_BACK})"),
    ("question act not found", "lostact"),
    ("element without vector", "novec"),
    ("vector keyword unknown", "unkk"),
    ("vector without point", "nopoint"),
]

QUERIES = {
    "dataset_counts": (
        dataset_counts,
        f"""WITH {C.CUR} SELECT 'question acts' AS what, count(DISTINCT a.nro) AS n FROM rel UNION ALL SELECT 'acts', count(DISTINCT nro) FROM cur_a
UNION ALL SELECT 'question keywords', count(*) FROM (SELECT DISTINCT k.conceptId, k.instanceOfType FROM (SELECT unnest(keywords) AS k FROM cur_q))
UNION ALL SELECT 'keywords', count(*) FROM cur_k""",
    ),
    "bad_element_ids": (bad_element_ids, f"{_ALL} SELECT nro, node_id, kind FROM badid"),
    "dangling_refs": (dangling_refs, f"{_ALL} SELECT nro, act FROM lostact"),
    "act_keyword_relations": (act_keyword_relations, f"{_ALL} SELECT conceptId, instanceOfType, nro FROM lackrel"),
    "elements_without_vector": (elements_without_vector, f"{_ALL} SELECT nro, node_id FROM novec"),
    "vector_keywords_unknown": (vector_keywords_unknown, f"{_ALL} SELECT nro, conceptId, instanceOfType FROM unkk"),
    "vector_keywords_first_only": (
        vector_keywords_first_only,
        f"""WITH {C.CUR} SELECT DISTINCT act_nro AS nro, k.conceptId AS conceptId, k.instanceOfType AS instanceOfType FROM (SELECT act_nro, unnest(keywords) AS k FROM cur_v) v
WHERE NOT EXISTS (SELECT 1 FROM cur_a a WHERE a.nro = v.act_nro AND a.keywords[1].conceptId = v.k.conceptId AND a.keywords[1].instanceOfType = v.k.instanceOfType)""",
    ),
    "quality_report": (
        quality_report,
        f"{_ALL} " + " UNION ALL ".join(f"SELECT '{n}' AS \"check\", count(*) = 0 AS ok, count(*) AS n_bad FROM {t}" for n, t in _PART),
    ),
}
