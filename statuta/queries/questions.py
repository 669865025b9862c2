"""Cleaning of questions and their act and keyword dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import questions as Q
from statuta.queries import common as C


def _clean(spark: SparkSession, d: str) -> DataFrame:
    parsable = C.acts(spark, d).where(F.cardinality("elements") > 0).select("nro")
    return Q.clean_questions(C.questions(spark, d), parsable)


def _flat(df: DataFrame) -> DataFrame:
    """Nested acts as text, for comparison."""
    acts = F.transform("relatedActs", lambda a: F.concat_ws(":", a["nro"], F.array_join(F.transform(a["relationData"], lambda c: c["id"]), ",")))
    return df.select("nro", F.array_join(acts, ";").alias("acts"))


def question_act_filter(spark: SparkSession, d: str) -> DataFrame:
    return _flat(_clean(spark, d))


def act_frequency(spark: SparkSession, d: str) -> DataFrame:
    return Q.act_frequencies(_clean(spark, d)).orderBy(F.desc("n"), "nro")


def frequent_acts_questions(spark: SparkSession, d: str) -> DataFrame:
    return _flat(Q.frequent_only(_clean(spark, d), 3))


def distinct_acts_from_questions(spark: SparkSession, d: str) -> DataFrame:
    return Q.cited_acts(C.questions(spark, d))


def distinct_keyword_pairs(spark: SparkSession, d: str) -> DataFrame:
    return Q.cited_keywords(C.questions(spark, d))


def prefix_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.acts(spark, d).where(~Q.is_amendment(F.col("title"))).select("nro", "title")


def questions_by_keys(spark: SparkSession, d: str) -> DataFrame:
    """Point lookups by a list of keys: the questions that cite the most cited act."""
    top = Q.act_frequencies(C.questions(spark, d)).where("nro IS NOT NULL").orderBy(F.desc("n"), "nro").limit(1)
    cited = C.questions(spark, d).select("nro", "title", F.explode("relatedActs.nro").alias("act"))
    return cited.join(top.select(F.col("nro").alias("act")), "act", "left_semi").select("nro", "title").distinct()


_CLEAN = f"""{C.CUR},
parsable AS (SELECT nro FROM cur_a WHERE elements IS NOT NULL AND cardinality(elements) > 0),
flat AS (
  SELECT r.qnro AS nro, r.apos, r.a.nro AS act, coalesce(array_to_string(list_filter(list_transform(r.a.relationData, lambda c: c.id),
         lambda i: NOT regexp_matches(i, '^(all|ks|dz|roz|tyt)')), ','), '') AS cites
  FROM rel r JOIN cur_q q ON q.nro = r.qnro
  WHERE len(q.keywords) > 0 AND r.a.validity = 'ACTUAL' AND NOT coalesce(starts_with(r.a.title, 'Zmiana ') OR starts_with(r.a.title, 'Zm.: '), false)
    AND r.a.nro IN (SELECT nro FROM parsable)),
freq AS (SELECT act AS nro, count(*) AS n FROM flat GROUP BY act)"""
_TEXT = "SELECT nro, string_agg(act || ':' || cites, ';' ORDER BY apos) AS acts FROM"

QUERIES = {
    "question_act_filter": (question_act_filter, f"WITH {_CLEAN} {_TEXT} flat GROUP BY nro"),
    "act_frequency": (act_frequency, f"WITH {_CLEAN} SELECT nro, n FROM freq ORDER BY n DESC, nro"),
    "frequent_acts_questions": (
        frequent_acts_questions,
        f"WITH {_CLEAN} {_TEXT} (SELECT * FROM flat WHERE act IN (SELECT nro FROM freq WHERE n >= 3)) GROUP BY nro",
    ),
    "distinct_acts_from_questions": (distinct_acts_from_questions, f"WITH {C.CUR} SELECT DISTINCT a.nro AS nro FROM rel WHERE a.nro IS NOT NULL"),
    "distinct_keyword_pairs": (
        distinct_keyword_pairs,
        f"""WITH {C.CUR} SELECT DISTINCT k.conceptId AS conceptId, k.instanceOfType AS instanceOfType FROM (SELECT unnest(keywords) AS k FROM cur_q)
WHERE k.conceptId IS NOT NULL AND k.instanceOfType IS NOT NULL""",
    ),
    "prefix_filter": (
        prefix_filter,
        f"WITH {C.CUR} SELECT nro, title FROM cur_a WHERE title IS NULL OR NOT (starts_with(title, 'Zmiana ') OR starts_with(title, 'Zm.: '))",
    ),
    "questions_by_keys": (
        questions_by_keys,
        f"""WITH {C.CUR}, top AS (SELECT a.nro AS nro FROM rel WHERE a.nro IS NOT NULL GROUP BY a.nro ORDER BY count(*) DESC, a.nro LIMIT 1)
SELECT DISTINCT q.nro, q.title FROM cur_q q JOIN rel r ON r.qnro = q.nro JOIN top t ON t.nro = r.a.nro""",
    ),
}
