"""Evaluation of retrieval against citations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from statuta.operators.vector import filtered_topk
from statuta.operators.vptree import vptree_topk
from statuta.plans import evaluate as E
from statuta.queries import common as C
from statuta.session import cut


def eval_eligible(spark: SparkSession, d: str) -> DataFrame:
    return E.eligible(C.questions(spark, d)).select("nro")


def random_sample_5pct(spark: SparkSession, d: str) -> DataFrame:
    return E.sample(E.eligible(C.questions(spark, d))).select("nro")


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Eligible questions with a vector; the query set of the evaluation."""
    vectors = C.question_vectors(spark, d).withColumnRenamed("id", "qid")
    return vectors.join(E.eligible(C.questions(spark, d)).select(F.col("nro").alias("qid"), "relatedActs", "keywords"), "qid")


def _gold_recall(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d)
    allowed = q.select("qid", F.explode("relatedActs.nro").alias("act"))
    wanted = q.where(F.size("keywords") > 0).select("qid", "vector", F.col("keywords.conceptId").alias("concepts"), F.col("keywords.instanceOfType").alias("types"))
    chunks = C.chunks(spark, d)
    hits = filtered_topk(wanted, allowed, chunks, 100, keyword_filter=True)
    gold = E.gold(C.questions(spark, d)).join(q.select("qid"), "qid")
    found = gold.join(E.chunk_cites(hits, chunks), "qid", "left")
    return found.select("qid", E.recall(F.col("cites"), F.coalesce("h_cites", F.array().cast("array<string>"))).alias("recall"))


def gold_filter_recall(spark: SparkSession, d: str) -> DataFrame:
    return _gold_recall(spark, d).withColumn("recall", F.round("recall", 6))


def gold_filter_mean(spark: SparkSession, d: str) -> DataFrame:
    return _gold_recall(spark, d).agg(F.count("recall").alias("n"), F.round(F.avg("recall"), 6).alias("recall"))


def _two_phase_recall(spark: SparkSession, d: str, *filters: bool) -> list[DataFrame]:
    """Recall with the keyword filter or without it; what comes before the filter is computed once for all ``filters``."""
    q = cut(_asked(spark, d).select("qid", "vector"))
    # One more than the seven, of which the question itself is one if it is found.
    near = vptree_topk(q, C.question_vectors(spark, d), 8, 1.0).where("id != qid")
    first = near.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy("rank"))).where("rank <= 7")
    sets = cut(E.found_sets(first, C.questions(spark, d)))
    asked = q.join(sets, "qid")
    allowed = asked.select("qid", F.explode("f_acts").alias("a")).select("qid", F.col("a").cast("long").alias("act"))
    part = lambda i: F.transform("f_pairs", lambda p: F.element_at(F.split(p, r"\|"), i).cast("long"))
    wanted = asked.select("qid", "vector", part(1).alias("concepts"), part(2).alias("types"))
    chunks = C.chunks(spark, d)
    gold = E.gold(C.questions(spark, d)).join(q.select("qid"), "qid").join(sets, "qid", "left")
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))

    def recall(keyword_filter: bool) -> DataFrame:
        hits = filtered_topk(wanted, allowed, chunks, 100, keyword_filter)
        joined = gold.join(E.chunk_cites(hits, chunks), "qid", "left")
        return joined.select(
            "qid", E.recall(F.col("acts"), some("f_acts")).alias("act_recall"), E.recall(F.col("cites"), some("f_cites")).alias("cite_recall"),
            E.recall(F.col("pairs"), some("f_pairs")).alias("keyword_recall"), E.recall(F.col("cites"), some("h_cites")).alias("second_recall"),
            F.size(some("f_acts")).cast("long").alias("n_acts"), F.size(some("f_pairs")).cast("long").alias("n_keywords"),
        )

    return [recall(flag) for flag in filters]


def two_phase_recall(spark: SparkSession, d: str) -> DataFrame:
    names = ["act_recall", "cite_recall", "keyword_recall", "second_recall"]
    return _two_phase_recall(spark, d, True)[0].withColumns({n: F.round(n, 6) for n in names})


def two_phase_means(spark: SparkSession, d: str) -> DataFrame:
    """Macro averages with the keyword filter and without it."""
    out = None
    for flag, found in zip((True, False), _two_phase_recall(spark, d, True, False)):
        rows = found.agg(
            F.lit(flag).alias("keyword_filter"), F.count(F.lit(1)).alias("n"),
            *[F.round(F.avg(c), 6).alias(c) for c in ("act_recall", "cite_recall", "keyword_recall", "second_recall", "n_acts", "n_keywords")],
        )
        out = rows if out is None else out.unionByName(rows)
    return out


_ELIGIBLE = """
elig AS (SELECT * FROM cur_q WHERE relatedActs IS NULL OR len(list_filter(relatedActs, lambda a: a.relationData IS NULL OR len(a.relationData) = 0)) = 0),
asked AS (SELECT e.nro AS qid, v.v, e.relatedActs, e.keywords FROM elig e JOIN qvec v ON v.id = e.nro),
g_act AS (SELECT DISTINCT qnro AS qid, a.nro AS act FROM rel),
g_cite AS (SELECT DISTINCT qid, act || '|' || c.id AS cite FROM (SELECT qnro AS qid, a.nro AS act, unnest(a.relationData) AS c FROM rel) WHERE c.id IS NOT NULL),
g_pair AS (SELECT DISTINCT nro AS qid, k.conceptId AS c, k.instanceOfType AS t FROM (SELECT nro, unnest(keywords) AS k FROM cur_q))"""

_GOLD = f"""{C.VEC},{_ELIGIBLE},
scored AS (
  SELECT q.qid, c.id, c.act, c.node_ids, list_cosine_similarity(q.v, c.v) AS score
  FROM asked q JOIN g_act w USING (qid) JOIN chunk c ON c.act = w.act
  WHERE len(list_filter(c.keywords, lambda k: list_contains(list_transform(q.keywords, lambda x: x.conceptId), k.conceptId)
        AND list_contains(list_transform(q.keywords, lambda x: x.instanceOfType), k.instanceOfType))) > 0),
hit2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 100),
found AS (SELECT DISTINCT qid, act || '|' || n AS cite FROM (SELECT qid, act, unnest(node_ids) AS n FROM hit2)),
per AS (SELECT q.qid, count(f.cite)::DOUBLE / nullif(count(g.cite), 0) AS recall
        FROM asked q LEFT JOIN g_cite g USING (qid) LEFT JOIN found f ON f.qid = g.qid AND f.cite = g.cite GROUP BY q.qid)"""


def _two_sql(flag: bool) -> str:
    condition = (
        """WHERE NOT EXISTS (SELECT 1 FROM f_pair p WHERE p.qid = q.qid) OR len(list_filter(c.keywords, lambda k:
          list_contains(s.cs, k.conceptId) AND list_contains(s.ts, k.instanceOfType))) > 0"""
        if flag
        else ""
    )
    return f"""{C.VEC},{_ELIGIBLE},
s1 AS (SELECT q.qid, c.id, row_number() OVER (PARTITION BY q.qid ORDER BY round(list_cosine_similarity(q.v, c.v), 9) DESC, c.id) AS rank
       FROM asked q, qvec c WHERE c.id <> q.qid),
h1 AS (SELECT qid, id FROM s1 WHERE rank <= 7),
f_act AS (SELECT DISTINCT h.qid, g.act FROM h1 h JOIN g_act g ON g.qid = h.id),
f_cite AS (SELECT DISTINCT h.qid, g.cite FROM h1 h JOIN g_cite g ON g.qid = h.id),
f_pair AS (SELECT DISTINCT h.qid, g.c, g.t FROM h1 h JOIN g_pair g ON g.qid = h.id),
f_set AS (SELECT qid, list(c) AS cs, list(t) AS ts FROM f_pair GROUP BY qid),
scored AS (
  SELECT q.qid, c.id, c.act, c.node_ids, list_cosine_similarity(q.v, c.v) AS score
  FROM asked q JOIN f_act w USING (qid) JOIN chunk c ON c.act = w.act LEFT JOIN f_set s ON s.qid = q.qid {condition}),
hit2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored) WHERE rank <= 100),
h_cite AS (SELECT DISTINCT qid, act || '|' || n AS cite FROM (SELECT qid, act, unnest(node_ids) AS n FROM hit2)),
ra AS (SELECT g.qid, count(f.act)::DOUBLE / count(*) AS r FROM g_act g LEFT JOIN f_act f ON f.qid = g.qid AND f.act = g.act GROUP BY g.qid),
rc AS (SELECT g.qid, count(f.cite)::DOUBLE / count(*) AS r FROM g_cite g LEFT JOIN f_cite f ON f.qid = g.qid AND f.cite = g.cite GROUP BY g.qid),
rk AS (SELECT g.qid, count(f.qid)::DOUBLE / count(*) AS r FROM g_pair g LEFT JOIN f_pair f ON f.qid = g.qid AND f.c = g.c AND f.t = g.t GROUP BY g.qid),
r2 AS (SELECT g.qid, count(f.cite)::DOUBLE / count(*) AS r FROM g_cite g LEFT JOIN h_cite f ON f.qid = g.qid AND f.cite = g.cite GROUP BY g.qid),
na AS (SELECT qid, count(*) AS n FROM f_act GROUP BY qid),
nk AS (SELECT qid, count(*) AS n FROM f_pair GROUP BY qid),
per AS (SELECT q.qid, ra.r AS act_recall, rc.r AS cite_recall, rk.r AS keyword_recall, r2.r AS second_recall,
               coalesce(na.n, 0) AS n_acts, coalesce(nk.n, 0) AS n_keywords
        FROM asked q LEFT JOIN ra USING (qid) LEFT JOIN rc USING (qid) LEFT JOIN rk USING (qid) LEFT JOIN r2 USING (qid)
        LEFT JOIN na USING (qid) LEFT JOIN nk USING (qid))"""


_MEANS = """count(*) AS n, round(avg(act_recall), 6) AS act_recall, round(avg(cite_recall), 6) AS cite_recall, round(avg(keyword_recall), 6) AS keyword_recall,
round(avg(second_recall), 6) AS second_recall, round(avg(n_acts), 6) AS n_acts, round(avg(n_keywords), 6) AS n_keywords FROM per"""

QUERIES = {
    "eval_eligible": (eval_eligible, f"WITH {C.VEC},{_ELIGIBLE} SELECT nro FROM elig"),
    "random_sample_5pct": (
        random_sample_5pct,
        f"""WITH {C.VEC},{_ELIGIBLE},
r AS (SELECT nro, row_number() OVER (ORDER BY md5(CAST(nro AS VARCHAR)), nro) AS r, count(*) OVER () AS n FROM elig)
SELECT nro FROM r WHERE r <= greatest(1, n // 20)""",
    ),
    "gold_filter_recall": (gold_filter_recall, f"WITH {_GOLD} SELECT qid, round(recall, 6) AS recall FROM per"),
    "gold_filter_mean": (gold_filter_mean, f"WITH {_GOLD} SELECT count(recall) AS n, round(avg(recall), 6) AS recall FROM per"),
    "two_phase_recall": (
        two_phase_recall,
        f"""WITH {_two_sql(True)} SELECT qid, round(act_recall, 6) AS act_recall, round(cite_recall, 6) AS cite_recall,
round(keyword_recall, 6) AS keyword_recall, round(second_recall, 6) AS second_recall, n_acts, n_keywords FROM per""",
    ),
    "two_phase_means": (
        two_phase_means,
        f"SELECT * FROM (WITH {_two_sql(True)} SELECT true AS keyword_filter, {_MEANS}) UNION ALL SELECT * FROM (WITH {_two_sql(False)} SELECT false AS keyword_filter, {_MEANS})",
    ),
}
