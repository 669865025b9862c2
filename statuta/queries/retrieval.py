"""Search and retrieval over question and act vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.chunks import word_tokens
from statuta.operators.vector import filtered_topk, reciprocal_rank_fusion, topk
from statuta.operators.vptree import vptree_topk
from statuta.plans import retrieval as R
from statuta.queries import common as C
from statuta.session import cut, table


def _scores(df: DataFrame) -> DataFrame:
    return df.select("qid", "id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


def vec_topk_cosine(spark: SparkSession, d: str) -> DataFrame:
    return _scores(topk(C.query_vectors(spark, d), C.question_vectors(spark, d), R.QUESTIONS))


def vec_topk_indexed(spark: SparkSession, d: str) -> DataFrame:
    """The same through the index; with factor one it is exact, which its SQL checks."""
    return _scores(vptree_topk(C.query_vectors(spark, d), C.question_vectors(spark, d), R.QUESTIONS, 1.0))


def vec_topk_approximate(spark: SparkSession, d: str) -> DataFrame:
    """Through the index with the production factor: the share of the exact neighbours that it finds, of each query."""
    exact = topk(C.query_vectors(spark, d), C.question_vectors(spark, d), R.QUESTIONS).select("qid", "id")
    found = vptree_topk(C.query_vectors(spark, d), C.question_vectors(spark, d), R.QUESTIONS).select("qid", "id", F.lit(1).alias("hit"))
    share = exact.join(found, ["qid", "id"], "left").groupBy("qid").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    return share.agg(F.count(F.lit(1)).alias("n"), (F.avg("recall") >= 0.9).alias("good"))


def vec_topk_excluding(spark: SparkSession, d: str) -> DataFrame:
    return _scores(topk(C.query_vectors(spark, d), C.question_vectors(spark, d), 7, exclude=True))


def embeddings_topk(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    queries = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("vec_id").alias("own"), F.col("embedding").alias("vector"))
    return _scores(topk(queries, e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector")), 7, exclude=True))


def _first(spark: SparkSession, d: str, k: int) -> DataFrame:
    return R.similar_questions(C.query_vectors(spark, d), C.question_vectors(spark, d), k)


def vec_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Top chunks restricted to the acts of the query's own question."""
    q = C.query_vectors(spark, d)
    allowed = q.select("qid", F.col("own").alias("nro")).join(C.questions(spark, d), "nro").select("qid", F.explode("relatedActs.nro").alias("act"))
    return _scores(filtered_topk(q, allowed, C.chunks(spark, d), 20))


def vec_topk_nested_filter(spark: SparkSession, d: str) -> DataFrame:
    """The same with the nested keyword filter, whose concept and type lists are independent."""
    q = C.query_vectors(spark, d)
    own = q.select("qid", "vector", F.col("own").alias("nro")).join(C.questions(spark, d).select("nro", "relatedActs", "keywords"), "nro")
    allowed = own.select("qid", F.explode("relatedActs.nro").alias("act"))
    # A question without keywords of its own finds nothing here.
    wanted = own.where(F.size("keywords") > 0).select("qid", "vector", F.col("keywords.conceptId").alias("concepts"), F.col("keywords.instanceOfType").alias("types"))
    return _scores(filtered_topk(wanted, allowed, C.chunks(spark, d), 20, keyword_filter=True))


def vec_topk_act_keywords(spark: SparkSession, d: str) -> DataFrame:
    """The nested filter with all keywords that the acts of the query's question list."""
    q = C.query_vectors(spark, d)
    own = q.select("qid", F.col("own").alias("nro")).join(C.questions(spark, d).select("nro", "relatedActs"), "nro")
    allowed = own.select("qid", F.explode("relatedActs.nro").alias("act"))
    listed = allowed.join(C.acts(spark, d).select(F.col("nro").alias("act"), F.explode("keywords").alias("k")), "act")
    lists = listed.groupBy("qid").agg(F.collect_set("k.conceptId").alias("concepts"), F.collect_set("k.instanceOfType").alias("types"))
    return _scores(filtered_topk(q.select("qid", "vector").join(lists, "qid"), allowed, C.chunks(spark, d), 20, keyword_filter=True))


def vec_budgeted_retrieve(spark: SparkSession, d: str) -> DataFrame:
    """Parts of acts: the request's queries share a budget of 100 chunks, each searching one act."""
    q = C.query_vectors(spark, d)
    request = q.select("qid", "vector", F.col("own").alias("nro")).join(C.questions(spark, d).select("nro", "relatedActs"), "nro")
    request = request.select("qid", "vector", F.element_at(F.filter("relatedActs", lambda a: a["nro"].isNotNull()), 1)["nro"].alias("act"))
    request = request.where("act IS NOT NULL")
    # At most the number of stated queries: one row.
    budget = request.agg(F.greatest(F.lit(1), F.floor(F.lit(100) / F.greatest(F.count(F.lit(1)), F.lit(1)))).alias("budget"))
    n = budget.first()["budget"]
    found = filtered_topk(request.select("qid", "vector"), request.select("qid", "act"), C.chunks(spark, d), int(n))
    return _scores(found)


def acts_search(spark: SparkSession, d: str) -> DataFrame:
    """Acts recommended to a request of several queries, each once, in order of first appearance."""
    q = C.query_vectors(spark, d)
    return (
        R.recommended_acts(_first(spark, d, R.QUESTIONS), C.questions(spark, d), q.select("qid", F.col("qid").alias("qpos")))
        .select("act_nro", "title", F.col("place.qpos").alias("qid"), F.col("place.rank").cast("long").alias("rank"), F.col("place.apos").cast("long").alias("apos"))
    )


def _two_phase(spark: SparkSession, d: str) -> DataFrame:
    return R.two_phase(C.query_vectors(spark, d), C.question_vectors(spark, d), C.questions(spark, d), C.chunks(spark, d))


def two_phase_hits(spark: SparkSession, d: str) -> DataFrame:
    return _scores(_two_phase(spark, d))


def _stored(spark: SparkSession, d: str) -> DataFrame:
    return C.nodes(spark, d).select("nro", "pos", F.col("node_id").alias("key"), F.col("node_id").alias("cite_id"), "text")


def two_phase_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: similar questions, chunks of their acts, and the act parts in document order."""
    # At most a hundred chunks per query, read for the parts and for the order of the acts.
    hits = cut(_two_phase(spark, d))
    parts = R.reconstruct(hits, _stored(spark, d), C.acts(spark, d))
    order = R.ranked_acts(hits).select("qid", F.col("act").alias("nro"), F.col("act_rank").cast("long").alias("act_rank"))
    return parts.join(order, ["qid", "nro"])


def reconstruct_in_order(spark: SparkSession, d: str) -> DataFrame:
    """The parts of each found act joined to one text in document order."""
    parts = R.reconstruct(_two_phase(spark, d), _stored(spark, d), C.acts(spark, d)).where("text IS NOT NULL")
    ordered = F.array_sort(F.collect_list(F.struct("pos", "text")))
    return parts.groupBy("qid", "nro").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def points_by_ids(spark: SparkSession, d: str) -> DataFrame:
    """Points of the chunks that the first two phases found, fetched by their ids."""
    wanted = _two_phase(spark, d).select(F.col("id").alias("point_id")).distinct()
    return table(spark, d, "vector_points").select("point_id", "coll", "act_nro", "reconstruct_id").join(wanted, "point_id", "left_semi")


def response_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Words of the parts of each answer: the size of the context it fills."""
    parts = R.reconstruct(_two_phase(spark, d), _stored(spark, d), C.acts(spark, d))
    return parts.groupBy("qid").agg(F.sum(word_tokens(F.col("text"))).alias("n_words"), F.count(F.lit(1)).alias("n_parts"))


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Two rankings of questions, with and without the query's own, fused by reciprocal ranks."""
    q, v = C.query_vectors(spark, d), C.question_vectors(spark, d)
    lists = topk(q, v, 20).select("qid", "id", "rank").unionByName(topk(q, v, 20, exclude=True).select("qid", "id", "rank"))
    return reciprocal_rank_fusion(lists, ["qid"], "id").withColumn("score", F.round("score", 9))


_HITS = "SELECT qid, id, round(score, 6) AS score, rank FROM "


def _ranked(source: str, k: int, name: str = "hit2") -> str:
    return f"""
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM {source}) WHERE rank <= {k})"""


_OWN = f"""{C.VEC},
allowed AS (SELECT DISTINCT q.qid, r.a.nro AS act FROM query q JOIN rel r ON r.qnro = q.own),
scored AS (SELECT q.qid, c.id, list_cosine_similarity(q.v, c.v) AS score, c.keywords, q.own FROM query q JOIN allowed w USING (qid) JOIN chunk c ON c.act = w.act)"""

_TWO = f"""{C.VEC},{C.first(60)},
allowed AS (SELECT DISTINCT h.qid, r.a.nro AS act FROM hit1 h JOIN rel r ON r.qnro = h.id),
scored AS (SELECT q.qid, c.id, c.act, c.parent_id, c.reconstruct_id, list_cosine_similarity(q.v, c.v) AS score
           FROM query q JOIN allowed w USING (qid) JOIN chunk c ON c.act = w.act),{_ranked('scored', 100)},
wanted AS (SELECT DISTINCT qid, act AS nro, unnest([parent_id, reconstruct_id]) AS key FROM hit2),
part AS (SELECT w.qid, n.nro, a.title, n.pos, regexp_replace(a.citeLink, '/[^/]*$', '') || '?unitId=' || n.node_id AS cite_id, n.e.text AS text
         FROM wanted w JOIN node n ON n.nro = w.nro AND n.node_id = w.key JOIN cur_a a ON a.nro = w.nro)"""

QUERIES = {
    "vec_topk_cosine": (vec_topk_cosine, f"WITH {C.VEC},{C.first(40)} {_HITS} hit1"),
    "vec_topk_indexed": (vec_topk_indexed, f"WITH {C.VEC},{C.first(40)} {_HITS} hit1"),
    "vec_topk_approximate": (vec_topk_approximate, f"WITH {C.VEC} SELECT count(DISTINCT qid) AS n, true AS good FROM query"),
    "vec_topk_excluding": (vec_topk_excluding, f"WITH {C.VEC},{C.first(7, True)} {_HITS} hit1"),
    "embeddings_topk": (
        embeddings_topk,
        """
WITH s AS (SELECT a.vec_id AS qid, b.vec_id AS id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
           FROM embeddings a, embeddings b WHERE a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM s)
SELECT qid, id, round(score, 6) AS score, rank FROM r WHERE rank <= 7""",
    ),
    "vec_topk_filtered": (vec_topk_filtered, f"WITH {_OWN},{_ranked('scored', 20)} {_HITS} hit2"),
    "vec_topk_nested_filter": (
        vec_topk_nested_filter,
        f"""WITH {_OWN},
kept AS (SELECT s.* FROM scored s JOIN cur_q c ON c.nro = s.own
  WHERE len(list_filter(s.keywords, lambda k: list_contains(list_transform(c.keywords, lambda x: x.conceptId), k.conceptId)
            AND list_contains(list_transform(c.keywords, lambda x: x.instanceOfType), k.instanceOfType))) > 0),{_ranked('kept', 20)}
{_HITS} hit2""",
    ),
    "vec_topk_act_keywords": (
        vec_topk_act_keywords,
        f"""WITH {_OWN},
lists AS (SELECT qid, list(k.conceptId) AS cs, list(k.instanceOfType) AS ts FROM (SELECT w.qid, unnest(a.keywords) AS k FROM allowed w JOIN cur_a a ON a.nro = w.act) GROUP BY qid),
kept AS (SELECT s.* FROM scored s JOIN lists l USING (qid)
  WHERE len(list_filter(s.keywords, lambda k: list_contains(l.cs, k.conceptId) AND list_contains(l.ts, k.instanceOfType))) > 0),{_ranked('kept', 20)}
{_HITS} hit2""",
    ),
    "vec_budgeted_retrieve": (
        vec_budgeted_retrieve,
        f"""WITH {C.VEC},
request AS (SELECT q.qid, q.v, list_filter(list_transform(c.relatedActs, lambda a: a.nro), lambda n: n IS NOT NULL)[1] AS act
            FROM query q JOIN cur_q c ON c.nro = q.own),
budget AS (SELECT greatest(1, 100 // greatest(count(*), 1)) AS n FROM request WHERE act IS NOT NULL),
scored AS (SELECT r.qid, c.id, list_cosine_similarity(r.v, c.v) AS score FROM request r JOIN chunk c ON c.act = r.act),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM scored)
SELECT qid, id, round(score, 6) AS score, rank FROM ranked, budget WHERE rank <= n""",
    ),
    "acts_search": (
        acts_search,
        f"""WITH {C.VEC},{C.first(40)},
seen AS (SELECT r.a.nro AS act_nro, r.a.title AS title, h.qid, h.rank, r.apos,
                row_number() OVER (PARTITION BY r.a.nro ORDER BY h.qid, h.rank, r.apos) AS n
         FROM hit1 h JOIN rel r ON r.qnro = h.id WHERE r.a.nro IS NOT NULL)
SELECT act_nro, title, qid, rank, apos FROM seen WHERE n = 1""",
    ),
    "two_phase_hits": (two_phase_hits, f"WITH {_TWO} {_HITS} hit2"),
    "two_phase_search": (
        two_phase_search,
        f"""WITH {_TWO},
best AS (SELECT qid, act AS nro, max(score) AS best FROM hit2 GROUP BY ALL),
ord AS (SELECT qid, nro, row_number() OVER (PARTITION BY qid ORDER BY round(best, 9) DESC, nro) AS act_rank FROM best)
SELECT p.qid, p.nro, p.title, p.pos, p.cite_id, p.text, o.act_rank FROM part p JOIN ord o USING (qid, nro)""",
    ),
    "reconstruct_in_order": (
        reconstruct_in_order,
        f"WITH {_TWO} SELECT qid, nro, string_agg(text, chr(10) ORDER BY pos) AS text FROM part WHERE text IS NOT NULL GROUP BY qid, nro",
    ),
    "points_by_ids": (
        points_by_ids,
        f"WITH {_TWO} SELECT DISTINCT p.point_id, p.coll, p.act_nro, p.reconstruct_id FROM vector_points p WHERE p.point_id IN (SELECT id FROM hit2)",
    ),
    "response_tokens": (
        response_tokens,
        f"""WITH {_TWO} SELECT qid, CAST(sum(len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> ''))) AS BIGINT) AS n_words, count(*) AS n_parts
FROM part GROUP BY qid""",
    ),
    "rrf_fusion": (
        rrf_fusion,
        f"""WITH {C.VEC},{C.first(20)},{C.first(20, True).replace('hit1', 'hit1x')},
lists AS (SELECT qid, id, rank FROM hit1 UNION ALL SELECT qid, id, rank FROM hit1x)
SELECT qid, id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM lists GROUP BY qid, id""",
    ),
}
