"""Inputs that several queries share, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators.entities import act_nodes, current_acts, current_keywords, current_questions
from statuta.operators.vector import usable
from statuta.session import table


def questions(spark: SparkSession, d: str) -> DataFrame:
    return current_questions(table(spark, d, "raw_questions"))


def acts(spark: SparkSession, d: str) -> DataFrame:
    return current_acts(table(spark, d, "tree_acts"))


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return act_nodes(acts(spark, d))


def keywords(spark: SparkSession, d: str) -> DataFrame:
    return current_keywords(table(spark, d, "keywords"))


def chunk_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows of vector_acts, of each key the latest; equal rows once."""
    from statuta.operators.current import current_rows

    return current_rows(table(spark, d, "vector_acts"), ["act_nro", "reconstruct_id"], "loaded_at")


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    """``id`` (the question's number) and ``vector``; of several points of a question the first."""
    points = table(spark, d, "vector_points").where("coll = 'questions' AND question_nro IS NOT NULL").where(usable(F.col("embedding"), 64))
    return points.groupBy(F.col("question_nro").alias("id")).agg(F.min_by("embedding", "point_id").alias("vector"))


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The stated query set: the question points whose id is divisible by 20, as ``qid, own, vector``."""
    points = table(spark, d, "vector_points").where("coll = 'questions' AND question_nro IS NOT NULL AND point_id % 20 = 0")
    return points.where(usable(F.col("embedding"), 64)).select(
        F.col("point_id").alias("qid"), F.col("question_nro").alias("own"), F.col("embedding").alias("vector")
    )


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """``id, act, vector`` of act chunks with their payload."""
    points = table(spark, d, "vector_points").where("coll = 'acts' AND act_nro IS NOT NULL").where(usable(F.col("embedding"), 64))
    payload = chunk_rows(spark, d).select("act_nro", "reconstruct_id", "parent_id", "keywords", "node_ids")
    return points.select(F.col("point_id").alias("id"), "act_nro", "reconstruct_id", F.col("embedding").alias("vector")).join(
        payload, ["act_nro", "reconstruct_id"]
    ).withColumnRenamed("act_nro", "act")


CUR = """
cur_q AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC) AS rn FROM raw_questions WHERE nro IS NOT NULL) WHERE rn = 1),
cur_a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC) AS rn FROM tree_acts WHERE nro IS NOT NULL) WHERE rn = 1),
cur_k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conceptId, instanceOfType ORDER BY fetched_at DESC) AS rn
          FROM keywords WHERE conceptId IS NOT NULL AND instanceOfType IS NOT NULL) WHERE rn = 1),
cur_v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY act_nro, reconstruct_id ORDER BY loaded_at DESC) AS rn
          FROM vector_acts WHERE act_nro IS NOT NULL AND reconstruct_id IS NOT NULL) WHERE rn = 1),
node AS (SELECT nro, unnest(range(CAST(cardinality(elements) AS BIGINT))) AS pos, unnest(map_keys(elements)) AS node_id, unnest(map_values(elements)) AS e
         FROM cur_a WHERE elements IS NOT NULL),
rel AS (SELECT nro AS qnro, unnest(relatedActs) AS a, unnest(range(CAST(len(relatedActs) AS BIGINT))) AS apos FROM cur_q WHERE relatedActs IS NOT NULL)"""

VEC = f"""{CUR},
usable AS (SELECT * FROM vector_points WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
qvec AS (SELECT question_nro AS id, CAST(arg_min(embedding, point_id) AS DOUBLE[]) AS v FROM usable WHERE coll = 'questions' AND question_nro IS NOT NULL GROUP BY question_nro),
query AS (SELECT point_id AS qid, question_nro AS own, CAST(embedding AS DOUBLE[]) AS v FROM usable WHERE coll = 'questions' AND question_nro IS NOT NULL AND point_id % 20 = 0),
chunk AS (SELECT p.point_id AS id, p.act_nro AS act, p.reconstruct_id, CAST(p.embedding AS DOUBLE[]) AS v, c.parent_id, c.keywords, c.node_ids
          FROM usable p JOIN cur_v c ON c.act_nro = p.act_nro AND c.reconstruct_id = p.reconstruct_id WHERE p.coll = 'acts'),
qscore AS (SELECT q.qid, q.own, c.id, list_cosine_similarity(q.v, c.v) AS score FROM query q, qvec c)"""


def first(k: int, exclude: bool = False) -> str:
    """SQL of the most similar questions, as table ``hit1``."""
    where = "WHERE id <> own" if exclude else ""
    return f"""
hit1 AS (SELECT * FROM (SELECT qid, own, id, score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, id) AS rank FROM qscore {where}) WHERE rank <= {k})"""
