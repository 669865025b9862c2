"""Retrieval plans: related acts of similar questions, parts of acts, and two-phase search."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.vector import filtered_topk, ranked, topk

QUESTIONS, FIRST_QUESTIONS, PARTS = 40, 60, 100


def act_link(cite_link):
    """The act's page with the query of a unit: cut at the last slash, or appended where there is none."""
    return F.concat(F.regexp_replace(cite_link, "/[^/]*$", ""), F.lit("?unitId="))


def similar_questions(queries: DataFrame, question_vectors: DataFrame, k: int, exclude: bool = False) -> DataFrame:
    """``qid, id, score, rank``: the most similar questions (``id`` is their number)."""
    return topk(queries, question_vectors, k, exclude=exclude)


def recommended_acts(hits: DataFrame, questions: DataFrame, qpos: DataFrame) -> DataFrame:
    """``act_nro, title, place``: acts of the found questions, each once, in order of first appearance.

    Appearance is by query, then rank, then place in the question; the title is that of the first.
    """
    acts = questions.select(F.col("nro").alias("id"), F.posexplode("relatedActs").alias("apos", "a"))
    seen = hits.join(qpos, "qid").join(acts, "id").where(F.col("a.nro").isNotNull())
    first = seen.groupBy(F.col("a.nro").alias("act_nro")).agg(
        F.min(F.struct("qpos", "rank", "apos", F.col("a.title").alias("title"))).alias("f")
    )
    return first.select("act_nro", "f.title", F.struct("f.qpos", "f.rank", "f.apos").alias("place"))


def acts_of(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, act``: the distinct acts of the found questions of each query."""
    acts = questions.select(F.col("nro").alias("id"), F.explode("relatedActs.nro").alias("act"))
    return hits.join(acts, "id").where("act IS NOT NULL").select("qid", "act").distinct()


def reconstruct(parts: DataFrame, stored: DataFrame, acts: DataFrame) -> DataFrame:
    """``qid, nro, title, pos, cite_id, text``: stored parts that a hit names, in document order.

    ``parts(qid, act, parent_id, reconstruct_id, ...)``, ``stored(nro, pos, key, cite_id, text)``,
    ``acts(nro, title, citeLink)``. A stored part comes out once per query, whatever the number of
    hits, and its link is prefixed once.
    """
    named = parts.select("qid", F.col("act").alias("nro"), F.explode(F.array("parent_id", "reconstruct_id")).alias("key"))
    wanted = named.where("key IS NOT NULL").distinct()
    found = stored.join(wanted, ["nro", "key"])
    heads = acts.select("nro", "title", act_link(F.col("citeLink")).alias("link"))
    return found.join(heads, "nro").select("qid", "nro", "title", "pos", F.concat("link", "cite_id").alias("cite_id"), "text")


def two_phase(
    queries: DataFrame, question_vectors: DataFrame, questions: DataFrame, chunks: DataFrame, k1: int = FIRST_QUESTIONS, k2: int = PARTS
) -> DataFrame:
    """``qid, id, score, rank, act, parent_id, reconstruct_id``: top chunks of the acts of similar questions."""
    first = similar_questions(queries, question_vectors, k1)
    hits = filtered_topk(queries, acts_of(first, questions), chunks, k2)
    return hits.join(chunks.select("id", "act", "parent_id", "reconstruct_id"), "id")


def ranked_acts(hits: DataFrame) -> DataFrame:
    """``qid, act, act_rank``: found acts by the score of their best chunk, then number."""
    best = hits.groupBy("qid", "act").agg(F.max("score").alias("best"))
    return best.withColumn("act_rank", F.row_number().over(Window.partitionBy("qid").orderBy(ranked("best"), "act")))
