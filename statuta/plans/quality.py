"""Checks of the tables against each other; each gives the offending rows."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.operators.references import resolve_units, unit_rows
from statuta.operators.trees import backward_references, edges, leaf_roots, reachable


def distinct_counts(questions: DataFrame, acts: DataFrame, keywords: DataFrame) -> DataFrame:
    """``what, n``: distinct acts and keywords in each source."""
    pair = F.struct("conceptId", "instanceOfType")
    k = questions.select(F.explode("keywords").alias("k")).select("k.conceptId", "k.instanceOfType")
    parts = [
        questions.select(F.explode("relatedActs.nro").alias("x")).agg(F.lit("question acts").alias("what"), F.count_distinct("x").alias("n")),
        acts.agg(F.lit("acts").alias("what"), F.count_distinct("nro").alias("n")),
        k.agg(F.lit("question keywords").alias("what"), F.count_distinct(pair).alias("n")),
        keywords.agg(F.lit("keywords").alias("what"), F.count_distinct(pair).alias("n")),
    ]
    return reduce(DataFrame.unionByName, parts)


def whole_act_units(relations: DataFrame) -> DataFrame:
    """Relations that name the whole act as if it were a unit."""
    return relations.where(F.exists("units", lambda u: u["id"] == "all()")).select("conceptId", "instanceOfType", "nro")


def acts_without_keyword_relation(acts: DataFrame, relations: DataFrame) -> DataFrame:
    """(keyword, act) pairs of acts that the keyword table has no relation for."""
    own = acts.select("nro", F.explode("keywords").alias("k")).select("k.conceptId", "k.instanceOfType", "nro").distinct()
    return own.join(relations, ["conceptId", "instanceOfType", "nro"], "left_anti")


def unresolved_units(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    return resolve_units(unit_rows(relations), nodes).where("resolved IS NULL")


def bad_element_ids(nodes: DataFrame) -> DataFrame:
    """``nro, node_id, kind``: ids with a space, and children that are no elements."""
    spaces = nodes.where(F.contains("node_id", F.lit(" "))).select("nro", "node_id", F.lit("space").alias("kind"))
    child = nodes.select("nro", F.explode("children").alias("node_id")).distinct()
    lost = child.join(nodes.select("nro", "node_id"), ["nro", "node_id"], "left_anti").withColumn("kind", F.lit("dangling"))
    return spaces.unionByName(lost.select("nro", "node_id", "kind"))


def questions_without_act(questions: DataFrame, acts: DataFrame) -> DataFrame:
    cited = questions.select("nro", F.explode("relatedActs.nro").alias("act")).where("act IS NOT NULL").distinct()
    return cited.join(acts.select(F.col("nro").alias("act")), "act", "left_anti").select("nro", "act")


def elements_without_vector(nodes: DataFrame, vectors: DataFrame, repealed: str = "(uchylony)") -> DataFrame:
    """Elements reachable from roots that no vector covers; those of repealed texts are exempt."""
    live = nodes.where(~F.contains(F.coalesce("text", F.lit("")), F.lit(repealed)))
    starts = leaf_roots(nodes).select("nro", F.col("root").alias("node_id"))
    below = reachable(starts, edges(nodes), [])
    covered = vectors.select(F.col("act_nro").alias("nro"), F.explode("node_ids").alias("node_id")).distinct()
    return below.join(live.select("nro", "node_id"), ["nro", "node_id"], "left_semi").join(covered, ["nro", "node_id"], "left_anti")


def vector_keywords_unknown(vectors: DataFrame, acts: DataFrame) -> DataFrame:
    """(act, keyword) pairs of vectors that the act itself does not list."""
    pair = ["nro", "conceptId", "instanceOfType"]
    have = vectors.select(F.col("act_nro").alias("nro"), F.explode("keywords").alias("k")).select("nro", "k.conceptId", "k.instanceOfType").distinct()
    own = acts.select("nro", F.explode("keywords").alias("k")).select("nro", "k.conceptId", "k.instanceOfType")
    return have.join(own, pair, "left_anti")


def vectors_without_point(vectors: DataFrame, points: DataFrame) -> DataFrame:
    keys = ["act_nro", "reconstruct_id"]
    return vectors.select(*keys).join(points.where("coll = 'acts'").select(*keys), keys, "left_anti")


def report(checks: Mapping[str, DataFrame]) -> DataFrame:
    """``check, ok, n_bad``: one row per check."""
    rows = [df.agg(F.lit(name).alias("check"), F.count(F.lit(1)).alias("n_bad")) for name, df in checks.items()]
    return reduce(DataFrame.unionByName, rows).select("check", (F.col("n_bad") == 0).alias("ok"), "n_bad")


def all_checks(questions: DataFrame, acts: DataFrame, nodes: DataFrame, relations: DataFrame, vectors: DataFrame, points: DataFrame) -> dict[str, DataFrame]:
    return {
        "whole act as unit": whole_act_units(relations),
        "act keyword without relation": acts_without_keyword_relation(acts, relations),
        "unit not found": unresolved_units(relations, nodes),
        "bad element id": bad_element_ids(nodes),
        "backward reference": backward_references(nodes),
        "question act not found": questions_without_act(questions, acts),
        "element without vector": elements_without_vector(nodes, vectors),
        "vector keyword unknown": vector_keywords_unknown(vectors, acts),
        "vector without point": vectors_without_point(vectors, points),
    }
