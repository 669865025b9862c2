"""Nested records as flat tables; the order inside maps and arrays is carried as ``pos``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.operators.current import current_rows


def act_nodes(acts: DataFrame) -> DataFrame:
    """``nro, pos, node_id, parent, children, text, keywords``: one row per element, in document order.

    Acts with null or empty ``elements`` give no rows; an element with a null body keeps its row.
    """
    return acts.select("nro", F.posexplode(F.map_entries("elements")).alias("pos", "e")).select(
        "nro", F.col("pos").cast("long").alias("pos"), F.col("e.key").alias("node_id"),
        F.col("e.value.parent").alias("parent"), F.col("e.value.children").alias("children"),
        F.col("e.value.text").alias("text"), F.col("e.value.keywords").alias("keywords"),
    )


def related_acts(questions: DataFrame, *more: str) -> DataFrame:
    """``qnro, apos, act`` and the columns ``more``: one row per act that a question cites."""
    return questions.select(F.col("nro").alias("qnro"), *more, F.posexplode("relatedActs").alias("apos", "act"))


def question_keywords(questions: DataFrame) -> DataFrame:
    """``qnro, kpos, label, conceptId, instanceOfType``: one row per keyword of a question."""
    return questions.select(F.col("nro").alias("qnro"), F.posexplode("keywords").alias("kpos", "k")).select(
        "qnro", "kpos", "k.label", "k.conceptId", "k.instanceOfType"
    )


def keyword_relations(keywords: DataFrame, *more: str) -> DataFrame:
    """``conceptId, instanceOfType, rpos, nro, title, lawType, validity, units``; null units: the whole act."""
    return keywords.select("conceptId", "instanceOfType", *more, F.posexplode("actRelations").alias("rpos", "r")).select(
        "conceptId", "instanceOfType", *more, "rpos", "r.nro", "r.title", "r.lawType", "r.validity",
        F.col("r.relationData.units").alias("units"),
    )


def current_questions(df: DataFrame) -> DataFrame:
    return current_rows(df, ["nro"])


def current_acts(df: DataFrame) -> DataFrame:
    return current_rows(df, ["nro"])


def current_keywords(df: DataFrame) -> DataFrame:
    return current_rows(df, ["conceptId", "instanceOfType"])
