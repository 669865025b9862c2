"""Cleaning of questions: nested filters over related acts and citations, frequencies, dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Titles of amending acts begin so, and citations of whole divisions.
AMENDMENTS = ("Zmiana ", "Zm.: ")
DIVISIONS = ("all", "ks", "dz", "roz", "tyt")
CITATIONS = "array<struct<nro:bigint,id:string,name:string>>"


def is_amendment(title: Column) -> Column:
    out = F.lit(False)
    for prefix in AMENDMENTS:
        out = out | F.coalesce(F.startswith(title, F.lit(prefix)), F.lit(False))
    return out


def citations(act: Column) -> Column:
    """An act's citations without those of whole divisions; none for null."""
    given = F.coalesce(act["relationData"], F.array().cast(CITATIONS))
    return F.filter(given, lambda c: ~F.coalesce(c["id"].rlike(f"^({'|'.join(DIVISIONS)})"), F.lit(False)))


def clean_questions(questions: DataFrame, parsable: DataFrame, act: str = "nro") -> DataFrame:
    """``nro, title, relatedActs, keywords``: valid, unamended, parsable acts with element citations.

    ``parsable`` lists the usable acts. Questions without keywords or without an act left are
    dropped. Acts keep their order. One semi-join on the act and one regrouping per question, whose
    size is that of the question's own list.
    """
    kept = F.filter("relatedActs", lambda a: (a["validity"] == "ACTUAL") & ~is_amendment(a["title"]))
    slim = F.transform(kept, lambda a: F.struct(
        a["nro"].alias("nro"), a["title"].alias("title"), a["validity"].alias("validity"), citations(a).alias("relationData")
    ))
    some = questions.where(F.size("keywords") > 0)
    rows = some.select("nro", "title", "keywords", F.posexplode(slim).alias("pos", "a"))
    usable = parsable.select(F.col(act).alias("act")).distinct()
    good = rows.withColumn("act", F.col("a.nro")).join(usable, "act", "left_semi")
    lists = good.groupBy("nro").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("l"))
    back = some.select("nro", "title", "keywords").join(lists, "nro")
    return back.select("nro", "title", F.transform("l", lambda x: x["a"]).alias("relatedActs"), "keywords")


def act_frequencies(questions: DataFrame) -> DataFrame:
    """``nro, n``: how often each act is cited; twice in one question counts twice."""
    return questions.select(F.explode("relatedActs.nro").alias("nro")).groupBy("nro").agg(F.count(F.lit(1)).alias("n"))


def frequent_only(questions: DataFrame, least: int) -> DataFrame:
    """Questions with only the acts cited at least ``least`` times; those left without any are dropped."""
    often = act_frequencies(questions).where(F.col("n") >= least).select("nro")
    rows = questions.select("nro", F.posexplode("relatedActs").alias("pos", "a")).withColumn("act", F.col("a.nro"))
    good = rows.join(often.withColumnRenamed("nro", "act"), "act", "left_semi")
    lists = good.groupBy("nro").agg(F.array_sort(F.collect_list(F.struct("pos", "a"))).alias("l"))
    rest = questions.drop("relatedActs")
    return rest.join(lists, "nro").withColumn("relatedActs", F.transform("l", lambda x: x["a"])).drop("l")


def cited_acts(questions: DataFrame) -> DataFrame:
    return questions.select(F.explode("relatedActs.nro").alias("nro")).where("nro IS NOT NULL").distinct()


def cited_keywords(questions: DataFrame) -> DataFrame:
    k = questions.select(F.explode("keywords").alias("k")).select("k.conceptId", "k.instanceOfType")
    return k.where("conceptId IS NOT NULL AND instanceOfType IS NOT NULL").distinct()
