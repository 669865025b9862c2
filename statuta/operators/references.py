"""Keyword relations: restriction to known acts, missing ones, and repair of element references."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statuta.functions.ids import normal_id, range_ends


def keyword_rows(relations: DataFrame) -> DataFrame:
    """One relation per (keyword, act): of repeated ones the last."""
    keys = ["conceptId", "instanceOfType", "nro"]
    rest = [c for c in relations.columns if c not in keys]
    last = relations.where("nro IS NOT NULL").groupBy(*keys).agg(F.max_by(F.struct(*rest), "rpos").alias("r"))
    return last.select(*keys, *[F.col(f"r.{c}").alias(c) for c in rest])


def restrict_to_acts(relations: DataFrame, acts: DataFrame) -> DataFrame:
    """Relations whose act is known."""
    return relations.join(acts.select("nro").distinct(), "nro", "left_semi")


def keyword_records(keywords: DataFrame, relations: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, relations``: keywords with their relations by act, an empty list for none left."""
    keys = ["conceptId", "instanceOfType"]
    one = relations.select(*keys, F.struct("nro", "title", "lawType", "validity", "units").alias("r"))
    lists = one.groupBy(*keys).agg(F.array_sort(F.collect_list("r")).alias("l"))
    none = F.array().cast(lists.schema["l"].dataType)
    return keywords.select(*keys).distinct().join(lists, keys, "left").select(*keys, F.coalesce("l", none).alias("relations"))


def missing_references(acts: DataFrame, keywords: DataFrame, relations: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, nro, title, lawType, validity``: whole-act relations to be added.

    A keyword of an act that exists but has no relation for that act gets one, valid, for the whole act.
    """
    keys = ["conceptId", "instanceOfType"]
    asked = acts.select("nro", "title", F.col("actLawType").alias("lawType"), F.explode("keywords").alias("k")).select(
        "k.conceptId", "k.instanceOfType", "nro", "title", "lawType"
    )
    known = keywords.select(*keys).distinct()
    lacking = asked.join(known, keys, "left_semi").join(relations.select(*keys, "nro").distinct(), [*keys, "nro"], "left_anti")
    return lacking.distinct().withColumn("validity", F.lit("ACTUAL"))


def unit_rows(relations: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, nro, upos, unit_id, name``: cited units; whole-act relations give none."""
    return relations.select("conceptId", "instanceOfType", "nro", F.posexplode("units").alias("upos", "u")).select(
        "conceptId", "instanceOfType", "nro", "upos", F.col("u.id").alias("unit_id"), F.col("u.name").alias("name")
    )


def resolve_units(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """``units`` with ``resolved``: the id as written or in normal form, null where it leads nowhere.

    A range is decided as a whole: unless both ends exist as written, both are normalised and both
    must exist then. Distinct (act, id) pairs are looked up, so a popular reference is looked up once.
    """
    ids = units.select("nro", "unit_id").where("unit_id IS NOT NULL").distinct()
    spelled = ids.select("nro", "unit_id", F.explode(F.array(
        F.struct(F.lit(0).alias("s"), range_ends(F.col("unit_id")).alias("ends")),
        F.struct(F.lit(1).alias("s"), F.transform(range_ends(F.col("unit_id")), normal_id).alias("ends")),
    )).alias("x")).select("nro", "unit_id", "x.s", F.posexplode("x.ends").alias("e", "end"))
    keys = nodes.select("nro", F.col("node_id").alias("end")).distinct().withColumn("hit", F.lit(1))
    hits = spelled.join(keys, ["nro", "end"], "left").groupBy("nro", "unit_id", "s").agg(
        F.count(F.lit(1)).alias("n"), F.count("hit").alias("h"), F.array_sort(F.collect_list(F.struct("e", "end"))).alias("ends")
    )
    joined = F.array_join(F.transform("ends", lambda x: x["end"]), "-")
    sound = hits.where("n = h").groupBy("nro", "unit_id").agg(F.min_by(F.when(F.col("s") == 0, F.col("unit_id")).otherwise(joined), "s").alias("resolved"))
    return units.join(sound, ["nro", "unit_id"], "left")


def repair_relations(relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, nro, units``: relations with resolved ids; null units: the whole act.

    Units that lead nowhere are dropped, and relations without a unit left; whole-act relations stay.
    """
    keys = ["conceptId", "instanceOfType", "nro"]
    good = resolve_units(unit_rows(relations), nodes).where("resolved IS NOT NULL")
    lists = good.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("upos", F.col("resolved").alias("id")))).alias("u"))
    some = lists.select(*keys, F.transform("u", lambda x: x["id"]).alias("units"))
    whole = relations.where("units IS NULL").select(*keys, F.lit(None).cast("array<string>").alias("units"))
    return some.unionByName(whole)
