"""The k most similar vectors for every vector, by vantage points with relaxed pruning.

Method. The vantage points and cells are those of :mod:`statuta.operators.vptree`: vectors are dealt into shards of
near ones, and shards and cells are passed over by the triangle inequality, relaxed by ``factor``; with factor 1
the search is exact. Here every vector is a query. Equal vectors are
searched once, and their classes are put together afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.vector import ranked
from statuta.operators.vptree import FACTOR, self_topk, sound
from statuta.session import cut, hot_join, ship

K, DIM = 5, 64


def nearest(
    points: DataFrame, k: int = K, factor: float = FACTOR, point: str = "point_id", coll: str = "coll", vector: str = "embedding", dim: int = DIM
) -> DataFrame:
    """``coll, point, near, rank, similarity``: of every vector the ``k`` most similar of its collection.

    Ties go to the smaller key, a vector is not its own neighbour. Left out are rows with a null key
    or collection, and vectors that are null, all zero, not of ``dim`` numbers, or hold a null, NaN
    or infinity. Repeated keys count once. A collection of fewer than k + 1 vectors gives fewer rows.

    Equal vectors are searched once; only the k + 1 smallest keys of such a class can be anybody's
    neighbours, so a class of any size stays cheap.
    """
    ship(points.sparkSession)
    v = F.col(f"`{vector}`")
    clean = points.where(sound(v, dim)).select(
        F.col(f"`{coll}`").cast("string").alias("coll"), F.col(f"`{point}`").cast("long").alias("id"), v.cast("array<float>").alias("raw")
    ).where("coll IS NOT NULL AND id IS NOT NULL").dropDuplicates(["coll", "id"])
    entries = cut(clean.groupBy("coll", "raw").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")))
    once = entries.select(F.col("coll").alias("grp"), F.col("rep").alias("id"), "raw")
    # Written once: both the single vectors and the classes of equal ones read it.
    hits = cut(self_topk(once, k + 1, factor).select(F.col("grp").alias("coll"), F.col("qid").alias("rep"), F.col("id").alias("near"), F.col("score").alias("sim")))
    order = Window.partitionBy("coll", "rep").orderBy(ranked("sim"), "near")
    # Classes of equal vectors: hits give way to the class's smallest keys, then every member gets the list.
    several = entries.where("n > 1")
    member = hot_join(clean, several.select("coll", "raw", "rep"), ["coll", "raw"], ["id"], "inner").select("coll", "rep", "id")
    smallest = Window.partitionBy("coll", "rep").orderBy("id")
    few = (
        member.withColumn("r", F.row_number().over(smallest)).where(F.col("r") <= k + 1)
        .groupBy("coll", F.col("rep").alias("near")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    )
    lists = (
        hits.join(few, ["coll", "near"], "left")
        .select("coll", "rep", "sim", F.explode(F.coalesce("ids", F.array("near"))).alias("near"))
        .withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1)
    )
    # A class may be a third of all vectors: its members meet the list of at most k + 1 entries in many tasks.
    gathered = lists.join(several.select("coll", "rep"), ["coll", "rep"], "left_semi").groupBy("coll", "rep").agg(F.collect_list(F.struct("near", "sim")).alias("l"))
    for_members = hot_join(member, cut(gathered), ["coll", "rep"], ["id"], "inner").select("coll", "id", F.explode("l").alias("x")).select("coll", "id", "x.near", "x.sim")
    single = lists.join(several.select("coll", "rep"), ["coll", "rep"], "left_anti").select("coll", F.col("rep").alias("id"), "near", "sim")
    each = Window.partitionBy("coll", "id").orderBy(ranked("sim"), "near")
    return (
        single.unionByName(for_members).where("near != id").withColumn("rank", F.row_number().over(each)).where(F.col("rank") <= k)
        .select("coll", F.col("id").alias(point), "near", "rank", F.col("sim").alias("similarity"))
    )


def neighbour_pairs(near: DataFrame, point: str = "point_id") -> DataFrame:
    """``point_a, point_b`` (smaller first): pairs of which at least one counts the other among its nearest."""
    return near.select(F.least(point, "near").alias("point_a"), F.greatest(point, "near").alias("point_b")).distinct()
