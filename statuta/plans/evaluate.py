"""Retrieval quality against the citations of questions: recall by question, macro averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def eligible(questions: DataFrame) -> DataFrame:
    """Questions all of whose related acts carry citations; vacuously true without related acts."""
    acts = F.coalesce("relatedActs", F.array().cast(questions.schema["relatedActs"].dataType))
    return questions.where(F.forall(acts, lambda a: F.coalesce(F.size(a["relationData"]), F.lit(0)) > 0))


def sample(questions: DataFrame, key: str = "nro", part: int = 20) -> DataFrame:
    """One row in ``part``, at least one if there is any, by the order of the key's md5.

    The size of the sample is the number of rows divided by ``part``; the sample is the feature here.
    Two histograms of 4096 bins find where the order is cut, so that only one range in sixteen million
    is sorted. Ties of the hash go to the smaller key; a null key comes last.
    """
    hashed = questions.withColumn("__h", F.coalesce(F.md5(F.col(f"`{key}`").cast("string")), F.lit("g" * 32)))
    need, edge, n = 0, "", None
    for level in (0, 1):
        bins = hashed.where(F.startswith("__h", F.lit(edge))).groupBy(F.substring("__h", 1, 3 * level + 3).alias("b")).agg(F.count(F.lit(1)).alias("n"))
        counted = sorted((r["b"], r["n"]) for r in bins.collect())  # at most 4097 rows
        if n is None:
            n = sum(c for _, c in counted)
            need = max(1, n // part) if n else 0
        for edge, c in counted:  # noqa: B007
            if c >= need:
                break
            need -= c
    prefix = F.substring("__h", 1, 6)
    last = hashed.where(prefix == edge).orderBy("__h", key).limit(need)
    return hashed.where(prefix < edge).unionByName(last).drop("__h")


def gold(questions: DataFrame) -> DataFrame:
    """``qid, acts, cites, pairs``: what a question cites: acts, (act, element) pairs and keyword pairs, as sets of text."""
    acts = F.transform(F.col("relatedActs"), lambda a: a["nro"].cast("string"))
    cites = F.flatten(F.transform(F.col("relatedActs"), lambda a: F.transform(
        F.coalesce(a["relationData"], F.array().cast("array<struct<nro:bigint,id:string,name:string>>")),
        lambda c: F.concat_ws("|", a["nro"], c["id"]),
    )))
    pairs = F.transform(F.col("keywords"), lambda k: F.concat_ws("|", k["conceptId"], k["instanceOfType"]))
    none = F.array().cast("array<string>")
    return questions.select(
        F.col("nro").alias("qid"), F.array_distinct(F.coalesce(acts, none)).alias("acts"),
        F.array_distinct(F.coalesce(cites, none)).alias("cites"), F.array_distinct(F.coalesce(pairs, none)).alias("pairs"),
    )


def recall(wanted: Column, found: Column) -> Column:
    """Share of the wanted set that was found; null for an empty set."""
    return F.try_divide(F.size(F.array_intersect(wanted, found)).cast("double"), F.size(wanted).cast("double"))


def found_sets(first: DataFrame, questions: DataFrame) -> DataFrame:
    """``qid, f_acts, f_cites, f_pairs``: what the found questions cite; ``first(qid, id)`` holds few rows per query."""
    cited = gold(questions).withColumnRenamed("qid", "id")
    sets = first.select("qid", "id").join(cited, "id").groupBy("qid")
    union = lambda c: F.array_distinct(F.flatten(F.collect_list(c)))
    return sets.agg(union("acts").alias("f_acts"), union("cites").alias("f_cites"), union("pairs").alias("f_pairs"))


def chunk_cites(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """``qid, h_cites``: (act, element) pairs of the found chunks, of at most k chunks per query."""
    nodes = chunks.select("id", F.transform(F.coalesce("node_ids", F.array().cast("array<string>")), lambda n: F.concat_ws("|", "act", n)).alias("c"))
    return hits.select("qid", "id").join(nodes, "id").groupBy("qid").agg(F.array_distinct(F.flatten(F.collect_list("c"))).alias("h_cites"))
