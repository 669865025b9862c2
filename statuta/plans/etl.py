"""The pipeline from raw tables to the stored ones: incremental, insert-only, checked after loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statuta import schemas as S
from statuta.functions.embed import Embedder, embed_rows
from statuta.operators import chunks as K
from statuta.operators import questions as Q
from statuta.operators import references as R
from statuta.operators import store as ST
from statuta.operators.trees import propagate_keywords
from statuta.plans.retrieval import act_link

VECTOR_KEYS = ["act_nro", "reconstruct_id"]


def transform_questions(raw: DataFrame, done: DataFrame, parsable: DataFrame, least: int | None = None) -> DataFrame:
    """Questions not transformed yet, cleaned; with ``least`` only acts cited that often in this batch."""
    todo = raw.join(done.select("nro"), "nro", "left_anti")
    clean = Q.clean_questions(todo, parsable)
    return clean if least is None else Q.frequent_only(clean, least)


def transform_keywords(keywords: DataFrame, relations: DataFrame, acts: DataFrame, nodes: DataFrame) -> DataFrame:
    """``conceptId, instanceOfType, nro, units``: relations of known acts, missing ones added, references repaired."""
    known = R.restrict_to_acts(R.keyword_rows(relations), acts)
    fixed = R.repair_relations(known, nodes)
    added = R.missing_references(acts, keywords, known).select(
        "conceptId", "instanceOfType", "nro", F.lit(None).cast("array<string>").alias("units")
    )
    return fixed.unionByName(added)


def keyworded_nodes(acts: DataFrame, relations: DataFrame, nodes: DataFrame) -> DataFrame:
    """``nodes`` with the keywords passed down the trees added to their own, each once."""
    labels = acts.select("nro", F.explode("keywords").alias("k")).distinct()
    passed = propagate_keywords(acts, relations, nodes)
    named = passed.join(
        labels.select("nro", "k", F.col("k.conceptId").alias("conceptId"), F.col("k.instanceOfType").alias("instanceOfType")), ["nro", "conceptId", "instanceOfType"]
    )
    added = named.groupBy("nro", "node_id").agg(F.array_sort(F.collect_set("k")).alias("more"))
    none = F.array().cast(f"ARRAY<{S.KW}>")
    return nodes.join(added, ["nro", "node_id"], "left").withColumn(
        "keywords", F.array_distinct(F.concat(F.coalesce("keywords", none), F.coalesce("more", none)))
    ).drop("more")


def vector_acts(vectors: DataFrame) -> DataFrame:
    """Vector rows as they are stored; of equal keys the first."""
    rows = vectors.select(
        F.col("nro").alias("act_nro"), "parent_id", "reconstruct_id", "text", "parent_tokens", "text_tokens", "chunk_id", "total_chunks", "keywords", "node_ids",
        "root_pos", "ord",
    )
    return ST.first_wins(rows, VECTOR_KEYS, ["root_pos", "ord"]).drop("root_pos", "ord")


def leaf_acts(acts: DataFrame, vectors: DataFrame) -> DataFrame:
    """``nro, title, actLawType, citeLink, reconstruct``: acts with their parts as an ordered list."""
    parts = K.reconstruct_parts(vectors).groupBy("nro").agg(F.array_sort(F.collect_list(F.struct("pos", "key", "cite_id", "text"))).alias("reconstruct"))
    return acts.select("nro", "title", "actLawType", act_link(F.col("citeLink")).alias("citeLink")).join(parts, "nro")


def run(
    store: ST.Store, raw_questions: DataFrame, acts: DataFrame, nodes: DataFrame, keywords: DataFrame, relations: DataFrame, embedder: Embedder,
    limit: int = K.LIMIT, tokens: Callable[[Column], Column] = K.word_tokens,
) -> DataFrame:
    """Transform and load everything that is not stored yet; returns the checks after loading."""
    store.create("questions", S.QUESTION)
    parsable = acts.where(F.cardinality("elements") > 0).select("nro")
    questions = transform_questions(raw_questions, store.read("questions"), parsable)
    store.insert_only("questions", questions, ["nro"], ["title"])
    wanted = ST.missing_keys(Q.cited_acts(store.read("questions")), store.read("leaf_acts") if store.exists("leaf_acts") else acts.limit(0), ["nro"])
    own, own_nodes = acts.join(wanted, "nro", "left_semi"), nodes.join(wanted, "nro", "left_semi")
    fixed = transform_keywords(keywords, relations, own, own_nodes)
    vectors = K.chunk_vectors(keyworded_nodes(own, fixed, own_nodes), limit, tokens)
    for name, rows, keys in (("leaf_acts", leaf_acts(own, vectors), ["nro"]), ("vector_acts", vector_acts(vectors), VECTOR_KEYS)):
        if store.exists(name):
            store.insert_only(name, rows, keys, keys)
        else:
            store.append(name, rows)
    stored = store.read("vector_acts")
    for name, rows, keys, text in (("act_vectors", stored, VECTOR_KEYS, "text"), ("question_vectors", store.read("questions"), ["nro"], "title")):
        todo = rows.join(store.read(name).select(*keys), keys, "left_anti") if store.exists(name) else rows
        store.append(name, embed_rows(todo, keys, text, embedder))
    return loaded(store)


def loaded(store: ST.Store) -> DataFrame:
    """``check, ok, n_bad``: stored tables against each other and unique keys."""
    from statuta.plans.quality import report

    q, v, leaf = store.read("questions"), store.read("vector_acts"), store.read("leaf_acts")
    return report({
        "question keys": ST.duplicate_keys(q, ["nro"]), "leaf act keys": ST.duplicate_keys(leaf, ["nro"]), "vector keys": ST.duplicate_keys(v, VECTOR_KEYS),
        "vector without leaf act": v.select(F.col("act_nro").alias("nro")).distinct().join(leaf, "nro", "left_anti"),
        "vector without embedding": v.where("text IS NOT NULL").join(store.read("act_vectors").select(*VECTOR_KEYS), VECTOR_KEYS, "left_anti"),
        "question without embedding": q.where("title IS NOT NULL").join(store.read("question_vectors").select("nro"), "nro", "left_anti"),
    })
