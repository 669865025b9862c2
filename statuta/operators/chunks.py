"""Subtrees of acts cut into embedding-sized chunks, and the parts from which acts are rebuilt."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statuta.operators.trees import leaf_roots, preorder
from statuta.session import cut

LIMIT = 512
# Fixed value: the mark of a repealed unit.
REPEALED = "(uchylony)"


def words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), " "), lambda w: w != "")


def word_tokens(text: Column) -> Column:
    """The default tokenizer: words between spaces."""
    return F.size(words(text))


def pack(text: Column, tokens: Column, limit: int) -> Column:
    """Words packed into ``tokens // limit + 1`` chunks of at most ``tokens // chunks + 1`` tokens, without overlap."""
    size = (F.floor(tokens / (F.floor(tokens / limit) + 1)) + 1).cast("int")
    given = words(text)
    last = (F.ceil(F.size(given) / size) - 1).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.array_join(F.slice(given, i * size + 1, size), " "))


def subtrees(nodes: DataFrame) -> DataFrame:
    """``nro, root, root_pos, branch_seq, branch, node_ids, texts, keywords``: one row per child of a root.

    Each subtree is the root followed by the child's nodes in pre-order; a root without children is a
    subtree by itself. A root all of whose leaves lie below earlier roots is left out.
    """
    # Elements, roots and the walk are each read several times below.
    nodes = cut(nodes.select("nro", "pos", "node_id", "children", "text", "keywords"))
    roots = cut(leaf_roots(nodes))
    walk = cut(preorder(nodes, roots).select("nro", "root", "node_id", "branch", "seq"))
    leaves = nodes.where(F.coalesce(F.size("children"), F.lit(0)) <= 0).select("nro", "node_id")
    held = walk.join(leaves, ["nro", "node_id"], "left_semi").select("nro", "node_id", "root").join(roots, ["nro", "root"])
    first = held.groupBy("nro", "node_id").agg(F.min_by("root", "pos").alias("root"))
    kept = roots.join(first.select("nro", "root").distinct(), ["nro", "root"], "left_semi")
    rows = walk.join(kept.select("nro", "root", F.col("pos").alias("root_pos")), ["nro", "root"])
    body = rows.where("branch IS NOT NULL").select("nro", "root", "root_pos", "branch", "node_id", "seq")
    branches = body.groupBy("nro", "root", "root_pos", "branch").agg(F.min("seq").alias("branch_seq"))
    lone = rows.where("branch IS NULL").select("nro", "root", "root_pos").join(branches.select("nro", "root").distinct(), ["nro", "root"], "left_anti")
    heads = branches.unionByName(lone.withColumn("branch", F.lit(None).cast("string")).withColumn("branch_seq", F.lit(0)))
    members = heads.select("nro", "root", "root_pos", "branch", "branch_seq", F.col("root").alias("node_id"), F.lit(-1).alias("seq")).unionByName(
        body.join(branches, ["nro", "root", "root_pos", "branch"]).select("nro", "root", "root_pos", "branch", "branch_seq", "node_id", "seq")
    )
    full = members.join(nodes.select("nro", "node_id", F.coalesce("text", F.lit("")).alias("text"), "keywords"), ["nro", "node_id"])
    listed = full.groupBy("nro", "root", "root_pos", "branch", "branch_seq").agg(
        F.array_sort(F.collect_list(F.struct("seq", "node_id", "text", "keywords"))).alias("l")
    )
    none = F.array().cast(nodes.schema["keywords"].dataType)
    return listed.select(
        "nro", "root", "root_pos", "branch", "branch_seq", F.transform("l", lambda x: x["node_id"]).alias("node_ids"),
        F.transform("l", lambda x: x["text"]).alias("texts"),
        F.array_distinct(F.flatten(F.transform("l", lambda x: F.coalesce(x["keywords"], none)))).alias("keywords"),
    )


def chunk_vectors(nodes: DataFrame, limit: int = LIMIT, tokens: Callable[[Column], Column] = word_tokens, full_text: bool = False) -> DataFrame:
    """The vector rows of acts: ``nro, root_pos, ord, parent_id, reconstruct_id, text, parent_tokens, text_tokens, chunk_id, total_chunks, keywords, node_ids, root_text, part_text``.

    A lone root is cut from ``limit`` tokens on, a subtree above ``limit``. Repealed vectors are dropped
    before the parts are named. ``part_text`` is what a reader gets for ``reconstruct_id``; for the only
    vector of a root it is the root's own text, with ``full_text`` the whole.
    """
    trees = subtrees(nodes).withColumn("root_text", F.col("texts")[0]).withColumn("text", F.array_join("texts", " "))
    trees = trees.withColumn("rest", F.array_join(F.slice("texts", 2, F.greatest(F.size("texts") - 1, F.lit(0))), " "))
    lone = F.size("node_ids") == 1
    n = tokens(F.col("text"))
    counted = trees.withColumn("n", n.cast("long")).withColumn("large", F.when(lone, F.col("n") >= limit).otherwise(F.col("n") > limit))
    plain = F.array(F.struct(F.lit(None).cast("int").alias("i"), F.col("text").alias("t")))
    packed = F.transform(pack(F.col("text"), F.col("n"), limit), lambda t, i: F.struct((i + 1).alias("i"), t.alias("t")))
    pieces = counted.withColumn("pieces", F.when(F.col("large"), packed).otherwise(plain)).withColumn(
        "total", F.when(F.col("large"), F.size("pieces"))
    )
    rows = pieces.select("*", F.explode("pieces").alias("p")).where(~F.contains(F.col("p.t"), F.lit(REPEALED)))
    mine = Window.partitionBy("nro", "root")
    order = mine.orderBy("branch_seq", F.coalesce("p.i", F.lit(0)))
    ranked = rows.withColumn("of_root", F.count(F.lit(1)).over(mine)).withColumn("first_size", F.first(F.size("node_ids")).over(order)).withColumn(
        "ord", F.row_number().over(order)
    )
    chunk = F.col("p.i")
    suffix = F.when(chunk.isNotNull(), F.concat(F.lit("_"), chunk.cast("string"))).otherwise(F.lit(""))
    only = F.col("of_root") == 1
    second = F.coalesce(F.try_element_at("node_ids", F.lit(2)), F.col("root"))
    key = F.when(only, F.col("root")).when(F.col("first_size") == 1, F.concat("root", suffix)).otherwise(F.concat(second, suffix))
    part = F.when(only, F.col("p.t") if full_text else F.col("root_text")).when(chunk.isNotNull(), F.col("p.t")).otherwise(F.col("rest"))
    whole = chunk.isNull() & ~lone
    return ranked.select(
        "nro", "root_pos", "ord", F.col("root").alias("parent_id"), key.alias("reconstruct_id"), F.col("p.t").alias("text"),
        F.when(whole, tokens(F.col("root_text"))).otherwise(0).cast("int").alias("parent_tokens"),
        F.when(whole, tokens(F.col("rest"))).otherwise(tokens(F.col("p.t"))).cast("int").alias("text_tokens"),
        chunk.alias("chunk_id"), F.col("total").cast("int").alias("total_chunks"), "keywords", "node_ids", "root_text", part.alias("part_text"),
        only.alias("only"), (F.col("first_size") == 1).alias("lone"),
    )


def reconstruct_parts(vectors: DataFrame) -> DataFrame:
    """``nro, pos, key, cite_id, text``: the stored parts of acts, in order.

    A root with several vectors of subtrees has a part of its own, the root's text, before them.
    """
    own = vectors.select("nro", "root_pos", "ord", F.col("reconstruct_id").alias("key"), F.regexp_replace("reconstruct_id", r"_\d+$", "").alias("cite_id"), F.col("part_text").alias("text"))
    heads = vectors.where("NOT only AND NOT lone").groupBy("nro", "root_pos", "parent_id").agg(F.first("root_text").alias("text")).select(
        "nro", "root_pos", F.lit(0).alias("ord"), F.col("parent_id").alias("key"), F.col("parent_id").alias("cite_id"), "text"
    )
    every = own.unionByName(heads)
    return every.withColumn("pos", F.row_number().over(Window.partitionBy("nro").orderBy("root_pos", "ord")) - 1).select("nro", "pos", "key", "cite_id", "text")
