"""Queries of the operators for training data in this subpackage: problems 2, 3, 4, 6, 7, 8 and 9."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.llm import leakage, mixing, neighbours, pairs, spans, spelling, splitting, sql, tokens
from statuta.operators.entities import act_nodes, current_acts, current_keywords, current_questions, keyword_relations
from statuta.session import table


def _units(spark: SparkSession, d: str) -> DataFrame:
    relations = keyword_relations(current_keywords(table(spark, d, "keywords")))
    return relations.select("conceptId", "instanceOfType", F.explode("units").alias("u")).select(
        F.lit("unit").alias("place"), F.col("conceptId").alias("concept_id"), F.col("instanceOfType").alias("instance_of_type"),
        F.col("u.nro").alias("nro"), F.col("u.id").alias("ref_id"), F.col("u.name").alias("text"),
    )


def _elements(spark: SparkSession, d: str) -> DataFrame:
    nodes = act_nodes(current_acts(table(spark, d, "tree_acts")))
    zero = F.lit(0).cast("long")
    return nodes.select(
        F.lit("element").alias("place"), zero.alias("concept_id"), zero.alias("instance_of_type"), "nro",
        F.col("node_id").alias("ref_id"), "text",
    )


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return _units(spark, d).unionByName(_elements(spark, d)).where("text IS NOT NULL")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    keys = ["place", "concept_id", "instance_of_type", "nro", "ref_id"]
    return spelling.unplain(_texts(spark, d), "text").select(*keys).distinct()


def p2_plain(spark: SparkSession, d: str) -> DataFrame:
    return spelling.with_plain(_texts(spark, d), "text", "plain")


def _defects(spark: SparkSession, d: str, evidence: bool = False) -> DataFrame:
    questions = current_questions(table(spark, d, "raw_questions")).select("nro", "question", "answer", "justification")
    labelled = table(spark, d, "documents").select("text", "lang")
    return pairs.pair_defects(questions, "nro", "question", {"answer": False, "justification": True}, labelled, evidence)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _defects(spark, d)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return p3_found(spark, d).groupBy("field", "defect").agg(F.count(F.lit(1)).alias("n"))


def p3_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Defects by what told them: of the truncated ones, how many the prefixes and the length limits did."""
    return _defects(spark, d, True).groupBy("field", "defect", "evidence").agg(F.count(F.lit(1)).alias("n"))


def _nearest(spark: SparkSession, d: str, factor: float = neighbours.FACTOR) -> DataFrame:
    return neighbours.nearest(table(spark, d, "vector_points"), factor=factor)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.neighbour_pairs(_nearest(spark, d))


def p4_nearest(spark: SparkSession, d: str) -> DataFrame:
    return _nearest(spark, d)


def p4_exact(spark: SparkSession, d: str) -> DataFrame:
    """The same with factor one, which restores the exact search."""
    return neighbours.neighbour_pairs(_nearest(spark, d, 1.0))


def _vector_texts(spark: SparkSession, d: str) -> DataFrame:
    """Rows of vector_acts, equal ones once; rows without a key are left out."""
    texts = table(spark, d, "vector_acts").select("act_nro", "reconstruct_id", "text")
    return texts.where("act_nro IS NOT NULL AND reconstruct_id IS NOT NULL").dropDuplicates(["act_nro", "reconstruct_id", "text"])


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(_vector_texts(spark, d), "text").drop("text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pieces(spark, d).where("chunk_id = 1").select("act_nro", "reconstruct_id").distinct()


def p6_checked(spark: SparkSession, d: str) -> DataFrame:
    """Of every oversized text: its words, and whether its pieces fit, are numbered in full and give the text again."""
    pieces = splitting.split_oversized(_vector_texts(spark, d), "text")
    shared = r"^(?:[^ \t\r\n]+[ \t\r\n]+){50}"
    own = F.when(F.col("chunk_id") == 1, F.col("piece")).otherwise(F.regexp_replace("piece", shared, ""))
    texts = pieces.groupBy("act_nro", "reconstruct_id", F.md5("text").alias("h")).agg(
        F.first("text").alias("text"), F.max("total_chunks").alias("total"), F.max(splitting.word_count(F.col("piece"))).alias("most"),
        F.array_sort(F.collect_list(F.struct("chunk_id", own.alias("own")))).alias("l"),
    )
    again = F.array_join(F.transform("l", lambda x: x["own"]), "")
    return texts.select(
        "act_nro", "reconstruct_id", splitting.word_count(F.col("text")).cast("long").alias("n_words"), (F.col("most") <= 512).alias("fits"),
        (F.transform("l", lambda x: x["chunk_id"]) == F.sequence(F.lit(1), F.col("total"))).alias("numbered"), (again == F.col("text")).alias("whole"),
    )


def _leaked(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaked(spark, d).select("doc_id", "item_id").distinct()


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """Every item with the number of documents it leaked into."""
    items = table(spark, d, "eval_items").where("item_id IS NOT NULL").groupBy("item_id").agg(F.max("suite").alias("suite"))
    leaks = _leaked(spark, d).groupBy("item_id").agg(F.count_distinct("doc_id").alias("n"))
    return items.join(leaks, "item_id", "left").select("item_id", "suite", F.coalesce("n", F.lit(0)).alias("n_documents"))


def p7_near(spark: SparkSession, d: str) -> DataFrame:
    return leakage.near_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


#: Tokens of the mixture with a stated total.
TOTAL = 100_000


def _mixture(spark: SparkSession, d: str, total: float | None = None, weighted: bool = False) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text", "lang")
    counted = documents.withColumn("tokens", tokens.token_counts(spark, F.col("text"))).drop("text")
    # Documents of an unknown language are wanted a quarter as often.
    weight = counted.withColumn("weight", F.when(F.col("lang").isNull(), 0.25).otherwise(1.0))
    return mixing.mixture(weight, table(spark, d, "mix_targets"), total=total, weight="weight" if weighted else None)


def p8_mixture(spark: SparkSession, d: str) -> DataFrame:
    return _mixture(spark, d)


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixture(spark, d), table(spark, d, "mix_targets"))


def p8_weighted(spark: SparkSession, d: str) -> DataFrame:
    """A mixture of a stated total, with documents of unequal weights."""
    return _mixture(spark, d, TOTAL, True)


def p8_weighted_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_mixture(spark, d, TOTAL, True), table(spark, d, "mix_targets"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return spans.shared_pairs(table(spark, d, "documents"))


def p9_members(spark: SparkSession, d: str) -> DataFrame:
    """Every document with the representative of its text, through which p9_found links copies."""
    return spans.classes(table(spark, d, "documents")).select("doc_id", "rep", "n_chars")


def p9_coverage(spark: SparkSession, d: str) -> DataFrame:
    return spans.coverage(table(spark, d, "documents"))


QUERIES = {
    name: (query, sql.SQL.get(name))
    for name, query in list(globals().items())
    if callable(query) and name[:1] == "p" and name[1:2].isdigit()
}
