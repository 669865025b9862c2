"""Chunking of acts and reconstruction parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.functions.tokens import token_counts as token_counts_of
from statuta.functions.tokens import token_texts
from statuta.operators import chunks as K
from statuta.plans.retrieval import act_link
from statuta.queries import common as C
from statuta.queries import trees as TQ


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return K.chunk_vectors(C.nodes(spark, d))


def chunk_words(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d).select(
        "nro", "parent_id", "reconstruct_id", "text", "parent_tokens", "text_tokens", "chunk_id", "total_chunks",
        F.array_join("node_ids", ",").alias("node_ids"), F.array_join(F.transform("keywords", lambda k: F.concat_ws("_", k["conceptId"], k["instanceOfType"])), ",").alias("keywords"),
    )


def leaf_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    parts = K.reconstruct_parts(_vectors(spark, d))
    links = C.acts(spark, d).select("nro", act_link(F.col("citeLink")).alias("link"))
    return parts.join(links, "nro").select("nro", F.col("pos").cast("long").alias("pos"), "key", "cite_id", "text", "link")


def repealed_filter(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_rows(spark, d).where(~F.contains(F.coalesce("text", F.lit("")), F.lit(K.REPEALED))).select("act_nro", "reconstruct_id")


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Word counts of chunk texts against the stored ones."""
    n = K.word_tokens(F.col("text")).cast("long")
    return C.chunk_rows(spark, d).select("act_nro", "reconstruct_id", n.alias("n_words"), F.col("text_tokens"))


def subword_counts(spark: SparkSession, d: str) -> DataFrame:
    """Chunk texts in tokens of a public vocabulary: as many as words at least and as bytes at most, and the text comes out again."""
    rows = C.chunk_rows(spark, d).where("text IS NOT NULL").withColumn("n", token_counts_of(spark, F.col("text"))).withColumn("again", token_texts(spark, F.col("text")))
    words = K.word_tokens(F.col("text")).cast("long")
    return rows.select("act_nro", "reconstruct_id", words.alias("n_words"), F.col("n").between(words, F.octet_length("text")).alias("plausible"), (F.col("again") == F.col("text")).alias("whole"))


_PREFIX = TQ.QUERIES["tree_preorder"][1]
_WALK = _PREFIX[: _PREFIX.rindex("SELECT nro, root, node_id")]
_CHUNKS = f"""{_WALK.rstrip()},
wseq AS (SELECT nro, root, node_id, branch, row_number() OVER (PARTITION BY nro, root ORDER BY ords) - 1 AS seq FROM walk),
leaf AS (SELECT nro, node_id FROM node WHERE e.children IS NULL OR len(e.children) = 0),
firstroot AS (SELECT w.nro, w.node_id, arg_min(w.root, r.pos) AS root FROM wseq w JOIN leaf USING (nro, node_id) JOIN leafroot r ON r.nro = w.nro AND r.root = w.root GROUP BY w.nro, w.node_id),
kept AS (SELECT DISTINCT r.nro, r.root, r.pos AS root_pos FROM leafroot r JOIN firstroot f ON f.nro = r.nro AND f.root = r.root),
branches AS (SELECT w.nro, w.root, k.root_pos, w.branch, min(w.seq) AS branch_seq FROM wseq w JOIN kept k USING (nro, root) WHERE w.branch IS NOT NULL GROUP BY ALL),
heads AS (SELECT * FROM branches UNION ALL SELECT k.nro, k.root, k.root_pos, NULL, 0 FROM kept k WHERE NOT EXISTS (SELECT 1 FROM branches b WHERE b.nro = k.nro AND b.root = k.root)),
members AS (
  SELECT nro, root, root_pos, branch, branch_seq, root AS node_id, -1 AS seq FROM heads
  UNION ALL
  SELECT b.nro, b.root, b.root_pos, b.branch, b.branch_seq, w.node_id, w.seq FROM branches b JOIN wseq w ON w.nro = b.nro AND w.root = b.root AND w.branch = b.branch),
tree1 AS (
  SELECT m.nro, m.root, m.root_pos, m.branch, m.branch_seq, list(m.node_id ORDER BY m.seq) AS node_ids, list(coalesce(n.e.text, '') ORDER BY m.seq) AS texts,
         flatten(list(coalesce(n.e.keywords, []) ORDER BY m.seq)) AS kws
  FROM members m JOIN node n ON n.nro = m.nro AND n.node_id = m.node_id GROUP BY ALL),
tree2 AS (SELECT *, array_to_string(texts, ' ') AS text, coalesce(array_to_string(texts[2:], ' '), '') AS rest, list_filter(string_split(array_to_string(texts, ' '), ' '), lambda w: w <> '') AS ws FROM tree1),
tree3 AS (SELECT *, len(ws) AS n, CASE WHEN len(node_ids) = 1 THEN len(ws) >= 512 ELSE len(ws) > 512 END AS large FROM tree2),
tree4 AS (SELECT *, CAST(n // (n // 512 + 1) + 1 AS BIGINT) AS size FROM tree3),
pieces AS (
  SELECT *, CAST(NULL AS BIGINT) AS chunk, text AS t, CAST(NULL AS BIGINT) AS total FROM tree4 WHERE NOT large
  UNION ALL
  SELECT *, array_to_string(ws[(chunk - 1) * size + 1 : chunk * size], ' ') AS t, CAST(ceil(n / size) AS BIGINT) AS total
  FROM (SELECT *, unnest(range(1, CAST(ceil(n / size) AS BIGINT) + 1)) AS chunk FROM tree4 WHERE large)),
live AS (SELECT *, count(*) OVER (PARTITION BY nro, root) AS of_root, first_value(len(node_ids)) OVER (PARTITION BY nro, root ORDER BY branch_seq, coalesce(chunk, 0)) AS first_size,
         row_number() OVER (PARTITION BY nro, root ORDER BY branch_seq, coalesce(chunk, 0)) AS ord FROM pieces WHERE NOT contains(t, '(uchylony)')),
vec AS (SELECT *, CASE WHEN of_root = 1 THEN root WHEN first_size = 1 THEN root || coalesce('_' || chunk, '') ELSE coalesce(node_ids[2], root) || coalesce('_' || chunk, '') END AS key,
        chunk IS NULL AND len(node_ids) > 1 AS whole FROM live)"""
_N = "len(list_filter(string_split({}, ' '), lambda w: w <> ''))"

QUERIES = {
    "chunk_words": (
        chunk_words,
        f"""{_CHUNKS}
SELECT nro, root AS parent_id, key AS reconstruct_id, t AS text, CASE WHEN whole THEN {_N.format('texts[1]')} ELSE 0 END AS parent_tokens,
CASE WHEN whole THEN {_N.format('rest')} ELSE {_N.format('t')} END AS text_tokens, chunk AS chunk_id, total AS total_chunks,
array_to_string(node_ids, ',') AS node_ids,
coalesce(array_to_string(list_transform(list_filter(list_transform(range(1, CAST(len(kws) AS BIGINT) + 1), lambda i: CASE WHEN list_position(kws, kws[i]) = i THEN i END), lambda i: i IS NOT NULL),
  lambda i: kws[i].conceptId || '_' || kws[i].instanceOfType), ','), '') AS keywords
FROM vec""",
    ),
    "leaf_reconstruct": (
        leaf_reconstruct,
        f"""{_CHUNKS},
part AS (
  SELECT nro, root_pos, ord, key, CASE WHEN chunk IS NULL THEN key ELSE regexp_replace(key, '_[0-9]+$', '') END AS cite_id,
         CASE WHEN of_root = 1 THEN texts[1] WHEN chunk IS NOT NULL THEN t ELSE rest END AS text FROM vec
  UNION ALL
  SELECT DISTINCT nro, root_pos, 0, root, root, texts[1] FROM vec WHERE of_root > 1 AND first_size > 1)
SELECT p.nro, row_number() OVER (PARTITION BY p.nro ORDER BY root_pos, ord) - 1 AS pos, key, cite_id, text, regexp_replace(a.citeLink, '/[^/]*$', '') || '?unitId=' AS link
FROM part p JOIN cur_a a ON a.nro = p.nro""",
    ),
    "repealed_filter": (repealed_filter, f"WITH {C.CUR} SELECT act_nro, reconstruct_id FROM cur_v WHERE NOT contains(coalesce(text, ''), '(uchylony)')"),
    "token_counts": (
        token_counts,
        f"WITH {C.CUR} SELECT act_nro, reconstruct_id, len(list_filter(string_split(coalesce(text, ''), ' '), lambda w: w <> '')) AS n_words, text_tokens FROM cur_v",
    ),
    "subword_counts": (
        subword_counts,
        f"""WITH {C.CUR} SELECT act_nro, reconstruct_id, len(list_filter(string_split(text, ' '), lambda w: w <> '')) AS n_words, true AS plausible, true AS whole
FROM cur_v WHERE text IS NOT NULL""",
    ),
}
