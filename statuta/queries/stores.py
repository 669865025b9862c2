"""Merges, deletes, key indexes, paging and counts of stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statuta.operators import store as S
from statuta.operators.current import current_rows
from statuta.queries import common as C
from statuta.session import table

TABLES = ("raw_questions", "tree_acts", "keywords", "vector_acts", "vector_points")


def _batches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two deliveries of questions: fetched until the end of 2023, and later."""
    q = table(spark, d, "raw_questions").select("nro", "title", "fetched_at", F.size("relatedActs").alias("n_acts"))
    old = current_rows(q.where("fetched_at < timestamp '2024-01-01'"), ["nro"])
    return old, q.where("fetched_at >= timestamp '2024-01-01'")


def insert_only_merge(spark: SparkSession, d: str) -> DataFrame:
    old, new = _batches(spark, d)
    return S.insert_only(old, new, ["nro"], ["fetched_at", "title", "n_acts"]).select("nro", "title", "fetched_at")


def inserted_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.inserted_keys(*_batches(spark, d), ["nro"])


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    old, new = _batches(spark, d)
    return S.upsert(old, new, ["nro"], [F.desc("fetched_at"), "title", "n_acts"]).select("nro", "title", "fetched_at")


def delete_keys(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without those of withdrawn acts."""
    gone = C.acts(spark, d).where("withdrawn_at IS NOT NULL").select(F.col("nro").alias("act_nro"))
    return S.delete(C.chunk_rows(spark, d).select("act_nro", "reconstruct_id"), gone, ["act_nro"])


def delete_one_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Chunks without the first one of each withdrawn act."""
    gone = C.acts(spark, d).where("withdrawn_at IS NOT NULL").select(F.col("nro").alias("act_nro"))
    return S.delete_one(C.chunk_rows(spark, d).select("act_nro", "reconstruct_id"), gone, ["act_nro"], ["reconstruct_id"])


def missing_keys_anti(spark: SparkSession, d: str) -> DataFrame:
    """Acts that questions cite and that were never extracted."""
    wanted = C.questions(spark, d).select(F.explode("relatedActs.nro").alias("nro"))
    return S.missing_keys(wanted, table(spark, d, "tree_acts"), ["nro"])


def index_union(spark: SparkSession, d: str) -> DataFrame:
    return S.index_union(*_batches(spark, d), ["nro"])


def index_set_equal(spark: SparkSession, d: str) -> DataFrame:
    """Whether acts with chunks are those with elements."""
    have = C.acts(spark, d).where(F.cardinality("elements") > 0).select("nro")
    return S.same_keys(have, table(spark, d, "vector_acts").select(F.col("act_nro").alias("nro")), ["nro"])


def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return S.duplicate_keys(table(spark, d, "raw_questions"), ["nro"])


def page_of_questions(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a hundred questions."""
    return S.page(C.questions(spark, d).select("nro"), ["nro"], 200, 100)


def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    return S.batches(C.questions(spark, d).select("nro"), ["nro"], 25).groupBy("batch").agg(F.min("nro").alias("first"), F.max("nro").alias("last"), F.count(F.lit(1)).alias("n"))


def row_counts(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name in TABLES:
        one = table(spark, d, name).agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def point_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunks that have no vector yet: what an embedding job has still to do."""
    have = table(spark, d, "vector_points").where("coll = 'acts'").select("act_nro", "reconstruct_id")
    return C.chunk_rows(spark, d).select("act_nro", "reconstruct_id").join(have, ["act_nro", "reconstruct_id"], "left_anti")


_B = """
b AS (SELECT nro, title, fetched_at, len(relatedActs) AS n_acts FROM raw_questions WHERE nro IS NOT NULL),
old AS (SELECT nro, title, fetched_at FROM b WHERE fetched_at < TIMESTAMPTZ '2024-01-01 00:00:00+00' QUALIFY row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC) = 1),
new AS (SELECT * FROM b WHERE fetched_at >= TIMESTAMPTZ '2024-01-01 00:00:00+00'),
first_new AS (SELECT nro, title, fetched_at FROM new QUALIFY row_number() OVER (PARTITION BY nro ORDER BY fetched_at, title NULLS FIRST, n_acts NULLS FIRST) = 1),
last_new AS (SELECT nro, title, fetched_at FROM new QUALIFY row_number() OVER (PARTITION BY nro ORDER BY fetched_at DESC, title NULLS FIRST, n_acts NULLS FIRST) = 1)"""
_V = f"WITH {C.CUR}, gone AS (SELECT nro FROM cur_a WHERE withdrawn_at IS NOT NULL)"

QUERIES = {
    "insert_only_merge": (insert_only_merge, f"WITH {_B} SELECT * FROM old UNION ALL SELECT * FROM first_new WHERE nro NOT IN (SELECT nro FROM old)"),
    "inserted_keys": (inserted_keys, f"WITH {_B} SELECT DISTINCT nro FROM new WHERE nro NOT IN (SELECT nro FROM old)"),
    "upsert_last_wins": (upsert_last_wins, f"WITH {_B} SELECT * FROM old WHERE nro NOT IN (SELECT nro FROM new) UNION ALL SELECT * FROM last_new"),
    "delete_keys": (delete_keys, f"{_V} SELECT act_nro, reconstruct_id FROM cur_v WHERE act_nro NOT IN (SELECT nro FROM gone)"),
    "delete_one_per_key": (
        delete_one_per_key,
        f"""{_V} SELECT act_nro, reconstruct_id FROM (SELECT act_nro, reconstruct_id, row_number() OVER (PARTITION BY act_nro ORDER BY reconstruct_id) AS r FROM cur_v)
WHERE NOT (r = 1 AND act_nro IN (SELECT nro FROM gone))""",
    ),
    "missing_keys_anti": (missing_keys_anti, f"WITH {C.CUR} SELECT DISTINCT a.nro AS nro FROM rel WHERE a.nro IS NOT NULL AND a.nro NOT IN (SELECT nro FROM tree_acts WHERE nro IS NOT NULL)"),
    "index_union": (index_union, f"WITH {_B} SELECT nro FROM old UNION SELECT nro FROM new"),
    "index_set_equal": (
        index_set_equal,
        f"""WITH {C.CUR}, l AS (SELECT nro FROM cur_a WHERE elements IS NOT NULL AND cardinality(elements) > 0), r AS (SELECT DISTINCT act_nro AS nro FROM vector_acts),
c AS (SELECT (SELECT count(*) FROM l WHERE nro NOT IN (SELECT nro FROM r)) AS only_left, (SELECT count(*) FROM r WHERE nro NOT IN (SELECT nro FROM l)) AS only_right)
SELECT only_left = 0 AND only_right = 0 AS same, only_left, only_right FROM c""",
    ),
    "duplicate_keys": (duplicate_keys, "SELECT nro, count(*) AS n FROM raw_questions GROUP BY nro HAVING count(*) > 1"),
    "page_of_questions": (page_of_questions, f"WITH {C.CUR} SELECT nro FROM cur_q ORDER BY nro LIMIT 100 OFFSET 200"),
    "batch_numbers": (
        batch_numbers,
        f"""WITH {C.CUR}, r AS (SELECT nro, (row_number() OVER (ORDER BY nro) - 1) // 25 AS batch FROM cur_q)
SELECT batch, min(nro) AS first, max(nro) AS last, count(*) AS n FROM r GROUP BY batch""",
    ),
    "row_counts": (row_counts, " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES)),
    "point_ids": (
        point_ids,
        f"""WITH {C.CUR} SELECT act_nro, reconstruct_id FROM cur_v v WHERE NOT EXISTS
(SELECT 1 FROM vector_points p WHERE p.coll = 'acts' AND p.act_nro = v.act_nro AND p.reconstruct_id = v.reconstruct_id)""",
    ),
}
