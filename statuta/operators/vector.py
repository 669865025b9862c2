"""Cosine similarity and exact top-k search, unfiltered, excluding and filtered before scoring."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import cut, ship, small

#: Rows and queries scored at a time, the most rows or queries of a block, and the blocks beyond which they grow.
PART, BLOCK, MANY = 4096, 65_536, 64
#: Pairs of a query and a small act that are scored in one place, about.
LIGHT = 20_000
#: Places to which scores are rounded before they are ranked.
DIGITS = 9
NONE = np.iinfo(np.int64).max
#: Queries that are scored at a time, and pairs whose vectors are laid side by side.
_QUERIES, _PAIRS = 1024, 65_536


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays in double precision; null for null or all-zero vectors."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def usable(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers that are not all zero."""
    return F.coalesce((F.size(vector) == dim) & F.exists(vector, lambda x: x != 0), F.lit(False))


def ranked(score: str = "score") -> Column:
    """What scores are ranked by: rounded, so that the noise of sums in another order decides nothing."""
    return F.desc(F.round(score, DIGITS))


class Best:
    """The best ``k`` entries so far of each of some queries, by rounded similarity, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.sim = np.full((queries, k), -2.0)
        self.raw = np.full((queries, k), -2.0)
        self.id = np.full((queries, k), NONE)

    def offer(self, rows: np.ndarray, rough: np.ndarray, queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray) -> None:
        """Entries for the queries ``rows``: what may be as good as the k-th by ``rough`` similarities is weighed in double precision."""
        least = self.sim[rows, -1] - 2e-6
        if rough.shape[1] > self.k and least.min() < -1.5:
            # Nothing known yet: what is worse than the k-th of this part alone is none of the best.
            least = np.maximum(least, np.partition(rough, -self.k, axis=1)[:, -self.k] - 4e-6)
        least = least.astype(np.float32)
        hit = np.flatnonzero(rough.max(axis=1) >= least)
        if not len(hit):
            return
        q, i = np.nonzero(rough[hit] >= least[hit, None])
        q = hit[q]
        self.weigh(rows, q, np.einsum("ij,ij->i", queries[rows[q]], vectors[i]), ids[i])

    def weigh(self, rows: np.ndarray, q: np.ndarray, raw: np.ndarray, ids: np.ndarray) -> None:
        """Entries ``ids`` with their similarities, each for the query ``rows[q]``."""
        touched, at = np.unique(q, return_inverse=True)
        own = rows[touched]
        of = np.concatenate([np.repeat(np.arange(len(own)), self.k), at])
        sim = np.concatenate([self.sim[own].ravel(), np.round(raw, DIGITS)])
        raw = np.concatenate([self.raw[own].ravel(), raw])
        idx = np.concatenate([self.id[own].ravel(), ids])
        order = np.lexsort((idx, -sim, of))
        of, sim, idx, raw = of[order], sim[order], idx[order], raw[order]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        kept = place < self.k
        at = own[of[kept]], place[kept]
        self.sim[at], self.id[at], self.raw[at] = sim[kept], idx[kept], raw[kept]


def topk(
    queries: DataFrame, corpus: DataFrame, k: int, dim: int = 64, exclude: bool = False
) -> DataFrame:
    """``qid, id, score, rank``: the ``k`` most similar rows of ``corpus(id, vector)`` for every query.

    ``queries(qid, vector)``, with ``exclude`` also ``own``: an id that must not be found. Ranks go by the
    score rounded to DIGITS places, ties to the smaller id. Unusable vectors on either side are left out.
    Queries and rows meet in blocks, as in :func:`filtered_topk`, and each block keeps its own top k.
    """
    one = F.lit(0).alias("act")
    return filtered_topk(queries, queries.select("qid", one), corpus.select("id", one, "vector"), k, dim=dim, exclude=exclude)


def _postings(keywords: pd.Series) -> dict[int, list[tuple[int, np.ndarray]]]:
    """The rows of each pair of concept and type, by concept."""
    held: dict[tuple, list[int]] = {}
    for r, own in enumerate(keywords):
        for pair in () if own is None else {(k["conceptId"], k["instanceOfType"]) for k in own if k is not None}:
            held.setdefault(pair, []).append(r)
    out: dict[int, list[tuple[int, np.ndarray]]] = {}
    for (concept, kind), rows in held.items():
        out.setdefault(concept, []).append((kind, np.array(rows)))
    return out


def _meeting(queries: pd.DataFrame, postings: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row) with a keyword whose concept and type the query lists, each once; and which queries have no lists."""
    free = np.array([c is None or not len(c) for c in queries["concepts"]], bool)
    at, found = [], []
    for q, (concepts, types) in enumerate(zip(queries["concepts"], queries["types"])):
        if not free[q] and types is not None:
            kinds = set(types)
            mine = [rows for c in set(concepts) for kind, rows in postings.get(c, ()) if kind in kinds]
            if mine:
                found.append(np.unique(np.concatenate(mine)) if len(mine) > 1 else mine[0])
                at.append(q)
    rows = np.concatenate(found) if found else np.zeros(0, np.int64)
    return np.repeat(np.array(at, np.int64), [len(f) for f in found]), rows, free


def _block_topk(keyword_filter: bool, exclude: bool, step: int):
    """The best of each query among the rows of an act, for all acts of a group; only a part of both is scored at a time."""

    def one(queries: pd.DataFrame, left: np.ndarray, ids: np.ndarray, right: np.ndarray, postings: dict | None) -> Best:
        best = Best(len(queries), int(queries["k"].max()))
        rows, own = np.arange(len(queries)), queries["own"].to_numpy() if exclude else None
        dense = rows
        if postings is not None:
            q, i, free = _meeting(queries, postings)
            for at in range(0, len(q), _PAIRS):
                a, b = q[at : at + _PAIRS], i[at : at + _PAIRS]
                raw = np.einsum("ij,ij->i", left[a], right[b])
                kept = raw > -2.0
                if exclude:
                    kept &= own[a] != ids[b]
                best.weigh(rows, a[kept], raw[kept], ids[b[kept]])
            dense = rows[free]
        if len(dense):
            single = left[dense].astype(np.float32)
            for at in range(0, len(ids), step):
                there = slice(at, at + step)
                rough = single @ right[there].astype(np.float32).T
                if exclude:
                    rough[own[dense][:, None] == ids[None, there]] = -9.0
                best.offer(dense, rough, left, right[there], ids[there])
        return best

    def run(both: pd.DataFrame) -> pd.DataFrame:
        queries, rows = both[both["asks"] & (both["k"] > 0)], both[~both["asks"]]
        out = [both.iloc[:0][["qid", "id"]].assign(score=0.0)]
        if len(queries) and len(rows):
            queries, rows = queries.sort_values("act", kind="stable"), rows.sort_values("act", kind="stable")
            left, right, ids = _unit(queries["vector"]), _unit(rows["vector"]), rows["id"].to_numpy()
            acts, begin = np.unique(rows["act"].to_numpy(), return_index=True)
            end = np.append(begin[1:], len(rows))
            asked = queries["act"].to_numpy()
            first, last = np.searchsorted(asked, acts), np.searchsorted(asked, acts, side="right")
            for a in np.flatnonzero(last > first):
                there = slice(begin[a], end[a])
                postings = _postings(rows["keywords"].iloc[there]) if keyword_filter else None
                for at in range(first[a], last[a], _QUERIES):
                    part = slice(at, min(at + _QUERIES, last[a]))
                    some = queries.iloc[part]
                    best = one(some, left[part], ids[there], right[there], postings)
                    q, place = np.nonzero((best.id != NONE) & (np.arange(best.k) < some["k"].to_numpy()[:, None]))
                    out.append(pd.DataFrame({"qid": some["qid"].to_numpy()[q], "id": best.id[q, place], "score": best.raw[q, place]}))
        return pd.concat(out[1:], ignore_index=True) if len(out) > 1 else out[0]

    return run


def _unit(column: pd.Series) -> np.ndarray:
    matrix = np.stack(column.to_numpy()).astype(np.float64)
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _row_blocks(n: Column, m: Column) -> Column:
    """Blocks of PART rows, MANY at most; the more queries ``m``, the larger ones, up to BLOCK rows: each block copies them and gives them k hits."""
    return F.greatest(F.ceil(n / BLOCK), F.least(F.ceil(n / PART), F.lit(MANY), F.ceil(F.lit(BLOCK) / m))).cast("int")


def filtered_topk(
    queries: DataFrame, allowed: DataFrame, corpus: DataFrame, k: int | str, keyword_filter: bool = False, dim: int = 64, exclude: bool = False
) -> DataFrame:
    """``qid, id, score, rank``: top k among the rows whose ``act`` the query allows.

    ``queries(qid, vector)``, ``allowed(qid, act)``, ``corpus(id, act, vector)``. ``k`` may name a column of
    ``queries`` with a budget of its own. With ``keyword_filter`` a row must have a keyword whose concept is among
    the query's ``concepts`` and whose type is among its ``types``; a query without concepts takes all rows. With
    ``exclude`` the row whose id is the query's ``own`` is not found. Ranks as in :func:`topk`. Null ids and
    acts find nothing.

    The filter comes before anything is scored: queries and rows meet per act, in blocks of at most
    about BLOCK rows, so that an act with a large part of all rows or queries is spread over many
    tasks. Small acts of few queries share a place. Each block keeps its own top k, and only those are shuffled.
    """
    spark = queries.sparkSession
    ship(spark)
    extra_q, extra_c = (["concepts", "types"], ["keywords"]) if keyword_filter else ([], [])
    extra_q = extra_q + ["own"] * exclude
    good = queries.where(usable(F.col("vector"), dim) & F.col("qid").isNotNull()).withColumn("k", (F.col(k) if isinstance(k, str) else F.lit(k)).cast("int"))
    rows = corpus.where(usable(F.col("vector"), dim) & F.col("id").isNotNull()).select("act", "id", "vector", *extra_c)
    pairs = allowed.where("act IS NOT NULL").select("qid", "act").distinct()
    # Blocks per act, from two narrow counts; four numbers an act, broadcast if they were measured to be small.
    n = rows.groupBy("act").agg(F.count(F.lit(1)).alias("n"))
    m = pairs.groupBy("act").agg(F.count(F.lit(1)).alias("m")).withColumn("qbs", F.ceil(F.col("m") / BLOCK).cast("int"))
    blocks = cut(n.join(m, "act").withColumn("rbs", _row_blocks(F.col("n"), F.col("m"))))
    light = (F.col("rbs") == 1) & (F.col("qbs") == 1)
    places = max(16, (blocks.where(light).agg(F.sum("m")).first()[0] or 0) // LIGHT)
    place = F.when(light, F.pmod(F.xxhash64("act"), F.lit(places))).otherwise(F.xxhash64("act")).alias("place")
    blocks = small(blocks.select("act", "rbs", "qbs", light.alias("light"), place))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    part = lambda c, of: F.pmod(F.xxhash64(c), F.col(of)).cast("int")
    nothing = {f.name: f.dataType for f in [*queries.schema.fields, *corpus.schema.fields]}
    null = lambda c: F.lit(None).cast(nothing[c]).alias(c)
    # No nulls among keys, which would make them doubles in pandas.
    zero = lambda c: F.lit(0).cast(nothing[c]).alias(c)
    asking = pairs.join(blocks, "act").join(good, "qid").select(
        "light", "place", "act", part("qid", "qbs").alias("qb"), upto("rbs").alias("rb"), F.lit(True).alias("asks"), "qid", zero("id"), "k", "vector",
        *extra_q, *[null(c) for c in extra_c],
    )
    held = rows.join(blocks, "act").select(
        "light", "place", "act", upto("qbs").alias("qb"), part("id", "rbs").alias("rb"), F.lit(False).alias("asks"), zero("qid"), "id", F.lit(0).alias("k"), "vector",
        *[zero(c) if c == "own" else null(c) for c in extra_q], *extra_c,
    )
    met = asking.unionByName(held).groupBy("light", "place", "qb", "rb")
    schema = T.StructType([T.StructField("qid", nothing["qid"]), T.StructField("id", nothing["id"]), T.StructField("score", T.DoubleType())])
    scored = met.applyInPandas(_block_topk(keyword_filter, exclude, PART), schema).join(good.select("qid", "k"), "qid")
    order = Window.partitionBy("qid").orderBy(ranked(), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= F.col("k")).drop("k")


def any_keyword(keywords: Column, concepts: Column, types: Column, pairs: Column | None = None) -> Column:
    """Whether an element of ``keywords`` has a wanted concept and a wanted type.

    The lists are independent, so that a concept of one pair meets the type of another; ``pairs``, an
    array of structs (conceptId, instanceOfType), asks for exact pairs instead.
    """
    if pairs is not None:
        return F.exists(keywords, lambda k: F.array_contains(pairs, F.struct(k["conceptId"].alias("conceptId"), k["instanceOfType"].alias("instanceOfType"))))
    return F.exists(keywords, lambda k: F.array_contains(concepts, k["conceptId"]) & F.array_contains(types, k["instanceOfType"]))


def reciprocal_rank_fusion(lists: DataFrame, by: Sequence[str], item: str, c: int = 60) -> DataFrame:
    """``by, item, score``: the sum of 1 / (c + rank) over the ranked lists of a group."""
    return lists.groupBy(*by, item).agg(F.sum(F.lit(1.0) / (F.lit(c) + F.col("rank"))).alias("score"))
