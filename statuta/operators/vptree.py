"""Similarity search by vantage points in the crowds, with relaxed pruning by the triangle inequality.

Vantage points are put into the crowds of a bounded sample of each group of vectors. A vector lies in the region of
the nearest one and in a ring about it, its cell; a vantage-point tree over the vantage points brings near regions into
one shard. A query is searched in its own shard first: its cell, the rest of its region, then cells that may hold
a neighbour, which bounds how far its neighbours can be. Before anything more is shuffled, all other cells
are tested, and the query goes only to shards that hold one that may.

The test is the triangle inequality between angles: a vector whose cosine with a vantage point is b has with a query
whose cosine with it is a at most the cosine ab + sqrt(1 - a^2) sqrt(1 - b^2). The vantage points are those of the
cell and of the query. ``factor`` divides the second term: with 1 nothing nearer can be passed over and
the search is exact; a larger one passes over more, but never a cell of the query's own region.

Distances are those of vectors of length 1, in which the order is that of the cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.operators.vector import DIGITS, NONE, Best, ranked
from statuta.session import cut, ship, small

FACTOR = 1.75
#: Vectors of a group on which its vantage points are fitted; all are indexed.
SAMPLE = 20_000
#: Vectors of a shard at most, about, and shards into which a group of more than FEW vectors is dealt at least.
SHARD, LEAST_SHARDS, FEW = 131_072, 4, 2048
#: Vectors of a cell, aimed at while a group has fewer than RINGS * PIVOTS cells.
CELL = 48
#: Vantage points of a group, and cells for each of them on average, at most.
PIVOTS, RINGS = 512, 4
#: Queries, and rows of a cell, that are scored at a time.
_QUERY_CHUNK = _ROWS = 2048


def sound(vector: Column, dim: int) -> Column:
    """Whether a vector has ``dim`` numbers, all finite and not all zero."""
    finite = ~F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a.astype(np.float32, copy=False) @ b.astype(np.float32, copy=False).T)), dtype=np.float32)


class Tree:
    """A complete vantage-point tree of a given depth, in heap order."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int = 7):
        self.depth = depth
        sample = sample.astype(np.float32)
        nodes = (1 << depth) - 1
        self.vantage = np.zeros((nodes, sample.shape[1]), np.float32)
        self.radius = np.zeros(nodes, np.float32)
        rng = np.random.default_rng(seed)
        parts = {0: np.arange(len(sample))}
        for node in range(nodes):
            ids = parts.pop(node)
            if not len(ids):
                parts[2 * node + 1] = parts[2 * node + 2] = ids
                continue
            # Of some candidates the one whose distances spread most.
            some = sample[rng.choice(ids, min(16, len(ids)), replace=False)]
            few = sample[rng.choice(ids, min(128, len(ids)), replace=False)]
            self.vantage[node] = some[np.argmax(_distances(some, few).std(axis=1))]
            d = _distances(sample[ids], self.vantage[node : node + 1])[:, 0]
            self.radius[node] = np.median(d)
            parts[2 * node + 1], parts[2 * node + 2] = ids[d <= self.radius[node]], ids[d > self.radius[node]]

    def leaves(self, vectors: np.ndarray) -> np.ndarray:
        vectors = vectors.astype(np.float32)
        node = np.zeros(len(vectors), np.int64)
        for _ in range(self.depth):
            d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * np.einsum("ij,ij->i", vectors, self.vantage[node])), dtype=np.float32)
            node = 2 * node + 1 + (d > self.radius[node])
        return node - ((1 << self.depth) - 1)


class Shard:
    """The vectors of a shard by cells."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, cells: np.ndarray):
        order = np.lexsort((ids, cells))
        self.ids, self.vectors = ids[order], vectors[order]
        self.single = self.vectors.astype(np.float32)
        self.names, self.begin = np.unique(cells[order], return_index=True)
        self.end = np.append(self.begin[1:], len(order))

    def measure(self, coarse: Coarse) -> None:
        """Set the ranges of the cosines with the vantage points in the cells of this shard, all of whose vectors are here."""
        for name, begin, end in zip(self.names, self.begin, self.end):
            for at in range(begin, end, _ROWS):
                sims = self.single[at : min(at + _ROWS, end)] @ coarse.pivots.T
                coarse.low[name], coarse.high[name] = np.minimum(coarse.low[name], sims.min(axis=0)), np.maximum(coarse.high[name], sims.max(axis=0))

    def search(self, queries: np.ndarray, cells: np.ndarray, best: Best, factor: float, coarse: Coarse | None) -> None:
        """Improve ``best`` for ``queries``, which lie in ``cells``: own cell, own region, then likely cells before others."""
        rows, single = np.arange(len(queries)), queries.astype(np.float32)

        def visit(c: int, who: np.ndarray) -> None:
            for at in range(self.begin[c], self.end[c], _ROWS):
                there = slice(at, min(at + _ROWS, self.end[c]))
                best.offer(who, single[who] @ self.single[there].T, queries, self.vectors[there], self.ids[there])

        if coarse is None:
            for c in range(len(self.names)):
                visit(c, rows)
            return
        own, region = coarse.region[cells], coarse.region[self.names]
        for same in (cells[:, None] == self.names, (own[:, None] == region) & (cells[:, None] != self.names)):
            for c in np.flatnonzero(same.any(axis=0)):
                visit(c, rows[same[:, c]])
        at_most = coarse.at_most(single, own, self.names, factor)
        at_most[own[:, None] == region] = -9.0
        likely = np.flatnonzero((at_most >= best.sim[: len(queries), -1:]).any(axis=0))
        for c in likely[np.argsort(-at_most[:, likely].mean(axis=0))]:
            active = rows[at_most[:, c] >= best.sim[: len(queries), -1]]
            if len(active):
                visit(c, active)


def _greatest(a: np.ndarray, low: np.ndarray, high: np.ndarray, share: float) -> np.ndarray:
    """The greatest cosine with a query of vectors whose cosines with a vantage point lie in a range; the query's is ``a``.

    The margins cover the errors of single precision.
    """
    rest = np.maximum(np.float32(0.0), 1 - a * a) + np.float32(1e-5)
    b = np.clip(a / np.sqrt(a * a + np.float32(share**2) * rest), low - np.float32(4e-6), high + np.float32(4e-6))
    return a * b + np.float32(share) * np.sqrt(rest * (np.maximum(np.float32(0.0), 1 - b * b) + np.float32(1e-5))) + np.float32(1e-5)


def _stack(column: pd.Series, kind: str) -> np.ndarray:
    """Unit vectors from the bytes of single ("f4") or double ("f8") numbers that are shuffled."""
    return unit(np.frombuffer(b"".join(column), kind).reshape(len(column), -1))


def _crowds(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` vantage points in the midst of the crowds of a sample of unit vectors."""
    rng = np.random.default_rng(7)
    few = sample[rng.choice(len(sample), min(len(sample), 8192), replace=False)]
    chosen, far = [0], np.full(len(few), 4.0)
    while len(chosen) < n:
        far = np.minimum(far, np.maximum(0.0, 2.0 - 2.0 * (few @ few[chosen[-1]]).astype(np.float64)))
        far[chosen[-1]] = 0.0
        weight = far**4
        if weight.sum() <= 0:
            break
        chosen.append(int(rng.choice(len(few), p=weight / weight.sum())))
    points = few[chosen].copy()
    for _ in range(6):
        nearest = np.argmax(sample @ points.T, axis=1)
        order = np.argsort(nearest, kind="stable")
        names, begin = np.unique(nearest[order], return_index=True)
        sums = np.add.reduceat(sample[order], begin, axis=0)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        points[names] = np.where(length > 1e-6, sums / np.maximum(length, 1e-6), points[names])
    return points


class Coarse:
    """The vantage points of a group, the cells about them, the shard of each and, once measured, the range of its cosines with them."""

    def __init__(self, sample: np.ndarray, n: int):
        sample = unit(sample).astype(np.float32)
        self.pivots = _crowds(sample, int(np.clip(n // (2 * CELL), 1, min(PIVOTS, len(sample)))))
        points, aim = len(self.pivots), min(RINGS * PIVOTS, n // CELL)
        sims = sample @ self.pivots.T
        nearest, own = sims.argmax(axis=1), sims.max(axis=1)
        # Near regions follow one another; a ring holds about as many of the sample as any other.
        depth = int(np.log2(max(1, points // 4)))
        order = np.argsort(Tree(self.pivots, depth).leaves(self.pivots), kind="stable") if depth else np.arange(points)
        edges, region, weight = [], [], []
        for r in range(points):
            held = np.sort(own[nearest == r])
            rings = int(np.clip(round(len(held) / len(sample) * aim), 1, max(1, len(held) // 4)))
            edges += [4.0 * r - 2.0, *(4.0 * r + held[len(held) * i // rings].astype(np.float64) for i in range(1, rings))]
            region += [r] * rings
            weight += [len(held) / rings / len(sample)] * rings
        self.edges, self.region, weight = np.array(edges), np.array(region), np.array(weight)
        self.shards = max(-(-n // SHARD), LEAST_SHARDS if n > FEW else 1)
        # A region is in one shard, by the middle of its share, unless it is more than one holds.
        place = np.argsort(np.argsort(order)[self.region], kind="stable")
        shares = np.bincount(self.region, weight, points)
        before = np.zeros(points)
        before[order] = np.cumsum(shares[order]) - shares[order]
        middle = (before + shares / 2)[self.region]
        middle[place] = np.where(shares[self.region[place]] > 1 / self.shards, np.cumsum(weight[place]) - weight[place] / 2, middle[place])
        self.shard = np.minimum((middle * self.shards).astype(np.int32), self.shards - 1)
        self.low = np.full((len(region), points), 2.0, np.float32)
        self.high = np.full((len(region), points), -2.0, np.float32)

    def cell(self, vectors: np.ndarray) -> np.ndarray:
        out = np.zeros(len(vectors), np.int32)
        for at in range(0, len(vectors), _ROWS):
            sims = vectors[at : at + _ROWS].astype(np.float32) @ self.pivots.T
            key = 4.0 * sims.argmax(axis=1) + sims.max(axis=1).astype(np.float64)
            out[at : at + _ROWS] = np.searchsorted(self.edges, key, side="right") - 1
        return out

    def at_most(self, queries: np.ndarray, own: np.ndarray, cells: np.ndarray, factor: float) -> np.ndarray:
        """The greatest cosine of each query, of the region ``own``, with any vector of each of ``cells``; -9 for empty ones."""
        sims, region, share = queries @ self.pivots.T, self.region[cells], 1.0 / factor
        out = _greatest(sims[:, region], self.low[cells, region], self.high[cells, region], share)
        names, back = np.unique(own, return_inverse=True)
        low, high = (x[np.ix_(cells, names)].T for x in (self.low, self.high))
        # What the query's own vantage point says, for queries of a region at a time.
        for i in range(len(names)):
            mine = np.flatnonzero(back == i)
            out[mine] = np.minimum(out[mine], _greatest(sims[mine, names[i]][:, None], low[i], high[i], share))
        out[:, self.high[cells, 0] < -1.5] = -9.0
        return out


def _deal(coarse, kind: str):
    """Unit vectors with the cell and the shard they lie in."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("grp", sort=False):
                raw = np.stack(rows["raw"].to_numpy()).astype(kind)
                c = coarse.value.get(name)
                cell = c.cell(unit(raw)) if c else np.zeros(len(rows), np.int32)
                yield pd.DataFrame({"grp": name, "id": rows["id"].to_numpy(), "shard": c.shard[cell] if c else cell, "cell": cell, "vector": [v.tobytes() for v in raw]})

    return run


def _others(coarse, factor: float, kind: str):
    """The shards beside its own that may hold a neighbour of a query, by what its own shard has given."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, rows in batch.groupby("grp", sort=False):
                c = coarse.value[name]
                to = []
                for at in range(0, len(rows), _QUERY_CHUNK):
                    part = rows.iloc[at : at + _QUERY_CHUNK]
                    own = c.region[part["cell"].to_numpy()]
                    may = c.at_most(_stack(part["vector"], kind).astype(np.float32), own, np.arange(len(c.region)), factor) >= part["kth"].to_numpy(np.float64)[:, None]
                    may |= (own[:, None] == c.region) & (c.high[:, 0] >= -1.5)
                    going = np.zeros((len(part), c.shards), bool)
                    q, i = np.nonzero(may)
                    going[q, c.shard[i]] = True
                    going[np.arange(len(part)), part["shard"].to_numpy()] = False
                    to += [np.flatnonzero(g).astype(np.int32) for g in going]
                yield pd.DataFrame({"grp": name, "id": rows["id"].to_numpy(), "cell": rows["cell"].to_numpy(), "kth": rows["kth"].to_numpy(), "vector": rows["vector"].to_numpy(), "to": to})

    return run


#: Hits and, with ``cell``, the least and greatest cosines of a cell with the vantage points.
_HIT = "grp string, qid long, near long, sim double, cell int, low binary, high binary"
_ASKS, _BOTH = 1, 2


def _search(coarse, k: int, factor: float, kind: str, first: bool):
    """Queries, which may know how far their neighbours can be, in one shard; the first search measures the shard."""

    def run(both: pd.DataFrame) -> pd.DataFrame:
        queries, rows = both[both["asks"] > 0], both[both["asks"] != _ASKS]
        name = both["grp"].iloc[0]
        columns = {"grp": object, "qid": "int64", "near": "int64", "sim": "float64", "cell": "Int32", "low": object, "high": object}
        out = [pd.DataFrame({c: pd.Series([], dtype=t) for c, t in columns.items()})]
        c = coarse.value.get(name)
        if len(rows):
            shard = Shard(rows["id"].to_numpy(), _stack(rows["vector"], kind), rows["cell"].to_numpy())
            if first and c:
                c.low[shard.names], c.high[shard.names] = 2.0, -2.0
                shard.measure(c)
                measured = {"cell": shard.names, "low": [c.low[n].tobytes() for n in shard.names], "high": [c.high[n].tobytes() for n in shard.names]}
                out.append(pd.DataFrame({"grp": name, "qid": 0, "near": 0, "sim": 0.0} | measured))
            # Queries of a cell follow one another, so that they visit the same cells.
            queries = queries.sort_values(["cell", "id"])
            for at in range(0, len(queries), _QUERY_CHUNK):
                part = queries.iloc[at : at + _QUERY_CHUNK]
                best = Best(len(part), k)
                # Entries that no id stands for: what is as good as the k-th known one comes before them.
                best.sim[:] = part["kth"].to_numpy(np.float64)[:, None]
                shard.search(_stack(part["vector"], kind), part["cell"].to_numpy(), best, factor, c)
                there = (best.id != NONE).ravel()
                out.append(pd.DataFrame({"grp": name, "qid": np.repeat(part["id"].to_numpy(), k)[there], "near": best.id.ravel()[there], "sim": best.raw.ravel()[there]}))
        found = pd.concat(out[1:] or out, ignore_index=True)
        return found.reindex(columns=list(columns)).astype({"cell": "Int32"})

    return run


def _fit(corpus: DataFrame) -> tuple[dict[str, Coarse], int]:
    """Vantage points from about SAMPLE vectors of each group of more than FEW, chosen by a hash of their key.

    The driver holds the samples of such groups and, of each cell, the range of its cosines with the vantage points. The
    sample is a fixed share of the hashes, so that nothing is sorted for it, cut to SAMPLE where chance gave more.
    """
    counted = corpus.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > FEW)
    sizes = {r["grp"]: r["n"] for r in counted.collect()}
    if not sizes:
        return {}, 0
    share = small(cut(counted.select("grp", (F.lit(float(SAMPLE)) / F.col("n") * (1 << 30)).cast("long").alias("upto"))))
    taken = corpus.join(share, "grp").where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < F.col("upto"))
    rows = taken.select("grp", "id", "raw").toPandas().sort_values(["grp", "id"])
    return {name: Coarse(np.stack(part["raw"].to_numpy()[:SAMPLE]), sizes[name]) for name, part in rows.groupby("grp")}, max(sizes.values())


def _met(queries: DataFrame, rows: DataFrame, least: int, every: bool = False) -> DataFrame:
    """Queries and rows of each (grp, shard) in one place; many queries in ``least`` places or more, with the rows in each.

    With ``every`` rows come out that no query meets, too.
    """
    keys = ["grp", "shard"]
    parts = F.greatest(F.ceil(F.col("n") / SHARD), F.least(F.lit(least), F.ceil(F.col("n") / FEW)), F.lit(1)).cast("int")
    # As many rows as shards, which are an SHARD-th of the vectors or LEAST_SHARDS a group.
    present = queries.select(*keys, F.lit(1).alias("one"))
    if every:
        present = present.unionByName(rows.select(*keys, F.lit(0).alias("one")))
    counts = cut(present.groupBy(*keys).agg(F.sum("one").alias("n")).select(*keys, parts.alias("parts")))
    tasks = min(20_000, 4 * (counts.agg(F.sum("parts")).first()[0] or 1))
    counts = small(counts)
    asking = queries.join(counts, keys).select(
        *keys, F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(_ASKS).alias("asks"), "id", "cell", "kth", "vector"
    )
    held = rows.join(counts, keys).select(
        *keys, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("asks"), "id", "cell", F.lit(-2.0).alias("kth"), "vector"
    )
    return asking.unionByName(held).repartition(tasks, *keys, "part").groupBy(*keys, "part")


def vptree_topk(
    queries: DataFrame, corpus: DataFrame, k: int, factor: float = FACTOR, dim: int = 64, group: str | None = None
) -> DataFrame:
    """``[group,] qid, id, score, rank``: of every query the ``k`` most similar vectors of its group.

    ``queries(qid, vector)`` and ``corpus(id, vector)`` with whole numbers for keys and, if named, a column
    ``group`` on both. Ranks go by the score rounded to nine places, ties to the smaller id. Unusable vectors
    (null, all zero, not of ``dim`` numbers, with a null, NaN or infinity), null keys and null groups are left out;
    of repeated keys one counts. A group of fewer than k vectors gives fewer rows. Exact with ``factor`` 1.
    """
    ship(queries.sparkSession)
    name = F.lit("") if group is None else F.col(f"`{group}`").cast("string")
    same = queries is corpus
    single = all(isinstance(df.schema["vector"].dataType.elementType, T.FloatType) for df in (queries, corpus))
    kind, number = ("f4", "float") if single else ("f8", "double")

    def clean(df: DataFrame, key: str) -> DataFrame:
        good = df.where(sound(F.col("vector"), dim)).select(name.alias("grp"), F.col(key).cast("long").alias("id"), F.col("vector").cast(f"array<{number}>").alias("raw"))
        return good.where("grp IS NOT NULL AND id IS NOT NULL").dropDuplicates(["grp", "id"])

    lead = [] if group is None else [F.col("grp").alias(group)]
    found = _topk(None if same else cut(clean(queries, "qid")), cut(clean(corpus, "id")), k, factor, kind)
    return found.select(*lead, "qid", "id", "score", "rank")


def self_topk(entries: DataFrame, k: int, factor: float = FACTOR) -> DataFrame:
    """``grp, qid, id, score, rank`` of ``entries(grp, id, raw)``: every vector a query, itself among its neighbours.

    The entries are taken as they are: sound single-precision vectors of unique keys, written already.
    """
    ship(entries.sparkSession)
    return _topk(None, entries, k, factor, "f4")


def _topk(queries: DataFrame | None, held: DataFrame, k: int, factor: float, kind: str) -> DataFrame:
    """The search in ``held``, for ``queries`` or, without any, for ``held`` itself."""
    spark = held.sparkSession
    coarse, most = _fit(held)
    shared = spark.sparkContext.broadcast(coarse)
    dealt = "grp string, id long, shard int, cell int, vector binary"
    rows = cut(held.mapInPandas(_deal(shared, kind), dealt))
    asked = rows if queries is None else cut(queries.mapInPandas(_deal(shared, kind), dealt))
    search = _search(shared, k, factor, kind, True)
    if queries is None:
        # Every vector is shuffled once, as a query and as a row.
        tasks = 4 * sum([1, *(c.shards for c in coarse.values())])
        met = rows.select("grp", "shard", F.lit(_BOTH).alias("asks"), "id", "cell", F.lit(-2.0).alias("kth"), "vector").repartition(tasks, "grp", "shard").groupBy("grp", "shard")
    else:
        met = _met(asked.withColumn("kth", F.lit(-2.0)), rows, 1, every=True)
    first = cut(met.applyInPandas(search, _HIT))
    own = first.where("cell IS NULL").select("grp", "qid", "near", "sim")
    hits = own
    if most > FEW:
        large = [g for g, c in coarse.items() if c.shards > 1]
        in_large = F.col("grp").isin(large)
        for r in first.where("cell IS NOT NULL").select("grp", "cell", "low", "high").coalesce(8).toLocalIterator():
            c = coarse[r["grp"]]
            c.low[r["cell"]] = np.minimum(c.low[r["cell"]], np.frombuffer(r["low"], np.float32))
            c.high[r["cell"]] = np.maximum(c.high[r["cell"]], np.frombuffer(r["high"], np.float32))
        measured = spark.sparkContext.broadcast(coarse)
        # How far the neighbours can be: the similarity of the k-th found so far.
        kth = own.groupBy("grp", F.col("qid").alias("id")).agg(F.when(F.count(F.lit(1)) >= k, F.round(F.min("sim"), DIGITS)).otherwise(-2.0).alias("kth"))
        known = asked.where(in_large).join(kth, ["grp", "id"], "left").fillna(-2.0, ["kth"])
        going = cut(known.mapInPandas(_others(measured, factor, kind), "grp string, id long, cell int, kth double, vector binary, to array<int>").where(F.size("to") > 0))
        far = going.select("grp", F.explode("to").alias("shard"), "id", "cell", "kth", "vector")
        searched = _met(far, rows.where(in_large), 2).applyInPandas(_search(measured, k, factor, kind, False), _HIT)
        hits = own.unionByName(searched.select("grp", "qid", "near", "sim"))
    order = Window.partitionBy("grp", "qid").orderBy(ranked("sim"), "near")
    best = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("grp", "qid", F.col("near").alias("id"), F.col("sim").alias("score"), "rank")
