"""Search by vantage-point trees against brute force: exact with factor one, recall with the production factor."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from statuta.operators import vptree as V


def vectors(seed, n, dim=16):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, dim))
    v = centres[rng.integers(9, size=n)] + 0.4 * rng.normal(size=(n, dim))
    v[: n // 20] = v[0]
    v[n // 2] = 4 * v[n // 2 - 1]
    return v.astype(np.float32)


def frame(spark, v, key, first=0, group=False):
    rows = [(i + first, "a" if i % 3 or not group else "b", [float(x) for x in r]) for i, r in enumerate(v)]
    return spark.createDataFrame(rows, f"{key} long, g string, vector array<float>")


def brute(q, c, k):
    unit = lambda m: m.astype(np.float64) / np.linalg.norm(m.astype(np.float64), axis=1, keepdims=True)
    s = np.round(unit(q) @ unit(c).T, 9)
    return {i: [int(j) for j in np.lexsort((np.arange(len(c)), -s[i]))[:k]] for i in range(len(q))}


def found(df):
    out = {}
    for r in df.orderBy("qid", "rank").collect():
        out.setdefault(r.qid, []).append(r.id)
    return out


@pytest.mark.parametrize("few,shard,pivots", [(10_000, 100_000, 127), (100, 100_000, 127), (100, 60, 5), (50, 700, 3)])
def test_exact_with_factor_one(spark, monkeypatch, few, shard, pivots):
    for name, value in (("FEW", few), ("SHARD", shard), ("PIVOTS", pivots)):
        monkeypatch.setattr(V, name, value)
    c, q = vectors(1, 900), vectors(2, 300)
    assert found(V.vptree_topk(frame(spark, q, "qid"), frame(spark, c, "id"), 7, 1.0, 16)) == brute(q, c, 7)


def test_recall_and_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "FEW", 100)
    c = vectors(3, 1500)
    df = frame(spark, c, "id", group=True)
    wanted = {}
    for rest in (True, False):
        ids = [i for i in range(1500) if bool(i % 3) is rest]
        wanted |= {ids[i]: [ids[j] for j in near] for i, near in brute(c[ids], c[ids], 6).items()}
    got = found(V.vptree_topk(df, df, 6, dim=16, group="g"))
    assert set(got) == set(wanted) and sum(len(set(got[i]) & set(wanted[i])) for i in wanted) >= 0.95 * 6 * len(wanted)
    assert V.vptree_topk(df, df, 6, dim=16, group="g").columns == ["g", "qid", "id", "score", "rank"]


def test_unusable_and_few(spark):
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.1]), (2, [2.0, 0.1]), (3, None), (4, [0.0, 0.0]), (5, [1.0]), (None, [1.0, 1.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0])]
    c = spark.createDataFrame(rows, "id long, vector array<double>").withColumn("shard", F.lit("x"))
    q = spark.createDataFrame([(9, [0.0, 1.0]), (10, None)], "qid long, vector array<float>")
    assert found(V.vptree_topk(q, c, 3, 1.0, 2)) == {9: [2, 1]}
    assert V.vptree_topk(q.limit(0), c, 3, 1.0, 2).count() == 0 and V.vptree_topk(q, c.limit(0), 3, 1.0, 2).count() == 0


def test_tree_covers_all():
    v = V.unit(np.random.default_rng(1).normal(size=(500, 64)))
    leaves = V.Tree(v, 4).leaves(v)
    assert set(leaves) <= set(range(16)) and np.bincount(leaves, minlength=16).max() < 80


@pytest.mark.parametrize("factor,least", [(1.0, 1.0), (V.FACTOR, 0.97)])
def test_crowds_are_not_searched_from_others(monkeypatch, factor, least):
    # 60 crowds of uneven size: a query is scored with vectors of its own crowd and few others, not with half of all.
    rng = np.random.default_rng(5)
    centres = V.unit(rng.normal(size=(60, 64)))
    crowd = np.minimum(rng.geometric(0.05, size=12_000) - 1, 59)
    v = V.unit(centres[crowd] + 0.07 * rng.gamma(3.0, 0.33, size=(12_000, 1)) * rng.normal(size=(12_000, 64)))
    coarse = V.Coarse(v, len(v))
    cells = coarse.cell(v)
    shard = V.Shard(np.arange(len(v)), v, cells)
    shard.measure(coarse)
    scored, offer = [], V.Best.offer
    monkeypatch.setattr(V.Best, "offer", lambda self, rows, rough, *rest: (scored.append(rough.size), offer(self, rows, rough, *rest))[1])
    asked = np.argsort(cells, kind="stable")[::12]
    best = V.Best(len(asked), 6)
    shard.search(v[asked], cells[asked], best, factor, coarse)
    s = np.round(v[asked] @ v.T, 9)
    wanted = [set(np.lexsort((np.arange(len(v)), -row))[:6]) for row in s]
    assert sum(len(w & set(got)) for w, got in zip(wanted, best.id)) >= least * 6 * len(asked)
    if factor > 1:
        assert sum(scored) < 0.15 * s.size
