"""Nearest vectors against brute force: exact with factor one, recall with the production factor."""

import numpy as np
import pytest

from statuta.llm import neighbours as N

SCHEMA = "point_id long, coll string, embedding array<float>"


def points(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 64))
    v = centres[rng.integers(12, size=n)] + 0.5 * rng.normal(size=(n, 64))
    v[: n // 6] = v[0]  # a class of equal vectors
    v[n // 2] = 3 * v[n // 2 - 1]
    rows = [(int(i), "a" if i % 3 else "b", [float(x) for x in v[i].astype(np.float32)]) for i in range(n)]
    return [*rows, (n, "a", None), (n + 1, "a", [0.0] * 64), (n + 2, "a", [1.0] * 32), (n + 3, None, rows[1][2]), (None, "a", rows[1][2]), rows[5], (n + 4, "a", [float("nan")] * 64)]


def brute(rows, k=5):
    out = {}
    clean = {}
    for i, c, v in rows:
        if i is not None and c is not None and v is not None and len(v) == 64 and any(v) and all(np.isfinite(v)):
            clean.setdefault(c, {})[i] = v
    for group in clean.values():
        ids = np.array(sorted(group))
        m = np.array([group[i] for i in ids], np.float64)
        m /= np.linalg.norm(m, axis=1, keepdims=True)
        s = np.round(m @ m.T, 6)
        for row, i in enumerate(ids):
            s[row, row] = -9
            out[int(i)] = [(float(s[row, j]), int(ids[j])) for j in np.argsort(-s[row], kind="stable")[:k]]
    return out


@pytest.mark.parametrize("n,factor,least", [(600, 1.0, 1.0), (600, N.FACTOR, 0.95)])
def test_recall(spark, n, factor, least):
    rows = points(3, n)
    expected = brute(rows)
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SCHEMA), factor=factor).collect():
        got.setdefault(r.point_id, []).append((r.rank, r.near, r.similarity))
    assert set(got) == set(expected)
    right = total = 0
    for i, wanted in expected.items():
        mine = sorted(got[i])
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and i not in [m[1] for m in mine]
        border = wanted[-1][0]
        right += sum(m[2] >= border - 1e-5 for m in mine)
        total += 5
    assert right / total >= least


def test_ties_go_to_the_smaller_key(spark):
    same = [1.0] + [0.0] * 63
    rows = [(i, "a", same) for i in range(40, 0, -1)] + [(99, "a", [0.0, 1.0] + [0.0] * 62)]
    got = {}
    for r in N.nearest(spark.createDataFrame(rows, SCHEMA)).orderBy("point_id", "rank").collect():
        got.setdefault(r.point_id, []).append(r.near)
    assert got[3] == [1, 2, 4, 5, 6] and got[40] == [1, 2, 3, 4, 5] and got[99] == [1, 2, 3, 4, 5]


def test_few_and_none(spark):
    rows = [(1, "a", [1.0] + [0.0] * 63), (2, "a", [1.0, 1.0] + [0.0] * 62), (3, "b", [1.0] + [0.0] * 63)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.point_a, r.point_b) for r in N.neighbour_pairs(N.nearest(df)).collect()} == {(1, 2)}
    assert N.nearest(df.limit(0)).count() == 0
