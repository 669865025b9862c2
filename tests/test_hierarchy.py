"""Hierarchies against brute force, and their edge cases."""

import random

import pytest
from pyspark.sql import functions as F

import statuta.operators.hierarchy as H

SCHEMA = "nro long, node_id string, pos long, parent string, children array<string>"


def brute(rows):
    """Sound nodes with their path, by peeling."""
    ids = {(r[0], r[1]): r[2] for r in rows}
    up = {k: {} for k in ids}
    for nro, node, _, parent, children in rows:
        if (nro, parent) in ids:
            up[nro, node][parent] = 0
        for c in children or []:
            if (nro, c) in ids:
                up[nro, c].setdefault(node, 1)
    path, changed = {}, True
    while changed:
        changed = False
        for key in ids:
            if key not in path and all((key[0], p) in path for p in up[key]):
                first = min(up[key], key=lambda p: (up[key][p], ids[key[0], p]), default=None)
                path[key] = (path[key[0], first] if first is not None else []) + [key[1]]
                changed = True
    return path


def graph(seed, n):
    rng = random.Random(seed)
    rows = []
    for tree in range(3):
        for i in range(n):
            parent = f"n{rng.randrange(max(1, i))}" if i and rng.random() < 0.8 else None
            if rng.random() < 0.05:
                parent = f"n{rng.randrange(n)}"
            children = [f"n{rng.randrange(n)}" for _ in range(rng.random() < 0.08)] + ["absent"] * (rng.random() < 0.1)
            rows.append((tree, f"n{i}", i, parent, children if rng.random() < 0.9 else None))
    return rows


@pytest.mark.parametrize("seed,n,width,fit,star", [(1, 30, 512, 99, 99), (2, 60, 4, 99, 99), (3, 200, 8, 5, 99), (4, 120, 1, 3, 2), (5, 150, 4, 0, 1)])
def test_equals_brute_force(spark, monkeypatch, seed, n, width, fit, star):
    """Few and many levels, wide and narrow fragments, and nodes with several parents that fit nowhere."""
    monkeypatch.setattr(H, "FIT", fit)
    monkeypatch.setattr(H, "STAR", star)
    rows = graph(seed, n)
    found = H.hierarchy(spark.createDataFrame(rows, SCHEMA), width=width).collect()
    path = brute(rows)
    assert len(found) == 3 * n
    for r in found:
        expected = path.get((r.nro, r.node_id))
        assert r.broken == (expected is None)
        assert r.path == expected
        assert (r.root, r.depth) == ((expected[0], len(expected) - 1) if expected else (None, None))


def test_without_paths_and_broken_alone(spark, monkeypatch):
    monkeypatch.setattr(H, "FIT", 20)
    df = spark.createDataFrame(graph(7, 150), SCHEMA)
    full = {(r.nro, r.node_id): (r.broken, r.root, r.depth) for r in H.hierarchy(df, width=4).collect()}
    short = H.hierarchy(df, width=4, paths=False)
    assert short.columns == ["nro", "node_id", "broken", "root", "depth"]
    assert {(r.nro, r.node_id): (r.broken, r.root, r.depth) for r in short.collect()} == full
    assert {(r.nro, r.node_id) for r in H.broken_nodes(df, width=4).collect()} == {k for k, v in full.items() if v[0]}


def test_groups_are_kept_whole(monkeypatch):
    import pandas as pd

    monkeypatch.setattr(H, "_CHUNK_ROWS", 7)
    rows = pd.DataFrame({"tree": ["a"] * 30 + ["b"] * 20, "frag": [0] * 2 + [1] * 25 + [2] * 3 + [0] * 1 + [1] * 19, "n": range(50)})
    for size in (1, 3, 8, 50):
        out = list(H._whole_groups(rows.iloc[i : i + size] for i in range(0, 50, size)))
        assert pd.concat(out)["n"].tolist() == list(range(50))
        ends = [set(zip(o["tree"], o["frag"])) for o in out]
        assert sum(map(len, ends)) == len(set().union(*ends))


@pytest.mark.parametrize("spread", [False, True])
def test_long_chain_across_fragments(spark, monkeypatch, spread):
    monkeypatch.setattr(H, "FIT", 8 if spread else H.FIT)
    n = 700
    rows = [(1, f"c{i}", i, f"c{i - 1}" if i else None, None) for i in range(n)] + [(1, "x", n, "y", None), (1, "y", n + 1, "x", None), (1, "z", n + 2, "y", None)]
    found = H.with_descendant_counts(H.hierarchy(spark.createDataFrame(rows, SCHEMA), width=50)).collect()
    by = {r.node_id: r for r in found}
    assert by["c699"].depth == 699 and by["c699"].root == "c0" and by["c0"].n_descendants == 699
    assert [by[k].broken for k in "xyz"] == [True] * 3 and by["z"].path is None and by["z"].n_descendants is None


def test_edge_cases(spark):
    assert H.hierarchy(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [
        (None, "a", 0, None, None), (1, None, 0, None, None), (1, "a", 0, "", ["a2", "a2"]), (1, "a", 0, "", ["a2"]), (1, "a2", 1, None, []),
        (1, "s", 2, "s", None), (1, "", 3, None, None),
    ]
    extra = spark.createDataFrame(rows, SCHEMA).withColumn("tree", F.lit("x")).withColumn("kind", F.lit(7)).withColumn("path", F.lit("p"))
    found = {r.node_id: r for r in H.hierarchy(extra).collect()}
    assert set(found) == {"a", "a2", "s", ""}
    # '' is a node here, and thus a parent like any other.
    assert found["a2"].path == ["", "a", "a2"] and found["s"].broken


def test_descendants_are_pairs(spark):
    rows = [(1, "r", 0, None, ["a", "b"]), (1, "a", 1, "r", ["c"]), (1, "b", 2, "r", None), (1, "c", 3, "a", None)]
    pairs = H.descendants(H.hierarchy(spark.createDataFrame(rows, SCHEMA))).collect()
    assert {(p.ancestor, p.descendant, p.distance) for p in pairs} == {("r", "a", 1), ("r", "b", 1), ("r", "c", 2), ("a", "c", 1)}


def closure(rows):
    """Pairs by any chain of links, from sound ancestors."""
    ids = {(r[0], r[1]) for r in rows}
    down = {k: set() for k in ids}
    for nro, node, _, parent, children in rows:
        if (nro, parent) in ids:
            down[nro, parent].add(node)
        down[nro, node] |= {c for c in children or [] if (nro, c) in ids}
    pairs = set()
    for nro, top in brute(rows):
        seen, todo = set(), [top]
        while todo:
            new = down[nro, todo.pop()] - seen
            seen |= new
            todo += new
        pairs |= {(nro, top, x) for x in seen}
    return pairs


def test_all_descendants_of_second_parents_and_above_loops(spark):
    rows = [
        (1, "r", 0, None, ["a", "b"]), (1, "a", 1, "r", None), (1, "b", 2, "r", ["c"]), (1, "c", 3, "a", None), (1, "d", 4, "c", ["e"]),
        (1, "x", 5, "c", ["y"]), (1, "y", 6, "x", ["x"]), (1, "z", 7, "y", None),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = H.hierarchy(df)
    pairs = H.all_descendants(df, found)
    got = {(p.nro, p.ancestor, p.descendant) for p in pairs.collect()}
    assert got == closure(rows) and pairs.count() == len(got)
    assert {(1, "b", "c"), (1, "b", "d"), (1, "r", "z"), (1, "b", "y")} <= got
    along = {(p.nro, p.ancestor, p.descendant) for p in H.descendants(found).collect()}
    assert along < got
    counts = {r.node_id: r.n_descendants for r in H.with_descendant_counts(found, pairs=pairs).collect()}
    assert counts == {"r": 7, "a": 5, "b": 5, "c": 4, "d": 0, "x": None, "y": None, "z": None}
    assert H.all_descendants(df.limit(0), H.hierarchy(df.limit(0))).count() == 0


@pytest.mark.parametrize("seed,n", [(1, 30), (4, 120)])
def test_all_descendants_by_brute_force(spark, seed, n):
    df = spark.createDataFrame(graph(seed, n), SCHEMA)
    got = [(p.nro, p.ancestor, p.descendant) for p in H.all_descendants(df, H.hierarchy(df)).collect()]
    assert set(got) == closure(graph(seed, n)) and len(got) == len(set(got))
