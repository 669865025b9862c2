"""Trees, keyword propagation, chunking and reconstruction on the mini fixtures."""

import pytest
from pyspark.sql import functions as F

from statuta.operators import chunks as K
from statuta.operators import trees as T
from statuta.plans import retrieval as R

NODES = "nro long, pos long, node_id string, parent string, children array<string>, text string, keywords array<struct<label: string, conceptId: bigint, instanceOfType: bigint>>"
ROWS = [
    (100, 0, "art(1)", None, ["art(1)ust(1)", "art(1)ust(2)"], "A1", [("k", 1, 2)]), (100, 1, "art(1)ust(1)", "art(1)", [], "u1", None),
    (100, 2, "art(1)ust(2)", "art(1)", ["art(1)ust(2)pkt(1)"], "u2", [("l", 3, 4), ("k", 1, 2)]), (100, 3, "art(1)ust(2)pkt(1)", "art(1)ust(2)", [], "p1", []),
    (100, 4, "art(2)", None, [], "(uchylony)", []), (100, 5, "art(3)", None, ["art(3)ust(1)"], "A3", []), (100, 6, "art(3)ust(1)", "art(3)", [], "u31", []),
    (100, 7, "art(4)", None, [], "A4", []),
]


@pytest.fixture(scope="module")
def nodes(spark):
    return spark.createDataFrame(ROWS, NODES)


def test_vectors_and_parts(nodes):
    vectors = K.chunk_vectors(nodes)
    got = [(r.parent_id, r.node_ids, r.text, r.parent_tokens, r.text_tokens, r.reconstruct_id, r.chunk_id, r.total_chunks) for r in vectors.orderBy("root_pos", "ord").collect()]
    assert got == [
        ("art(1)", ["art(1)", "art(1)ust(1)"], "A1 u1", 1, 1, "art(1)ust(1)", None, None),
        ("art(1)", ["art(1)", "art(1)ust(2)", "art(1)ust(2)pkt(1)"], "A1 u2 p1", 1, 2, "art(1)ust(2)", None, None),
        ("art(3)", ["art(3)", "art(3)ust(1)"], "A3 u31", 1, 1, "art(3)", None, None), ("art(4)", ["art(4)"], "A4", 0, 1, "art(4)", None, None),
    ]
    parts = [(r.key, r.cite_id, r.text) for r in K.reconstruct_parts(vectors).orderBy("pos").collect()]
    assert parts == [(k, k, t) for k, t in [("art(1)", "A1"), ("art(1)ust(1)", "u1"), ("art(1)ust(2)", "u2 p1"), ("art(3)", "A3"), ("art(4)", "A4")]]
    full = {r.reconstruct_id: r.part_text for r in K.chunk_vectors(nodes, full_text=True).collect()}
    assert full["art(3)"] == "A3 u31"
    keywords = {r.reconstruct_id: [k.conceptId for k in r.keywords] for r in vectors.collect()}
    assert keywords["art(1)ust(2)"] == [1, 3]


@pytest.mark.parametrize(
    "root,child,sizes,ids,parent_tokens",
    [
        (3, None, [3], [None], 0), (4, None, [3, 1], [1, 2], 0), (1, 3, [4], [None], 1), (2, 8, [4, 4, 2], [1, 2, 3], 0),
    ],
)
def test_chunk_rules(spark, root, child, sizes, ids, parent_tokens):
    rows = [(1, 0, "art(1)", None, ["art(1)ust(1)"] if child else [], " ".join(f"r{i}" for i in range(root)), [])]
    if child:
        rows.append((1, 1, "art(1)ust(1)", "art(1)", [], " ".join(f"c{i}" for i in range(child)), []))
    got = K.chunk_vectors(spark.createDataFrame(rows, NODES), limit=4).orderBy("ord").collect()
    assert [len(r.text.split()) for r in got] == sizes
    assert [r.chunk_id for r in got] == ids
    assert {r.parent_tokens for r in got} == {parent_tokens}


def test_equal_chunks_keep_their_numbers(spark):
    got = K.chunk_vectors(spark.createDataFrame([(1, 0, "art(1)", None, [], "a b a b", [])], NODES), limit=2).orderBy("ord").collect()
    assert [r.reconstruct_id for r in got][:2] == ["art(1)_1", "art(1)_2"]


RELATION = "conceptId long, instanceOfType long, nro long, units array<string>"


@pytest.mark.parametrize(
    "units,positions",
    [
        (None, list(range(8))), ([], []), (["art(1)ust(2)"], [2, 3]), (["art(1)ust(2)-art(3)"], [2, 3, 4, 5, 6]), (["art(9)-art(3)"], []),
        (["art(3)-art(9)"], [5, 6, 7]), (["art(3)-art(1)"], []),
    ],
)
def test_propagation(spark, nodes, units, positions):
    acts = spark.createDataFrame([(100, [("k", 1, 2)])], "nro long, keywords array<struct<label: string, conceptId: bigint, instanceOfType: bigint>>")
    got = T.propagate_keywords(acts, spark.createDataFrame([(1, 2, 100, units), (5, 5, 100, None)], RELATION), nodes)
    at = {r[2]: r[1] for r in ROWS}
    assert sorted(at[r.node_id] for r in got.collect()) == positions


def test_reachable_by_brute_force(spark):
    """Trees, second parents, loops and absent children; several groups of starts."""
    import random

    rng = random.Random(8)
    rows, down = [], {}
    for tree in (1, 2):
        for i in range(60):
            children = [f"n{c}" for c in range(i + 1, 60) if rng.random() < 0.04] + [f"n{rng.randrange(60)}"] * (rng.random() < 0.08) + ["absent"] * (rng.random() < 0.1)
            rows.append((tree, i, f"n{i}", None, children if rng.random() < 0.9 else None, "", []))
            down[tree, f"n{i}"] = [c for c in rows[-1][4] or [] if c != "absent"]
    starts = [(g, tree, f"n{rng.randrange(60)}") for g in ("x", "y") for tree in (1, 2) for _ in range(4)] + [("x", 1, "n59")]
    expected = set()
    for g, tree, node in starts:
        seen, waiting = {node}, [node]
        while waiting:
            for c in down[tree, waiting.pop()]:
                if c not in seen:
                    seen.add(c)
                    waiting.append(c)
        expected |= {(g, tree, n) for n in seen}
    nodes = spark.createDataFrame(rows, NODES)
    got = T.reachable(spark.createDataFrame(starts, "g string, nro long, node_id string"), T.edges(nodes), ["g"]).collect()
    assert sorted((r.g, r.nro, r.node_id) for r in got) == sorted(expected)


def test_loops_end(spark):
    rows = [(1, 0, "a", "c", ["b"], "x", []), (1, 1, "b", "a", ["c"], "y", []), (1, 2, "c", "b", ["a"], "z", []), (1, 3, "d", None, ["d"], "w", [])]
    looped = spark.createDataFrame(rows, NODES)
    found = {(r.node_id, r.kind) for r in T.backward_references(looped).collect()}
    assert found == {("a", "three"), ("b", "three"), ("c", "three"), ("d", "self")}
    start = looped.where("node_id = 'a'").select("nro", "node_id")
    assert T.reachable(start, T.edges(looped), []).count() == 3
    roots = looped.where("node_id = 'a'").select("nro", F.col("node_id").alias("root"), "pos")
    assert [r.node_id for r in T.preorder(looped, roots).orderBy("seq").collect()] == ["a", "b", "c"]


def test_reconstruction_prefixes_once(spark, nodes):
    stored = K.reconstruct_parts(K.chunk_vectors(nodes))
    acts = spark.createDataFrame([(100, "T", "https://x.example/akt-100/")], "nro long, title string, citeLink string")
    hits = spark.createDataFrame([(1, 100, "art(1)", "art(1)ust(1)"), (1, 100, "art(1)", "art(1)ust(1)"), (2, 100, "art(1)", "art(1)ust(1)")], "qid long, act long, parent_id string, reconstruct_id string")
    got = R.reconstruct(hits, stored, acts).orderBy("qid", "pos").collect()
    assert [(r.qid, r.text, r.cite_id) for r in got] == [
        (q, t, f"https://x.example/akt-100?unitId={k}") for q in (1, 2) for t, k in (("A1", "art(1)"), ("u1", "art(1)ust(1)"))
    ]


def test_empty(spark):
    none = spark.createDataFrame([], NODES)
    assert K.chunk_vectors(none).count() == 0 and T.leaf_roots(none).count() == 0
