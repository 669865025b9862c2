"""Shared spans: windows against a Cartesian tree, pairs and coverage against brute force."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import spans as S


def tree_windows(values, width):
    """Nodes of the Cartesian tree that span at least ``width``, by recursion on the leftmost minimum."""
    out, stack = set(), [(0, len(values) - 1)]
    while stack:
        lo, hi = stack.pop()
        if hi - lo + 1 < width:
            continue
        c = min(range(lo, hi + 1), key=lambda i: (values[i], i))
        out.add((max(lo, c - width + 1), c, min(hi, c + width - 1)))
        stack += [(lo, c - 1), (c + 1, hi)]
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=60), st.integers(1, 9))
def test_compact_windows(values, width):
    keyed = np.array([v << 32 for v in values], np.uint64)
    got = set(zip(*(x.tolist() for x in S.compact_windows(keyed, width)))) if len(values) >= width else set()
    assert got == tree_windows(values, width)


def test_gram_values():
    rng = random.Random(1)
    text = "".join(rng.choice("abż𝖺 ") for _ in range(400))
    values = S.gram_values(S._codes(text), 5)
    grams = [text[i : i + 5] for i in range(len(text) - 4)]
    assert len(set(zip(values.tolist(), grams))) == len(set(grams)) == len(set(values.tolist()))


def texts(seed):
    rng = random.Random(seed)
    letters = "abcdefgh żółć\n"
    make = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [make(n) for n in (299, 300, 301, 420, 700)] + ["z" * 350, "ab" * 200]
    docs = []
    for d in range(60):
        t = make(rng.randrange(0, 500))
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            at = rng.randrange(len(t) + 1)
            t = t[:at] + s + t[at:]
        docs.append((d, t))
    return [*docs, (100, docs[3][1]), (101, docs[3][1]), (102, None), (103, ""), (None, "q" * 400), docs[5]]


def brute(docs, least):
    by, held = {}, {}
    for d, t in docs:
        if d is not None:
            held[d] = t or ""
            for i in range(len(held[d]) - least + 1):
                by.setdefault(held[d][i : i + least], set()).add(d)
    pairs = {(a, b) for s in by.values() for a in s for b in s if a < b}
    cover = {d: len({j for i in range(len(t) - least + 1) if len(by[t[i : i + least]]) > 1 for j in range(i, i + least)}) for d, t in held.items()}
    return pairs, cover, held


@pytest.mark.parametrize("seed,least,meeting", [(1, 300, 1024), (2, 300, 3), (3, 100, 2), (4, 250, 1024), (5, 249, 7), (6, 5, 1024)])
def test_pairs_and_coverage(spark, monkeypatch, seed, least, meeting):
    monkeypatch.setattr(S, "MEETING", meeting)
    docs = texts(seed) if least > 5 else [(i, "".join(random.Random(i).choice("ab") for _ in range(i % 12))) for i in range(60)]
    pairs, cover, held = brute(docs, least)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {(r.doc_a, r.doc_b) for r in S.shared_pairs(df, least=least).collect()}
    rep = {d: min(x for x, t in held.items() if t == held[d]) for d in held}
    assert got <= pairs
    # No link between different texts is lost; copies are linked to their representative.
    assert {tuple(sorted((rep[a], rep[b]))) for a, b in got if rep[a] != rep[b]} == {tuple(sorted((rep[a], rep[b]))) for a, b in pairs if rep[a] != rep[b]}
    assert all((min(rep[d], d), max(rep[d], d)) in got for d in held if rep[d] != d and len(held[d]) >= least)
    rows = {r.doc_id: (r.n_chars, r.shared_chars) for r in S.coverage(df, least=least).collect()}
    assert rows == {d: (len(t), cover[d]) for d, t in held.items()}


def test_several_hashes_and_members(spark):
    df = spark.createDataFrame(texts(7), "doc_id long, text string")
    runs = lambda n: {(r.doc_a, r.doc_b) for r in S.representative_runs(df, hashes=n).collect()}
    assert runs(1) == runs(3) and runs(1)
    rep = {r.doc_id: r.rep for r in S.classes(df).collect()}
    assert rep[100] == rep[101] == rep[3] == 3 and 102 not in rep and rep[103] == min(d for d, t in texts(7) if t == "")


def test_long_repetitions_are_compared_once(spark):
    """Two texts of one repeated letter share every place with every place; the work grows with their lengths only."""
    df = spark.createDataFrame([(1, "z" * 6000), (2, "y" + "z" * 7000), (3, "x" * 400)], "doc_id long, text string")
    assert [tuple(r) for r in S.shared_pairs(df).collect()] == [(1, 2)]
    assert {r.doc_id: r.shared_chars for r in S.coverage(df).collect()} == {1: 6000, 2: 7000, 3: 0}


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert S.shared_pairs(none).count() == 0 and S.coverage(none).count() == 0
