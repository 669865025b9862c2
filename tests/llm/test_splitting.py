"""Splitting: round trips, limits, overlaps, boundaries, range maxima."""

import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from statuta.llm import splitting as S

WORD = re.compile(r"[^ \t\r\n]+")


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=80), st.data())
def test_range_maximum(values, data):
    low = data.draw(st.integers(0, len(values) - 1))
    high = data.draw(st.integers(low, len(values) - 1))
    best = max(range(low, high + 1), key=lambda i: (values[i], i))
    assert S.RangeMaximum(values, len(values)).strongest(low, high) == (values[best], best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b.", "C", "c,", "art.", "5", "D!"]), max_size=120), st.lists(st.sampled_from([" ", "\n\n", "\t", "  ", "\r\n", " x "]), min_size=1, max_size=9), st.integers(8, 30), st.integers(0, 3))
def test_round_trip(parts, gaps, limit, overlap):
    text = "".join(w + gaps[i % len(gaps)] for i, w in enumerate(parts))
    pieces = S.split(text, limit, overlap)
    words = [WORD.findall(p) for p in pieces]
    assert all(len(w) <= limit for w in words)
    if len(pieces) == 1:
        assert pieces == [text]
        return
    assert all(a[len(a) - overlap :] == b[:overlap] for a, b in zip(words, words[1:]))
    # Without the shared words the pieces are the whole text, separators included.
    whole = pieces[0]
    for piece in pieces[1:]:
        at = [m.start() for m in WORD.finditer(piece)][overlap]
        whole += piece[at:]
    assert whole == text


@pytest.mark.parametrize("mark,strength", [("x.\nY", 3), ("x. Y", 2), ("x, y", 1), ("x y", 0), ("art. 5", 0), ("x. y", 0), ("x? y", 2), ("x; Y", 1), ("„x.” Y", 2)])
def test_strengths(mark, strength):
    spans = np.array([m.span() for m in WORD.finditer(mark)]).reshape(-1, 2)
    assert list(S.strengths(mark, spans)) == [strength]


def test_strongest_boundary_wins_and_ties_go_right():
    text = " ".join(["w"] * 5 + ["s."] + ["W"] * 2 + ["s."] + ["W"] * 8)
    assert len(WORD.findall(S.split(text, 10, 1)[0])) == 9
    text = " ".join(["w"] * 6) + ".\n" + " ".join(["W"] * 2) + ". " + " ".join(["W"] * 9)
    assert len(WORD.findall(S.split(text, 10, 1)[0])) == 6
    # No boundary in the preferred half of the window: an earlier one serves.
    text = "w w. " + " ".join(["W"] * 20)
    assert [len(WORD.findall(p)) for p in S.split(text, 10, 1)][:2] == [2, 10]


def test_frame(spark):
    long = " ".join(f"w{i}" for i in range(1300))
    rows = [(1, long, "k"), (1, long, "k"), (2, "short", "k"), (3, None, "k"), (4, " \n", "k"), (5, " ".join(["x"] * 512), "k"), (6, " ".join(["x"] * 600), "k")]
    df = spark.createDataFrame(rows, "id int, text string, piece string")
    got = S.split_oversized(df, "text").orderBy("id", "chunk_id").collect()
    assert [r.chunk_id for r in got] == [1, 1, 2, 2, 3, 3] and {r.total_chunks for r in got} == {3} and {r.id for r in got} == {1}
    assert S.split_oversized(df.limit(0), "text").count() == 0
    counts = {r.id: r.n for r in df.select("id", S.word_count(df["text"]).alias("n")).collect()}
    assert counts == {1: 1300, 2: 1, 3: None, 4: 0, 5: 512, 6: 1}
    with pytest.raises(ValueError):
        S.split_oversized(df, "text", 10, 5)


def test_very_long_text():
    words = ["slowo"] * 200_000
    pieces = S.split(" ".join(words))
    assert sum(len(p.split()) - 50 for p in pieces) + 50 == len(words)
