"""Cutting oversized texts into overlapping pieces at natural boundaries.

Method. Every gap between two words has a boundary strength: paragraph, sentence, clause or none. A
sparse table answers range-maximum queries over the strengths in constant time; each piece ends at
the strongest gap of its permissible window, the rightmost among equals, and the next piece begins
the overlap before that gap.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import ship

LIMIT, OVERLAP = 512, 50
#: Words are separated by space, tab, CR and LF only.
SEPARATORS = " \\t\\r\\n"
_WORD = re.compile(f"[^{SEPARATORS}]+")
NONE, CLAUSE, SENTENCE, PARAGRAPH = 0, 1, 2, 3
# Abbreviations whose full stop ends no sentence.
_ABBREVIATIONS = {"art.", "ust.", "pkt.", "lit.", "nr.", "zw.", "tzw.", "np.", "tj.", "por.", "zob.", "poz.", "m.in.", "dz.", "r.", "zł.", "ww."}


def strengths(text: str, spans: np.ndarray) -> np.ndarray:
    """Strength of the gap after each word but the last."""
    out = np.zeros(max(0, len(spans) - 1), np.int64)
    for i in range(len(out)):
        gap = text[spans[i, 1] : spans[i + 1, 0]]
        if "\n" in gap or "\r" in gap:
            out[i] = PARAGRAPH
            continue
        word = text[spans[i, 0] : spans[i, 1]]
        core = word.rstrip("\"'”’»)]}") or word
        if core[-1] in ".!?…":
            after = text[spans[i + 1, 0]]
            if word.lower() in _ABBREVIATIONS and not (word == "r." and after.isupper()):
                continue
            # A full stop before a small letter or a digit is an abbreviation or a number.
            out[i] = SENTENCE if core[-1] in "!?…" or not (after.islower() or after.isdigit()) else NONE
        elif core[-1] in ",;:" or word in ("–", "—", "-"):
            out[i] = CLAUSE
    return out


class RangeMaximum:
    """Sparse table over strengths: the rightmost strongest position of any range in constant time."""

    def __init__(self, values: Sequence[int], longest: int):
        n = len(values)
        # Position in the low part: of equal strengths the rightmost is the greatest.
        self.base = n + 1
        level = np.asarray(values, np.int64) * self.base + np.arange(n)
        self.levels = [level]
        width = 1
        while 2 * width <= min(longest, n):
            level = np.maximum(level[:-width], level[width:])
            self.levels.append(level)
            width *= 2

    def strongest(self, low: int, high: int) -> tuple[int, int]:
        """(strength, position) over the positions low..high."""
        k = (high - low + 1).bit_length() - 1
        best = int(max(self.levels[k][low], self.levels[k][high - (1 << k) + 1]))
        return best // self.base, best % self.base


def cuts(strength: Sequence[int], words: int, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Word ranges (start, end) of the pieces of a text of ``words`` words.

    A piece is preferably at least half the limit long; where that window holds no natural boundary,
    any boundary beyond the overlap serves, and only then a plain gap at the limit.
    """
    if words <= limit:
        return [(0, words)]
    table = RangeMaximum(strength, limit)
    out, start = [], 0
    while words - start > limit:
        # A piece that ends at word e is cut in gap e - 1; it must reach beyond the overlap.
        low, last = start + max(overlap + 1, limit // 2), start + limit
        value, gap = table.strongest(low - 1, last - 1)
        if value == NONE:
            wider, at = table.strongest(start + overlap, last - 1)
            gap = at if wider > NONE else last - 1
        out.append((start, gap + 1))
        start = gap + 1 - overlap
    out.append((start, words))
    return out


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[str]:
    """The pieces of a text; together, without the shared words, they are the whole text."""
    spans = np.array([m.span() for m in _WORD.finditer(text)], np.int64).reshape(-1, 2)
    ranges = cuts(strengths(text, spans), len(spans), limit, overlap)
    if len(ranges) == 1:
        return [text]
    # A piece runs to the next word's start, so that the separators in between are kept as well.
    ends = np.append(spans[1:, 0], len(text))
    return [text[0 if a == 0 else spans[a, 0] : ends[b - 1]] for a, b in ranges]


def word_count(text: Column) -> Column:
    """Words of a text, counted in the JVM; null for null, 0 for a text of separators only."""
    words = F.size(F.split(F.regexp_replace(text, f"^[{SEPARATORS}]+|[{SEPARATORS}]+$", ""), f"[{SEPARATORS}]+"))
    return F.when(F.length(F.regexp_replace(text, f"[{SEPARATORS}]+", "")) == 0, 0).otherwise(words)


def split_oversized(
    df: DataFrame, text: str, limit: int = LIMIT, overlap: int = OVERLAP, out: tuple[str, str, str] = ("piece", "chunk_id", "total_chunks")
) -> DataFrame:
    """The rows whose ``text`` has more than ``limit`` words, one output row per piece.

    Columns of ``df`` named as an output column are replaced, all others are kept. ``chunk_id``
    counts from 1. Each piece has at most ``limit`` words and shares exactly ``overlap`` words with
    the one before. Null and small texts give no row; repeated rows are cut repeatedly. There is no
    shuffle: rows are cut where they are read.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("the overlap must be less than half the limit")
    ship(df.sparkSession)
    kept = [f for f in df.schema.fields if f.name not in out]
    types = [T.StringType(), T.IntegerType(), T.IntegerType()]
    schema = T.StructType([T.StructField("n", T.ArrayType(T.StringType()))])

    def pieces(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split(t, limit, overlap) if t is not None else None)

    cut = F.pandas_udf(pieces, schema["n"].dataType)
    large = df.where(word_count(F.col(f"`{text}`")) > limit).withColumn("__pieces", cut(F.col(f"`{text}`")))
    names = [F.col(f"`{f.name}`") for f in kept]
    return large.select(*names, F.size("__pieces").cast(types[2]).alias(out[2]), F.posexplode("__pieces").alias("__i", out[0])).select(
        *names, out[0], (F.col("__i") + 1).cast(types[1]).alias(out[1]), out[2]
    )


def pieces_of(texts: Iterator[str], limit: int = LIMIT, overlap: int = OVERLAP) -> list[list[str]]:
    """Plain Python form of :func:`split_oversized`, for use outside Spark."""
    return [split(t, limit, overlap) for t in texts]
