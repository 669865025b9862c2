"""Text to vectors behind a small protocol; the default needs no model and is repeatable."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import ship

# Fixed value: what stands before a query, and not before the texts of the corpus.
QUERY_PREFIX = "zapytanie: "


class Embedder(Protocol):
    """Anything that turns texts into a matrix, one row a text."""

    dim: int

    def encode(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed hashing of words and of their pieces of four letters, of length 1."""

    def __init__(self, dim: int = 64, seed: int = 1):
        self.dim, self.seed = dim, seed

    def _slot(self, feature: str) -> tuple[int, float]:
        h = int.from_bytes(hashlib.blake2b(feature.encode(), digest_size=8, key=str(self.seed).encode()).digest(), "little")
        return h % self.dim, 1.0 if h >> 63 else -1.0

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim), np.float32)
        for row, text in zip(out, texts):
            for word in text.lower().split():
                for feature in (word, *(word[i : i + 4] for i in range(len(word) - 3))):
                    slot, sign = self._slot(feature)
                    row[slot] += sign
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=out, where=norm > 0)


def embed(text: Column, embedder: Embedder, prefix: str = "") -> Column:
    """Vectors of texts by Arrow batches; null for null."""

    def run(texts: pd.Series) -> pd.Series:
        given = [t for t in texts if t is not None]
        rows = iter(embedder.encode([prefix + t for t in given])) if given else iter(())
        return pd.Series([None if t is None else next(rows) for t in texts], dtype=object)

    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)


def pending(rows: DataFrame, vectors: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that have no vector yet."""
    return rows.join(vectors.select(*keys), keys, "left_anti")


def embed_rows(rows: DataFrame, keys: list[str], text: str, embedder: Embedder) -> DataFrame:
    """``keys, embedding`` for rows with a text."""
    ship(rows.sparkSession)
    return rows.where(F.col(text).isNotNull()).select(*keys, embed(F.col(text), embedder).alias("embedding"))
