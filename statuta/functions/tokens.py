"""Sizes of texts in tokens of a public tokenizer, whose vocabulary file is a parameter."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from statuta.session import ship

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def vocabulary_path(path: str | None = None) -> str:
    """The vocabulary file: the parameter, else the environment's, else the public package's."""
    if path or os.environ.get("STATUTA_VOCABULARY"):
        return path or os.environ["STATUTA_VOCABULARY"]
    import public_tokenizers

    return str(public_tokenizers.path(VOCABULARY))


@lru_cache(maxsize=2)
def _encoding(content: bytes, pattern: str):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines()) if a}
    return tiktoken.Encoding("vocabulary", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _shared(spark: SparkSession, path: str | None, pattern: str | None):
    """The vocabulary file, of a fixed size of about a megabyte, as a broadcast, and the pattern of words."""
    ship(spark)
    if pattern is None:
        import public_tokenizers

        pattern = public_tokenizers.PATTERN
    with open(vocabulary_path(path), "rb") as file:
        return spark.sparkContext.broadcast(file.read()), pattern


def token_counts(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Tokens of whole texts; 0 for null and ''. Workers need no copy of the vocabulary file."""
    content, pattern = _shared(spark, path, pattern)

    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(content.value, pattern)
        return pd.Series([len(encoding.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return F.pandas_udf(count, T.LongType())(text)


def token_texts(spark: SparkSession, text: Column, path: str | None = None, pattern: str | None = None) -> Column:
    """Texts put together again from their tokens: what tokenizing keeps; null for null."""
    content, pattern = _shared(spark, path, pattern)

    def again(texts: pd.Series) -> pd.Series:
        encoding = _encoding(content.value, pattern)
        return pd.Series([None if t is None else encoding.decode(encoding.encode_ordinary(t)) for t in texts], dtype=object)

    return F.pandas_udf(again, T.StringType())(text)
