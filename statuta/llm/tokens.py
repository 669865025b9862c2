"""Sizes of texts in tokens of a public tokenizer: those of the core, under the name this subpackage uses."""

from statuta.functions.tokens import token_counts, vocabulary_path

__all__ = ["token_counts", "vocabulary_path"]
