"""Tokens and n-grams as array expressions."""

from __future__ import annotations

import functools

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"  # runs of at least two letters, digits or underscores


@functools.cache
def stop_words() -> tuple[str, ...]:
    """Spark's own list of English stop words."""
    return tuple(StopWordsRemover.loadDefaultStopWords("english"))


def tokens(text: Column) -> Column:
    """Lower-case words without stop words; null text gives an empty array."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({TOKEN_PATTERN})"), F.lit(1))
    return F.filter(words, lambda w: ~w.isin(*stop_words()))


def grams(words: Column) -> Column:
    """The words followed by all pairs of neighbouring words."""
    n = F.greatest(F.size(words) - 1, F.lit(0))
    pairs = F.zip_with(F.slice(words, F.lit(1), n), F.slice(words, F.lit(2), n), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.concat(words, pairs)
