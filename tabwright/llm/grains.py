"""Words of many texts at once, as arrays, and bit sets whose size follows the number of their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import LOWER, Spans, dense, mix64

CHUNK_BYTES = 1 << 20  # texts are looked at in chunks of about this size; a longer text is a chunk of its own

# odd factors, one for each place in a phrase
_AT = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93))
_AT_2 = tuple(np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F))


class Words:
    """Words of consecutive texts: `starts`, `ends` in `low`, `row` of each word, `piece` it lies in, its hash."""

    def __init__(self, texts: list[bytes], first: int, is_word: np.ndarray, is_break: np.ndarray):
        self.low = LOWER[np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)]
        edge = np.zeros(len(self.low) + 1, dtype=bool)
        inside = is_word[self.low]
        edge[1:] = inside
        at = np.flatnonzero(edge[1:] != edge[:-1])  # the last byte is a line feed: runs are closed
        self.starts, self.ends = at[::2], at[1::2]
        sizes = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
        self.row = first + np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(self.starts, np.concatenate(([0], np.cumsum(sizes))))))
        self.piece = np.cumsum(is_break[self.low], dtype=np.int32)[self.starts]
        self.hash = Spans(self.low.astype(np.uint64) + np.uint64(1), 0)(self.starts, self.ends) if len(at) else np.zeros(0, dtype=np.uint64)

    def phrase(self, at: int, n: int) -> bytes:
        """n words from word `at`, joined by one space."""
        return b" ".join(self.low[a:b].tobytes() for a, b in zip(self.starts[at : at + n], self.ends[at : at + n], strict=True))


def chunks(texts: list[str | None], is_word: np.ndarray, is_break: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[Words]:
    """The words of the texts of a batch, chunk by chunk; a null has no words."""
    held, first, total = [], 0, 0
    for k, text in enumerate(texts):
        data = (text or "").encode()
        if held and total + len(data) > size:
            yield Words(held, first, is_word, is_break)
            held, first, total = [], k, 0
        held.append(data)
        total += len(data) + 1
    if held:
        yield Words(held, first, is_word, is_break)


def gram_hashes(words: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """Hash of every n consecutive word hashes."""
    count = max(len(words) - n + 1, 0)
    total = np.full(count, n, dtype=np.uint64)
    for k in range(n):
        total += words[k : k + count] * (_AT_2 if second else _AT)[k]
    return mix64(total)


class Bits:
    """A broadcast set of 64-bit hashes: no key is missed, a foreign one passes with a chance of one in 16 or less.

    It holds 16 places for each key, from 2^16 to 2^30 places (128 MB); beyond 2^26 keys foreign hashes pass more
    often, which costs time in the exact step behind it and nothing else.
    """

    def __init__(self, keys: DataFrame, column: str = "h"):
        count = keys.count()
        self.power = min(30, max(16, (max(1, count) * 16 - 1).bit_length()))
        place = F.shiftrightunsigned(column, 64 - self.power)
        words = keys.select(place.alias("p")).select(F.shiftright("p", 6).alias("at"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        cells = words.groupBy("at").agg(F.bit_or("b").alias("n"))
        held = dense(cells, 1 << (self.power - 6), "<i8").view(np.uint64) if count else np.zeros(1 << (self.power - 6), dtype=np.uint64)
        self.held = keys.sparkSession.sparkContext.broadcast(held)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        place = hashes >> np.uint64(64 - self.power)
        return (self.held.value[place >> np.uint64(6)] >> (place & np.uint64(63))) & np.uint64(1) != 0

    def __getstate__(self):
        return {"power": self.power, "held": self.held}


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))
