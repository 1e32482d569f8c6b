"""Shared pieces: tables kept in the shared folder, global numbering, words as hashes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import stored

ROW_BITS = 33  # monotonically_increasing_id() holds the row in a partition in its low 33 bits


def discard(table: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more; what follows from it must be stored."""
    context = table.sparkSession.sparkContext
    for path in {name.rpartition("/")[0] for name in table.inputFiles()}:
        place = context._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def text_digest(text: Column) -> Column:
    """256-bit digest that keeps null apart from every text."""
    return F.coalesce(F.sha2(text.cast("binary"), 256), F.lit("null"))


def row_digest(text: Column) -> Column:
    """128-bit digest of a text: tells rows with one doc_id apart; null for null."""
    return F.substring(F.unhex(F.sha2(text.cast("binary"), 256)), 1, 16)


def numbered(df: DataFrame, group: list[str], order: list[str], out: str, name: str) -> DataFrame:
    """0-based position `out` of every row inside its group, by the given order.

    Rows are range-partitioned by (group, order), so a group of any size spreads over partitions;
    each partition numbers its own rows and adds what earlier partitions hold of the same group.
    """
    keys = [F.col(c) for c in [*group, *order]]
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_id", F.monotonically_increasing_id())
    )
    placed = placed.withColumns(
        {"_part": F.shiftright("_id", ROW_BITS), "_row": F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}
    ).drop("_id")
    placed = stored(placed, name)
    # one row for each partition and each further group in it
    starts = placed.groupBy("_part", *group).agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    if group:
        earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        shift = starts.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    else:
        shift = partition_offsets(starts)
    kept = [F.col(f"a.{c}") for c in df.columns]
    match = F.col("a._part") == F.col("b._part")
    for c in group:
        match = match & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
    return (
        placed.alias("a")
        .join(shift.alias("b"), match)
        .select(*kept, (F.col("a._row") - F.col("b._first") + F.col("b._before")).cast("long").alias(out))
    )


def partition_offsets(starts: DataFrame) -> DataFrame:
    """Rows before each partition; one driver-side number per partition."""
    spark, total, rows = starts.sparkSession, 0, []
    for r in sorted(starts.collect(), key=lambda r: r["_part"]):
        rows.append((r["_part"], r["_first"], total))
        total += r["_n"]
    return F.broadcast(spark.createDataFrame(rows, "_part long, _first long, _before long"))


# --- bit sets ----------------------------------------------------------------------------------

BITS = 24


def spot(*parts: Column, bits: int = BITS) -> Column:
    """Place of a key in a bit set of 2^bits places; `spot_of` gives the same for Python values."""
    texts = [F.coalesce(p.cast("string"), F.lit("None")) for p in parts]
    return F.crc32(F.concat_ws(" ", *texts).cast("binary")).bitwiseAND(F.lit((1 << bits) - 1))


def spot_of(*parts, bits: int = BITS) -> int:
    return zlib.crc32(" ".join(str(p) for p in parts).encode()) & ((1 << bits) - 1)


def bit_set(spots: DataFrame, bits: int = BITS):
    """Broadcast bits of the taken spots (column `s`) of 2^bits, read by `taken`: by default 2 MB in each worker, whatever the
    number of rows.

    It thins a scan before a join; what it lets through by chance, the join drops.
    """
    words = spots.select(F.shiftright("s", 6).alias("at"), F.expr("shiftleft(1L, cast(s & 63 as int))").alias("b"))
    held = dense(words.groupBy("at").agg(F.bit_or("b").alias("n")), 1 << (bits - 6), "<i8")
    return spots.sparkSession.sparkContext.broadcast(held.tobytes())


def taken(bits: bytes, at: int) -> bool:
    """Is the spot in a bit set?"""
    return bool(bits[at >> 3] >> (at & 7) & 1)


def dense(cells: DataFrame, size: int, kind: str) -> np.ndarray:
    """The array of `size` cells with n at position `at`, 0 elsewhere; cells come to the driver packed by 4096."""

    def pack(batches):
        for batch in batches:
            packed = []
            for rows in batch.column("cells").to_pylist():
                part = np.zeros(4096, dtype=kind)
                part[[r["at"] & 4095 for r in rows]] = [r["n"] for r in rows]
                packed.append(part.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("high"), pa.array(packed, type=pa.binary())], names=["high", "packed"])

    rows = cells.groupBy(F.shiftright("at", 12).alias("high")).agg(F.collect_list(F.struct("at", "n")).alias("cells"))
    out = np.zeros(max(size, 4096), dtype=kind)
    for r in rows.mapInArrow(pack, "high long, packed binary").collect():  # the array itself, in one job
        out[r["high"] << 12 : (r["high"] + 1) << 12] = np.frombuffer(r["packed"], dtype=kind)
    return out[:size]


# --- words as hashes -------------------------------------------------------------------------

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
IS_WORD = np.zeros(256, dtype=bool)
IS_WORD[48:58] = IS_WORD[97:123] = IS_WORD[128:] = True  # after lower-casing; all bytes of non-ASCII characters

_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 modulo 2^64 of an odd base, and of its inverse."""
    held = _POWERS.get(base)
    if held is None or len(held[0]) < n:
        size = max(1 << 14, 1 << (n - 1).bit_length())
        b = int(_BASES[base])
        held = tuple(_power_row(x, size) for x in (b, pow(b, -1, 1 << 64)))
        _POWERS[base] = held
    return held[0][:n], held[1][:n]


def _power_row(b: int, size: int) -> np.ndarray:
    row = np.ones(size, dtype=np.uint64)
    row[1:] = np.uint64(b)
    return np.multiply.accumulate(row)


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser, so that neighbouring values become unrelated."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Spans:
    """Hashes of values[start:end] by one running sum."""

    def __init__(self, values: np.ndarray, base: int):
        up, self.down = powers(base, len(values) + 1)
        self.total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(values * up[:-1], out=self.total[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix64((self.total[ends] - self.total[starts]) * self.down[starts] + (ends - starts).astype(np.uint64))


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, Spans]:
    """(bytes with A-Z lower-cased, starts, ends of the words, hashes of byte spans)."""
    low = LOWER[np.frombuffer(data, dtype=np.uint8)]
    edge = np.zeros(len(low) + 2, dtype=np.int8)
    edge[1:-1] = IS_WORD[low]
    step = np.diff(edge)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    return low, starts, ends, Spans(low.astype(np.uint64) + np.uint64(1), 0)


def words_of(data: bytes) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """(text with A-Z lower-cased, starts, ends, 64-bit hashes) of its words.

    A word is a longest run of ASCII letters, digits and non-ASCII characters.
    """
    low, starts, ends, spans = word_spans(data)
    return low.tobytes(), starts, ends, spans(starts, ends)


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words; of all words where there are fewer, but some."""
    if len(hashes) == 0:
        return hashes
    n = min(n, len(hashes))
    starts = np.arange(len(hashes) - n + 1)
    return Spans(hashes, 1)(starts, starts + n)


def digest16(*arrays: np.ndarray | bytes) -> bytes:
    """128-bit digest of arrays, or of their bytes."""
    h = hashlib.blake2b(digest_size=16)
    for a in arrays:
        h.update(a if isinstance(a, bytes) else a.tobytes())
    return h.digest()
