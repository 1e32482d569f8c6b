"""Best-fit packing of token sequences in bulk-synchronous rounds.

Documents are tokenised once, where they lie; only pieces of (length, rank) travel. Documents and gaps
are range-sorted by length, and as lengths end at the sequence length, both sorted orders are kept as
runs of equal length: at most `sequence` runs of documents and as many lengths of gaps. A round is:

1. successor sweep: in one descending pass over both sorted orders each gap takes the longest document
   run at or below it that is still free (nested matching);
2. conflicts: a run of m documents and a run of n gaps settle by rank, the first min(m, n) of each match;
3. update: the matched gaps shrink and are sorted in again;
4. when no document fits any gap, new sequences are opened: for every document longer than half a
   sequence, otherwise for the longest ones, as many as the remaining tokens need at least.

Ranks are then resolved to documents in parallel: pieces are range-sorted and numbered inside their
length, and each finds its sequence and offset by binary search in the broadcast list of matches. The
list has at most `sequence` entries per round, which does not depend on the number of documents; it is
sent in parts of bounded size.

Defined results: a null text is an empty one, and an empty document is its end id alone; documents above the
sequence length are cut into full pieces and a rest; equal and repeated rows are packed one by one; an
empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import numbered, stored
from tabwright.llm.registry import register, table
from tabwright.llm.tokens import encoder, tokenizer_path

SEQUENCE = 2048
PART = 2_000_000  # matches in one broadcast: three long arrays of 16 MB
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, path: str, kind: str, end_id: int, sequence: int = SEQUENCE) -> DataFrame:
    """Pieces of at most `sequence` tokens of every document, without their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(path, kind, added=True).ids
        end = np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            rows = []
            ids = batch.column(0).to_pylist()
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, data in zip(ids, ids_of(texts), strict=True):
                data += end
                for k, at in enumerate(range(0, len(data), 4 * sequence)):
                    own = data[at : at + 4 * sequence]
                    rows.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)],
                names=[x.split()[0] for x in _PIECES.split(", ")],
            )

    return documents.mapInArrow(run, _PIECES)


def pack_runs(counts: dict[int, int], sequence: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """[(length, first, end, sequence of the first, offset)]: documents first..end-1 of a length in the
    range-sorted order go to consecutive sequences, all at the same offset."""
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = defaultdict(int)  # documents of a length that are placed
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap: intervals of sequences
    opened, out = 0, []

    def put(n: int, count: int, first: int, gap: int, into: dict) -> None:
        out.append((n, used[n], used[n] + count, first, sequence - gap))
        used[n] += count
        left[n] -= count
        if not left[n]:
            del left[n]
        if gap > n:
            into[gap - n].append((first, count))

    while left:
        fresh: dict[int, list] = defaultdict(list)
        matched = False
        # descending sweep: gaps wait in order of size, the smallest at or above a document on top
        waiting: list[tuple[int, int, int]] = []
        for size in sorted({*left, *gaps}, reverse=True):
            for first, count in gaps.pop(size, ()):
                heapq.heappush(waiting, (size, first, count))
            while waiting and left.get(size):
                gap, first, count = heapq.heappop(waiting)
                take = min(count, left[size])
                put(size, take, first, gap, fresh)
                matched = True
                if take < count:
                    heapq.heappush(waiting, (gap, first + take, count - take))
        for gap, first, count in waiting:
            fresh[gap].append((first, count))
        gaps = fresh
        if matched or not left:
            continue
        alone = {n: c for n, c in left.items() if 2 * n > sequence}
        need = -(-sum(n * c for n, c in left.items()) // sequence)
        for n in sorted(left, reverse=True):
            take = alone.get(n, 0) if alone else min(left[n], need)
            if take:
                put(n, take, opened, sequence, gaps)
                opened += take
                need -= take
    return out


def place(ranked: DataFrame, plan: list[tuple], sequence: int = SEQUENCE, part: int = PART) -> DataFrame:
    """`ranked` (length, rank) with sequence_id and offset from the list of matches, sent in parts."""
    spark = ranked.sparkSession
    plan = sorted(plan)
    out = ranked.withColumns({"sequence_id": F.lit(-1).cast("long"), "offset": F.lit(-1).cast("long")})
    schema = out.schema
    step = sequence + 1
    for at in range(0, max(len(plan), 1), part):
        some = np.array(plan[at : at + part], dtype=np.int64).reshape(-1, 5)
        # length and rank as one number: rank x step + length would not sort, so sort by (length, rank)
        held = spark.sparkContext.broadcast((some[:, 0], some[:, 1], some[:, 2], some[:, 3] * step + some[:, 4]))
        out = out.mapInArrow(_finder(held, step), schema)
    return out


def _finder(held, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, firsts, ends, targets = held.value
        edges = np.searchsorted(lengths, np.arange(step + 1))  # where each length begins
        for batch in batches:
            n = batch.column("length").to_numpy(zero_copy_only=False)
            r = batch.column("_rank").to_numpy(zero_copy_only=False)
            made = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("sequence_id", "offset")]
            order = np.argsort(n, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(n[order])) + 1):
                if not len(own):
                    continue
                a, b = edges[n[own[0]]], edges[n[own[0]] + 1]
                if a == b:
                    continue
                k = a + np.searchsorted(firsts[a:b], r[own], side="right") - 1
                fit = (k >= a) & (r[own] < ends[np.maximum(k, a)])
                k, own = k[fit], own[fit]
                target, offset = np.divmod(targets[k], step)
                made[0][own] = target + r[own] - firsts[k]
                made[1][own] = offset
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            columns |= {"sequence_id": pa.array(made[0]), "offset": pa.array(made[1])}
            yield pa.RecordBatch.from_pydict(columns)

    return run


def best_fit(
    documents: DataFrame,
    path: str,
    kind: str = "word",
    end_id: int = 0,
    sequence: int = SEQUENCE,
    text: str = "text",
    id_: str = "doc_id",
) -> DataFrame:
    """Pieces with the sequence that holds them and their offset there."""
    slim = documents.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    cut = stored(pieces(slim, path, kind, end_id, sequence), "pack-pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    ranked = numbered(cut, ["length"], ["doc_id", "piece"], "_rank", "pack-ranks")
    return place(ranked, pack_runs(counts, sequence), sequence).drop("_rank")


@register("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return best_fit(documents, tokenizer_path("word_bpe_49k.json"))
