"""Token-id output: an adaptive context-mixing range coder in independent, checksummed blocks.

A block is coded from a fresh model, so blocks can be read in any order and a damaged one harms no other. Its
ids are laid out in lanes that are coded side by side; every lane has its own range coder, all share one model,
which learns from all lanes after each step. For the next id of a lane

* order 2 predicts what last followed its two predecessors, order 1 what followed the last one, each with a
  confidence, and order 0 knows how often every id has occurred;
* the two confidences (and whether both predictions agree) select counters of how often order 2, order 1 or
  neither was right: these are the mixing weights;
* the interval of the range coder holds the share of order 2's id, then of order 1's, and the rest is dealt
  out by order 0.

Everything is integer arithmetic, so a reader anywhere rebuilds the same model. Files are Parquet tables of blocks
(part, block, n_tokens, payload), because Spark then writes and reads them in any store, retries included.

Defined results: a null text is an empty one and has its end id alone; documents are in ascending order of doc_id,
nulls first, equal doc_ids in the order of their texts; an empty table gives an empty file. A block that fails its
checksum raises an error. Other columns are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.llm.registry import register, table
from tabwright.llm.tokens import encoder, tokenizer_path
from tabwright.session import scratch_path

BLOCK = 1 << 21  # ids after which a block ends with its document
LANES = 4096
STEPS = 64  # ids in a lane at least, so that small blocks have fewer lanes
MAGIC = b"TWIC1"
_HEAD = "<5sIQIIII"  # magic, documents, ids, alphabet, lanes, words, checksum of the ids

TOTAL = 24  # bits of the probability scale
LEAST = 1 << 20  # of the scale that is left to order 0
CONFIDENT = 7
SLOTS = 18  # bits of the order-2 table


class Model:
    """Predictions of order 0 to 2 and their mixing weights; one for each block."""

    def __init__(self, alphabet: int):
        self.counts = np.ones(alphabet, dtype=np.int64)
        self.one = np.zeros(alphabet, dtype=np.int64)  # prediction and confidence of order 1
        self.two = np.zeros(1 << SLOTS, dtype=np.int64)
        self.weights = np.tile(np.array([2, 1, 3], dtype=np.int64), (128, 1))  # right: order 2, order 1, neither
        self.floor = 16 if alphabet <= 1 << 18 else 1
        self.step, self.due = 0, 0

    def predict(self, before: np.ndarray, last: np.ndarray) -> None:
        """Set up the distributions for one id of every lane."""
        if self.step == self.due:
            free = (1 << TOTAL) - self.floor * len(self.counts)
            share = self.floor + self.counts * free // int(self.counts.sum())
            self.cum = np.concatenate(([0], np.cumsum(share)))
            self.due = self.step + min(16, max(1, self.step))
        self.last = last
        self.slot = ((before * 0x9E3779B1 + last * 0x85EBCA6B) & 0xFFFFFFFF) >> (32 - SLOTS)
        e1, e2 = self.one[last], self.two[self.slot]
        self.id1, self.id2, self.sure1, self.sure2 = e1 >> 3, e2 >> 3, e1 & 7, e2 & 7
        agree = self.id1 == self.id2
        self.state = (self.sure2 << 4) | (self.sure1 << 1) | agree
        w = self.weights
        scale = (1 << TOTAL) - LEAST
        total = w.sum(axis=1)
        first = np.maximum(w[:, 0] * scale // total, 1)
        second = np.maximum(w[:, 1] * scale // total, 1)
        second[1::2] = 0  # both predict the same id
        self.a, self.b = first[self.state], second[self.state]
        self.ab = self.a + self.b
        self.rest = (1 << TOTAL) - self.ab

    def update(self, ids: np.ndarray, hit: np.ndarray) -> None:
        """Learn the ids that came; `hit` is 0, 1 or 2 for order 2, order 1, neither."""
        self.weights += np.bincount(self.state * 3 + hit, minlength=384).reshape(128, 3)
        self.counts += 24 * np.bincount(ids, minlength=len(self.counts))
        for held, at, guess, sure in ((self.one, self.last, self.id1, self.sure1), (self.two, self.slot, self.id2, self.sure2)):
            right = guess == ids
            keep = right | (sure > 0)
            held[at] = (np.where(keep, guess, ids) << 3) | np.where(right, np.minimum(sure + 1, CONFIDENT), np.maximum(sure - 2, 0))
        self.step += 1


def _shape(n: int) -> tuple[int, int]:
    """(lanes, steps) for n ids; lane k holds ids k x steps to (k + 1) x steps - 1."""
    steps = max(STEPS, -(-n // LANES))
    return -(-n // steps), steps


def encode_ids(ids: np.ndarray, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """(16-bit words of all lanes one after the other, words per lane)."""
    lanes, steps = _shape(len(ids))
    grid = np.zeros(lanes * steps, dtype=np.int64)
    grid[: len(ids)] = ids
    grid = np.ascontiguousarray(grid.reshape(lanes, steps).T)
    model = Model(alphabet)
    low, width = np.zeros(lanes, dtype=np.int64), np.full(lanes, (1 << 48) - 1, dtype=np.int64)
    before = last = np.zeros(lanes, dtype=np.int64)
    owners, digits = [], []
    full = len(ids) - (lanes - 1) * steps  # steps of the last lane
    for t in range(steps):
        n = lanes if t < full else lanes - 1
        if not n:
            break
        x = grid[t, :n]
        model.predict(before[:n], last[:n])
        hit = np.where(x == model.id2, 0, np.where(x == model.id1, 1, 2))
        start = np.where(hit == 1, model.a, 0)
        size = np.where(hit == 1, model.b, model.a)
        miss = np.flatnonzero(hit == 2)
        own, rest = x[miss], model.rest[miss]
        lo = (model.cum[own] * rest) >> TOTAL
        start[miss] = model.ab[miss] + lo
        size[miss] = ((model.cum[own + 1] * rest) >> TOTAL) - lo
        unit = width[:n] >> TOTAL
        low[:n] += unit * start
        width[:n] = unit * size
        for _ in (0, 1):
            out = np.flatnonzero(width[:n] < (1 << 32))
            if not len(out):
                break
            owners.append(out.astype(np.uint16))
            digits.append(low[out] >> 32)  # may hold a carry for the word before
            low[out] = (low[out] & 0xFFFFFFFF) << 16
            width[out] <<= 16
        model.update(x, hit)
        before, last = last, grid[t]
    owners.append(np.arange(lanes, dtype=np.uint16))
    digits.append((low + 0xFFFFFFFF) >> 32)  # one word names a value inside the last interval
    owner, digit = np.concatenate(owners), np.concatenate(digits)
    order = np.argsort(owner, kind="stable")
    digit = digit[order]
    while len(over := np.flatnonzero(digit > 0xFFFF)):
        digit[over] -= 1 << 16
        np.add.at(digit, over - 1, 1)
    return digit.astype("<u2"), np.bincount(owner, minlength=lanes).astype("<u4")


def decode_ids(words: np.ndarray, sizes: np.ndarray, n_ids: int, alphabet: int) -> np.ndarray:
    lanes, steps = _shape(n_ids)
    words = np.concatenate((words.astype(np.int64), [0]))
    ends = np.cumsum(sizes.astype(np.int64))
    at = ends - sizes

    def take(k) -> np.ndarray:
        """The next word of these lanes; zeros behind the end."""
        here = np.where(at[k] < ends[k], at[k], len(words) - 1)
        at[k] += 1
        return words[here]

    every = np.arange(lanes)
    code = (take(every) << 32) | (take(every) << 16) | take(every)
    width = np.full(lanes, (1 << 48) - 1, dtype=np.int64)
    model = Model(alphabet)
    grid = np.zeros((steps, lanes), dtype=np.int64)
    before = last = np.zeros(lanes, dtype=np.int64)
    full = n_ids - (lanes - 1) * steps
    for t in range(steps):
        n = lanes if t < full else lanes - 1
        if not n:
            break
        model.predict(before[:n], last[:n])
        unit = width[:n] >> TOTAL
        value = np.minimum(code[:n] // unit, (1 << TOTAL) - 1)
        hit = (value >= model.a).astype(np.int64) + (value >= model.ab)
        x = np.where(hit == 1, model.id1, model.id2)
        start = np.where(hit == 1, model.a, 0)
        size = np.where(hit == 1, model.b, model.a)
        miss = np.flatnonzero(hit == 2)
        rest, base = model.rest[miss], model.ab[miss]
        own = np.searchsorted(model.cum, (((value[miss] - base + 1) << TOTAL) - 1) // rest, side="right") - 1
        own = np.minimum(own, alphabet - 1)
        lo = (model.cum[own] * rest) >> TOTAL
        x[miss] = own
        start[miss] = base + lo
        size[miss] = ((model.cum[own + 1] * rest) >> TOTAL) - lo
        code[:n] -= unit * start
        width[:n] = unit * size
        for _ in (0, 1):
            out = np.flatnonzero(width[:n] < (1 << 32))
            if not len(out):
                break
            code[out] = (code[out] << 16) | take(out)
            width[out] <<= 16
        # what order 2 and order 1 both miss may still equal their ids: the encoder never does that
        model.update(x, hit)
        grid[t, :n] = x
        before, last = last, grid[t]
    return np.ascontiguousarray(grid.T).ravel()[:n_ids]


# --- blocks --------------------------------------------------------------------------------------


def pack_block(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> bytes:
    alphabet = int(ids.max(initial=0)) + 1
    words, lanes = encode_ids(ids, alphabet) if len(ids) else (np.zeros(0, "<u2"), np.zeros(0, "<u4"))
    docs = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    check = zlib.crc32(ids.astype("<u4").tobytes())
    head = struct.pack(_HEAD, MAGIC, len(doc_ids), len(ids), alphabet, len(lanes), len(words), check)
    body = b"".join(x.tobytes() for x in (docs, known, np.array(sizes, dtype="<u4"), lanes, words))
    return head + body + struct.pack("<I", zlib.crc32(head + body))


def unpack_block(payload: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc_ids, ids per document, ids); raises ValueError for a damaged block."""
    if len(payload) < struct.calcsize(_HEAD) + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError("a block of token ids is damaged")
    magic, n_docs, n_ids, alphabet, n_lanes, n_words, check = struct.unpack_from(_HEAD, payload)
    if magic != MAGIC:
        raise ValueError("this is no block of token ids")
    at, parts = struct.calcsize(_HEAD), []
    for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u4", n_docs), ("<u4", n_lanes), ("<u2", n_words)):
        parts.append(np.frombuffer(payload, dtype=kind, count=n, offset=at))
        at += parts[-1].nbytes
    docs, known, sizes, lanes, words = parts
    ids = decode_ids(words, lanes, n_ids, alphabet).astype("<u4") if n_ids else np.zeros(0, "<u4")
    if zlib.crc32(ids.tobytes()) != check:
        raise ValueError("a block of token ids does not decode to what was written")
    return [d if k else None for d, k in zip(docs.tolist(), known.tolist(), strict=True)], sizes, ids


_BLOCKS = "part int, block int, n_tokens long, payload binary"


def write_ids(documents: DataFrame, target: str, path: str, kind: str, end_id: int, block: int = BLOCK, text: str = "text", id_: str = "doc_id") -> None:
    """Encode all texts in ascending order of doc_id and write their blocks to the folder `target`."""
    ordered = documents.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(path, kind, added=True).ids, np.array([end_id], dtype="<u4").tobytes()
        part, number = TaskContext.get().partitionId(), 0
        docs: list[int | None] = []
        held: list[bytes] = []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), dtype="<u4").astype(np.int64)
            row = [part, number, len(ids), pack_block(docs, [len(h) // 4 for h in held], ids)]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(row, kinds, strict=True)], names=["part", "block", "n_tokens", "payload"])

        size = 0
        for batch in batches:
            for at in range(0, len(batch), 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                for doc, ids in zip(some.column(0).to_pylist(), encode(texts), strict=True):
                    docs.append(doc)
                    held.append(ids + end)
                    size += len(ids) // 4 + 1
                    if size >= block:
                        yield flush()
                        docs, held, size, number = [], [], 0, number + 1
        if docs:
            yield flush()

    ordered.mapInArrow(run, _BLOCKS).write.option("compression", "none").parquet(target)


def read_ids(spark: SparkSession, target: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and the ids of every document of the files."""
    blocks = spark.read.schema(_BLOCKS).parquet(target)
    rows, total = [], 0
    for r in sorted(blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect(), key=lambda r: r["part"]):  # one row per file
        rows.append((r["part"], total))
        total += r["n"]
    parts = F.broadcast(spark.createDataFrame(rows, "_part int, _base long"))
    earlier = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sizes = blocks.select("part", "block", F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0)).alias("_before"))
    sizes = sizes.join(parts, F.col("part") == F.col("_part"))
    sizes = sizes.select("_part", F.col("block").alias("_block"), (F.col("_base") + F.col("_before")).alias("first"))
    placed = blocks.join(sizes, (F.col("part") == F.col("_part")) & (F.col("block") == F.col("_block"))).select("first", "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for first, payload in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs, sizes, ids = unpack_block(payload.as_py())
                ends = np.cumsum(sizes, dtype=np.int64)
                starts = ends - sizes
                data = ids.tobytes()
                checks = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                columns = [pa.array(docs, type=pa.int64()), pa.array(starts + first), pa.array(sizes.astype(np.int64)), pa.array(checks, type=pa.int64())]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "ids"] if with_ids else names)

    return placed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids)


@register("op3_token_ids")
def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    target = scratch_path(spark, "token-ids")
    write_ids(table(spark, sf_dir, "documents"), target, tokenizer_path("byte_bpe_50k.json"), "byte", 2)
    return read_ids(spark, target, with_ids=False)
