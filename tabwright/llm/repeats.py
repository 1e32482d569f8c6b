"""Removal of long repeated byte strings by external induced sorting of suffixes.

Every window of `length` bytes has one anchor: the leftmost smallest of its 32-byte grams. Equal windows have equal
anchors at equal offsets, so anchors play the part of the few suffixes that are sorted first, and the order of the
suffixes before them is induced:

1. Anchored chunks. Runs of windows with one anchor are cut into chunks of up to CHUNK starts, counted from the
   anchor. All windows of a chunk contain its core. Cores are hashed and counted over the whole corpus with map-side
   combination; only chunks whose core occurs at two places go on, so unrepeated text never travels.
2. Base sort. Chunks are shuffled by core and sorted by (core, bytes from the core on) - Spark's sort, which spills
   to disk - and the common prefix (LCP) of neighbours is taken once.
3. Induction. From the suffixes e bytes before the core follow those e + 1 bytes before it: a stable sort by the one new byte,
   and LCP = 1 + the least LCP in between, or 0. A window is repeated when its LCP with a neighbour reaches `length`.

The queue between tasks is the sorted shuffle on disk, so a shard is streamed group by group and may be far larger
than memory. Equal chunks are one row, however many documents hold them. A core with more than `hot` different
chunks is not sorted in one task: its windows are hashed (128 bits) and counted with map-side combination.

Texts are known by a 128-bit digest; a text that occurs twice is repeated as a whole and analysed once.

Defined results: a null text is an empty one; texts shorter than `length` lose nothing; overlapping repeats
inside one text count; repeated rows are repeated texts; results follow the text, so rows with null or equal doc_id
are fine; removal may cut a multi-byte character, therefore the remaining text is offered as bytes. Other columns pass through
in `without_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import Spans, bit_set, digest16, mix64, spot_of, stored, taken
from tabwright.llm.common import spot as spot_column
from tabwright.llm.registry import register, table

LENGTH = 400
GRAM = 32
CHUNK = 128
HOT = 256
SLICE = 1 << 23  # bytes of a text that are analysed at once

_MARKS = "core long, place long, key binary, at int, lo int, hi int"
_CONTENT = "core long, content binary, place long, key binary, lo int, lead int, body binary"


# --- anchors -------------------------------------------------------------------------------------


def _sliding_min(v: np.ndarray, width: int) -> np.ndarray:
    """Minimum of v[s : s + width] for every s."""
    n = len(v)
    blocks = -(-n // width)
    full = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    full[:n] = v
    square = full.reshape(blocks, width)
    left = np.minimum.accumulate(square, axis=1).ravel()
    right = np.minimum.accumulate(square[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def chunks(data: np.ndarray, length: int, chunk: int) -> tuple[np.ndarray, ...]:
    """(core hash, core start, first window start, last window start) of all chunks."""
    parts = []
    for a in range(0, max(1, len(data) - length + 1), SLICE):
        own = data[a : a + SLICE + length - 1]
        if len(own) < length:
            break
        spans = Spans(own.astype(np.uint64) + np.uint64(1), 0)
        grams = np.arange(len(own) - GRAM + 1)
        h = spans(grams, grams + GRAM)
        low = np.uint64((1 << 24) - 1)
        anchor = (_sliding_min((h & ~low) | grams.astype(np.uint64), length - GRAM + 1) & low).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(np.diff(anchor)) + 1))
        last = np.concatenate((first[1:], [len(anchor)])) - 1
        p = anchor[first]
        near, far = (p - last) // chunk, (p - first) // chunk
        count = far - near + 1
        run = np.repeat(np.arange(len(p)), count)
        c = near[run] + np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count)
        start = p[run] - c * chunk
        lo = np.maximum(first[run], start - chunk + 1)
        hi = np.minimum(last[run], start)
        core = spans(start, start + (length - chunk + 1)) ^ mix64(c.astype(np.uint64))
        parts.append((core, start + a, lo + a, hi + a))
    if not parts:
        return tuple(np.zeros(0, dtype=t) for t in (np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _bytes(text) -> np.ndarray:
    """The bytes of an Arrow string without a copy; null is empty."""
    return np.frombuffer(text.as_buffer(), dtype=np.uint8) if text.is_valid and len(text.as_buffer()) else np.zeros(0, np.uint8)


def _marks(length: int, chunk: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(0):
                data = _bytes(text)
                if len(data) < length:
                    continue
                key = digest16(data)
                core, start, lo, hi = chunks(data, length, chunk)
                place = mix64(start.astype(np.uint64) ^ np.frombuffer(key, dtype="<u8")[0])
                rows.append((core, place, key, start, lo, hi))
            if rows:
                cat = lambda k, kind: pa.array(np.concatenate([r[k] for r in rows]).astype(kind))
                keys = pa.array([r[2] for r in rows], type=pa.binary()).take(pa.array(np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])))
                core, place = (pa.array(np.concatenate([r[k] for r in rows]).view(np.int64)) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [core, place, keys, cat(3, np.int32), cat(4, np.int32), cat(5, np.int32)], names=[x.split()[0] for x in _MARKS.split(", ")]
                )

    return run


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([digest16(_bytes(t)) for t in batch.column(0)], type=pa.binary())], names=["key"])


def _wanted(held, length: int):
    """(key, body) of the texts whose key is in the bit set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = [], []
            for text in batch.column(0):
                data = _bytes(text)
                if len(data) >= length and taken(held.value, spot_of((key := digest16(data)).hex())):
                    keys.append(key)
                    bodies.append(data.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(bodies, type=pa.binary())], names=["key", "body"])

    return run


def _contents(length: int):
    """The bytes of each repeated chunk, from its first window start to the end of its last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in _CONTENT.split(", ")]
        kinds = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary())
        for batch in batches:
            for key, body, marks in zip(*(batch.column(c).to_pylist() for c in ("key", "body", "marks")), strict=True):
                rows = []
                for m in marks:
                    own, lead = body[m["lo"] : m["hi"] + length], m["at"] - m["lo"]
                    digest = hashlib.blake2b(own, digest_size=16, salt=lead.to_bytes(4, "little")).digest()
                    rows.append((m["core"], digest, m["place"], key, m["lo"], lead, own))
                yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return run


# --- sorting -------------------------------------------------------------------------------------


def repeated_windows(core: np.ndarray, lead: np.ndarray, body: list[bytes], many: np.ndarray, length: int) -> list[np.ndarray]:
    """For each chunk, a flag for each of its windows: does it occur in another chunk of its core, or is its chunk at
    several places. Rows are sorted by (core, bytes from the core on)."""
    size = np.array([len(b) for b in body])
    flags = [np.full(s - length + 1, m) for s, m in zip(size.tolist(), many.tolist(), strict=True)]
    width = int(lead.max()) + length
    grid = np.zeros((len(body), int((size - lead).max())), dtype=np.uint8)  # from the core on
    front = np.zeros((len(body), int(lead.max())), dtype=np.uint8)  # before the core, nearest byte first
    for k, b in enumerate(body):
        row = np.frombuffer(b, dtype=np.uint8)
        grid[k, : size[k] - lead[k]] = row[lead[k] :]
        front[k, : lead[k]] = row[: lead[k]][::-1]
    same = grid[1:] == grid[:-1]
    lcp = np.zeros(len(body), dtype=np.int64)  # with the row before
    lcp[1:] = np.where(same.all(axis=1), width, same.argmin(axis=1))
    lcp[1:] = np.where(core[1:] == core[:-1], np.minimum(lcp[1:], np.minimum((size - lead)[1:], (size - lead)[:-1])), 0)
    order = np.arange(len(body))
    for e in range(int(lead.max()) + 1):
        if e:
            alive = np.flatnonzero(lead[order] >= e)
            if not len(alive):
                break
            new = front[order[alive], e - 1].astype(np.int64)
            group = np.cumsum(np.concatenate(([True], core[order[alive]][1:] != core[order[alive]][:-1])))
            turn = np.argsort(group * 256 + new, kind="stable")
            before, new, group = alive[turn], new[turn], group[turn]
            fresh = np.zeros(len(before), dtype=np.int64)
            pair = np.flatnonzero((new[1:] == new[:-1]) & (group[1:] == group[:-1])) + 1
            if len(pair):
                ends = np.column_stack((before[pair - 1] + 1, before[pair] + 1)).ravel()
                fresh[pair] = np.minimum.reduceat(np.concatenate((lcp, [0])), ends)[::2] + 1
            order, lcp = order[before], fresh
        full = lcp >= length
        full |= np.concatenate((full[1:], [False]))
        for k in order[full].tolist():
            at = lead[k] - e
            if at < len(flags[k]):
                flags[k][at] = True
    return flags


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return list(zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True))


def _sorted_shard(length: int, rows_at_once: int = 4096):
    """Stream (core, content, lead, body, many) sorted by (core, bytes from the core on), whole cores at a time."""

    def solve(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(held)
        core, lead = (rows.column(c).to_numpy() for c in ("core", "lead"))
        flags = repeated_windows(core, lead, rows.column("body").to_pylist(), rows.column("many").to_numpy(), length)
        content, first, end = [], [], []
        for digest, own in zip(rows.column("content").to_pylist(), flags, strict=True):
            for a, b in _runs(own):
                content.append(digest)
                first.append(a)
                end.append(b)
        return pa.RecordBatch.from_arrays(
            [pa.array(content, type=pa.binary()), pa.array(first, type=pa.int32()), pa.array(end, type=pa.int32())], names=["content", "first", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not len(batch):
                continue
            held.append(batch)
            if sum(map(len, held)) < rows_at_once:
                continue
            core = batch.column("core").to_numpy()
            cut = int(np.searchsorted(core, core[-1]))  # the last core may go on in the next batch
            if cut or core[0] != core[-1]:
                yield solve([*held[:-1], batch.slice(0, cut)])
                held = [batch.slice(cut)]
        if held:
            yield solve(held)

    return run


def _windows(length: int):
    """(window digest, content, first, place) of every window of hot chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for core, content, lead, body, many in zip(*(batch.column(c).to_pylist() for c in ("core", "content", "lead", "body", "many")), strict=True):
                for k in range(len(body) - length + 1):
                    row = (hashlib.blake2b(body[k : k + length], digest_size=16).digest(), content, k, many, core)
                    for part, value in zip(out, row, strict=True):
                        part.append(value)
            kinds = (pa.binary(), pa.binary(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(out, kinds, strict=True)], names=["window", "content", "first", "many", "core"])

    return run


def repeated_spans(texts: DataFrame, length: int = LENGTH, chunk: int = CHUNK, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """For a single text column: (key, spans) of texts with repeats, and (key) of texts that occur more than once."""
    marks = stored(texts.mapInArrow(_marks(length, chunk), _MARKS), "repeat-marks")
    cores = marks.groupBy("core").agg(F.min("place").alias("_a"), F.max("place").alias("_b"))
    cores = cores.where(F.col("_a") != F.col("_b")).select(F.col("core").alias("_core"))
    found = marks.join(cores, F.col("core") == F.col("_core")).drop("_core").distinct()  # copies of a text collapse
    mark = F.struct("core", "place", "at", "lo", "hi")
    found = stored(found.groupBy("key").agg(F.collect_list(mark).alias("marks")), "repeat-found")  # of one text
    held = bit_set(found.select(spot_column(F.lower(F.hex("key"))).alias("s")))
    bodies = texts.mapInArrow(_wanted(held, length), "key binary, body binary").groupBy("key").agg(F.first("body").alias("body"))
    parts = found.join(bodies.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select("key", "body", "marks")
    parts = stored(parts.mapInArrow(_contents(length), _CONTENT), "repeat-chunks")

    bodies = parts.groupBy("content").agg(
        F.first("core").alias("core"), F.first("lead").alias("lead"), F.first("body").alias("body"),
        (F.min("place") != F.max("place")).alias("many"),
    )
    bodies = stored(bodies, "repeat-contents")
    crowded = bodies.groupBy("core").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select(F.col("core").alias("_core"))
    crowded = stored(crowded, "repeat-crowded")
    cold = bodies.join(crowded, F.col("core") == F.col("_core"), "left_anti").withColumn("_tail", F.expr("substring(body, lead + 1)"))
    cold = cold.repartition("core").sortWithinPartitions("core", "_tail").select("core", "content", "lead", "body", "many")
    flags = cold.mapInArrow(_sorted_shard(length), "content binary, first int, end int")
    win = bodies.join(crowded, F.col("core") == F.col("_core"), "left_semi").select("core", "content", "lead", "body", "many")
    win = win.mapInArrow(_windows(length), "window binary, content binary, first int, many boolean, core long")
    twice = win.groupBy("window").agg(F.min("content").alias("_a"), F.max("content").alias("_b"), F.max("many").alias("_m"))
    twice = twice.where((F.col("_a") != F.col("_b")) | F.col("_m")).select(F.col("window").alias("_w"))
    hot_flags = win.join(twice, F.col("window") == F.col("_w")).select("content", "first", (F.col("first") + 1).alias("end"))
    flags = stored(flags.unionAll(hot_flags).withColumnRenamed("content", "_content"), "repeat-flags")
    spans = parts.select("key", "lo", "content").join(flags, F.col("content") == F.col("_content"))
    spans = spans.select("key", F.struct((F.col("lo") + F.col("first")).alias("a"), (F.col("lo") + F.col("end") + (length - 1)).alias("b")).alias("s"))
    spans = spans.groupBy("key").agg(F.collect_list("s").alias("spans"))  # of one text
    copies = texts.mapInArrow(_keyed, "key binary").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("key")
    return stored(spans, "repeat-spans"), stored(copies, "repeat-copies")


_RESULT = "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def _cut(at: int, length: int, keep: bool):
    """Result columns from the text (column `at`), and from `spans` and `whole` in the last two columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans, whole in zip(batch.column(at), batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                data = _bytes(text).tobytes()
                if whole and len(data) >= length:
                    spans = [{"a": 0, "b": len(data)}]
                pieces, here, removed, runs = [], 0, 0, 0
                for s in sorted(spans or (), key=lambda s: s["a"]):
                    if s["a"] > here or not runs:
                        pieces.append(data[here : s["a"]])
                        here, runs = s["a"], runs + 1
                    removed += max(0, s["b"] - here)
                    here = max(here, s["b"])
                pieces.append(data[here:])
                kept = b"".join(pieces)
                rows.append((len(data), removed, runs, hashlib.sha256(kept).hexdigest(), kept if keep else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            made = [pa.array([r[k] for r in rows], type=kind) for k, kind in enumerate(kinds)]
            names = [*batch.schema.names[:-2], *[x.split()[0] for x in _RESULT.split(", ")]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *made], names=names)

    return run


def _split(held, at: int, inside: bool):
    """Rows whose text is in the bit set, with its key; or the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = [digest16(_bytes(t)) for t in batch.column(at)]
            mask = pa.array([taken(held.value, spot_of(k.hex())) == inside for k in keys], type=pa.bool_())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, type=pa.binary())], names=[*batch.schema.names, "_key"]).filter(mask)

    return run


def without_repeats(
    documents: DataFrame, length: int = LENGTH, chunk: int = CHUNK, hot: int = HOT, text: str = "text", keep: bool = True
) -> DataFrame:
    """The documents with n_bytes, n_removed, n_spans, kept_sha256 and (`keep`) the remaining bytes `kept`."""
    from pyspark.sql.types import StructType

    documents = documents.drop(*[x.split()[0] for x in _RESULT.split(", ")], "_key", "_spans", "_whole", "_known")
    at = documents.columns.index(text)
    spans, copies = repeated_spans(documents.select(text), length, chunk, hot)
    touched = spans.select("key").unionAll(copies)
    held = bit_set(touched.select(spot_column(F.lower(F.hex("key"))).alias("s")))
    keyed = StructType([*documents.schema.fields, *StructType.fromDDL("_key binary").fields])
    known = spans.withColumnRenamed("spans", "_spans").join(copies.select("key", F.lit(True).alias("_whole")), "key", "full")
    known = known.withColumnRenamed("key", "_known")
    inside = documents.mapInArrow(_split(held, at, True), keyed).join(known, F.col("_key") == F.col("_known"), "left")
    outside = documents.mapInArrow(_split(held, at, False), keyed)
    none = [F.lit(None).cast(known.schema["_spans"].dataType).alias("_spans"), F.lit(None).cast("boolean").alias("_whole")]
    own = [F.col(f"`{c}`") for c in documents.columns]
    both = inside.select(*own, "_spans", "_whole").unionAll(outside.select(*own, *none))
    return both.mapInArrow(_cut(at, length, keep), StructType([*documents.schema.fields, *StructType.fromDDL(_RESULT).fields]))


@register("op10_repeated_strings")
def op10_repeated_strings(spark, sf_dir: str) -> DataFrame:
    cut = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=False)
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
