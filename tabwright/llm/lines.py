"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Words carry a 63-bit code, rarity class first, so that ascending codes order
them by rarity; the counts behind it cover all documents and live in a table of fixed size (2^20 counters).
Candidates meet by the upper 31 bits of a code. Lines with equal sets are one node. Two sets of sizes n <= m with Jaccard >= t
share at least a = ceil(t / (1 + t) (n + m)) words, so

* prefix: they share a word among the first m - ceil(t m) + 1 of the larger one and the first
  n - ceil(2 t / (1 + t) n) + 1 of the smaller one,
* length: n >= t m,
* position: 1 + min(words after the shared one) >= a, which is what shortens the smaller one's prefix,
* bitmap: maps of 64 bits (128 for sets of `WIDE` words and more) in which every word toggles its bit differ in at most
  n + m - 2 a bits; common words cancel out, so long lines are told apart as well,

and what is left is verified on the full sets. Sets meet by word in one exchange of sizes and maps, sorted by size, so that each
is held against those in reach of its length alone; a word with more than `TILE` sets is dealt into parts that meet in pairs.
A pair belongs to its rarest common word. Where more than `hot` sets share a word and pass by the maps so often that pairs
would grow with the square of a cluster, only the sets that pass are named: these are dealt into blocks with their words, each
pair of blocks is compared inside one task by an incidence product, and only counts and the earliest partner leave it.

A line goes when an earlier line, in the order (doc_id, line), has the same set or a similar one.

Defined results: lines without words have no class and always stay; a null text has no lines; an empty text
has one empty line; null doc_ids come first; repeated rows are lines like others, and of lines with the same
doc_id and number exactly the first occurrence counts as earliest (so both stay). Texts are rebuilt by doc_id and
text digest, so rows with a repeated or null doc_id lose their own lines only. Other columns pass through.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import bit_set, dense, digest16, row_digest, spot, spot_of, stored, taken, word_spans
from tabwright.llm.registry import register, table
from tabwright.session import BROADCAST_ROWS

THRESHOLD = 0.8
HOT = 512
BLOCK = 384
COUNTERS = 20  # bits
WIDE = 72  # words from which a set has 128 bits
TILE = 1 << 14  # sets of a word that are compared in one place
ROWS = 1 << 16  # postings that are compared at once
CELLS = 1 << 18  # pairs whose maps are held at once
RUN = 48  # sets of a word from which they are compared as a matrix
AT_ONCE = 1 << 17  # characters whose lines are coded at once

_LINES = "doc_id long, line int, key binary, n int, bits long, wide long, prefix array<int>"


# --- words of lines ----------------------------------------------------------------------------


def _chunks(texts: list[str]) -> Iterator[range]:
    """Consecutive texts of about AT_ONCE characters."""
    begin, size = 0, 0
    for k, text in enumerate(texts):
        size += len(text) + 1
        if size >= AT_ONCE:
            yield range(begin, k + 1)
            begin, size = k + 1, 0
    if begin < len(texts):
        yield range(begin, len(texts))


def _words(text: str) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of lines, line of each word, hash of each word)."""
    low, starts, ends, spans = word_spans(text.encode())
    breaks = np.flatnonzero(low == 10)
    first = np.concatenate(([0], np.searchsorted(starts, breaks), [len(starts)]))
    return len(breaks) + 1, np.repeat(np.arange(len(breaks) + 1), np.diff(first)), spans(starts, ends)


def _codes(text: str, rarity: np.ndarray) -> tuple[int, np.ndarray, np.ndarray]:
    """(number of lines, line, code) of the distinct words of each line, in ascending order."""
    n, line, h = _words(text)
    rare = rarity[(h & np.uint64(len(rarity) - 1)).astype(np.int64)]
    code = (rare.astype(np.uint64) << np.uint64(57)) | (h >> np.uint64(7))
    order = _by_line(line, code, n)
    line, code = line[order], code[order]
    fresh = np.ones(len(code), dtype=bool)
    fresh[1:] = (line[1:] != line[:-1]) | (code[1:] != code[:-1])
    return n, line[fresh], code[fresh]


def _by_line(line: np.ndarray, code: np.ndarray, n: int) -> np.ndarray:
    """Order by (line, code): by one number that holds the line and the upper bits of the code, where these settle it."""
    width = max(n - 1, 1).bit_length()
    both = (line.astype(np.uint64) << np.uint64(64 - width)) | (code >> np.uint64(width - 1))
    order = np.argsort(both)
    both, code_ = both[order], code[order]
    unsettled = (both[1:] == both[:-1]) & (code_[1:] != code_[:-1])
    return np.lexsort((code, line)) if unsettled.any() else order


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(1 << COUNTERS, dtype=np.int64)
    for batch in batches:
        texts = [t for t in batch.column(0).to_pylist() if t]
        for some in _chunks(texts):
            _, _, h = _words("\n".join(texts[some.start : some.stop]))
            np.add.at(total, (h & np.uint64(len(total) - 1)).astype(np.int64), 1)
    spot = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(spot), pa.array(total[spot])], names=["at", "n"])


def _rarity(documents: DataFrame) -> np.ndarray:
    """Rarity class, 0 to 63, for each counter."""
    found = documents.select("text").mapInArrow(_count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n"))
    return np.minimum(2 * np.log2(dense(found, 1 << COUNTERS, "<i8") + 1.0), 63).astype(np.uint8)


def _prefix(n: np.ndarray, t: float) -> np.ndarray:
    return n - np.ceil(t * n - 1e-9).astype(np.int64) + 1


def _toggled(marks: np.ndarray, start: np.ndarray, full: np.ndarray, n: int) -> np.ndarray:
    """The maps of n lines, of which `full` have words from `start` on."""
    bits = np.zeros(n, dtype=np.uint64)
    if len(full):
        bits[full] = np.bitwise_xor.reduceat(marks, start[full])
    return bits


def _line_rows(held, t: float):
    """The lines of all texts; further columns go to each line of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity = held.value
        for batch in batches:
            batch = batch.filter(batch.column(1).is_valid())
            docs, texts = batch.column(0), batch.column(1).to_pylist()
            for some in _chunks(texts):
                texts_ = texts[some.start : some.stop]
                n, line, code = _codes("\n".join(texts_), rarity)
                held_lines = np.array([x.count("\n") + 1 for x in texts_])
                origin = np.repeat(np.arange(some.start, some.stop), held_lines)
                own = np.arange(n) - np.repeat(np.cumsum(held_lines) - held_lines, held_lines)
                size = np.bincount(line, minlength=n)
                start = np.cumsum(size) - size
                raw, ends = code.tobytes(), np.cumsum(size)
                keys = [digest16(raw[8 * a : 8 * b]) if b > a else None for a, b in zip(start.tolist(), ends.tolist(), strict=True)]
                full, marks = np.flatnonzero(size), np.uint64(1) << (code & np.uint64(63))
                bits = _toggled(marks, start, full, n)
                wide = _toggled(np.where(code & np.uint64(64), marks, np.uint64(0)), start, full, n)
                wide[size < WIDE] = 0
                prefix = _prefix(size, t)
                head = code[np.arange(len(code)) - start[line] < prefix[line]]
                edges = np.concatenate(([0], np.cumsum(np.minimum(prefix, size)))).astype(np.int32)
                origin = pa.array(origin)
                yield pa.RecordBatch.from_arrays(
                    [
                        docs.take(origin),
                        pa.array(own.astype(np.int32)),
                        pa.array(keys, type=pa.binary()),
                        pa.array(size.astype(np.int32)),
                        pa.array(bits.view(np.int64)),
                        pa.array(wide.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(edges), pa.array((head >> np.uint64(32)).astype(np.int32))),
                        *[c.take(origin) for c in batch.columns[2:]],
                    ],
                    names=[*[x.split()[0] for x in _LINES.split(", ")], *batch.schema.names[2:]],
                )

    return run


def _full_sets(held, bits, power: int):
    """(key, packed codes) of the lines whose spot in the bit set of 2^power places is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, flags = held.value, bits.value
        for batch in batches:
            wanted = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if text:
                    wanted += [x for k, x in enumerate(text.split("\n")) if taken(flags, spot_of(doc, k, bits=power))]
            for some in _chunks(wanted):
                n, line, code = _codes("\n".join(wanted[some.start : some.stop]), rarity)
                raw, ends = code.tobytes(), 8 * np.searchsorted(line, np.arange(n + 1))
                packed = [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True) if b > a]
                keys = [digest16(x) for x in packed]
                yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(packed, type=pa.binary())], names=["key", "words"])

    return run


# --- the join ----------------------------------------------------------------------------------


def _shared_least(n: Column, m: Column, t: float) -> Column:
    return F.ceil(F.lit(t / (1 + t)) * (n + m) - 1e-9)


def _dealt(postings: DataFrame) -> DataFrame:
    """The postings by place of comparison: (key, at, id, bits, wide), sorted by key in their partitions.

    `key` holds the word, the two parts that meet and the size, so equal upper 48 bits are one place; `at` holds the size, the
    position and, in its lowest bits, whether the word is dealt into parts and of which of the two parts a set is.
    """
    # only words whose counter is that high can have as many sets
    often = postings.where(F.shiftright("word", 25) >= int(2 * math.log2(TILE + 1)))
    parts = often.groupBy("word").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > TILE)
    parts = stored(parts.select(F.col("word").alias("_word"), F.least(F.ceil(F.col("m") / F.lit(TILE)), F.lit(256)).cast("int").alias("parts")), "line-parts")
    own = F.lit(0)
    many = parts.count()
    if many:
        parts = F.broadcast(parts) if many <= BROADCAST_ROWS else parts
        postings = postings.join(parts, F.col("word") == F.col("_word"), "left")
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        # bits 2 to 17: the parts, the smaller one first
        met = F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda x: F.shiftleft(F.least(x, part), 10).bitwiseOR(F.shiftleft(F.greatest(x, part), 2)).bitwiseOR(F.lit(2)).bitwiseOR((part > x).cast("int")),
        )
        postings = postings.withColumn("place", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(met)))
        own = F.col("place")
    size = F.least(F.col("n"), F.lit(0xFFFF)).cast("long")
    key = F.shiftleft(F.col("word").cast("long"), 32).bitwiseOR(F.shiftleft(F.shiftright(own, 2).cast("long"), 16)).bitwiseOR(size)
    at = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("pos").cast("long"), 2)).bitwiseOR(own.bitwiseAND(F.lit(3)).cast("long"))
    placed = postings.select(key.alias("key"), at.alias("at"), "id", "bits", "wide")
    return placed.repartition(F.shiftright("key", 16)).sortWithinPartitions("key")


class _Places:
    """Postings of whole places, in order: which of them are candidates."""

    def __init__(self, key: np.ndarray, at: np.ndarray, id_: np.ndarray, bits: np.ndarray, wide: np.ndarray, t: float):
        self.key, self.id, self.low, self.high, self.t = key, id_, bits, wide, t
        self.n, self.pos, self.side = at >> 32, (at >> 2) & 0x3FFFFFFF, at & 1
        self.many = (at & 2) > 0  # the word is dealt into parts
        self.apart = ((key >> 24) & 0xFF) != ((key >> 16) & 0xFF)  # two parts meet, each of which is compared elsewhere
        place = key >> 16
        self.first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        self.end = np.append(self.first[1:], len(key))
        # partners follow in the order of sizes, up to n / t
        reach = np.minimum(np.floor((self.n + 1e-9) / max(t, 1e-9)), 0xFFFF).astype(np.int64)
        self.reach = np.searchsorted(key, (place << 16) | reach, side="right")
        self.most = np.minimum(self.n * (1 - t) / max(t, 1e-9) + 1e-6, 255).astype(np.uint8)  # bits that maps of partners differ in

    def pass_(self, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs of postings those that pass all filters."""
        n, m = self.n[x], self.n[y]
        least = np.ceil(self.t / (1 + self.t) * (n + m) - 1e-9)
        apart = n + m - 2 * least
        low = self.low[x] ^ self.low[y]
        ok = (np.bitwise_count(low) <= apart) & (np.minimum(n, m) >= self.t * np.maximum(n, m) - 1e-9)
        ok &= 1 + np.minimum(n - self.pos[x] - 1, m - self.pos[y] - 1) >= least
        ok &= (self.id[x] != self.id[y]) & (~self.apart[x] | (self.side[x] != self.side[y]))
        x, y, low, apart, n, m = (v[ok] for v in (x, y, low, apart, n, m))
        # the 64 bits are the 128 folded, `wide` is their upper half
        high = self.high[x] ^ self.high[y]
        ok = (np.minimum(n, m) < WIDE) | (np.bitwise_count(low ^ high).astype(np.int64) + np.bitwise_count(high) <= apart)
        return x[ok], y[ok]

    def short(self, chosen: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of the chosen postings, pair by pair."""
        count = self.reach[chosen] - chosen - 1
        chosen, count = chosen[count > 0], count[count > 0]
        total = np.cumsum(count)
        a = 0
        while a < len(chosen):
            before = total[a] - count[a]
            b = max(a + 1, int(np.searchsorted(total, before + CELLS, side="right")))
            x = np.repeat(chosen[a:b], count[a:b])
            y = x + 1 + np.arange(len(x)) - np.repeat(total[a:b] - count[a:b] - before, count[a:b])
            near = np.flatnonzero(np.bitwise_count(self.low[x] ^ self.low[y]) <= self.most[x])
            yield self.pass_(x[near], y[near])
            a = b

    def long(self, first: int, end: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates of one place, by matrices of maps."""
        a = first
        while a < end:
            b = min(end, a + max(1, CELLS // max(1, int(self.reach[a]) - a)))
            last = int(self.reach[b - 1])
            x, y = np.nonzero(np.bitwise_count(self.low[a:b, None] ^ self.low[None, a:last]) <= self.most[a:b, None])
            x, y = x + a, y + a
            ahead = (y > x) & (y < self.reach[x])
            yield self.pass_(x[ahead], y[ahead])
            a = b


def _meet(t: float, hot: int):
    """Candidates among sorted postings: (a, b, word), where `word` is given if it is dealt into parts; (a, null, word) for the
    sets that are candidates at a place where pairs are too many to be named."""

    def found(rows: _Places) -> Iterator[tuple[np.ndarray, ...]]:
        size = rows.end - rows.first
        long = (size > min(hot, RUN)) | rows.many[rows.first]
        few = np.repeat(~long, size)
        for x, y in rows.short(np.flatnonzero(few)):
            yield rows.id[x], rows.id[y], np.zeros(len(x), dtype=np.int64), np.zeros(len(x), dtype=bool)
        for first, end in zip(rows.first[long].tolist(), rows.end[long].tolist(), strict=True):
            # so many pairs a set can be named, whatever the size of a cluster
            most = (end - first) * hot / 32 if end - first > hot else math.inf
            held, count, active, named = [], 0, np.zeros(end - first, dtype=bool), True
            for x, y in rows.long(first, end):
                active[x - first] = active[y - first] = True
                count += len(x)
                named = named and count <= most
                held = [*held, (x, y)] if named else []
            word = rows.key[first] >> 32
            if named:
                if count:
                    x, y = (np.concatenate(v) for v in zip(*held, strict=True))
                    yield rows.id[x], rows.id[y], np.full(count, word), np.full(count, rows.many[first])
            else:
                x = np.flatnonzero(active) + first
                yield rows.id[x], np.full(len(x), -1), np.full(len(x), word), np.ones(len(x), dtype=bool)

    def rows_of(places: _Places) -> Iterator[pa.RecordBatch]:
        for a, b, word, told in found(places):
            low, high, one = np.minimum(a, b), np.maximum(a, b), b < 0
            columns = [
                pa.array(np.where(one, a, low)),
                pa.array(high, mask=one),
                pa.array(word.astype(np.int32), mask=~told),
            ]
            if len(a):
                yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def whole(last: bool) -> Iterator[_Places]:
            """Places that are whole; the last one may go on."""
            nonlocal held, size
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            place = columns[0] >> 16
            cut = len(place) if last else int(np.searchsorted(place, place[-1]))
            if cut:
                yield _Places(*(c[:cut] for c in columns), t)
            held, size = [tuple(c[cut:] for c in columns)], len(place) - cut

        wanted = ROWS
        for batch in batches:
            key, at, id_, bits, wide = (c.to_numpy() for c in batch.columns)
            held.append((key, at, id_, bits.view(np.uint64), wide.view(np.uint64)))
            size += len(key)
            if size >= wanted:
                for places in whole(False):
                    yield from rows_of(places)
                wanted = max(ROWS, 2 * size)
        if size:
            for places in whole(True):
                yield from rows_of(places)

    return run


def _verify(t: float):
    """Of the candidates those that are similar enough, with their rarest common word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, home = [], []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.int64) for v in (x, y))
                both = np.intersect1d(x, y, assume_unique=True)
                keep.append(len(both) > 0 and len(both) >= t * (len(x) + len(y) - len(both)) - 1e-9)
                home.append(int(both[0]) >> 32 if len(both) else 0)
            mask, home = pa.array(keep, type=pa.bool_()), pa.array(home, type=pa.int32())
            yield pa.RecordBatch.from_arrays([c.filter(mask) for c in (batch.column("a"), batch.column("b"), home)], names=["a", "b", "home"])

    return run


def _block_pairs(t: float):
    """Links between two blocks of sets that share `word`: (id, number of links, earliest partner)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                same = r["i"] == r["j"]
                if same or (r["left"] and r["right"]):
                    out += _links_of(r["word"], r["left"], r["left"] if same else r["right"], same, t)
            columns = list(zip(*out, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, type=k) for c, k in zip(columns, kinds, strict=True)], names=["id", "links", "f_doc", "f_line"])

    return run


def _links_of(word: int, left: list[dict], right: list[dict], same: bool, t: float) -> list[tuple]:
    sets = [[np.frombuffer(r["words"], dtype=np.int64) for r in side] for side in (left, right)]
    common = np.intersect1d(np.concatenate(sets[0]), np.concatenate(sets[1]))
    marks = []
    for side in sets:
        mark = np.zeros((len(side), len(common)), dtype=np.float32)
        for k, words in enumerate(side):
            place = np.searchsorted(common, words)
            place[place == len(common)] = 0
            mark[k, place[common[place] == words]] = 1
        marks.append(mark)
    size = [np.array([len(w) for w in side], dtype=np.float64) for side in sets]
    shared = (marks[0] @ marks[1].T).astype(np.float64)
    before, after = (int(np.searchsorted(common >> 32, word, side=s)) for s in ("left", "right"))
    # pairs that share this word and no rarer one
    home = (marks[0][:, :before] @ marks[1][:, :before].T == 0) & (marks[0][:, before:after] @ marks[1][:, before:after].T > 0)
    link = home & (shared >= t * (size[0][:, None] + size[1][None, :] - shared) - 1e-9)
    out = []
    if same:
        np.fill_diagonal(link, False)
    for rows, others, matrix in ((left, right, link),) if same else ((left, right, link), (right, left, link.T)):
        rank = sorted(range(len(others)), key=lambda k: _order(others[k]))
        first = np.argmax(matrix[:, rank], axis=1)
        for k in np.flatnonzero(matrix.any(axis=1)).tolist():
            early = others[rank[first[k]]]
            out.append((rows[k]["id"], int(matrix[k].sum()), early["f_doc"], early["f_line"]))
    return out


def _order(r: dict) -> tuple:
    return (r["f_doc"] is not None, r["f_doc"] or 0, r["f_line"])


def _earliest(doc: str, line: str) -> Column:
    return F.struct(F.col(doc).alias("doc"), F.col(line).alias("line"))


def line_classes(
    documents: DataFrame, threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK, text: str = "text", id_: str = "doc_id"
) -> DataFrame:
    """One row per line: doc_id, line (from 0), class (first line with the same set), n_links, removed."""
    return _classes(documents, False, threshold, hot, block, text, id_)


def _classes(
    documents: DataFrame, keyed: bool, threshold: float = THRESHOLD, hot: int = HOT, block: int = BLOCK, text: str = "text", id_: str = "doc_id"
) -> DataFrame:
    """`line_classes`, with the digest of the whole text in `row` where `keyed`."""
    spark = documents.sparkSession
    slim = documents.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    held = spark.sparkContext.broadcast(_rarity(slim))
    row = ["row"] if keyed else []
    whole = slim.withColumn("row", row_digest(F.col("text"))) if keyed else slim
    lines = stored(whole.mapInArrow(_line_rows(held, threshold), _LINES + ", row binary" * keyed), "line-rows")
    nodes = lines.where(F.col("key").isNotNull()).groupBy("key").agg(
        F.min(_earliest("doc_id", "line")).alias("f"), F.first("n").alias("n"), *[F.first(c).alias(c) for c in ("bits", "wide", "prefix")]
    )
    nodes = stored(nodes.withColumn("id", F.monotonically_increasing_id()), "line-nodes")
    links = _links(slim, nodes, held, threshold, hot, block)
    found = nodes.select("key", "f", "id").join(links.withColumnRenamed("id", "_id"), F.col("id") == F.col("_id"), "left")
    found = found.select(F.col("key").alias("_key"), "f", F.coalesce("links", F.lit(0)).alias("n_links"), F.col("early"))
    out = lines.select("doc_id", "line", "key", *row).join(found, F.col("key") == F.col("_key"), "left")
    here = _earliest("doc_id", "line")
    later = (here > F.col("f")) | F.coalesce(F.col("early") < F.col("f"), F.lit(False))
    return out.select(
        "doc_id", "line", F.col("f.doc").alias("class_doc"), F.col("f.line").alias("class_line"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(later, F.lit(False)).alias("removed"), *row,
    )


def _links(slim: DataFrame, nodes: DataFrame, held, t: float, hot: int, block: int) -> DataFrame:
    """(id, links, early): number of similar other sets, and the first line of the earliest."""
    # sets so small that not even one more word keeps the similarity link to none
    able = nodes.where(F.col("n") >= F.lit(t) * (F.col("n") + 1) - 1e-9)
    postings = able.select("id", "n", "bits", "wide", F.posexplode("prefix").alias("pos", "word"))
    met = stored(_dealt(postings).mapInArrow(_meet(t, hot), "a long, b long, word int"), "line-met")
    pairs = stored(met.where(F.col("b").isNotNull()).select("a", "b").distinct(), "line-pairs")
    heavy_words = stored(met.where(F.col("b").isNull()).select(F.col("word").alias("_word")).distinct(), "line-words")
    # a place of a heavy word may have named its pairs
    told = met.where(F.col("word").isNotNull()).select("word", F.explode(F.array("a", "b")).alias("id")).where(F.col("id").isNotNull())
    heavy = told.join(heavy_words, F.col("word") == F.col("_word"), "left_semi").distinct()
    sized = heavy.groupBy(F.col("word").alias("_w")).agg(F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int").alias("blocks"))
    heavy = stored(heavy.join(sized, F.col("word") == F.col("_w")).select("id", "word", "blocks"), "line-heavy")

    # full sets of the lines that are candidates anywhere
    wanted = pairs.select(F.col("a").alias("_k")).unionAll(pairs.select(F.col("b").alias("_k"))).unionAll(heavy.select(F.col("id").alias("_k")))
    at = stored(nodes.select("id", "key", "f").join(wanted.distinct(), F.col("id") == F.col("_k")).drop("_k"), "line-wanted")
    power = min(28, max(16, (max(1, at.count()) * 8 - 1).bit_length()))
    bits = bit_set(at.select(spot(F.col("f.doc"), F.col("f.line"), bits=power).alias("s")), power)
    sets = slim.mapInArrow(_full_sets(held, bits, power), "key binary, words binary")
    sets = sets.join(at.select("id", F.col("key").alias("_key"), "f"), F.col("key") == F.col("_key"))
    sets = sets.groupBy("key").agg(F.first("id").alias("id"), F.first("words").alias("words"), F.first("f").alias("f"))
    sets = stored(sets.drop("key"), "line-sets")

    left = sets.select(F.col("id").alias("_ka"), F.col("words").alias("x"))
    right = sets.select(F.col("id").alias("_kb"), F.col("words").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("_ka")).join(right, F.col("b") == F.col("_kb"))
    true = both.select("a", "b", "x", "y").mapInArrow(_verify(t), "a long, b long, home int")
    true = stored(true.join(heavy_words, F.col("home") == F.col("_word"), "left_anti").select("a", "b"), "line-links")
    ends = true.select(F.col("a").alias("_x"), F.col("b").alias("_y")).unionAll(true.select(F.col("b").alias("_x"), F.col("a").alias("_y")))
    firsts = at.select(F.col("id").alias("_n"), "f")
    sparse = ends.join(firsts, F.col("_y") == F.col("_n")).groupBy(F.col("_x").alias("id")).agg(
        F.count(F.lit(1)).alias("links"), F.min("f").alias("early")
    )

    full = heavy.join(sets.withColumnRenamed("id", "_ks"), F.col("id") == F.col("_ks"))
    part = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    full = full.withColumns({"_b": part, "_o": F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))})
    row = F.struct("id", "words", F.col("f.doc").alias("f_doc"), F.col("f.line").alias("f_line"))
    cells = full.groupBy("word", F.least("_b", "_o").alias("i"), F.greatest("_b", "_o").alias("j")).agg(
        F.collect_list(F.when(F.col("_b") <= F.col("_o"), row)).alias("left"), F.collect_list(F.when(F.col("_b") > F.col("_o"), row)).alias("right")
    )
    met = cells.mapInArrow(_block_pairs(t), "id long, links long, f_doc long, f_line int")
    dense = met.groupBy("id").agg(F.sum("links").alias("links"), F.min(_earliest("f_doc", "f_line")).alias("early"))
    return sparse.unionAll(dense).groupBy("id").agg(F.sum("links").alias("links"), F.min("early").alias("early"))


def without_repeated_lines(documents: DataFrame, text: str = "text", id_: str = "doc_id", **options) -> DataFrame:
    """The documents without their removed lines; n_chars, where there is one, follows the text."""
    own = [f"c{k}" for k in range(len(documents.columns))]
    at, key = documents.columns.index(text), documents.columns.index(id_)
    classes = _classes(documents, True, text=text, id_=id_, **options)
    # lines of one text: rows with equal doc_id and text lose the same lines, others have their own
    gone = classes.where("removed").groupBy("doc_id", "row").agg(F.collect_set("line").alias("_gone"))
    same = F.col(own[key]).cast("long").eqNullSafe(F.col("doc_id")) & (row_digest(F.col(own[at])) == F.col("row"))
    joined = documents.toDF(*own).join(gone, same, "left")
    kept = F.filter(F.split(F.col(own[at]), "\n"), lambda x, i: ~F.array_contains(F.col("_gone"), i))
    joined = joined.withColumn(own[at], F.when(F.col("_gone").isNull(), F.col(own[at])).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in documents.columns:
        chars = own[documents.columns.index("n_chars")]
        joined = joined.withColumn(chars, F.when(F.col("_gone").isNull(), F.col(chars)).otherwise(F.length(own[at]).cast("long")))
    return joined.select(*own).toDF(*documents.columns)


@register("op4_line_dedup")
def op4_line_dedup(spark, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
