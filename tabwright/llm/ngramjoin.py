"""Exact n-gram Jaccard join: size-banded tiles of sets with hashed bitmaps, then sorted-array intersection.

A text's set holds its distinct five-word shingles; two texts link when their sets' Jaccard similarity reaches the
threshold, and components are the connected texts. Nothing is lost: every filter is a bound, every link is exact.

1. Shingles are ordered by how often the corpus holds them (counts in 2^20 hashed cells, all documents), rare ones
   first. Sets that are similar enough share a shingle among the first floor((1 - t) n) + 1 of either, so only sets
   that share such a shingle meet; groups of shingles with the same members count once. A shingle that a third of all
   documents hold stands last in their order and brings only those together that hold little else.
2. Equal sets are one node. In a few star rounds every node meets one drawn member of each of its groups by bitmap and
   is verified against one that passes; groups whose members are connected by then are done, so a group of copies costs
   no pairs.
3. What is left is cut into tiles by band of set size and hash. Only tiles of the same and the next band meet. Each
   set has a bitmap that every shingle toggles one bit of: the bits in which two bitmaps differ are no more than the
   shingles in which the sets differ, which bounds the overlap from above. Pairs that pass, of different components
   so far, are intersected as sorted arrays.
4. Long sets fill a bitmap, so it tells nothing about them. From `LONG` shingles on a set also has how many shingles each
   of 1024 cells holds: the counts differ by no more than the sets do. Pairs are held against these before a set moves.

Tiles hold about `TILE` sets, so a hot group becomes many tile pairs in many tasks; no pair leaves a tile unless its
bound passes. Nothing about documents is collected but counts in cells and bit sets (see grains.Bits).

Defined results: words are runs of other bytes than white space, A-Z lower-cased; fewer than five words are one
shingle; a null text or one without words has an empty set, n_shingles 0, and is linked with nothing, so component_id
is its own doc_id. component_id is the smallest doc_id of the component (null where all are null). Repeated rows share
theirs. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import digest16, discard, stored
from tabwright.llm.components import components
from tabwright.llm.grains import Bits, chunks, gram_hashes, signed
from tabwright.llm.registry import register, table
from tabwright.llm.tiles import BITMAP, TILE, alike, bitmap, cell_counts, compare, near, open_groups, overlap_enough, tile_pairs, tiles  # noqa: F401

SHINGLE = 5
PERCENT = 80
CELLS = 20  # 2^20 counters
CELL_ROW = 1024
STARS = 2  # star rounds before tiles
LONG = 1024  # shingles from which a set has counts

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
NO_BREAK = np.zeros(256, dtype=bool)


def shingle_sets(texts: list[str | None], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct shingle hashes) of the texts that have words."""
    for words in chunks(texts, ~SPACE, NO_BREAK):
        if not len(words.hash):
            continue
        cuts = np.flatnonzero(np.concatenate(([True], words.row[1:] != words.row[:-1], [True])))
        whole = gram_hashes(words.hash, size)
        for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            found = whole[a : b - size + 1] if b - a >= size else gram_hashes(words.hash[a:b], b - a)
            yield int(words.row[a]), np.unique(found)


# --- order of shingles ---------------------------------------------------------------------------


def _count_cells(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS, dtype=np.uint32)
        for batch in batches:
            held, n = [], 0
            for _, found in shingle_sets(batch.column(0).to_pylist(), size):
                held.append(found >> np.uint64(64 - CELLS))
                n += len(found)
                if n > 1 << 20:
                    total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
                    held, n = [], 0
            if held:
                total += np.bincount(np.concatenate(held).astype(np.int64), minlength=1 << CELLS).astype(np.uint32)
        rows = total.reshape(-1, CELL_ROW)
        used = np.flatnonzero(rows.any(axis=1))
        packed = [r.astype(np.uint8 if r.max() < 256 else np.uint32).tobytes() for r in rows[used]]
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(packed, type=pa.binary())], names=["cell", "packed"])

    return run


def _add_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for cell, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            kind = np.uint8 if len(packed) == CELL_ROW else np.int64 if len(packed) == 8 * CELL_ROW else np.uint32
            total[cell] = total.get(cell, 0) + np.frombuffer(packed, dtype=kind).astype(np.int64)
    yield pa.RecordBatch.from_arrays(
        [pa.array(list(total), type=pa.int64()), pa.array([v.tobytes() for v in total.values()], type=pa.binary())], names=["cell", "packed"]
    )


def frequency_classes(texts: DataFrame, size: int):
    """Broadcast class of each cell, from rare to frequent: 1 MB, whatever the corpus."""
    shape = "cell long, packed binary"
    summed = texts.mapInArrow(_count_cells(size), shape).repartition("cell").mapInArrow(_add_cells, shape)
    counts = np.zeros((1 << CELLS) // CELL_ROW * CELL_ROW, dtype=np.int64).reshape(-1, CELL_ROW)
    for r in summed.collect():  # 8 MB
        counts[r["cell"]] = np.frombuffer(r["packed"], dtype=np.int64)
    classes = np.minimum(4 * np.log2(1.0 + counts.ravel()), 255).astype(np.uint8)
    return texts.sparkSession.sparkContext.broadcast(classes)


# --- sets ----------------------------------------------------------------------------------------


def prefix_length(n: int, percent: int) -> int:
    """So many of its first shingles must hold one that a similar set shares."""
    return n + (-percent * n) // 100 + 1


def _describe(size: int, percent: int, classes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = classes.value
        low = np.uint64((1 << 56) - 1)
        for batch in batches:
            n = batch.num_rows
            keys, sizes, maps, counts, prefixes = [None] * n, [0] * n, [None] * n, [None] * n, [None] * n
            for row, found in shingle_sets(batch.column(1).to_pylist(), size):
                order = (held[found >> np.uint64(64 - CELLS)].astype(np.uint64) << np.uint64(56)) | (found & low)
                short = prefix_length(len(found), percent)
                first = np.partition(order, short - 1)[:short] if short < len(order) else order
                keys[row], sizes[row], maps[row], prefixes[row] = digest16(found), len(found), bitmap(found), first.view(np.int64)
                counts[row] = cell_counts(found) if len(found) >= LONG else None
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(keys, type=pa.binary()),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(maps, type=pa.binary()),
                    pa.array(counts, type=pa.binary()),
                    pa.array(prefixes, type=pa.list_(pa.int64())),
                ],
                names=["doc_id", "key", "n", "bitmap", "counts", "prefix"],
            )

    return run


def _items(size: int, wanted: Bits):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(wanted.has(batch.column(0).to_numpy().view(np.uint64))))
            found = [s for _, s in shingle_sets(some.column(1).to_pylist(), size)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([digest16(s) for s in found], type=pa.binary()), pa.array([s.tobytes() for s in found], type=pa.binary())],
                names=["key", "items"],
            )

    return run


# --- pairs ---------------------------------------------------------------------------------------


def _intersect(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(bool(overlap_enough(len(x), len(y), shared, percent)))
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def _links(pairs: DataFrame, nodes: DataFrame, slim: DataFrame, percent: int, shingle: int) -> DataFrame:
    """The (a, b) pairs whose sets are similar enough; the sets of their nodes are read from the texts again."""
    pairs = stored(alike(stored(pairs, "ngramjoin-met"), nodes, percent), "ngramjoin-pairs")
    ends = pairs.select(F.col("a").alias("_m")).unionAll(pairs.select("b")).distinct()
    some = stored(nodes.join(ends, F.col("node") == F.col("_m")).select("doc_id", "key", "node"), "ngramjoin-ends")
    wanted = Bits(some.select(F.xxhash64("doc_id").alias("h")))
    items = slim.select(F.xxhash64("doc_id").alias("h"), "text").mapInArrow(_items(shingle, wanted), "key binary, items binary")
    items = items.groupBy(F.col("key").alias("_k")).agg(F.first("items").alias("items"))
    sets = stored(items.join(some.select("key", "node"), F.col("_k") == F.col("key")).select("node", "items"), "ngramjoin-items")
    left = sets.select(F.col("node").alias("_a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("_b"), F.col("items").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    links = stored(both.mapInArrow(_intersect(percent), "a long, b long"), "ngramjoin-links")
    discard(sets)
    return links


def _star(members: DataFrame, nodes: DataFrame, turn: int, percent: int) -> DataFrame:
    """One pair for each node: with the drawn member of one of its groups, if in another component and near by their bitmaps."""
    drawn = F.xxhash64("node", F.lit(turn))
    hubs = members.groupBy(F.col("token").alias("_t")).agg(F.min_by(F.struct("node", "n", "root"), drawn).alias("hub"))
    met = members.join(hubs, F.col("token") == F.col("_t")).where(F.col("root") != F.col("hub.root"))
    met = met.where(100 * F.least("n", "hub.n") >= percent * F.greatest("n", "hub.n"))
    met = near(met.select(F.col("node").alias("a"), F.col("hub.node").alias("b")).distinct(), nodes, percent)
    one = met.groupBy("a").agg(F.min_by("b", F.xxhash64("b", F.lit(turn))).alias("b"))
    return one.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def ngram_components(
    documents: DataFrame,
    percent: int = PERCENT,
    shingle: int = SHINGLE,
    stars: int = STARS,
    tile: int = TILE,
    text: str = "text",
    id_: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document."""
    if not 0 < percent <= 100:
        raise ValueError("percent lies above 0 and up to 100")
    slim = documents.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    classes = frequency_classes(slim.select("text"), shingle)
    shape = "doc_id long, key binary, n long, bitmap binary, counts binary, prefix array<long>"
    found = slim.mapInArrow(_describe(shingle, percent, classes), shape).withColumn("at", F.monotonically_increasing_id())
    found = stored(found, "ngramjoin-sets")
    real = found.where(F.col("key").isNotNull())
    nodes = stored(real.groupBy("key").agg(F.min("at").alias("node"), F.min("doc_id").alias("least")), "ngramjoin-nodes")

    own = real.join(nodes.select("node"), F.col("at") == F.col("node"))
    # groups and members take the same columns of the same rows, so that one exchange serves both
    held = own.select("node", "n", F.explode("prefix").alias("token")).where(F.col("token").isNotNull()).repartition("token")
    groups = held.groupBy("token").agg(
        F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("node", "n")).alias("x"), F.bit_xor(F.xxhash64("node", "n", F.lit(7))).alias("y")
    )
    # of shingles with the same members one is enough
    kept = groups.where("size > 1").groupBy("size", "x", "y").agg(F.min("token").alias("_kept")).select("_kept")
    members = stored(held.join(kept, F.col("token") == F.col("_kept")).select("token", "node", "n"), "ngramjoin-members")
    roots = _roots(slim, real, members, percent, shingle, stars, tile)

    named = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select(
        "key", "least", F.coalesce("root", "node").alias("root")
    )
    least = named.groupBy(F.col("root").alias("_root")).agg(F.min("least").alias("component_id"))
    named = named.join(least, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), "component_id")
    linked = real.select("doc_id", "key", "n").join(named, F.col("key") == F.col("_key")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    alone = found.where(F.col("key").isNull()).select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return linked.unionAll(alone)


def _roots(slim: DataFrame, real: DataFrame, members: DataFrame, percent: int, shingle: int, stars: int, tile: int) -> DataFrame:
    """(node, root) of the nodes that have links."""
    some = real.join(members.select(F.col("node").alias("_m")).distinct(), F.col("at") == F.col("_m")).select(
        "doc_id", "key", F.col("at").alias("node"), "n", "bitmap", "counts"
    )
    some = stored(some, "ngramjoin-candidates")
    links, labels, left = None, None, members
    for turn in range(stars + 1):
        left = open_groups(left, labels)
        if left.isEmpty():
            break
        if turn < stars:
            pairs = _star(left, some, turn, percent)
        else:
            pairs = tiles(left, some.select("node", "bitmap"), percent, tile).mapInArrow(compare(percent), "a long, b long").distinct()
        more = _links(pairs, some, slim, percent, shingle)
        links = more if links is None else links.unionAll(more)  # of stored tables, one a round
        if turn < stars:
            labels = _relabelled(labels, more, turn)
    if links is None:
        return slim.sparkSession.createDataFrame([], "node long, root long")
    return components(links)


def _relabelled(labels: DataFrame | None, links: DataFrame, turn: int) -> DataFrame:
    """(node, root) where root is another node of its component: enough to skip pairs, at a few joins a round."""
    x, y = F.col("a"), F.col("b")
    if labels is not None:
        for side in ("a", "b"):
            named = labels.select(F.col("node").alias("_n"), F.col("root").alias(f"_{side}"))
            links = links.join(named, F.col(side) == F.col("_n"), "left").drop("_n")
        x, y = F.coalesce("_a", "a"), F.coalesce("_b", "b")
    ends = links.select(x.alias("x"), y.alias("y")).where("x <> y")
    place = lambda c: F.xxhash64(c, F.lit(turn))  # noqa: E731  links point to the smaller place, so there are no cycles
    down = place("x") < place("y")
    ends = ends.select(F.when(down, F.col("y")).otherwise(F.col("x")).alias("node"), F.when(down, F.col("x")).otherwise(F.col("y")).alias("root"))
    up = stored(ends.groupBy("node").agg(F.min_by("root", place("root")).alias("root")), "ngramjoin-labels")
    above = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    for _ in range(2):
        up = up.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    up = stored(up, "ngramjoin-labels")
    if labels is None:
        return up
    above = up.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    moved = labels.join(above, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return stored(moved.unionAll(up), "ngramjoin-labels")


SQL = r"""
WITH RECURSIVE
d AS (SELECT row_number() OVER () AS k, doc_id,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT k, w[p : p + 4] AS g FROM (SELECT k, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT k, count(*) AS n FROM s GROUP BY k),
shared AS (SELECT a.k AS x, b.k AS y, count(*) AS c FROM s AS a JOIN s AS b ON a.g = b.g AND a.k < b.k GROUP BY a.k, b.k),
links AS (SELECT x, y FROM shared JOIN n AS a ON a.k = x JOIN n AS b ON b.k = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
both_ways AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT k AS x, k AS y FROM d UNION SELECT reach.x, both_ways.y FROM reach JOIN both_ways ON reach.y = both_ways.x),
least AS (SELECT x, min(doc_id) AS component_id FROM reach JOIN d ON d.k = y GROUP BY x)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id FROM d LEFT JOIN n USING (k) JOIN least ON x = d.k
"""


@register("op11_ngram_join", SQL)
def op11_ngram_join(spark, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents").select("doc_id", "text"))
