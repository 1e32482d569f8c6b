"""Near-duplicate classes by ProbMinHash, banding and exact verification.

Each text is a set of five-word shingles. Every shingle is a Poisson process; each arrival falls into one of
120 registers, a register keeps the shingle of its first arrival, and a shingle stops once its arrivals come
later than every register's first. All shingles have the same rate, however often a text repeats them, so two
texts agree in a register with the Jaccard similarity of their sets, which is what links are verified by
(rates by occurrences would lose near copies of which one repeats a passage). 24 bands of 5 registers let a
pair at 0.8 pass with probability 1 - (1 - 0.8^5)^24 = 0.9999. Every link is verified on the shingle sets:
Jaccard >= 0.8. Classes are the connected components of the links.

Texts with equal shingle sets are one node, so a group of exact copies costs one row. Nodes carry a bitmap that
bounds how far two sets differ (see tiles). In a band bucket members are first compared with its smallest member, the
hub, where their bitmaps allow a link; what that links, the next step need not compare. Buckets that still hold several
components are cut into tiles, whose members meet inside a task; only pairs of different components whose bitmaps allow
a link leave it. Every pair of a bucket is thus verified, ruled out by its bound or already connected, without emitting
the pairs of a group. Shingles of texts that share a bucket are read by a second pass, thinned by a bit set of fixed
size. Nothing about documents is collected except that bit set.

Defined results: a text of fewer than five words, but some, is one shingle of all of them; texts without words
form a class only with equal, non-empty texts; null and empty texts are alone; class_id is the smallest
doc_id of the class (null where all are null); repeated rows share their class. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import bit_set, digest16, mix64, row_digest, spot, spot_of, stored, taken, windows, words_of
from tabwright.llm.components import components
from tabwright.llm.registry import register, table
from tabwright.llm.tiles import TILE, bitmap, compare, near, open_groups, tiles

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 24, 5
CHUNK = 1024  # arrivals drawn at once


def shingles(text: str | None, n: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes."""
    return np.unique(windows(words_of((text or "").encode())[3], n))


def signature(items: np.ndarray, weights: np.ndarray, registers: int) -> np.ndarray:
    """ProbMinHash: the item that owns each register."""
    first = np.full(registers, np.inf)
    owner = np.zeros(registers, dtype=np.uint64)
    now, drawn = np.zeros(len(items)), 0
    while len(items):
        each = max(1, CHUNK // len(items))
        number = (np.arange(drawn, drawn + each, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        seed = mix64(items[:, None] ^ mix64(number)[None, :])
        gap = -np.log1p(-(seed >> np.uint64(11)).astype(np.float64) * 2.0**-53) / weights[:, None]
        arrival = now[:, None] + np.cumsum(gap, axis=1)
        where = (mix64(seed + np.uint64(0xD6E8FEB86659FD93)) % np.uint64(registers)).astype(np.int64).ravel()
        when = arrival.ravel()
        np.minimum.at(first, where, when)
        own = np.flatnonzero(first[where] == when)
        owner[where[own]] = items[own // each]
        now, drawn = arrival[:, -1], drawn + each
        going = now < first.max()
        items, weights, now = items[going], weights[going], now[going]
    return owner


def band_hashes(owner: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = owner.reshape(bands, rows)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for k in range(rows):
        out = mix64(out ^ parts[:, k])
    return out.view(np.int64)


def _key(text: str | None, found: np.ndarray) -> bytes | None:
    """Digest of the shingle set; of the text where it has no words."""
    if len(found):
        return digest16(found)
    return digest16(np.frombuffer(b"text:" + text.encode(), dtype=np.uint8)) if text else None


def _sketch(bands: int, rows: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, hashes, sizes, maps = [], [], [], []
            for text in batch.column(1).to_pylist():
                found = shingles(text, shingle)
                keys.append(_key(text, found))
                owner = signature(found, np.ones(len(found)), bands * rows) if len(found) else None
                hashes.append(band_hashes(owner, bands, rows) if owner is not None else [])
                sizes.append(len(found))
                maps.append(bitmap(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(2),
                    pa.array(keys, type=pa.binary()),
                    pa.array(hashes, type=pa.list_(pa.int64())),
                    pa.array(sizes, type=pa.int64()),
                    pa.array(maps, type=pa.binary()),
                ],
                names=["doc_id", "row", "key", "bands", "n", "bitmap"],
            )

    return run


def _sets(held, shingle: int):
    """(key, packed sorted shingles) of documents whose spot in the bit set is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = held.value
        for batch in batches:
            keys, packed = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = shingles(text, shingle)
                if len(found) and taken(bits, spot_of((key := _key(text, found)).hex(), doc_id)):
                    keys.append(key)
                    packed.append(found.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(keys, type=pa.binary()), pa.array(packed, type=pa.binary())], names=["key", "items"])

    return run


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
            x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
            shared = len(np.intersect1d(x, y, assume_unique=True))
            scores.append(shared / (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(scores, type=pa.float64())], names=["a", "b", "jaccard"])


def _similar(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Of the (a, b) pairs those that are similar enough, with their Jaccard similarity."""
    left = sets.select(F.col("node").alias("_a"), F.col("items").alias("x"))
    right = sets.select(F.col("node").alias("_b"), F.col("items").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    scored = both.select("a", "b", "x", "y").mapInArrow(_verified, "a long, b long, jaccard double")
    return stored(scored.where(F.col("jaccard") >= similarity), "neardup-links")


def near_duplicates(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    text: str = "text",
    id_: str = "doc_id",
) -> DataFrame:
    """(doc_id, class_id) of every document."""
    return _classes(documents, similarity, shingle, bands, rows, text, id_).select("doc_id", "class_id")


def _classes(
    documents: DataFrame,
    similarity: float = SIMILARITY,
    shingle: int = SHINGLE,
    bands: int = BANDS,
    rows: int = ROWS,
    text: str = "text",
    id_: str = "doc_id",
) -> DataFrame:
    """(doc_id, row, class_id, first) of every document: `row` is the digest of its text, `first` the (doc_id missing,
    doc_id, row) that stands for its class, null for texts that are alone by definition."""
    slim = documents.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    whole = slim.withColumn("row", row_digest(F.col("text")))
    shape = "doc_id long, row binary, key binary, bands array<long>, n long, bitmap binary"
    sketched = stored(whole.mapInArrow(_sketch(bands, rows, shingle), shape).withColumn("at", F.monotonically_increasing_id()), "neardup-sketches")
    real = sketched.where(F.col("key").isNotNull())
    nodes = real.groupBy("key").agg(F.min("at").alias("node"), F.min("doc_id").alias("rep"), F.min(_place()).alias("first"))
    nodes = stored(nodes, "neardup-nodes")
    own = real.select("at", "bands", "n", "bitmap").join(nodes.select("node", "key", "rep"), F.col("at") == F.col("node")).drop("at")
    roots = _roots(slim, own, similarity, shingle).withColumnRenamed("node", "_node")
    classes = nodes.join(roots, F.col("node") == F.col("_node"), "left")
    classes = classes.select("key", "rep", "first", F.coalesce("root", "node").alias("root"))
    named = classes.groupBy("root").agg(F.min("rep").alias("class_id"), F.min("first").alias("first")).withColumnRenamed("root", "_root")
    named = classes.drop("first").join(named, F.col("root") == F.col("_root")).select(F.col("key").alias("_key"), "class_id", "first")
    out = sketched.select("doc_id", "row", "key").join(named, F.col("key") == F.col("_key"), "left")
    return out.select("doc_id", "row", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), "first")


def _place() -> Column:
    """Order of documents inside a class: by doc_id, missing ones last, then by the digest of the text."""
    return F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row")


def _roots(slim: DataFrame, nodes: DataFrame, similarity: float, shingle: int, tile: int = TILE) -> DataFrame:
    """(node, root) of the nodes that have links."""
    percent = 100 * similarity - 1e-9  # bounds may let a little more through
    banded = nodes.select("node", "n", F.explode("bands").alias("token"))
    hubs = banded.groupBy("token").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("size")).where(F.col("size") > 1)
    members = stored(banded.join(hubs.withColumnRenamed("token", "_t"), F.col("token") == F.col("_t")).drop("_t"), "neardup-members")
    some = nodes.join(members.select(F.col("node").alias("_m")).distinct(), F.col("node") == F.col("_m"))
    some = stored(some.select("key", "rep", "node", "n", "bitmap"), "neardup-candidates")

    held = bit_set(some.select(spot(F.lower(F.hex("key")), F.col("rep")).alias("s")))
    sets = slim.mapInArrow(_sets(held, shingle), "key binary, items binary").groupBy(F.col("key").alias("_k")).agg(F.first("items").alias("items"))
    sets = stored(sets.join(some.select("key", "node"), F.col("_k") == F.col("key")).select("node", "items"), "neardup-sets")

    # one hub for each node, then the hubs of its other bands
    pairs = members.where(F.col("node") != F.col("hub")).select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    pairs = stored(near(pairs, some, percent), "neardup-pairs")
    links = _similar(pairs.groupBy("a").agg(F.min("b").alias("b")), sets, similarity).select("a", "b")
    more = _similar(_apart(pairs, components(links)), sets, similarity).select("a", "b")
    links = links.unionAll(more)
    roots = components(links)

    # buckets whose members still lie in different components
    left = open_groups(members.where(F.col("size") > 2), roots)
    if left.isEmpty():
        return roots
    pairs = tiles(left, some.select("node", "bitmap"), percent, tile).mapInArrow(compare(percent), "a long, b long").distinct()
    more = _similar(stored(pairs, "neardup-pairs"), sets, similarity).select("a", "b")
    return components(links.unionAll(more))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Pairs whose ends lie in different components so far."""
    a = roots.select(F.col("node").alias("_na"), F.col("root").alias("_ra"))
    b = roots.select(F.col("node").alias("_nb"), F.col("root").alias("_rb"))
    both = pairs.join(a, F.col("a") == F.col("_na"), "left").join(b, F.col("b") == F.col("_nb"), "left")
    return both.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b")


def without_near_duplicates(documents: DataFrame, **options) -> DataFrame:
    """One document of each class, the one with the smallest doc_id (missing ones last); its columns are unchanged.

    Rows are told apart by doc_id and text; those with equal ones collapse to one. Null and empty texts stay.
    """
    own = [f"c{k}" for k in range(len(documents.columns))]
    at, body = (documents.columns.index(options.get(name, default)) for name, default in (("id_", "doc_id"), ("text", "text")))
    classes = stored(_classes(documents, **options).where(F.col("first").isNotNull()), "neardup-classes")
    gone = classes.where(~_place().eqNullSafe(F.col("first"))).select(F.col("doc_id").alias("_gone"), F.col("row").alias("_row")).distinct()
    same = F.col(own[at]).cast("long").eqNullSafe(F.col("_gone")) & (row_digest(F.col(own[body])) == F.col("_row"))
    kept = documents.toDF(*own).join(gone, same, "left_anti")
    if not classes.groupBy("doc_id", "row").count().where("count > 1").isEmpty():
        # only where a row occurs again are rows compared
        texts = F.col(own[body]).isNotNull() & (F.col(own[body]) != "")
        kept = kept.where(texts).dropDuplicates([own[at], own[body]]).unionAll(kept.where(~texts))
    return kept.toDF(*documents.columns)


@register("op8_near_duplicates")
def op8_near_duplicates(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
