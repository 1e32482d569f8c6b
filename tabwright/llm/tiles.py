"""Sets with hashed bitmaps, compared in tiles inside a task: a group of any size emits only pairs whose bound passes.

Every item of a set toggles one bit of its bitmap: the bits in which two bitmaps differ are no more than the items in which
the sets differ, which bounds the overlap from above. Members are (token, node, n, root): a group's token, the number of a
set, its size and the component it is known to lie in.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import stored

BITMAP = 1024  # bits of a set's bitmap
TILE = 1024  # sets in a tile


def bitmap(found: np.ndarray) -> bytes:
    at = (found & np.uint64(BITMAP - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=BITMAP) & 1).astype(bool), bitorder="little").tobytes()


def cell_counts(found: np.ndarray) -> bytes:
    """How many items fall on each bit of the bitmap, modulo 256."""
    return np.bincount((found & np.uint64(BITMAP - 1)).astype(np.int64), minlength=BITMAP).astype(np.uint8).tobytes()


def overlap_enough(na, nb, overlap, percent: float):
    return 100 * overlap >= percent * (na + nb - overlap)


def _bitmaps(values: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(values.to_pylist()), dtype=np.uint64).reshape(len(values), BITMAP // 64)


def _tile(values: pa.Array, at: int, end: int) -> tuple[np.ndarray, ...]:
    part = values.slice(at, end - at)
    return (*(part.field(k).to_numpy() for k in range(3)), _bitmaps(part.field(3)))


def tile_pairs(a: tuple, b: tuple, same: bool, percent: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of two tiles (node, root, n, bitmap) whose bound passes."""
    step = max(1, (1 << 16) // len(b[0]))
    left, right = [], []
    for s in range(0, len(a[0]), step):
        e = min(s + step, len(a[0]))
        total = a[2][s:e, None] + b[2][None, :]
        apart = np.bitwise_count(a[3][s:e, None, :] ^ b[3][None, :, :]).sum(axis=-1, dtype=np.int64)
        most = np.minimum((total - apart) // 2, np.minimum(a[2][s:e, None], b[2][None, :]))
        ok = (100 * most >= percent * (total - most)) & (a[1][s:e, None] != b[1][None, :])
        if same:
            ok &= np.arange(s, e)[:, None] < np.arange(len(b[0]))[None, :]
        x, y = np.nonzero(ok)
        left.append(x + s)
        right.append(y)
    return np.concatenate(left), np.concatenate(right)


def compare(percent: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same = batch.column(0).to_pylist()
            x, y = batch.column(1), batch.column(2)
            xo, yo = x.offsets.to_numpy(), y.offsets.to_numpy()
            out = []
            for k in range(batch.num_rows):
                a = _tile(x.values, xo[k], xo[k + 1])
                b = a if same[k] else _tile(y.values, yo[k], yo[k + 1])
                i, j = tile_pairs(a, b, same[k], percent)
                if len(i):
                    out.append(np.stack([np.minimum(a[0][i], b[0][j]), np.maximum(a[0][i], b[0][j])]))
            made = np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
            order = np.lexsort(made)
            made = made[:, order]  # sets that meet in several groups are one pair
            first = np.concatenate(([True], (made[:, 1:] != made[:, :-1]).any(axis=0)))[: made.shape[1]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in made[:, first]], names=["a", "b"])

    return run


def bounded(percent: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("n").to_numpy() + batch.column("m").to_numpy()
            apart = np.bitwise_count(_bitmaps(batch.column("x")) ^ _bitmaps(batch.column("y"))).sum(axis=1, dtype=np.int64)
            yield batch.select(["a", "b"]).filter(pa.array(overlap_enough(total, 0, (total - apart) // 2, percent)))

    return run


def near(pairs: DataFrame, nodes: DataFrame, percent: float) -> DataFrame:
    """The (a, b) pairs whose sizes and bitmaps allow a link."""
    left = nodes.select(F.col("node").alias("_a"), "n", F.col("bitmap").alias("x"))
    right = nodes.select(F.col("node").alias("_b"), F.col("n").alias("m"), F.col("bitmap").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b"))
    both = both.where(100 * F.least("n", "m") >= percent * F.greatest("n", "m")).select("a", "b", "n", "m", "x", "y")
    return both.mapInArrow(bounded(percent), "a long, b long")


def counted(percent: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for n, m, x, y in zip(*(batch.column(c).to_pylist() for c in ("n", "m", "x", "y")), strict=True):
                ok = True
                if x is not None and y is not None:
                    ahead = np.frombuffer(x, dtype=np.uint8) - np.frombuffer(y, dtype=np.uint8)  # modulo 256
                    apart = int(np.minimum(ahead, -ahead).sum(dtype=np.int64))
                    ok = bool(overlap_enough(n + m, 0, min((n + m - apart) // 2, n, m), percent))
                keep.append(ok)
            yield batch.select(["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    return run


def alike(pairs: DataFrame, nodes: DataFrame, percent: float) -> DataFrame:
    """The (a, b) pairs whose cell counts allow a link; pairs with a set that has none pass."""
    long = nodes.where(F.col("counts").isNotNull())
    left = long.select(F.col("node").alias("_a"), "n", F.col("counts").alias("x"))
    right = long.select(F.col("node").alias("_b"), F.col("n").alias("m"), F.col("counts").alias("y"))
    both = pairs.join(left, F.col("a") == F.col("_a"), "left").join(right, F.col("b") == F.col("_b"), "left")
    return both.select("a", "b", "n", "m", "x", "y").mapInArrow(counted(percent), "a long, b long")


def open_groups(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Members of groups that hold several components, with their root."""
    if roots is None:
        return members.withColumn("root", F.col("node"))
    named = roots.select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    at = members.drop("root").join(named, F.col("node") == F.col("_n"), "left").select("token", "node", "n", F.coalesce("_r", "node").alias("root"))
    apart = at.groupBy("token").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo < _hi").select(F.col("token").alias("_t"))
    return stored(at.join(apart, F.col("token") == F.col("_t")).drop("_t"), "tiles-open")


def tiles(members: DataFrame, bitmaps: DataFrame, percent: float, tile: int) -> DataFrame:
    """Tiles and pairs of tiles that may hold links: (same, x, y), each a list of (node, root, n, bitmap).

    A group that fits a tile is one; a larger one is cut by band of set size and by hash.
    """
    width = math.log(100 / percent) * 1.05 + 1e-9  # a little wider than the bound, so that rounding skips no band
    totals = members.groupBy(F.col("token").alias("_t")).agg(F.count(F.lit(1)).alias("_m"))
    sized = members.join(totals, F.col("token") == F.col("_t")).drop("_t")
    sized = sized.join(bitmaps.select(F.col("node").alias("_n"), "bitmap"), F.col("node") == F.col("_n"))
    sets = F.collect_list(F.struct("node", "root", "n", "bitmap")).alias("sets")
    small = sized.where(F.col("_m") <= tile).groupBy("token").agg(sets)

    banded = sized.where(F.col("_m") > tile).withColumn("band", F.floor(F.log("n") / F.lit(width)))
    parts = banded.groupBy(F.col("token").alias("_t"), F.col("band").alias("_b")).agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).alias("_parts"))
    dealt = banded.join(parts, (F.col("token") == F.col("_t")) & (F.col("band") == F.col("_b")))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("node"), F.col("_parts")))
    whole = stored(dealt.groupBy("token", "band", "part").agg(sets), "tiles")
    left = whole.select("token", "band", "part", F.col("sets").alias("x"), F.explode(F.array("band", F.col("band") + 1)).alias("to"))
    right = whole.select(F.col("token").alias("_t"), F.col("band").alias("_b"), F.col("part").alias("_p"), F.col("sets").alias("y"))
    met = left.join(right, (F.col("token") == F.col("_t")) & (F.col("to") == F.col("_b")) & ((F.col("band") < F.col("to")) | (F.col("part") <= F.col("_p"))))
    same = (F.col("band") == F.col("to")) & (F.col("part") == F.col("_p"))
    large = met.select(same.alias("same"), "x", F.when(~same, F.col("y")).otherwise(F.array()).alias("y"))
    return small.select(F.lit(True).alias("same"), F.col("sets").alias("x"), F.array().cast(small.schema["sets"].dataType).alias("y")).unionAll(large)
