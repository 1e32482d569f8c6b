"""Exact top-k search by inner product: dual-tree traversal of cover trees over queries and data.

Vectors become integers, floor(256 x). All rows are sorted into cells around pivots (a cover of a bounded
sample: PIVOTS of SAMPLE rows) by range partitioning on (cell, vec_id), so a vector that a third of the
rows repeat spreads over partitions. Runs of at most BLOCK rows are indexed as cover trees: a node is a
point of the block and the radius that covers its descendants, and children cover half of their parent's
radius. Queries are indexed in the same way.

A node pair (Q, D) with centres q, d and radii r, s holds no product above q.d + r|d| + s|q| + rs; it is
dropped when that lies below the worst k-th score of Q's queries. Two rounds make this work across tasks: the
first visits, for every query block, one data block of each of its cells and leaves a k-th score for every
query; the second compares the roots of all other block pairs with those scores and visits what is left. A
visit is one row with a data block and up to a few query blocks, so no row or group grows with the data.

Defined results: vectors that are null, or hold null or non-finite components, take no part, nor do rows without
vec_id; a scaled component or a score that does not fit a 64-bit integer fails the query; vectors of different
length count as padded with zeros; a query meets every row with another vec_id; a query id that occurs
again is answered once, for its smallest vector in byte order; repeated candidates each count; ties go to the
smaller vec_id. Other columns are not read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.llm.common import stored
from tabwright.llm.registry import register, table

SAMPLE, PIVOTS = 2048, 64
BLOCK, QUERY_BLOCK = 4096, 1024
LEAF, QUERY_LEAF, FANOUT = 64, 8, 64
TOGETHER = 16  # query blocks in one visit, on average
SALTS = 16
NONE = -(1 << 63)

_BLOCKS = "block long, cells array<int>, centre binary, radius double, tree binary"


# --- cover trees ---------------------------------------------------------------------------------


class Tree:
    """Rows in tree order and nodes (start, end, centre row, radius, children)."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF):
        self.size = float(np.abs(vectors).max(initial=0))
        points = vectors.astype(np.float64)
        order: list[np.ndarray] = []
        self.root = _cover(points, np.arange(len(ids)), 0, order, leaf)
        at = np.concatenate(order)
        self.ids, self.vectors = ids[at], vectors[at]

    def ready(self, width: int) -> Tree:
        """With double vectors of that width, for products and bounds."""
        self.points = np.zeros((len(self.ids), width))
        self.points[:, : self.vectors.shape[1]] = self.vectors
        self.norms = np.sqrt((self.points**2).sum(axis=1))
        return self


def _cover(points: np.ndarray, rows: np.ndarray, start: int, order: list[np.ndarray], leaf: int) -> tuple:
    away = np.sqrt(((points[rows] - points[rows[0]]) ** 2).sum(axis=1))
    radius = float(away.max())
    children: list[np.ndarray] = []
    if len(rows) > leaf and radius > 0:
        left = rows
        while len(left) and len(children) < FANOUT:
            near = ((points[left] - points[left[0]]) ** 2).sum(axis=1) <= (radius / 2) ** 2
            children.append(left[near])
            left = left[~near]
        if len(left):  # half the radius separates nearly everything: one scan is as good
            children = []
    if not children:
        order.append(rows)
        return (start, start + len(rows), start, radius, ())
    nodes, at = [], start
    for own in children:
        nodes.append(_cover(points, own, at, order, leaf))
        at += len(own)
    return (start, at, start, radius, tuple(nodes))


class Best:
    """The k best (score, id) of every query row of a tree, and floors that other visits have set."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.score = np.full((n, k), NONE, dtype=np.int64)
        self.id = np.full((n, k), np.iinfo(np.int64).max, dtype=np.int64)
        self.worst = floor.copy()

    def add(self, a: int, b: int, score: np.ndarray, ids: np.ndarray) -> None:
        """Scores of rows a..b-1 with candidates in ascending order of id; NONE marks the query's own row."""
        wanted = ((score >= self.worst[a:b, None]) & (score > NONE)).any(axis=0)
        if not wanted.any():
            return
        score, ids = score[:, wanted], ids[wanted]
        k = self.score.shape[1]
        top = np.argsort(~score, axis=1, kind="stable")[:, :k]
        all_scores = np.concatenate([self.score[a:b], np.take_along_axis(score, top, axis=1)], axis=1)
        all_ids = np.concatenate([self.id[a:b], ids[top]], axis=1)
        rank = np.lexsort((all_ids, ~all_scores), axis=-1)[:, :k]
        self.score[a:b] = np.take_along_axis(all_scores, rank, axis=1)
        self.id[a:b] = np.take_along_axis(all_ids, rank, axis=1)
        self.worst[a:b] = np.maximum(self.worst[a:b], self.score[a:b, -1])


def search(queries: Tree, data: Tree, best: Best) -> None:
    """Dual-tree traversal, the most promising node pairs first."""
    width = queries.points.shape[1]
    exact = queries.size * data.size * width < 2**52  # then products of doubles are the integers themselves

    def bound(q: tuple, d: tuple) -> float:
        a, b = q[2], d[2]
        value = queries.points[a] @ data.points[b] + q[3] * data.norms[b] + d[3] * queries.norms[a] + q[3] * d[3]
        return value + 1e-9 * abs(value) + 1e-12 * queries.norms[a] * data.norms[b] + 1.0

    stack = [(bound(queries.root, data.root), queries.root, data.root)]
    while stack:
        most, q, d = stack.pop()
        if most < best.worst[q[0] : q[1]].min():
            continue
        if not q[4] and not d[4]:
            rows, columns = slice(q[0], q[1]), np.arange(d[0], d[1])
            columns = columns[np.argsort(data.ids[columns], kind="stable")]
            if exact:
                score = np.rint(queries.points[rows] @ data.points[columns].T).astype(np.int64)
            else:
                wide = [t.vectors.astype(np.int64) for t in (queries, data)]
                n = min(w.shape[1] for w in wide)
                near = queries.points[rows] @ data.points[columns].T
                near[queries.ids[rows, None] == data.ids[None, columns]] = 0
                if np.abs(near).max() >= 2**63 * (1 - 1e-9):
                    raise OverflowError("a score does not fit a 64-bit integer")
                score = wide[0][rows, :n] @ wide[1][columns, :n].T
            score[queries.ids[rows, None] == data.ids[None, columns]] = NONE
            best.add(q[0], q[1], score, data.ids[columns])
            continue
        pairs = [(bound(x, y), x, y) for x in (q[4] or (q,)) for y in (d[4] or (d,))]
        stack += sorted(pairs, key=lambda p: p[0])  # the best is popped first


# --- blocks --------------------------------------------------------------------------------------


def _vectors(column: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
    """(positions, integer vectors) of the vectors that take part."""
    at, out = [], []
    for k, v in enumerate(column):
        if not v.is_valid or v.values.null_count:
            continue
        scaled = np.floor(256.0 * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if np.isfinite(scaled).all():
            if (np.abs(scaled) >= 2**63).any():
                raise OverflowError("a component does not fit a 64-bit integer")
            at.append(k)
            out.append(scaled.astype("<i4" if (np.abs(scaled) < 2**31).all() else "<i8"))
    return np.array(at, dtype=np.int64), out


def _packed(vector: np.ndarray) -> bytes:
    """The width of an integer, then the integers."""
    return bytes([vector.itemsize]) + vector.tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype=f"<i{data[0]}", offset=1)


def _padded(vectors: list[np.ndarray], width: int = 0) -> np.ndarray:
    width = max([width, 1, *(len(v) for v in vectors)])
    out = np.zeros((len(vectors), width), dtype=np.int64 if any(v.itemsize == 8 for v in vectors) else np.int32)
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v
    return out


def _quantise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        at, vectors = _vectors(batch.column(1))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(at)), pa.array([_packed(v) for v in vectors], type=pa.binary())], names=["vec_id", "v"]
        )


def _pivots(rows: DataFrame) -> np.ndarray:
    """A greedy cover of SAMPLE rows (those with the smallest hash) by PIVOTS points."""
    some = rows.orderBy(F.xxhash64("vec_id", "v"), "vec_id").limit(SAMPLE).collect()
    points = _padded([_unpacked(r["v"]) for r in some]).astype(np.float64)
    chosen, away = [], np.full(len(points), np.inf)
    while len(chosen) < min(PIVOTS, len(points)):
        chosen.append(int(np.argmax(away)) if chosen else 0)
        away = np.minimum(away, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
        if away.max() == 0:
            break
    return points[chosen]


def _celled(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots = held.value
        for batch in batches:
            points = _padded([_unpacked(v) for v in batch.column(1).to_pylist()], pivots.shape[1]).astype(np.float64)
            wide = np.zeros((len(pivots), points.shape[1]))
            wide[:, : pivots.shape[1]] = pivots
            near = (wide**2).sum(axis=1)[None, :] - 2 * points @ wide.T
            yield pa.RecordBatch.from_arrays([pa.array(near.argmin(axis=1).astype(np.int32)), *batch.columns], names=["cell", "vec_id", "v"])

    return run


def _indexed(size: int, leaf: int):
    """Sorted rows of a partition as blocks of at most `size` rows."""

    def pack(number: int, rows: list[tuple]) -> pa.RecordBatch:
        ids = np.array([r[1] for r in rows], dtype=np.int64)
        tree = Tree(ids, _padded([_unpacked(r[2]) for r in rows]), leaf)
        centre = tree.vectors[0].astype("<f8").tobytes()
        values = [number, sorted({r[0] for r in rows}), centre, tree.root[3], pickle.dumps(tree)]
        kinds = (pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.float64(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([v], type=k) for v, k in zip(values, kinds, strict=True)], names=[x.split()[0] for x in _BLOCKS.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []
        for batch in batches:
            held += list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            while len(held) >= size:
                yield pack(number, held[:size])
                number, held = number + 1, held[size:]
        if held:
            yield pack(number, held)

    return run


def _visits(k: int):
    """Candidates of one data block for some query blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                data = pickle.loads(row["tree"])
                found: list[list] = [[], [], []]
                for q in row["queries"]:
                    queries = pickle.loads(q["tree"])
                    width = max(data.vectors.shape[1], queries.vectors.shape[1])
                    floors = dict(zip(q["ids"] or (), q["worst"] or (), strict=True))
                    floor = np.array([floors.get(i, NONE) for i in queries.ids.tolist()], dtype=np.int64)
                    best = Best(len(queries.ids), k, floor)
                    search(queries.ready(width), data.ready(width), best)
                    own, at = np.nonzero((best.score > NONE) & (best.score >= floor[:, None]))
                    for part, values in zip(found, (queries.ids[own], best.id[own, at], best.score[own, at]), strict=True):
                        part.append(values)
                columns = [pa.array(np.concatenate(part) if part else np.zeros(0, np.int64), type=pa.int64()) for part in found]
                yield pa.RecordBatch.from_arrays(columns, names=["query_id", "vec_id", "score"])

    return run


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of a data block and the query blocks of a pack whose roots may still hold a result."""
    for batch in batches:
        pairs = []
        for r in batch.to_pylist():
            d = np.frombuffer(r["centre"], dtype="<f8")
            for q in r["pack_rows"]:
                c = np.frombuffer(q["centre"], dtype="<f8")
                n = min(len(c), len(d))
                size = np.sqrt((c**2).sum()), np.sqrt((d**2).sum())
                most = c[:n] @ d[:n] + q["radius"] * size[1] + r["radius"] * size[0] + q["radius"] * r["radius"]
                if q["least"] is None or most + 1e-9 * abs(most) + 1e-12 * size[0] * size[1] + 1.0 >= q["least"]:
                    pairs.append((r["block"], q["block"]))
        columns = list(zip(*pairs, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns], names=["d", "q"])


def _best_rows(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k(vectors: DataFrame, every: int = 50, k: int = 5, id_: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for every row whose id is divisible by `every`."""
    spark = vectors.sparkSession
    slim = vectors.select(F.col(id_).cast("long").alias("vec_id"), F.col(vector).alias("v")).where(F.col("vec_id").isNotNull())
    rows = slim.mapInArrow(_quantise, "vec_id long, v binary")
    held = spark.sparkContext.broadcast(_pivots(rows))
    celled = rows.mapInArrow(_celled(held), "cell int, vec_id long, v binary")
    sort = ("cell", "vec_id")
    data = stored(celled.repartitionByRange(*sort).sortWithinPartitions(*sort).mapInArrow(_indexed(BLOCK, LEAF), _BLOCKS), "topk-data")
    asked = rows.where(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    asked = stored(asked.mapInArrow(_celled(held), "cell int, vec_id long, v binary"), "topk-asked")
    parts = max(1, -(-asked.count() // QUERY_BLOCK))
    queries = asked.repartitionByRange(parts, *sort).coalesce(parts).sortWithinPartitions(*sort)
    queries = stored(queries.mapInArrow(_indexed(QUERY_BLOCK, QUERY_LEAF), _BLOCKS), "topk-queries")
    count = queries.count()

    # round 1: one data block for each cell of a query block
    at = data.select("block", F.explode("cells").alias("cell")).groupBy("cell").agg(F.min("block").alias("d"))
    seeds = queries.select(F.col("block").alias("q"), F.explode("cells").alias("_cell"))
    seeds = stored(seeds.join(at, F.col("_cell") == F.col("cell")).select("d", "q").distinct(), "topk-seeds")
    plain = queries.select(F.col("block").alias("_q"), "tree", F.lit(None).cast("array<long>").alias("ids"), F.lit(None).cast("array<long>").alias("worst"))
    first = stored(_best_rows(_visit(data, seeds, plain, k, count), k), "topk-first").drop("rank")

    # round 2: all other pairs that the k-th scores leave open
    worst = first.groupBy("query_id").agg(F.min("score").alias("worst"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    owner = queries.mapInArrow(_members, "block long, query_id long")
    known = owner.join(worst, "query_id", "left").groupBy(F.col("block").alias("_b")).agg(
        F.collect_list(F.when(F.col("worst").isNotNull(), F.struct("query_id", "worst"))).alias("known"), F.min("worst").alias("_least"),
        F.count_if(F.col("worst").isNull()).alias("open"),
    )
    state = queries.join(known, F.col("block") == F.col("_b")).withColumn("least", F.when(F.col("open") == 0, F.col("_least")))
    state = stored(state.drop("_b", "_least", "open"), "topk-state")
    packs = -(-count // 64) or 1
    root = F.struct("block", "centre", "radius", "least")
    packed = state.groupBy(F.pmod(F.xxhash64("block"), F.lit(packs)).alias("_pack")).agg(F.collect_list(root).alias("pack_rows"))
    packed = packed.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    roots = data.select("block", "centre", "radius").withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
    roots = roots.withColumn("salt", F.pmod(F.xxhash64("block"), F.lit(SALTS)))
    met = roots.join(packed, (F.col("pack") == F.col("_pack")) & (F.col("salt") == F.col("_salt")))
    open_ = met.select("block", "centre", "radius", "pack_rows").mapInArrow(_bounded, "d long, q long").join(seeds, ["d", "q"], "left_anti")
    floors = state.select(F.col("block").alias("_q"), "tree", F.col("known.query_id").alias("ids"), F.col("known.worst").alias("worst"))
    second = _visit(data, open_, floors, k, count)
    best = _best_rows(first.unionAll(second), k)
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, tree in zip(batch.column("block").to_pylist(), batch.column("tree").to_pylist(), strict=True):
            ids = pickle.loads(tree).ids
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(ids)], names=["block", "query_id"])


def _visit(data: DataFrame, pairs: DataFrame, queries: DataFrame, k: int, count: int) -> DataFrame:
    """Run the pairs (d, q): query blocks are gathered, about TOGETHER at a time, and meet the data block once."""
    share = F.pmod(F.xxhash64("q"), F.lit(max(1, -(-count // TOGETHER))))
    sent = pairs.join(queries, F.col("q") == F.col("_q")).groupBy("d", share.alias("_share"))
    sent = sent.agg(F.collect_list(F.struct("tree", "ids", "worst")).alias("queries"))
    rows = data.select("block", "tree").join(sent, F.col("block") == F.col("d")).select("tree", "queries")
    return rows.mapInArrow(_visits(k), "query_id long, vec_id long, score long")


SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v AS q JOIN v AS c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@register("op1_top_k", SQL)
def op1_top_k(spark, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
