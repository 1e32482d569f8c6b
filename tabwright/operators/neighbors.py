"""Exact nearest neighbours between points with missing coordinates, without comparing all pairs.

Donors of one label and one pattern of missing coordinates form a tree of range cells, one tree for each set of coordinates
that queries share with them, split along these only; more than `PROJECTIONS` sets share one tree. Axis splits come from a
bounded sample and place every donor, exact boxes come from all donors. Each query then

1. takes the k-th distance to the sampled donors around it as its radius, which no nearer donor can exceed;
2. meets the cells whose box reaches into this radius, usually one or two, and takes the k nearest of each.

So a donor moves once for every tree and a query once for every cell it meets. A cell with more donors than planned is cut
into parts, one that many queries meet is copied for each share of them, and equal points are one point with a weight. Of
donors that are alike in all that a tree's queries can compare only the first k by the order of ties take part, wherever
that leaves less than half of them. The driver holds the splits, `SAMPLE` points and one box per cell (at most `MAX_CELLS` plus one a tree).

The distance of two points is the squared Euclidean one over the coordinates both have, scaled up to all
coordinates; points that share none are no neighbours. Ties go to the smaller coordinates (missing ones first).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.session import stored

CELL = 2048
MAX_CELLS = 1 << 16
SAMPLE = 1 << 18
PROJECTIONS = 4  # trees for one pattern of donors
LOOK = 64  # sampled donors that a radius comes from
SHARE = 4096  # queries that meet a block of donors at once
SLACK = 1 + 1e-12

HIT = "query long, near double, x array<double>, n long"


def mask_of(x: Column) -> Column:
    """Which coordinates are there, as text."""
    return F.array_join(F.transform(x, lambda v: F.when(v.isNull(), "0").otherwise("1")), "")


def distinct_points(df: DataFrame, columns: list[Column], label: Column | None = None) -> DataFrame:
    """(id, label, x, n): the distinct points of a table and how many rows have them; kept, so ids stay."""
    x = F.array(*[c.cast("double") for c in columns])
    text = F.lit("") if label is None else label.cast("string")
    points = df.select(text.alias("label"), x.alias("x")).groupBy("label", "x").agg(F.count(F.lit(1)).alias("n"))
    return stored(points.withColumn("id", F.monotonically_increasing_id()), "points")


# ---- cells --------------------------------------------------------------------------------------


def _matrix(values: pa.Array, width: int) -> np.ndarray:
    return values.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def _distance(a: np.ndarray, b: np.ndarray, axes: np.ndarray, width: int) -> np.ndarray:
    """Scaled squared distances over some axes; the arrays' last axis holds the coordinates."""
    total = 0.0
    for j in axes:
        gap = a[..., j] - b[..., j]
        total = total + gap * gap
    return total * width / len(axes)


@dataclass
class Forest:
    """Trees of axis splits with the sampled donors below each node; a leaf is a cell."""

    width: int
    roots: dict[int, int] = field(default_factory=dict)
    axis: list[int] = field(default_factory=list)
    at: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    first: list[int] = field(default_factory=list)
    last: list[int] = field(default_factory=list)
    points: np.ndarray | None = None
    weight: np.ndarray | None = None  # of the points before each one
    low: np.ndarray | None = None
    high: np.ndarray | None = None

    @classmethod
    def fit(cls, donors: DataFrame, sizes: dict[int, int], axes: dict[int, list[int]], width: int, cell: int) -> Forest:
        forest, total, most = cls(width), sum(sizes.values()), min(SAMPLE, 8 * SAMPLE // width)
        drawn = donors
        if total > most:
            drawn = donors.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int((1 << 30) * most / total))
        found = drawn.select("tree", "x", "n").toArrow().combine_chunks()
        tree, n = found["tree"].to_numpy(), found["n"].to_numpy()
        points = _matrix(found["x"].combine_chunks(), width) if len(tree) else np.zeros((0, width))
        order: list[np.ndarray] = []
        done = 0
        for t, size in sizes.items():
            here = np.flatnonzero(tree == t)
            forest.roots[t] = forest._grow(points, here, axes[t], max(1, min(-(-size // cell), MAX_CELLS * size // total)), done, order)
            done += len(here)
        for name in ("axis", "at", "left", "right", "first", "last"):
            setattr(forest, name, np.array(getattr(forest, name)))
        placed = np.concatenate(order) if order else np.zeros(0, dtype=np.int64)
        forest.points, forest.weight = points[placed], np.concatenate([[0], np.cumsum(n[placed])])
        return forest

    def _grow(self, points: np.ndarray, some: np.ndarray, axes: list[int], leaves: int, done: int, order: list[np.ndarray]) -> int:
        node = len(self.axis)
        for held, start in ((self.axis, -1), (self.at, 0.0), (self.left, -1), (self.right, -1), (self.first, done), (self.last, done + len(some))):
            held.append(start)
        spread = np.nan_to_num(np.ptp(points[np.ix_(some, axes)], axis=0), nan=0.0) if leaves > 1 and len(some) > 1 else np.zeros(1)
        if not (spread > 0).any():
            order.append(some)
            return node
        axis = axes[int(spread.argmax())]
        values = points[some, axis]
        low = values <= np.partition(values, (len(values) - 1) // 2)[(len(values) - 1) // 2]
        if low.all():
            low = values < values.max()
        self.axis[node], self.at[node] = axis, float(values[low].max())
        share = min(max(1, round(leaves * low.mean())), leaves - 1)
        self.left[node] = self._grow(points, some[low], axes, share, done, order)
        self.right[node] = self._grow(points, some[~low], axes, leaves - share, done + int(low.sum()), order)
        return node

    def descend(self, node: np.ndarray, x: np.ndarray, least: int = 0) -> np.ndarray:
        """The leaf of every point below its node, or the last node on the way with sampled donors of weight `least`."""
        node = node.copy()
        going = np.flatnonzero(self.axis[node] >= 0)
        while len(going):
            here = node[going]
            child = np.where(x[going, self.axis[here]] <= self.at[here], self.left[here], self.right[here])
            enough = self.weight[self.last[child]] - self.weight[self.first[child]] >= least
            going, child = going[enough], child[enough]
            node[going] = child
            going = going[self.axis[child] >= 0]
        return node

    def bound(self, tree: int, x: np.ndarray, axes: np.ndarray, need: int) -> np.ndarray:
        """A distance within which every query has donors of weight `need`; infinite where the sample has fewer."""
        node = self.descend(np.full(len(x), self.roots[tree]), x, need)
        out = np.full(len(x), np.inf)
        look = max(LOOK, 2 * need)
        step = max(1, (1 << 18) // look)
        for s in range(0, len(x), step):
            some = node[s : s + step]
            at = self.first[some][:, None] + np.arange(look)[None, :]
            there = at < self.last[some][:, None]
            if not there.any():
                continue
            at = np.where(there, at, 0)
            near = _distance(x[s : s + step, None, :], self.points[at], axes, self.width)
            near = np.where(there & np.isfinite(near), near, np.inf)
            order = np.argsort(near, axis=1, kind="stable")
            held = np.cumsum(np.take_along_axis(np.where(there, self.weight[at + 1] - self.weight[at], 0), order, axis=1), axis=1) >= need
            last = np.take_along_axis(near, np.take_along_axis(order, held.argmax(axis=1)[:, None], axis=1), axis=1)[:, 0]
            out[s : s + step] = np.where(held.any(axis=1), last, np.inf)
        return out

    def enclose(self, boxes: Boxes) -> None:
        """Exact boxes of all nodes from those of the cells."""
        self.low, self.high = np.full((len(self.axis), self.width), np.nan), np.full((len(self.axis), self.width), np.nan)
        self.low[boxes.cell], self.high[boxes.cell] = boxes.low, boxes.high
        for node in np.flatnonzero(self.axis >= 0)[::-1]:  # children come after their parent
            a, b = self.left[node], self.right[node]
            self.low[node], self.high[node] = np.fmin(self.low[a], self.low[b]), np.fmax(self.high[a], self.high[b])

    def reached(self, tree: int, x: np.ndarray, axes: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(query, cell) for all cells of a tree whose box reaches into the query's radius."""
        query, node = np.arange(len(x)), np.full(len(x), self.roots[tree])
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            apart = np.maximum(0.0, np.maximum(self.low[node] - x[query], x[query] - self.high[node]))
            gap = _distance(apart, np.zeros(self.width), axes, self.width)
            near = np.isfinite(gap) & (gap <= radius[query] * SLACK)
            query, node = query[near], node[near]
            leaf = self.axis[node] < 0
            found.append((query[leaf], node[leaf]))
            query, node = query[~leaf], node[~leaf]
            query, node = np.concatenate([query, query]), np.concatenate([self.left[node], self.right[node]])
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (query, node)


def _placed(donors: DataFrame, forest: Forest) -> DataFrame:
    """Donors with their cell."""
    roots = np.full(max(forest.roots, default=0) + 1, -1)
    for tree, node in forest.roots.items():
        roots[tree] = node

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = forest.descend(roots[batch.column("tree").to_numpy()], _matrix(batch.column("x"), forest.width))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(cells)], names=[*batch.schema.names[:-1], "cell"])

    return donors.select("id", "label", "x", "n", "tree").mapInArrow(run, "id long, label string, x array<double>, n long, cell long")


@dataclass
class Boxes:
    """Number, label, bounds and weight of every cell; NaN bounds where its points lack the coordinate."""

    cell: np.ndarray
    label: np.ndarray
    low: np.ndarray
    high: np.ndarray
    weight: np.ndarray
    rows: np.ndarray

    @classmethod
    def of(cls, placed: DataFrame, width: int) -> Boxes:
        bounds = [f(F.col("x")[i]).alias(f"{f.__name__}{i}") for i in range(width) for f in (F.min, F.max)]
        found = placed.groupBy("cell").agg(F.first("label").alias("label"), F.sum("n").alias("w"), F.count(F.lit(1)).alias("m"), *bounds).collect()
        real = lambda name: np.array(
            [[np.nan if r[f"{name}{i}"] is None else r[f"{name}{i}"] for i in range(width)] for r in found], dtype=np.float64
        ).reshape(-1, width)
        return cls(
            np.array([r["cell"] for r in found], dtype=np.int64), np.array([r["label"] for r in found], dtype=object),
            real("min"), real("max"), np.array([r["w"] for r in found], dtype=np.int64), np.array([r["m"] for r in found], dtype=np.int64),
        )

    def gap(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Least scaled squared distance from a box to each cell; infinite without a shared coordinate."""
        apart = np.maximum(0.0, np.maximum(self.low - high, low - self.high))
        shared = (~np.isnan(apart)).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            total = np.nansum(apart * apart, axis=1) * len(low) / shared
        return np.where(shared > 0, total, np.inf)


def _known(spark, boxes: Boxes, cell: int, shares: dict[int, int]) -> DataFrame:
    """Parts that a cell's donors are cut into, and shares of the queries that meet it."""
    rows = [(int(c), int(-(-m // cell)), shares.get(int(c), 1)) for c, m in zip(boxes.cell, boxes.rows, strict=True)]
    return spark.createDataFrame(rows, "_cell long, _parts long, _shares long")


def _blocks(placed: DataFrame, boxes: Boxes, cell: int, out: str, shares: dict[int, int] | None = None) -> DataFrame:
    """Donors packed by cell and part, sorted by their coordinates; a part is copied for each share of the queries."""
    known = F.broadcast(_known(placed.sparkSession, boxes, cell, shares or {}))
    dealt = placed.join(known, F.col("cell") == F.col("_cell")).withColumn("_part", F.pmod(F.xxhash64("id"), F.col("_parts")) * F.col("_shares"))
    dealt = dealt.withColumn("part", F.explode(F.sequence("_part", F.col("_part") + F.col("_shares") - 1)))
    return dealt.groupBy("cell", "part").agg(F.array_sort(F.collect_list(F.struct("x", "n", "id"))).alias(out))


# ---- search -------------------------------------------------------------------------------------


def _visits(forest: Forest, trees: dict[str, list[int]], masks: dict[int, np.ndarray], need: int):
    """The cells that each query meets, with its radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, ids = _matrix(batch.column("x"), forest.width), batch.column("id").to_numpy()
            parts = batch.column("part").dictionary_encode()
            codes = parts.indices.to_numpy()
            for code, part in enumerate(parts.dictionary.to_pylist()):
                rows = np.flatnonzero(codes == code)
                mine, own = x[rows], np.flatnonzero(~np.isnan(x[rows[0]]))
                axes = {t: own[masks[t][own]] for t in trees.get(part, [])}
                radius = np.full(len(rows), np.inf)
                for t in axes:
                    radius = np.minimum(radius, forest.bound(t, mine, axes[t], need))
                for t in axes:
                    query, cell = forest.reached(t, mine, axes[t], radius)
                    if len(query):
                        lists = pa.ListArray.from_arrays(
                            pa.array(np.arange(0, len(query) * forest.width + 1, forest.width, dtype=np.int32)),
                            pa.array(mine[query].ravel(), from_pandas=True),
                        )
                        arrays = [pa.array(cell), pa.array(ids[rows[query]]), lists, pa.array(radius[query])]
                        yield pa.RecordBatch.from_arrays(arrays, names=["cell", "id", "x", "radius"])

    return run


def _compare(width: int, k: int, without_self: bool):
    """The k nearest donors of a block for each query of a block, within the query's radius."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            queries, donors = batch.column("q"), batch.column("d")
            qo, do = queries.offsets.to_numpy(), donors.offsets.to_numpy()
            for row in range(batch.num_rows):
                q, d = queries.values.slice(qo[row], qo[row + 1] - qo[row]), donors.values.slice(do[row], do[row + 1] - do[row])
                qx, dx = _matrix(q.field("x"), width), _matrix(d.field("x"), width)
                ids, own, n = q.field("id").to_numpy(), d.field("id").to_numpy(), d.field("n").to_numpy()
                limit = q.field("radius").to_numpy() * SLACK
                patterns, kind = np.unique(~np.isnan(qx), axis=0, return_inverse=True)
                made: list[tuple] = []
                for p, pattern in enumerate(patterns):
                    axes = np.flatnonzero(pattern & ~np.isnan(dx[0]))  # donors of a cell have one pattern
                    here = np.flatnonzero(kind.ravel() == p)
                    step = max(1, (1 << 20) // len(dx))
                    for s in range(0, len(here), step):
                        some = here[s : s + step]
                        near = _distance(qx[some][:, None, :], dx[None, :, :], axes, width)
                        if without_self:
                            near[(ids[some][:, None] == own[None, :]) & (n[None, :] == 1)] = np.inf
                        at, to = np.nonzero(np.isfinite(near) & (near <= limit[some][:, None]))
                        order = np.lexsort((to, near[at, to], at))  # donors are sorted by their coordinates
                        at, to = at[order], to[order]
                        start = np.flatnonzero(np.diff(at, prepend=-1))
                        first = np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at)))) < k
                        at, to = at[first], to[first]
                        weight = n[to] - (own[to] == ids[some[at]]) if without_self else n[to]
                        made.append((ids[some[at]], near[at, to], dx[to], weight))
                query, near, x, n = (np.concatenate(c) for c in zip(*made, strict=True))
                if len(query):
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, width, dtype=np.int32)), pa.array(x.ravel(), from_pandas=True))
                    yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(near), lists, pa.array(n.astype(np.int64))], names=["query", "near", "x", "n"])

    return run


def _best(hits: DataFrame, k: int) -> DataFrame:
    """The nearest donors of each query until their weights reach k, with the weight `before` each."""
    order = Window.partitionBy("query").orderBy("near", "x")
    first = hits.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return first.withColumn("before", before).where(F.col("before") < k).drop("_r")


def _trees(donors: set[str], queries: set[str]) -> tuple[list[tuple[str, int, str]], dict[str, list[int]]]:
    """[(part of donors, tree, coordinates it is split along)], and the trees that each part of queries meets."""
    both = lambda a, b: "".join("1" if u == v == "1" else "0" for u, v in zip(a, b, strict=True))
    asked: dict[str, list[str]] = {}
    for part in queries:
        mask, label = part.split("|", 1)
        asked.setdefault(label, []).append(mask)
    rows: list[tuple[str, int, str]] = []
    met: dict[str, list[int]] = {}
    for part in sorted(donors):
        mask, label = part.split("|", 1)
        shared = {q: both(mask, q) for q in asked.get(label, []) if "1" in both(mask, q)}
        if len(set(shared.values())) > PROJECTIONS:
            shared = dict.fromkeys(shared, mask)
        number = {s: len(rows) + i for i, s in enumerate(sorted(set(shared.values())))}
        rows += [(part, t, s) for s, t in number.items()]
        for q, s in shared.items():
            met.setdefault(f"{q}|{label}", []).append(number[s])
    return rows, met


def nearest(queries: DataFrame, donors: DataFrame, width: int, k: int, without_self: bool = False, cell: int = CELL) -> DataFrame:
    """(query, near, x, n, before): for each query its nearest donors of the same label, by weight k in all.

    queries and donors: (id, label, x, n) with x of `width` coordinates; donors of one id and label are equal points. `near` is the
    squared distance, `before` the weight of the nearer ones. With `without_self` a donor of the query's id counts one less.
    """
    spark, need = queries.sparkSession, k + without_self
    part = F.concat_ws("|", mask_of(F.col("x")), F.col("label"))
    donors, queries = donors.withColumn("part", part), queries.withColumn("part", part)
    parts = lambda df: {r["part"] for r in df.select("part").distinct().collect()}
    rows, met = _trees(parts(donors), parts(queries))
    listed = spark.createDataFrame(rows, "part string, tree long, split string")
    dealt = donors.join(F.broadcast(listed), "part")
    seen = F.transform("x", lambda v, i: F.when(F.substring("split", i + 1, F.lit(1)) == "1", v))
    counted = dealt.groupBy("tree").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.hash(seen)).alias("kinds")).collect()
    alike = [r["tree"] for r in counted if 2 * need * r["kinds"] < r["n"]]
    dealt = dealt.withColumn("_seen", seen)
    shape = ["id", "label", "x", "n", "tree"]
    chosen = dealt.where(~F.col("tree").isin(alike)).select(*shape)
    if alike:
        order = Window.partitionBy("tree", "_seen").orderBy("x")
        first = dealt.where(F.col("tree").isin(alike)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= need)
        chosen = chosen.unionAll(stored(first.select(*shape), "alike"))
    sizes = {r["tree"]: r["n"] for r in counted if r["tree"] not in alike}
    if alike:
        sizes |= {r["tree"]: r["n"] for r in chosen.where(F.col("tree").isin(alike)).groupBy("tree").agg(F.count(F.lit(1)).alias("n")).collect()}
    forest = Forest.fit(chosen, sizes, {t: [j for j, c in enumerate(s) if c == "1"] for _, t, s in rows}, width, cell)
    ours = _placed(chosen, forest)
    boxes = Boxes.of(ours, width)
    forest.enclose(boxes)

    masks = {t: np.array([c == "1" for c in p[:width]]) for p, t, _ in rows}
    find = _visits(forest, met, masks, need)
    visits = lambda df: df.select("id", "x", "part").mapInArrow(find, "cell long, id long, x array<double>, radius double")
    every = 16  # the shares only level the work, so some queries tell how many meet a cell
    some = visits(queries.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0)).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    shares = {r["cell"]: -(-r["n"] * every // SHARE) for r in some.collect()}
    known = F.broadcast(_known(spark, boxes, cell, shares))
    going = visits(queries).join(known, F.col("cell") == F.col("_cell")).withColumn("_share", F.pmod(F.xxhash64("id"), F.col("_shares")))
    going = going.withColumn("part", F.explode(F.expr("transform(sequence(0L, _parts - 1), p -> p * _shares + _share)")))
    asked = going.groupBy("cell", "part").agg(F.collect_list(F.struct("x", "id", "radius")).alias("q"))
    both = asked.join(_blocks(ours, boxes, cell, "d", shares), ["cell", "part"]).select("q", "d")
    return _best(both.mapInArrow(_compare(width, k, without_self), HIT), k)
