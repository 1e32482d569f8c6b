"""Density clusters (DBSCAN) over an eps grid."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import columns_of, named, nan_to_null
from tabwright.operators import steps as st
from tabwright.operators.graph import connected
from tabwright.operators.neighbors import CELL, distinct_points
from tabwright.operators.ranking import numbered
from tabwright.session import cut_lineage

NOISE = -1
MAX_OFFSETS = 4096  # neighbour cells of a cell; reached at five columns


def offsets(width: int, shrink: float = 1e-9) -> list[list[int]]:
    """Steps to all other cells of side eps / sqrt(width) that can hold a point within eps."""
    reach = math.isqrt(width) + 1 + (math.isqrt(width) ** 2 < width)
    near = lambda step: sum(max(abs(o) - 1, 0) ** 2 for o in step) <= width * (1 + 1e-6)
    return [list(s) for s in itertools.product(range(-reach, reach + 1), repeat=width) if any(s) and near(s)]


def _square(a: str, b: str, width: int) -> Column:
    total = F.lit(0.0)
    for i in range(width):
        gap = F.col(a)[i] - F.col(b)[i]
        total = total + gap * gap
    return total


def _around(points: DataFrame, steps: list[list[int]], *kept: str) -> DataFrame:
    """Each point once for every cell around its own, in `to`."""
    step = F.explode(F.array(*[F.array(*[F.lit(o).cast("long") for o in s]) for s in steps]))
    moved = points.select(*kept, "cell", step.alias("_step"))
    return moved.withColumn("to", F.zip_with("cell", "_step", lambda a, b: a + b)).drop("_step")


def _touching(width: int, limit: float):
    """Of rows (a, b, x, y) with blocks of core points the (a, b) that hold a pair within the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            x, y = batch.column("x"), batch.column("y")
            for k in range(batch.num_rows):
                p, q = (np.array(v[k].as_py(), dtype=np.float64).reshape(-1, width) for v in (x, y))
                for own, other in ((0, 1), (1, 0)):  # only points within the limit of the other box
                    s, o = (p, q) if own == 0 else (q, p)
                    if not len(s) or not len(o):
                        continue
                    apart = np.maximum(0.0, np.maximum(o.min(axis=0) - s, s - o.max(axis=0)))
                    s = s[(apart * apart).sum(axis=1) <= limit * (1 + 1e-9)]
                    p, q = (s, q) if own == 0 else (p, s)
                hit = False
                for at in range(0, len(p), 256):
                    total = np.zeros((len(p[at : at + 256]), len(q)))
                    for j in range(width):
                        gap = p[at : at + 256, j][:, None] - q[None, :, j]
                        total += gap * gap
                    if (total <= limit).any():
                        hit = True
                        break
                found.append(hit)
            yield batch.select(["a", "b"]).filter(pa.array(found, type=pa.bool_()))

    return run


def dbscan(df: DataFrame, columns: list[str], eps: float, min_points: int = 5, cell: int = CELL) -> DataFrame:
    """Append `cluster`: rows within `eps` of a core row share its cluster; a core row has `min_points` rows within eps, itself counted.

    Clusters are numbered from 0 by their smallest core point; noise is -1; a row with a missing coordinate has null.
    A row near cores of several clusters joins the first of them.

    Space is cut into cells of side eps / sqrt(columns): rows of a cell are within eps of each other, so a cell with
    min_points rows is all core and one node, however many rows it holds. Rows of other cells, fewer than min_points each, are
    matched with the cells around. Two full cells are compared by their outermost rows first, and in blocks only
    if that leaves them in different clusters. Equal rows are one point with a weight.
    """
    width = len(columns)
    if not columns or eps <= 0 or min_points < 1:
        raise ValueError("dbscan needs columns, eps above 0 and min_points of 1 or more")
    steps = offsets(width) if width <= 5 else []
    if not 0 < len(steps) <= MAX_OFFSETS:
        raise ValueError("too many columns for a grid: reduce them first")
    df = nan_to_null(df)
    side, limit = eps / math.sqrt(width) * (1 - 1e-9), eps * eps
    x = F.array(*[named(c).cast("double") for c in columns])
    whole = ~F.exists(x, lambda v: v.isNull())
    points = distinct_points(df.where(whole), [named(c) for c in columns])
    points = cut_lineage(points.select("id", "x", "n", F.transform("x", lambda v: F.floor(v / F.lit(side))).alias("cell")))
    cells = points.groupBy(F.col("cell").alias("_cell")).agg(F.sum("n").alias("weight"), F.count(F.lit(1)).alias("rows"))
    placed = cut_lineage(points.join(cells, F.col("cell") == F.col("_cell")).drop("_cell"))
    full, thin = placed.where(F.col("weight") >= min_points), placed.where(F.col("weight") < min_points)

    there = placed.select(F.col("cell").alias("_there"), F.col("x").alias("y"), F.col("n").alias("m"))
    met = _around(thin, steps, "id", "x").join(there, F.col("to") == F.col("_there")).where(_square("x", "y", width) <= limit)
    around = met.groupBy(F.col("id").alias("_id")).agg(F.sum("m").alias("_m"))
    counted = thin.join(around, F.col("id") == F.col("_id"), "left").withColumn("core", F.col("weight") + F.coalesce("_m", F.lit(0)) >= min_points)
    marked = cut_lineage(full.withColumn("core", F.lit(True)).select("id", "x", "cell", "weight", "rows", "core").unionAll(
        counted.select("id", "x", "cell", "weight", "rows", "core")
    ))
    core = marked.where("core")

    links = _cell_links(core, steps, width, limit, min_points, cell)
    roots = connected(links).select(F.col("node").alias("_node"), "root")
    owned = core.join(roots, F.col("cell") == F.col("_node"), "left").select("id", "x", "cell", F.coalesce("root", "cell").alias("root"))
    names = numbered(owned.groupBy("root").agg(F.min("x").alias("least")), "least", "cluster", None).select(F.col("root").alias("_root"), "cluster")
    owned = cut_lineage(owned.join(names, F.col("root") == F.col("_root")).select("id", "x", "cell", "cluster"))

    rest = marked.where("not core")
    near = owned.select(F.col("cell").alias("_there"), F.col("x").alias("y"), "cluster")
    edge = _around(rest, [[0] * width, *steps], "id", "x").join(near, F.col("to") == F.col("_there")).where(_square("x", "y", width) <= limit)
    edge = edge.groupBy(F.col("id").alias("_id")).agg(F.min("cluster").alias("cluster"))
    rest = rest.join(edge, F.col("id") == F.col("_id"), "left").select("x", F.coalesce("cluster", F.lit(NOISE)).cast("bigint").alias("cluster"))
    found = owned.select("x", "cluster").unionAll(rest).withColumnRenamed("x", "_x")
    kept = df.where(whole).withColumn("_key", x).join(found, F.col("_key") == F.col("_x"))
    lost = df.where(~whole).withColumn("cluster", F.lit(None).cast("bigint"))
    return kept.select(*[named(c) for c in df.columns], "cluster").unionAll(lost)


def _cell_links(core: DataFrame, steps: list[list[int]], width: int, limit: float, min_points: int, cell: int) -> DataFrame:
    """(a, b) of the cells that hold core points within eps of each other."""
    there = core.select(F.col("cell").alias("b"), F.col("x").alias("y"))
    thin = _around(core.where(F.col("weight") < min_points), steps, "x").join(there, F.col("to") == F.col("b")).where(_square("x", "y", width) <= limit)
    links = thin.select(F.col("cell").alias("a"), "b").distinct()

    full = core.where(F.col("weight") >= min_points)
    half = [s for s in steps if s > [0] * width]
    outer = [f("x", F.col("x")[i]) for i in range(width) for f in (F.min_by, F.max_by)]
    edges = cut_lineage(full.groupBy("cell").agg(F.array(*outer).alias("outer"), F.first("rows").alias("rows")))
    other = edges.select(F.col("cell").alias("_b"), F.col("outer").alias("y"))
    pairs = _around(edges, half, "outer").join(other, F.col("to") == F.col("_b")).select(F.col("cell").alias("a"), F.col("to").alias("b"), F.col("outer").alias("x"), "y")
    pairs = cut_lineage(pairs)
    links = cut_lineage(links.unionAll(pairs.mapInArrow(_touching(width, limit), "a array<long>, b array<long>")))

    roots = connected(links).select(F.col("node").alias("_n"), F.col("root").alias("_r"))
    open_ = pairs.select("a", "b")
    for c in ("a", "b"):
        open_ = open_.join(roots.select(F.col("_n").alias(f"_n{c}"), F.col("_r").alias(f"_r{c}")), F.col(c) == F.col(f"_n{c}"), "left")
    open_ = cut_lineage(open_.where(F.coalesce("_ra", "a") != F.coalesce("_rb", "b")).select("a", "b"))
    ends = open_.select(F.col("a").alias("_e")).unionAll(open_.select("b")).distinct()
    part = F.pmod(F.xxhash64("id"), F.ceil(F.col("rows") / F.lit(cell)))
    blocks = full.join(ends, F.col("cell") == F.col("_e"), "left_semi").groupBy("cell", part.alias("part")).agg(F.collect_list("x").alias("points"))
    blocks = cut_lineage(blocks)
    left = blocks.select(F.col("cell").alias("_a"), F.col("points").alias("x"))
    right = blocks.select(F.col("cell").alias("_b"), F.col("points").alias("y"))
    met = open_.join(left, F.col("a") == F.col("_a")).join(right, F.col("b") == F.col("_b")).select("a", "b", "x", "y")
    return links.unionAll(met.mapInArrow(_touching(width, limit), "a array<long>, b array<long>").distinct())


def train_dbscan(df: DataFrame, columns: list[str] | None = None, eps: float = 0.5, min_points: int = 5) -> DataFrame:
    """DBSCAN over numeric columns with filled gaps (median) and unit deviation: the rows with `cluster`, -1 for noise."""
    clean = nan_to_null(df)
    columns = columns or columns_of(clean, "numeric")
    medians = st.fit_median(clean, columns)["values"]
    value = {c: F.coalesce(named(c).cast("double"), F.lit(float(medians.get(c, 0.0)))) for c in columns}
    filled = clean.select(*[named(c) for c in df.columns], *[v.alias(f"_z{i}") for i, v in enumerate(value.values())])
    scaled = st.apply_step(filled, st.fit_scale(filled, [f"_z{i}" for i in range(len(columns))], "standard"))
    found = dbscan(scaled, [f"_z{i}" for i in range(len(columns))], eps, min_points)
    return found.select(*[named(c) for c in df.columns], "cluster")
