"""Imputation from other columns: nearest rows, and chained regressions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import columns_of, named, nan_to_null
from tabwright.operators.neighbors import CELL, distinct_points, nearest
from tabwright.operators.steps import counts_of

NEIGHBORS = 5
ROUNDS = 10
TOLERANCE = 1e-6


def _numbers(df: DataFrame, columns: list[str]) -> None:
    wrong = [c for c in columns if c not in columns_of(df, "numeric")]
    if wrong or not columns:
        raise ValueError(f"not a numeric column: {', '.join(wrong) or 'none is named'}")


def knn_impute(df: DataFrame, columns: list[str], k: int = NEIGHBORS, cell: int = CELL) -> DataFrame:
    """Missing numbers become the mean of the k nearest rows that have them; the columns become doubles.

    Nearness is the Euclidean distance over the columns both rows have, scaled up to all `columns`. A row that shares
    no column with any other that has the value gets the column's mean; an all-null column stays so.
    Equal rows count each and are searched once; rows without gaps are only read.
    """
    _numbers(df, columns)
    df = nan_to_null(df)
    x = F.array(*[named(c).cast("double") for c in columns])
    gap = F.exists(x, lambda v: v.isNull())
    points = distinct_points(df, [named(c) for c in columns])
    row = df.agg(*[F.avg(named(c).cast("double")).alias(str(i)) for i, c in enumerate(columns)], *[F.count(named(c)).alias(f"n{i}") for i, c in enumerate(columns)], F.count(F.lit(1)).alias("all")).first()
    filled = points.where(F.exists("x", lambda v: v.isNull())).select("id", "x")
    for i in range(len(columns)):
        if row[f"n{i}"] in (0, row["all"]):
            continue
        lacks, has = points.where(F.col("x")[i].isNull()), points.where(F.col("x")[i].isNotNull())
        hits = nearest(lacks, has, len(columns), k, cell=cell)
        take = F.least("n", F.lit(k) - F.col("before")).cast("double")
        mean = hits.groupBy(F.col("query").alias("_q")).agg((F.sum(F.col("x")[i] * take) / F.sum(take)).alias(f"_v{i}"))
        filled = filled.join(mean, F.col("id") == F.col("_q"), "left").drop("_q")
        filled = filled.withColumn(f"_v{i}", F.coalesce(F.col("x")[i], f"_v{i}", F.lit(row[i])))
    filled = filled.select(F.col("x").alias("_x"), *[c for c in filled.columns if c.startswith("_v")])
    whole = df.where(~gap).select(*[named(c).cast("double").alias(c) if c in columns else named(c) for c in df.columns])
    holes = df.where(gap).withColumn("_key", x).join(filled, F.col("_key") == F.col("_x"))
    value = lambda c: f"_v{columns.index(c)}" if f"_v{columns.index(c)}" in filled.columns else None
    holes = holes.select(*[(F.col(value(c)) if value(c) else named(c).cast("double")).alias(c) if c in columns else named(c) for c in df.columns])
    return whole.unionAll(holes)


# ---- chained regressions ------------------------------------------------------------------------


def _replay(values: np.ndarray, means: np.ndarray, rounds: list[np.ndarray]) -> np.ndarray:
    """Values with every gap filled, as the rounds so far fill it; each coefficient row is (intercept, one per column)."""
    gaps = np.isnan(values)
    filled = np.where(gaps, means, values)
    open_ = [(j, np.flatnonzero(gaps[:, j])) for j in np.flatnonzero(gaps.any(axis=0))]
    for weights in rounds:
        for j, rows in open_:  # a column sees what the round has made of the columns before it
            filled[rows, j] = weights[j, 0] + filled[rows] @ weights[j, 1:]
    return filled


def _products(means: np.ndarray, rounds: list[np.ndarray], width: int):
    """Sums of products of (1, columns) over the rows that have each column: one width x (width + 1)^2 block a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width + 1, width + 1))
        for batch in batches:
            values = np.column_stack([c.to_numpy(zero_copy_only=False).astype(np.float64) for c in batch.columns])
            filled = _replay(values, means, rounds) - means  # around the means, which keeps the sums small
            full = np.column_stack([np.ones(len(filled)), filled])
            for j in range(width):
                some = full[~np.isnan(values[:, j])]
                total[j] += some.T @ some
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "s"])

    return run


def _fitted(products: np.ndarray, means: np.ndarray, targets: list[int]) -> np.ndarray:
    """Least squares of each target column on all others; a column that had no gap stands for its mean."""
    width = len(means)
    weights = np.zeros((width, width + 1))
    weights[:, 0] = means
    for j in targets:
        others = [0, *(i + 1 for i in range(width) if i != j)]
        gram, right = products[j][np.ix_(others, others)], products[j][others, j + 1]
        scale = np.sqrt(np.maximum(np.diag(gram), 1e-300))
        found = np.linalg.lstsq(gram / np.outer(scale, scale), right / scale, rcond=1e-12)[0] / scale
        weights[j, others] = found
        weights[j, 0] = found[0] + means[j] - weights[j, 1:] @ means
    return weights


def fit_iterative(df: DataFrame, columns: list[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict:
    """Step of chained regressions: every column with gaps is predicted from all others, round by round.

    Gaps start at the column's mean; inside a round a column sees the new values of the columns before it. A round takes one pass that sums products of the filled columns
    over the rows that have the target; only width x (width + 1)^2 sums reach the driver. It ends
    when no standardised coefficient moves by more than `tolerance`, or after `rounds`.
    """
    _numbers(df, columns)
    numbers = nan_to_null(df).select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    counts = counts_of(numbers.withColumn("_one", F.lit(1)), numbers.columns + ["_one"])
    empty = [i for i in range(len(columns)) if not counts[f"c{i}"]]
    used = [i for i in range(len(columns)) if i not in empty]
    numbers = numbers.select(*[f"c{i}" for i in used])
    step = {"op": "iterative", "columns": [columns[i] for i in used], "means": [], "rounds": []}
    if not used:
        return step
    width = len(used)
    row = numbers.agg(*[F.avg(c) for c in numbers.columns], *[F.stddev_pop(c) for c in numbers.columns]).first()
    means, spread = np.array(row[:width], dtype=float), np.array([s or 1.0 for s in row[width:]], dtype=float)
    targets = [j for j, i in enumerate(used) if counts[f"c{i}"] < counts["_one"]]
    step["means"] = means.tolist()
    done: list[np.ndarray] = []
    while targets and width > 1 and len(done) < rounds:
        sums = numbers.mapInArrow(_products(means, list(done), width), "at long, s double").groupBy("at").agg(F.sum("s").alias("s"))
        products = np.zeros(width * (width + 1) ** 2)
        for r in sums.collect():
            products[r["at"]] = r["s"]
        done.append(_fitted(products.reshape(width, width + 1, width + 1), means, targets))
        if len(done) > 1:
            moved = np.abs(done[-1][:, 1:] - done[-2][:, 1:]) * spread[None, :] / spread[:, None]
            if moved.max() <= tolerance:
                break
    step["rounds"] = [w.tolist() for w in done]
    return step


def apply_iterative(df: DataFrame, step: dict) -> DataFrame:
    """Fill the gaps as a fitted step says, in one narrow pass; works on streams too."""
    columns = [c for c in step["columns"] if c in df.columns]
    if len(columns) < len(step["columns"]):
        raise ValueError("a column of the fitted imputation is missing")
    if not columns:
        return df
    means, rounds = np.array(step["means"]), [np.array(w) for w in step["rounds"]]
    df = nan_to_null(df)
    schema = T.StructType([T.StructField(f.name, T.DoubleType()) if f.name in columns else f for f in df.schema.fields])
    ready = df.select(*[named(c).cast("double").alias(c) if c in columns else named(c) for c in df.columns])
    places = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.column_stack([batch.column(p).to_numpy(zero_copy_only=False).astype(np.float64) for p in places])
            filled = _replay(values, means, rounds)
            arrays = list(batch.columns)
            for j, p in enumerate(places):
                arrays[p] = pa.array(filled[:, j])
            yield pa.RecordBatch.from_arrays(arrays, names=batch.schema.names)

    return ready.mapInArrow(run, schema)


def iterative_impute(df: DataFrame, columns: list[str], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> DataFrame:
    return apply_iterative(df, fit_iterative(df, columns, rounds, tolerance))
