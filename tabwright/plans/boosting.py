"""Gradient boosting of trees that grow best leaf first, over binned features with missing values.

Features are cut once into bins and kept as one byte each; missing has a bin of its own, and every split learns which
side missing values go to. A pass over the rows sums gradients by (leaf, feature, bin) inside each task and
shuffles only these sums. Of two siblings only the smaller is summed, the other is the difference to their
parent. A pass serves the best split of every leaf at once, so a tree takes about as many passes as it is deep,
and yet its leaves are opened strictly by gain. Rows carry their margin, which is written anew every `KEEP` trees;
trees since then are replayed.

Nothing about rows reaches the driver: bin edges, sums per bin and trees do, whatever the number of rows.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import columns_of, named, nan_to_null
from tabwright.operators import steps as st
from tabwright.session import cut_lineage, local_table

BINS = 64
KEEP = 10
NODE_DDL = (
    "margin int, tree int, node int, feature string, edge double, missing_left boolean, gain double, left_node int, right_node int, "
    "value double"
)


@dataclass
class Tree:
    """Nodes in the order they were opened; a node without a feature is a leaf. Values go left up to `edge`."""

    feature: list[int] = field(default_factory=list)
    bin: list[int] = field(default_factory=list)
    edge: list[float] = field(default_factory=list)
    missing_left: list[bool] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)
    gain: list[float] = field(default_factory=list)

    def leaf(self) -> int:
        for held, start in (
            (self.feature, -1), (self.bin, -1), (self.edge, 0.0), (self.missing_left, False), (self.left, -1), (self.right, -1), (self.value, 0.0),
            (self.gain, 0.0),
        ):
            held.append(start)
        return len(self.feature) - 1

    def places(self, below, missing) -> np.ndarray:
        """Leaf of each row; below(features, nodes) and missing(features) look at the rows' own values."""
        feature, left, right = (np.array(x, dtype=np.int64) for x in (self.feature, self.left, self.right))
        missing_left = np.array(self.missing_left)
        at = np.zeros(below.rows, dtype=np.int64)
        while True:
            going = np.flatnonzero(feature[at] >= 0)
            if not len(going):
                return at
            node = at[going]
            goes_left = np.where(missing(going, feature[node]), missing_left[node], below(going, feature[node], node))
            at[going] = np.where(goes_left, left[node], right[node])

    def places_of_bins(self, bins: np.ndarray, lost: int) -> np.ndarray:
        cut = np.array(self.bin)
        return self.places(_Rows(len(bins), lambda r, f, node: bins[r, f] <= cut[node]), lambda r, f: bins[r, f] == lost)

    def places_of_values(self, values: np.ndarray) -> np.ndarray:
        edge = np.array(self.edge)
        return self.places(_Rows(len(values), lambda r, f, node: values[r, f] <= edge[node]), lambda r, f: np.isnan(values[r, f]))

    def margins(self, places: np.ndarray) -> np.ndarray:
        return np.array(self.value)[places]


@dataclass
class _Rows:
    rows: int
    test: object

    def __call__(self, *args):
        return self.test(*args)


@dataclass
class LeafwiseModel:
    """Fitted trees of one margin (regression, two classes) or one per class; plain numbers, stored as JSON."""

    target: str
    features: list[str]
    labels: list[str] | None
    base: list[float]
    trees: list[list[Tree]]
    label_type: str = "double"

    def predict(self, df: DataFrame) -> DataFrame:
        """The rows with `prediction` (and for classes `probability`, one number per label) appended; works on streams."""
        clean = nan_to_null(df)
        kept = [f"_c{i}" for i in range(len(df.columns))]
        inputs = [named(c).cast("double").alias(f"_x{i}") for i, c in enumerate(self.features)]
        ready = clean.select(*[named(c).alias(k) for c, k in zip(df.columns, kept)], *inputs)
        fields = [T.StructField(k, f.dataType) for k, f in zip(kept, df.schema.fields)]
        shape = T.StructType([*fields, T.StructField("_scores", T.ArrayType(T.DoubleType()))])
        scored = ready.mapInArrow(_scorer(self, len(kept)), shape)
        out = [F.col(k).alias(c) for k, c in zip(kept, df.columns)]
        if self.labels is None:
            return scored.select(*out, F.col("_scores")[0].alias("prediction"))
        names = F.array(*[F.lit(x) for x in self.labels])
        best = names[(F.array_position("_scores", F.array_max("_scores")) - 1).cast("int")]
        return scored.select(*out, best.cast(self.label_type).alias("prediction"), F.col("_scores").alias("probability"))

    def nodes(self, spark: SparkSession) -> DataFrame:
        """One row for each node of each tree; leaves have a value, other nodes a feature and its edge."""
        rows = [
            {
                "margin": m, "tree": k, "node": i, "feature": self.features[t.feature[i]] if t.feature[i] >= 0 else None,
                "edge": t.edge[i] if t.feature[i] >= 0 else None, "missing_left": t.missing_left[i] if t.feature[i] >= 0 else None,
                "gain": t.gain[i] if t.feature[i] >= 0 else None, "left_node": t.left[i] if t.feature[i] >= 0 else None,
                "right_node": t.right[i] if t.feature[i] >= 0 else None, "value": t.value[i] if t.feature[i] < 0 else None,
            }
            for m, trees in enumerate(self.trees) for k, t in enumerate(trees) for i in range(len(t.feature))
        ]
        return local_table(spark, rows, NODE_DDL)

    def importance(self) -> dict[str, float]:
        """Share of each feature in the gain of all splits."""
        total = dict.fromkeys(self.features, 0.0)
        for tree in (t for trees in self.trees for t in trees):
            for f, gain in zip(tree.feature, tree.gain, strict=True):
                if f >= 0:
                    total[self.features[f]] += gain
        whole = sum(total.values()) or 1.0
        return {c: g / whole for c, g in total.items()}

    def to_json(self) -> str:
        return json.dumps({**vars(self), "trees": [[vars(t) for t in trees] for trees in self.trees]})

    @classmethod
    def from_json(cls, text: str) -> LeafwiseModel:
        held = json.loads(text)
        return cls(**{**held, "trees": [[Tree(**t) for t in trees] for trees in held["trees"]]})


def _scorer(model: LeafwiseModel, first: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(first + i).to_numpy(zero_copy_only=False).astype(float) for i in range(len(model.features))]
            values = np.column_stack(columns)
            margins = np.column_stack(
                [b + sum((t.margins(t.places_of_values(values)) for t in trees), np.zeros(len(values))) for b, trees in zip(model.base, model.trees, strict=True)]
            )
            if model.labels is not None:
                margins = 1 / (1 + np.exp(-margins))
                margins = np.column_stack([1 - margins, margins]) if len(model.labels) == 2 else margins / margins.sum(axis=1, keepdims=True)
            scores = pa.ListArray.from_arrays(pa.array(np.arange(0, margins.size + 1, margins.shape[1], dtype=np.int32)), pa.array(margins.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:first], scores], names=[*batch.schema.names[:first], "_scores"])

    return run


# ---- fitting ------------------------------------------------------------------------------------


def feature_edges(df: DataFrame, features: list[str], bins: int = BINS) -> list[list[float]]:
    """Upper edges of the bins of each feature: exact quantiles without repetitions."""
    found = st.quantiles_of(df, features, [(i + 1) / bins for i in range(bins - 1)])
    return [sorted({float(v) for v in found.get(c, []) if v is not None}) for c in features]


def _binned(df: DataFrame, target, features: list[str], edges: list[list[float]], lost: int) -> DataFrame:
    """(bins binary, y, margin): one byte for each feature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, len(features)), dtype=np.uint8)
            for i in range(len(features)):
                values = batch.column(i + 1).to_numpy(zero_copy_only=False).astype(float)
                out[:, i] = np.where(np.isnan(values), lost, np.searchsorted(np.array(edges[i]), values, side="left"))
            packed = pa.array([r.tobytes() for r in out], type=pa.binary())
            yield pa.RecordBatch.from_arrays([packed, batch.column(0)], names=["bins", "y"])

    inputs = df.select(target.cast("double").alias("y"), *[named(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)])
    return inputs.mapInArrow(run, "bins binary, y double")


def _rows(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, width)
    return bins, batch.column("y").to_numpy(), batch.column("margin").to_numpy()


def _gradients(y: np.ndarray, margin: np.ndarray, logistic: bool) -> tuple[np.ndarray, np.ndarray]:
    if not logistic:
        return margin - y, np.ones(len(y))
    p = 1 / (1 + np.exp(-margin))
    return p - y, p * (1 - p)


def _sums(replay: list[Tree], tree: Tree, wanted: list[int], width: int, size: int, logistic: bool):
    """Gradient, curvature and row sums by (wanted leaf, feature, bin)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = len(wanted) * width * size
        total = np.zeros((3, cells))
        slot = np.full(len(tree.feature), -1)
        slot[wanted] = np.arange(len(wanted))
        for batch in batches:
            bins, y, margin = _rows(batch, width)
            for t in replay:
                margin = margin + t.margins(t.places_of_bins(bins, size - 1))
            g, h = _gradients(y, margin, logistic)
            own = slot[tree.places_of_bins(bins, size - 1)]
            some = np.flatnonzero(own >= 0)
            for j in range(width):
                at = (own[some] * width + j) * size + bins[some, j]
                for k, weights in enumerate((g[some], h[some], None)):
                    total[k] += np.bincount(at, weights, minlength=cells)
        used = np.flatnonzero(total[2])
        yield pa.RecordBatch.from_arrays([pa.array(used), *[pa.array(t[used]) for t in total]], names=["at", "g", "h", "n"])

    return run


def _advance(replay: list[Tree], width: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, _, margin = _rows(batch, width)
            for t in replay:
                margin = margin + t.margins(t.places_of_bins(bins, size - 1))
            yield pa.RecordBatch.from_arrays([batch.column("bins"), batch.column("y"), pa.array(margin)], names=["bins", "y", "margin"])

    return run


@dataclass
class Growth:
    """How trees grow: shrinkage, penalty on leaf values, least rows of a leaf, leaves of a tree."""

    rate: float = 0.1
    penalty: float = 1.0
    least_rows: int = 20
    leaves: int = 31

    def best_split(self, sums: np.ndarray) -> tuple[float, int, int, bool] | None:
        """(gain, feature, last bin to the left, missing left) of a (3, features, bins) block whose last bin is missing."""
        g, h, n = sums
        lost = np.stack([s[:, -1] for s in sums])  # 3 x features
        left = np.cumsum(sums[:, :, :-1], axis=2)[:, :, :-1]
        whole = sums.sum(axis=2)[:, :1]  # the same for every feature
        score = lambda a, b: a * a / (b + self.penalty)
        best = None
        for missing_left in (True, False):
            lg, lh, ln = left + (lost[:, :, None] if missing_left else 0)
            rg, rh, rn = whole[0][:, None] - lg, whole[1][:, None] - lh, whole[2][:, None] - ln
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = score(lg, lh) + score(rg, rh) - score(whole[0], whole[1])[:, None]
            gain = np.where((ln >= self.least_rows) & (rn >= self.least_rows), gain, -np.inf)
            if not gain.size:
                continue
            at = int(gain.argmax())
            found = (float(gain.flat[at]), *map(int, divmod(at, gain.shape[1])), missing_left)
            if found[0] > 1e-12 and (best is None or found[0] > best[0] * (1 + 1e-12)):
                best = found
        return best

    def value(self, sums: np.ndarray) -> float:
        g, h, _ = sums[:, 0].sum(axis=1)
        return -self.rate * float(g / (h + self.penalty))


def _grow(data: DataFrame, replay: list[Tree], edges: list[list[float]], size: int, logistic: bool, growth: Growth) -> Tree:
    width, tree, held, splits = len(edges), Tree(), {}, {}

    def measure(view: Tree, leaves: list[int]) -> None:
        rows = data.mapInArrow(_sums(replay, view, leaves, width, size, logistic), "at long, g double, h double, n double")
        found = np.zeros((3, len(leaves) * width * size))
        for r in rows.groupBy("at").agg(*[F.sum(c).alias(c) for c in "ghn"]).collect():  # leaves x features x bins at most
            found[:, r["at"]] = r["g"], r["h"], r["n"]
        for leaf, block in zip(leaves, found.reshape(3, len(leaves), width, size).swapaxes(0, 1), strict=True):
            held[leaf] = block

    def open_(view: Tree, node: int) -> None:
        _, view.feature[node], view.bin[node], view.missing_left[node] = splits[node]
        view.edge[node] = edges[view.feature[node]][view.bin[node]]
        view.gain[node] = splits[node][0]
        view.left[node], view.right[node] = view.leaf(), view.leaf()

    def judge(node: int) -> None:
        tree.value[node] = growth.value(held[node])
        found = growth.best_split(held[node])
        if found:
            splits[node] = found

    root = tree.leaf()
    measure(tree, [root])
    judge(root)
    ready: dict[int, tuple[np.ndarray, np.ndarray]] = {}  # leaf -> sums of the two children that its best split makes
    leaves = 1
    while splits and leaves < growth.leaves:
        node = max(splits, key=lambda n: (splits[n][0], -n))
        if node not in ready:
            # one pass serves all leaves: each is opened on a copy of the tree, and its smaller child is summed
            view = Tree(**{k: list(v) for k, v in vars(tree).items()})
            asked = {}
            for leaf in [n for n in splits if n not in ready]:
                open_(view, leaf)
                feature, cut, missing_left = splits[leaf][1:]
                rows = held[leaf][2, feature]
                on_left = rows[: cut + 1].sum() + (rows[-1] if missing_left else 0)
                small = view.left[leaf] if on_left * 2 <= rows.sum() else view.right[leaf]
                asked[leaf] = (small, small == view.left[leaf])
            before = dict(held)
            measure(view, [small for small, _ in asked.values()])
            for leaf, (small, is_left) in asked.items():
                a, b = held[small], before[leaf] - held[small]
                ready[leaf] = (a, b) if is_left else (b, a)
            held.clear()
            held.update(before)
        open_(tree, node)
        held[tree.left[node]], held[tree.right[node]] = ready.pop(node)
        splits.pop(node)
        judge(tree.left[node])
        judge(tree.right[node])
        leaves += 1
    return tree


def train_gbt_leafwise(
    df: DataFrame,
    target: str,
    features: list[str] | None = None,
    classification: bool = False,
    rounds: int = 100,
    growth: Growth | None = None,
    bins: int = BINS,
    edges: list[list[float]] | None = None,
) -> LeafwiseModel:
    """Boosted trees of numeric features with missing values; more than two classes get one margin each.

    `edges` fixes the upper edges of the bins per feature; left out, they are quantiles. Rows without a target are left out.
    """
    if bins > 255:
        raise ValueError("a feature has at most 255 bins")
    growth = growth or Growth()
    clean = nan_to_null(df).where(named(target).isNotNull())
    features = features or [c for c in columns_of(clean, "numeric") if c != target]
    if not features:
        raise ValueError("no numeric feature column")
    edges = edges or feature_edges(clean, features, bins)
    size = max(len(e) for e in edges) + 2  # values above the last edge, and missing
    labels = None
    if classification:
        labels = [r["g"] for r in clean.select(named(target).cast("string").alias("g")).distinct().orderBy("g").collect()]
        if target in columns_of(clean, "numeric"):
            labels.sort(key=float)
    sides = [None] if labels is None else labels[1:] if len(labels) == 2 else labels
    base, trees = [], []
    for side in sides:
        y = named(target) if side is None else (named(target).cast("string") == side).cast("int")
        data = cut_lineage(_binned(clean, y, features, edges, size - 1))
        mean = data.agg(F.avg("y")).first()[0]
        if mean is None:
            raise ValueError("no row has a target")
        start = mean if side is None else math.log(max(mean, 1e-9) / max(1 - mean, 1e-9))
        data = data.withColumn("margin", F.lit(float(start)))
        grown: list[Tree] = []
        kept = 0
        for _ in range(rounds):
            tree = _grow(data, grown[kept:], edges, size, side is not None, growth)
            grown.append(tree)
            if len(tree.feature) == 1:  # nothing left to split
                break
            if len(grown) - kept >= KEEP and len(grown) < rounds:
                data = cut_lineage(data.mapInArrow(_advance(grown[kept:], len(features), size), "bins binary, y double, margin double"))
                kept = len(grown)
        base.append(float(start))
        trees.append(grown)
    kind = dict(df.dtypes)[target]
    return LeafwiseModel(target, features, labels, base, trees, kind)
