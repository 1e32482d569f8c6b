"""Toxicity by maximum-scoring segments of token log-odds, calibrated by extreme-value statistics.

Fit, over all labelled rows outside the held-out fold: in how many distinct texts of each class a token
form occurs (the word, or its first 4 to 9 bytes, so that inflected and compound words share a form), its
log-odds under an informative Dirichlet prior (pooled share of the form, plus a floor), and the standard
error. Forms whose log-odds lie `z` errors above 0 keep the value; a token scores as its highest such
form, and all tokens without one form one class with one, negative, score. Copies of a text count once per
class, so a text that was copied a thousand times is one witness.

Score, one narrow pass: a linear scan finds every maximal scoring segment of the whole text. A segment of
score S in n tokens is expected E = K n exp(-lambda S) times by chance; lambda solves
sum p exp(lambda s) = 1 over the clean class and K comes from the segments of all clean training texts. The
evidence of a text adds max(0, -ln E) over its segments. A logistic curve over the evidence, fitted on
counts in evidence bins, turns it into a probability.

Every form that passes `z` counts, however many there are: the table of scored forms is broadcast in parts of PART
forms (32 MB). With several parts each but the last takes a pass of its own over the texts and leaves the scores
found so far; the driver holds 16 bytes per form. Lang, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no tokens and get the curve's value at evidence 0; rows with a
null label are not learnt from; of several labels for a doc_id each counts; rows are told apart by doc_id and text, and a
repeated row teaches once; a row without doc_id is never held out; without labels, or with labels
of one class, every score is that class's share (0 without any). Other columns pass through.
"""

from __future__ import annotations

import copy
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tabwright.llm.common import bit_set, spot, spot_of, stored, taken, text_digest, word_spans
from tabwright.llm.registry import register, table

FOLDS = 5
PART = 2_000_000  # forms in one broadcast: two arrays of 16 MB
BINS = 400  # of evidence, for the curve
PREFIXES = range(4, 10)  # bytes

_MARKS = "_mark_at array<int>, _mark_score array<double>"
SEGMENTS = "n_tokens long, evidence double, seg_from array<int>, seg_to array<int>, seg_score array<double>"


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def maximal_segments(position: list[int], score: list[float], other: float) -> list[tuple[int, int, float]]:
    """[(first, end, score)] of all maximal scoring segments, in linear time.

    Only tokens with a positive score are listed; every token between them scores `other` (negative).
    """
    # one entry per candidate: left total, right total, first token, end token, nearest earlier with a smaller left
    stack: list[tuple[float, float, int, int]] = []
    total, last = 0.0, 0
    for at, s in zip(position, score, strict=True):
        total += other * (at - last)
        left, right, first = total, total + s, at
        total, last = right, at + 1
        while True:
            j = len(stack) - 1
            while j >= 0 and stack[j][0] >= left:
                j -= 1
            if j < 0 or stack[j][1] >= right:
                stack.append((left, right, first, at + 1))
                break
            left, first = stack[j][0], stack[j][2]
            del stack[j:]
    return [(a, b, hi - lo) for lo, hi, a, b in stack]


class Model:
    """Scores of token forms (by hash), and what turns segment scores into probabilities."""

    def __init__(self, hashes: np.ndarray, values: np.ndarray, part: int = PART):
        self.hashes, self.values, self.size = hashes, values, part  # in the order of the hashes
        self.other, self.lam, self.k, self.slope, self.intercept = -1.0, 1.0, 1.0, 0.0, 0.0

    def parts(self) -> list[Model]:
        """The same model with at most `size` forms each."""
        out = []
        for at in range(0, max(len(self.hashes), 1), self.size):
            own = copy.copy(self)
            own.hashes, own.values = self.hashes[at : at + self.size], self.values[at : at + self.size]
            out.append(own)
        return out

    def found(self, text: str | None, where: list[int] | None = None, scores: list[float] | None = None) -> tuple[int, np.ndarray, np.ndarray]:
        """(tokens, positions of scored tokens, their scores), beside those found already."""
        count, forms = token_forms(text)
        if not count:
            return count, np.zeros(0, dtype=np.int64), np.zeros(0)
        best = np.full(count, -np.inf)
        if where:
            best[where] = scores
        for owners, hashes in forms if len(self.hashes) else ():
            place = np.searchsorted(self.hashes, hashes)
            place[place == len(self.hashes)] = 0
            hit = self.hashes[place] == hashes
            np.maximum.at(best, owners[hit], self.values[place[hit]])
        where = np.flatnonzero(best > -np.inf)
        return count, where, best[where]

    def found_in(self, batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """`found` of the texts in column `at`, after the passes of earlier parts."""
        marks = [batch.column(c).to_pylist() for c in ("_mark_at", "_mark_score")] if "_mark_at" in batch.schema.names else None
        for k, text in enumerate(batch.columns[at]):
            yield self.found(text.as_py(), *([m[k] for m in marks] if marks else ()))


def _prepared(documents: DataFrame, model: Model, at: int) -> tuple[DataFrame, Model]:
    """The documents after the passes of all parts but the last, and the last part."""
    *earlier, last = model.parts()
    for part in earlier:
        held = documents.sparkSession.sparkContext.broadcast(part)
        slim = documents.drop("_mark_at", "_mark_score")
        schema = StructType([*slim.schema.fields, *StructType.fromDDL(_MARKS).fields])
        documents = stored(documents.mapInArrow(_marker(held, at, len(slim.columns)), schema), "toxicity-marks")
    return documents, last


def _marker(held, at: int, own: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(held.value.found_in(batch, at))
            marks = [pa.array([f[j] for f in found], type=pa.list_(kind)) for j, kind in ((1, pa.int32()), (2, pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], *marks], names=[*batch.schema.names[:own], "_mark_at", "_mark_score"])

    return run


def token_forms(text: str | None) -> tuple[int, list[tuple[np.ndarray, np.ndarray]]]:
    """(tokens, [(token numbers, hashes of one form)]): whole words, then prefixes of words that are longer."""
    _, starts, ends, spans = word_spans((text or "").encode())
    forms = [(np.arange(len(starts)), spans(starts, ends))]
    for n in PREFIXES:
        own = np.flatnonzero(ends - starts > n)
        forms.append((own, spans(starts[own], starts[own] + n) ^ np.uint64(n)))
    return len(starts), forms


def fit(documents: DataFrame, labels: DataFrame, z: float = 3.3, floor: float = 0.5, part: int = PART) -> Model:
    """Learn from all labelled rows outside fold 0."""
    known = labels.where(F.col("toxic").isNotNull()).select(F.col("doc_id").alias("_label_id"), (F.col("toxic") == 1).alias("toxic"))
    slim = documents.where((fold(F.col("doc_id")) != 0) & F.col("text").isNotNull())
    slim = slim.select("doc_id", text_digest(F.col("text")).alias("d")).join(known, F.col("doc_id") == F.col("_label_id"))
    chosen = slim.groupBy("d", "toxic").agg(F.min("doc_id").alias("_rep"), F.count(F.lit(1)).alias("n"))
    chosen = stored(chosen, "toxicity-chosen")
    # texts of the chosen rows only; a bit set thins the scan before anything is shuffled
    held = bit_set(chosen.select(spot(F.col("_rep")).alias("s")))
    texts = documents.select("doc_id", "text").mapInArrow(_among(held), "doc_id long, text string")
    # merged at every size: the labels grow with the documents, so they are never sent whole
    own = (F.col("doc_id") == F.col("_rep")) & (text_digest(F.col("text")) == F.col("d"))
    train = texts.join(chosen.hint("merge"), own).dropDuplicates(["d", "toxic"]).select("toxic", "text", "n")
    train = stored(train, "toxicity-train")
    sizes = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.sum("n").alias("n")).collect()}
    bad, good = sizes.get(True, 0), sizes.get(False, 0)
    if not bad or not good:
        model = Model(np.zeros(0, dtype=np.uint64), np.zeros(0))
        model.intercept = 40.0 if bad else -40.0  # the only class there is
        return model
    counts = train.select("toxic", "text").mapInArrow(_form_counts, "h long, y1 long, y0 long").groupBy("h")
    counts = stored(counts.agg(F.sum("y1").alias("y1"), F.sum("y0").alias("y0")), "toxicity-counts")
    n1, n0, v = counts.agg(F.sum("y1"), F.sum("y0"), F.count(F.lit(1))).head()
    n1, n0 = n1 or 0, n0 or 0
    # prior: a hundredth of a pseudo-count per form, shared out by pooled frequency, and the floor
    prior = F.lit(floor) + F.lit(float(v)) * (F.col("y1") + F.col("y0")) / F.lit(float(max(n1 + n0, 1)) * 100)
    a0 = floor * v + v / 100
    a1, b1 = F.col("y1") + F.col("a"), F.col("y0") + F.col("a")
    odds = F.log(a1 / (F.lit(n1 + a0) - a1)) - F.log(b1 / (F.lit(n0 + a0) - b1))
    scored = counts.withColumn("a", prior).select("h", odds.alias("odds"), (odds / F.sqrt(1 / a1 + 1 / b1)).alias("z"))
    model = Model(*_terms(stored(scored.where(F.col("z") >= z).select("h", "odds"), "toxicity-terms"), part), part)
    _background(model, train)
    _calibrate(model, train)
    return model


def _terms(terms: DataFrame, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, values) in the order of the hashes; they come to the driver as packed arrays, a part at a time."""
    parts, held = -(-terms.count() // part) or 1, []
    for k in range(parts):
        own = terms.where(F.pmod("h", F.lit(parts)) == k).toArrow()
        held.append((own.column("h").to_numpy().view(np.uint64), own.column("odds").to_numpy()))
    hashes, values = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.argsort(hashes)
    return hashes[order], values[order]


def _among(held):
    """Rows whose doc_id is in the bit set; texts are passed on untouched."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([taken(held.value, spot_of(i)) for i in batch.column(0).to_pylist()], type=pa.bool_()))

    return run


def _form_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many texts of either class each form occurs; forms are signed 64-bit hashes."""
    for batch in batches:
        forms: dict[bool, list] = {True: [], False: []}
        for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            forms[toxic].append(np.unique(np.concatenate([h for _, h in token_forms(text)[1]])))
        for toxic, own in forms.items():
            h, n = np.unique(np.concatenate(own) if own else np.zeros(0, np.uint64), return_counts=True)
            zero = np.zeros(len(n), dtype=np.int64)
            counts = [pa.array(n.astype(np.int64)), pa.array(zero)]
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), *(counts if toxic else counts[::-1])], names=["h", "y1", "y0"])


def _background(model: Model, train: DataFrame) -> None:
    """Score of all other tokens, and lambda, from how often each class has each score."""
    marked, last = _prepared(train.select("toxic", "text"), model, 1)
    held = train.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: dict[tuple, int] = {}
            for toxic, (count, _, scores) in zip(batch.column(0).to_pylist(), held.value.found_in(batch, 1), strict=True):
                total[toxic, 0.0] = total.get((toxic, 0.0), 0) + count - len(scores)
                for s in np.round(scores * 8) / 8:
                    total[toxic, float(s)] = total.get((toxic, float(s)), 0) + 1
            rows = [(t, s, n) for (t, s), n in total.items()]
            columns = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, type=k) for c, k in zip(columns, (pa.bool_(), pa.float64(), pa.int64()), strict=True)], names=["toxic", "s", "n"]
            )

    seen = marked.mapInArrow(run, "toxic boolean, s double, n long")
    rows = {(r["toxic"], r["s"]): r["n"] for r in seen.groupBy("toxic", "s").agg(F.sum("n").alias("n")).collect()}
    size = {t: sum(n for (c, _), n in rows.items() if c == t) for t in (True, False)}
    plain = [(rows.get((t, 0.0), 0) + 1) / (size[t] + 1) for t in (True, False)]
    model.other = min(-1e-3, math.log(plain[0]) - math.log(plain[1]))
    share = [((n + 0.5) / (size[False] + 1), s) for (c, s), n in rows.items() if not c and s]
    model.lam = _lambda(share, model.other)


def _lambda(share: list[tuple[float, float]], other: float) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the clean class, by bisection."""
    rest = 1 - sum(p for p, _ in share)
    if not share or sum(p * s for p, s in share) + rest * other >= 0:
        return 1.0

    def excess(x: float) -> float:
        return sum(p * math.exp(min(x * s, 500)) for p, s in share) + rest * math.exp(x * other) - 1

    low, high = 1e-9, 1.0
    while excess(high) < 0:
        high *= 2
    for _ in range(80):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def _calibrate(model: Model, train: DataFrame) -> None:
    """K from the segments of clean training texts, then the curve over evidence bins."""
    model.k = 1.0
    found = stored(segments(train.select("toxic", "text", "n"), model).drop("text"), "toxicity-segments")
    clean = found.where(~F.col("toxic"))
    tokens = clean.agg(F.sum("n_tokens")).head()[0] or 0
    least = float(model.values.min()) if len(model.values) else 1.0
    above = clean.select(F.explode("seg_score").alias("s")).where(F.col("s") >= least).count()
    # E(least) = K n exp(-lambda least) is what was seen; half a segment where none was
    model.k = max((above + 0.5) / max(tokens, 1) * math.exp(min(model.lam * least, 500)), 1e-300)
    again = segments(train.select("toxic", "text", "n"), model)
    bins = again.groupBy(F.least(F.floor(F.col("evidence") * 4), F.lit(BINS)).alias("b"), "toxic").agg(F.sum("n").alias("n")).collect()
    model.slope, model.intercept = _logistic([(r["b"] / 4, r["toxic"], r["n"]) for r in bins])


def _logistic(rows: list[tuple[float, bool, int]], ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and intercept over log(1 + evidence) by Newton steps; a light ridge keeps separable data finite."""
    x = np.array([[math.log1p(e), 1.0] for e, _, _ in rows])
    y = np.array([float(t) for _, t, _ in rows])
    n = np.array([float(k) for _, _, k in rows])
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -40, 40)))
        gradient = x.T @ (n * (y - p)) - ridge * n.sum() * w / 100
        hessian = (x * (n * p * (1 - p))[:, None]).T @ x + ridge * n.sum() / 100 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w += np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), float(w[1])


def segments(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Tokens, evidence and all maximal scoring segments (token offsets, scores) of every document."""
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    documents = documents.drop(*names)
    at = documents.columns.index(text)
    fields = documents.schema.fields
    documents, last = _prepared(documents, model, at)
    held = documents.sparkSession.sparkContext.broadcast(last)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held.value
        for batch in batches:
            rows = []
            for count, where, scores in model.found_in(batch, at):
                found = maximal_segments(where.tolist(), scores.tolist(), model.other)
                chance = math.log(model.k * count) if count else 0.0
                evidence = sum(max(0.0, model.lam * s - chance) for _, _, s in found)
                rows.append((count, evidence, [a for a, _, _ in found], [b for _, b, _ in found], [s for _, _, s in found]))
            kinds = (pa.int64(), pa.float64(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64()))
            made = [pa.array([r[j] for r in rows], type=kind) for j, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(fields)], *made], names=[*batch.schema.names[: len(fields)], *names])

    return documents.mapInArrow(run, StructType([*fields, *StructType.fromDDL(SEGMENTS).fields]))


def score(documents: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The documents with their segments, `score` (0 to 1) and `predicted`."""
    found = segments(documents.drop("score", "predicted"), model, text)
    curve = F.lit(model.slope) * F.log1p("evidence") + F.lit(model.intercept)
    return found.withColumn("score", 1 / (1 + F.exp(-curve))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(documents: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that are not predicted toxic, with their own columns."""
    own = [f"c{k}" for k in range(len(documents.columns))]
    at = documents.columns.index("text")
    model = fit(documents.select("doc_id", "text"), labels, **options)
    return score(documents.toDF(*own), model, own[at]).where(F.col("predicted") == 0).select(*own).toDF(*documents.columns)


@register("op2_toxicity")
def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score(documents, fit(documents, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "score", "predicted", "evidence", "seg_from", "seg_to", "seg_score")
