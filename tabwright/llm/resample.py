"""Importance resampling towards a target: documents are drawn by how much likelier their n-grams are in the target.

Words and runs of up to two words fall into hashed buckets; the bucket counts of all documents and of all target
texts give each bucket a gain (a log ratio), a document's weight is the mean gain of its runs, and a draw without
replacement takes the documents with the largest weight plus Gumbel noise, which a hash of the id gives.

Texts are cut by Arrow kernels: `ascii_lower`, `split_pattern_regex`, `list_flatten` and `dictionary_encode` give the
words of a batch as dictionary indices; an index beside the one shifted by a place is a run of two words, distinct
pairs get their CRC once, `take` brings gains back to places and a segment sum adds them up per document. Both
passes are narrow. What a task counts is one array of bucket counts, so the shuffle holds at most `buckets` rows
a task and the driver `buckets` rows. The draw is a range sort of narrow rows, numbered across partitions.

Defined results: a null, empty or wordless text has no features and weight 0; it takes part in the draw only if
`least_words` lets it. Repeated rows count and are drawn each for themselves; rows alike in score and doc_id
follow by weight and number of features, a missing doc_id comes last and is spelt `null` in its hash. An empty
target or an empty corpus has counts of 0. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import numbered, stored
from tabwright.llm.registry import register, table

BUCKETS = 10_000
SHARE = 25  # in percent
LEAST_WORDS = 20
SEED = 7
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PAIRS_HELD = 1 << 20  # distinct pairs whose bucket a task remembers


class Featurizer:
    """Buckets of the runs of one and two words of a batch of texts; remembers buckets of pairs it has seen."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.known: dict[bytes, int] = {}

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket) of every word and (row, bucket) of every pair, both by row."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        split = pc.split_pattern_regex(pc.ascii_lower(texts), pattern=GAPS)
        rows = pc.list_parent_indices(split).to_numpy()
        words = pc.list_flatten(split)
        real = pc.not_equal(words, "")
        rows, words = rows[real.to_numpy(zero_copy_only=False)], words.filter(real)
        coded = words.dictionary_encode()
        index, spelt = coded.indices.to_numpy().astype(np.int64), coded.dictionary.to_pylist()
        spelt = [w.encode() for w in spelt]
        crc = np.fromiter(map(zlib.crc32, spelt), dtype=np.int64, count=len(spelt))
        near = np.flatnonzero(rows[1:] == rows[:-1])
        pairs, place = np.unique(index[near] * len(spelt) + index[near + 1], return_inverse=True)
        of_pair = self._pairs(pairs, spelt, crc) if len(pairs) else pairs
        single = pc.take(pa.array(crc % self.buckets), coded.indices).to_numpy()
        double = pc.take(pa.array(of_pair), pa.array(place)).to_numpy() if len(pairs) else pairs
        return rows, single, rows[near], double

    def _pairs(self, pairs: np.ndarray, spelt: list[bytes], crc: np.ndarray) -> np.ndarray:
        left, right = np.divmod(pairs, len(spelt))
        after = [zlib.crc32(b" ", c) for c in crc.tolist()]  # of the word and the space
        found = [zlib.crc32(spelt[b], after[a]) for a, b in zip(left.tolist(), right.tolist(), strict=True)]
        return np.array(found, dtype=np.int64) % self.buckets


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Featurizer(buckets), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            _, single, _, double = features(batch.column(0))
            total += np.bincount(single, minlength=buckets) + np.bincount(double, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts (the only column) fall into each bucket."""
    counted = texts.mapInArrow(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, dtype=np.int64)
    for r in counted.collect():  # one row for each bucket at most
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of the smoothed share in the target over that in the corpus, bucket by bucket."""
    buckets, all_s, all_t = len(corpus), float(corpus.sum()), float(target.sum())
    ratios = [
        (float(t) + 1) * (all_s + buckets) / ((float(s) + 1) * (all_t + buckets)) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)
    ]
    return np.array([math.floor(1000 * math.log(x)) for x in ratios], dtype=np.int64)


def noise(doc_id, seed: int) -> int:
    """floor(1000 x) of a Gumbel variate x that the id alone decides."""
    name = "null" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _weigher(gain: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Featurizer(len(gain))
        for batch in batches:
            row, single, row_2, double = features(batch.column(1))
            n, n_words = np.zeros((2, batch.num_rows), dtype=np.int64)
            total = np.zeros(batch.num_rows, dtype=np.int64)
            for rows, found in ((row, single), (row_2, double)):
                if len(rows):
                    first = np.flatnonzero(np.concatenate(([True], rows[1:] != rows[:-1])))
                    total[rows[first]] += np.add.reduceat(gain[found], first)
                    n += np.bincount(rows, minlength=batch.num_rows)
            n_words += np.bincount(row, minlength=batch.num_rows)
            weight = np.floor_divide(total, np.maximum(n, 1))
            ids = batch.column(0).to_pylist()
            score = weight + np.fromiter((noise(i, seed) for i in ids), dtype=np.int64, count=len(ids))
            made = [pa.array(x) for x in (n, n_words, weight, score)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["doc_id", "n_features", "n_words", "weight", "score"])

    return run


def importance_resample(
    documents: DataFrame,
    target: DataFrame,
    share: int = SHARE,
    least_words: int = LEAST_WORDS,
    buckets: int = BUCKETS,
    seed: int = SEED,
    text: str = "text",
    id_: str = "doc_id",
    target_text: str = "text",
) -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank): rank numbers the drawn documents from 1, others have null.

    floor(share * N / 100) of the N documents with at least `least_words` words are drawn.
    """
    slim = documents.select(F.col(id_).cast("long").alias("doc_id"), F.col(text).alias("text"))
    gain = gains(bucket_counts(slim.select("text"), buckets), bucket_counts(target.select(F.col(target_text).alias("text")), buckets))
    weighed = slim.mapInArrow(_weigher(gain, seed), "doc_id long, n_features long, n_words long, weight long, score long")
    # documents that are out, then by falling score; the last key spreads rows that are alike in all others
    weighed = weighed.withColumns({"_out": F.col("n_words") < least_words, "_fall": -F.col("score"), "_none": F.col("doc_id").isNull(), "_any": F.rand(seed)})
    weighed = stored(weighed, "resample-weights")
    drawn = weighed.where(~F.col("_out")).count() * share // 100
    placed = numbered(weighed, [], ["_out", "_fall", "_none", "doc_id", "weight", "n_features", "_any"], "_at", "resample-order")
    rank = F.when(~F.col("_out") & (F.col("_at") < drawn), F.col("_at") + 1)
    return placed.select("doc_id", "n_features", "n_words", "weight", "score", rank.alias("rank"))


WORDS_SQL = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""

SQL = f"""
WITH RECURSIVE
tab AS (SELECT i, list_reduce([CAST(i AS BIGINT), 1, 1, 1, 1, 1, 1, 1, 1],
                              lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(i)),
d AS (SELECT row_number() OVER () AS k, doc_id, {WORDS_SQL} AS w FROM documents),
b AS (SELECT {WORDS_SQL} AS w FROM benchmark),
df AS (SELECT k, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
bf AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
crc AS (SELECT f, hex(f) AS x, 1 AS p, CAST(4294967295 AS BIGINT) AS c FROM (SELECT f FROM df UNION SELECT f FROM bf)
        UNION ALL
        SELECT f, x, p + 2, xor(c >> 8, v) FROM crc JOIN tab ON i = xor(c, CAST('0x' || substr(x, p, 2) AS BIGINT)) & 255 WHERE p < len(x)),
bucket AS (SELECT f, xor(c, 4294967295) % 10000 AS h FROM crc WHERE p > len(x)),
s AS (SELECT h, count(*) AS n FROM df JOIN bucket USING (f) GROUP BY h),
t AS (SELECT h, count(*) AS n FROM bf JOIN bucket USING (f) GROUP BY h),
gain AS (SELECT r.h, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM df) + 10000.0::DOUBLE)
                                / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bf) + 10000.0::DOUBLE)))) AS BIGINT) AS g
         FROM range(10000) AS r(h) LEFT JOIN s ON s.h = r.h LEFT JOIN t ON t.h = r.h),
sums AS (SELECT k, count(*) AS n, CAST(sum(g) AS BIGINT) AS total FROM df JOIN bucket USING (f) JOIN gain USING (h) GROUP BY k),
w AS (SELECT d.k, doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, len(w) >= 20 AS takes_part,
             CAST(CASE WHEN n > 0 THEN (total - ((total % n) + n) % n) // n ELSE 0 END AS BIGINT) AS weight,
             CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 8) AS BIGINT) AS h
      FROM d LEFT JOIN sums ON sums.k = d.k),
scored AS (SELECT k, doc_id, n_features, weight, takes_part,
                  weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM w),
ranked AS (SELECT k, row_number() OVER (ORDER BY score DESC, doc_id, weight, n_features) AS r FROM scored WHERE takes_part)
SELECT doc_id, n_features, weight, score,
       CASE WHEN r <= (SELECT count(*) FROM ranked) * 25 // 100 THEN CAST(r AS BIGINT) END AS rank
FROM scored LEFT JOIN ranked USING (k)
"""


@register("op13_importance_resampling", SQL)
def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    drawn = importance_resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")
