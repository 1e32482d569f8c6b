"""Benchmark decontamination: a broadcast hash set of test n-grams against every training window.

Benchmark windows are hashed, collected and broadcast in parts of a bounded size (see PART_BYTES);
each part is one narrow pass over the documents, which stay where they are: nothing is shuffled.
A hash that is found is verified word by word before it counts.

Defined results: a null or empty text has no words and is never contaminated; a null or empty
benchmark text has no window; equal items and repeated documents each count for themselves; an item
shorter than the window is one window of its own length; a null item_id takes part in hits but is
left out of the listed ids. Other columns pass through; one named like a result is replaced by it.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.llm.common import words_of
from tabwright.llm.common import windows as window_hashes
from tabwright.llm.registry import register, table

WINDOW = 10
PART_BYTES = 32 << 20  # of benchmark text in one broadcast; more text means more passes

OUT = "n_words long, n_items long, n_hit long, items_sha256 string, hit_from array<int>, hit_to array<int>"
RESULT = [x.split()[0] for x in OUT.split(", ")] + ["contaminated"]


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """The documents with n_words, n_hit, n_items, items_sha256, contaminated and the hit byte spans.

    `hit_from`/`hit_to` are byte offsets of the words inside benchmark windows, joined to maximal runs.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t"))
    items = items.where(F.col("t").isNotNull())
    size = items.agg(F.sum(F.octet_length("t")).alias("b")).head()["b"] or 0
    parts = max(1, -(-size // part_bytes))
    documents = documents.drop(*RESULT, "_marks", "_found")
    schema = documents.schema
    found = documents
    at = documents.columns.index(text)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == part)
        held = documents.sparkSession.sparkContext.broadcast(_index(own.toLocalIterator(), window))
        last = part == parts - 1
        found = found.mapInArrow(
            _scanner(held, window, at, first=part == 0, last=last),
            _with(schema, OUT if last else "_marks binary, _found binary"),
        )
    return found.withColumn("contaminated", F.col("n_hit") > 0)


def _with(schema, ddl: str):
    from pyspark.sql.types import StructType

    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])


def _index(rows: Iterator, window: int) -> dict:
    """{window length: (sorted hashes, {hash: {words: [item numbers]}})} and the item ids."""
    sizes: dict[int, dict] = {}
    ids: list[str | None] = []
    for r in rows:
        low, starts, ends, hashes = words_of(r["t"].encode())
        if not len(starts):
            continue
        n = min(window, len(starts))
        at = sizes.setdefault(n, {})
        for k, h in enumerate(window_hashes(hashes, n).tolist()):
            words = b" ".join(low[starts[j] : ends[j]] for j in range(k, k + n))
            at.setdefault(h, {}).setdefault(words, set()).add(len(ids))
        ids.append(r["i"])
    return {"ids": ids, "sizes": {n: (np.array(sorted(x), dtype=np.uint64), x) for n, x in sizes.items()}}


def _hits(data: bytes, index: dict):
    """(number of words, word starts, word ends, hit flag of each word, items) of one text."""
    low, starts, ends, hashes = words_of(data)
    hit = np.zeros(len(starts), dtype=bool)
    items: set[int] = set()
    for n, (known, exact) in index["sizes"].items():
        if len(starts) < n:
            continue
        own = window_hashes(hashes, n)
        place = np.searchsorted(known, own)
        place[place == len(known)] = 0
        for k in np.flatnonzero(known[place] == own).tolist():
            words = b" ".join(low[starts[j] : ends[j]] for j in range(k, k + n))
            of = exact[int(own[k])].get(words)
            if of:
                hit[k : k + n] = True
                items |= of
    return starts, ends, hit, items


def _scanner(held, window: int, at: int, first: bool, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = held.value
        for batch in batches:
            columns = batch.columns if first else batch.columns[:-2]
            marks_in = None if first else batch.columns[-2]
            found_in = None if first else batch.columns[-1]
            rows = []
            for k, value in enumerate(batch.columns[at]):
                data = (value.as_py() or "").encode()
                starts, ends, hit, items = _hits(data, index)
                names = [index["ids"][i] for i in items]
                if not first:
                    hit |= np.frombuffer(marks_in[k].as_py(), dtype=bool)
                    names += pickle.loads(found_in[k].as_py())
                rows.append((hit.tobytes(), pickle.dumps(names)) if not last else _result(starts, ends, hit, names))
            if last:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32())]
            else:
                kinds = [pa.binary(), pa.binary()]
            made = [pa.array([r[j] for r in rows], type=kind) for j, kind in enumerate(kinds)]
            tail = OUT.split(", ") if last else ["_marks binary", "_found binary"]
            yield pa.RecordBatch.from_arrays(
                [*columns, *made], names=[*batch.schema.names[: len(columns)], *[x.split()[0] for x in tail]]
            )

    return run


def _result(starts, ends, hit, names: list[str | None]) -> tuple:
    edge = np.diff(np.concatenate(([0], hit.view(np.int8), [0])))
    runs = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1
    listed = ",".join(sorted(n for n in names if n is not None))
    return (
        len(starts),
        len(names),
        int(hit.sum()),
        hashlib.sha256(listed.encode()).hexdigest(),
        starts[runs[0]].tolist(),
        ends[runs[1]].tolist(),
    )


def decontaminate(documents: DataFrame, benchmark: DataFrame, remove: str = "documents", **options) -> DataFrame:
    """Documents without benchmark text: contaminated ones go whole, or lose the hit spans (`remove="spans"`)."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove is 'documents' or 'spans'")
    at = documents.columns.index(options.pop("text", "text"))
    own = [f"c{k}" for k in range(len(documents.columns))]  # no name can clash with a result
    scanned = contamination(documents.toDF(*own), benchmark, text=own[at], **options)
    if remove == "documents":
        return scanned.where(~F.col("contaminated")).select(*own).toDF(*documents.columns)
    cut = F.pandas_udf(_without_many, "string")(own[at], "hit_from", "hit_to")
    scanned = scanned.withColumn(own[at], F.when(F.col("contaminated"), cut).otherwise(F.col(own[at])))
    return scanned.select(*own).toDF(*documents.columns)


def _without(text: str | None, starts, ends) -> str | None:
    if text is None:
        return None
    data, kept, at = text.encode(), [], 0
    for a, b in zip(starts, ends, strict=True):
        kept.append(data[at:a])
        at = b
    return b"".join([*kept, data[at:]]).decode()


def _without_many(text, starts, ends):
    import pandas as pd

    return pd.Series([_without(*x) for x in zip(text, starts, ends, strict=True)], dtype=object)


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT row_number() OVER () AS j, CAST(item_id AS VARCHAR) AS i,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT j, i, len(w[p : p + 9]) AS n, w[p : p + 9] AS g
       FROM (SELECT j, i, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS p FROM b WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT k, n, p, w[p : p + n - 1] AS g
       FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT dw.k, dw.p, dw.n, bw.j, bw.i FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g),
words AS (SELECT k, count(DISTINCT q) AS n_hit FROM (SELECT k, unnest(range(p, p + n)) AS q FROM hits) GROUP BY k),
items AS (SELECT k, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS listed
          FROM (SELECT DISTINCT k, j, i FROM hits) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (k) LEFT JOIN items USING (k)
"""


@register("op9_decontamination", SQL)
def op9_decontamination(spark, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
