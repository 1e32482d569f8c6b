import hashlib
import math
import re
import zlib

from pyspark.sql import functions as F

from tabwright.llm.resample import gains, importance_resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def features(text):
    w = WORD.findall((text or "").translate(FOLD))
    return len(w), [zlib.crc32(f.encode()) % 10000 for f in [*w, *(f"{a} {b}" for a, b in zip(w, w[1:]))]]


def brute(rows, target, share=25, least=20):
    s, t = [0] * 10000, [0] * 10000
    for texts, into in (([x for _, x in rows], s), (target, t)):
        for text in texts:
            for b in features(text)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = []
    for k, (doc_id, text) in enumerate(rows):
        n_words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([doc_id, len(found), weight, score, None, n_words >= least, k])
    order = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[2], r[1]))
    for at, r in enumerate(order[: len(order) * share // 100]):
        r[4] = at + 1
    return sorted((tuple(r[:5]) for r in out), key=repr)


def found(df, target, **options):
    got = importance_resample(df, target, **options).select("doc_id", "n_features", "weight", "score", "rank")
    return sorted((tuple(r) for r in got.collect()), key=repr)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_whole_draw_against_brute_force(llm, prose):
    target = llm.createDataFrame([("abc def " * 30,), (None,), ("",), ("The OF and, abcdefg!",)], "text string")
    assert found(prose, target) == brute(rows_of(prose), [r["text"] for r in target.collect()])


def test_odd_rows(llm, messy, empty):
    target = llm.createDataFrame([("Alpha BETA",), ("straße",)], "text string")
    assert found(messy, target, least_words=1, share=60) == brute(rows_of(messy), ["Alpha BETA", "straße"], 60, 1)
    assert found(empty, target) == [] == found(empty, target.where("false"))
    assert found(messy, target.where("false")) == brute(rows_of(messy), [])
    null = messy.withColumn("text", F.lit(None).cast("string"))
    assert all(r[1:3] == (0, 0) and r[4] is None for r in found(null, target))


def test_ties_go_to_the_smaller_id_and_repeated_rows_count_each(llm):
    text = " ".join(f"w{k}" for k in range(25))
    rows = [(k % 5, text) for k in range(40)]
    df = llm.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df, df.select("text")) == brute(rows, [text] * 40)
    assert sorted(r[4] for r in found(df, df.select("text"), share=100)) == list(range(1, 41))


def test_documents_like_the_target_are_drawn(llm, prose):
    """A corpus of two kinds: the draw holds mostly the kind that the target is made of."""
    kinds = prose.select(F.col("doc_id"), F.translate("text", "abcdefgh", "ijklmnop").alias("other"), "text")
    both = kinds.select("doc_id", "text").unionAll(kinds.select(F.col("doc_id") + 1000, "other"))
    drawn = importance_resample(both, kinds.select(F.col("other").alias("text")).where("doc_id % 3 = 0"))
    shares = {r["kind"]: r["count"] for r in drawn.where("rank is not null").groupBy((F.col("doc_id") >= 1000).alias("kind")).count().collect()}
    assert shares[True] > 3 * shares.get(False, 0)


def test_gains():
    import numpy as np

    got = gains(np.array([5, 0, 2]), np.array([0, 7, 1]))
    assert got.tolist() == [math.floor(1000 * math.log(x)) for x in (1 * 10 / (6 * 11), 8 * 10 / (1 * 11), 2 * 10 / (3 * 11))]
