import math
import random
import re
import zlib
from collections import Counter

import pytest

from tabwright.llm.toxicity import fit, maximal_segments, score, without_toxic


def slow(scores, first=0):
    """The definition: the best segment, then the best ones left and right of it."""
    best = None
    for a in range(len(scores)):
        for b in range(a + 1, len(scores) + 1):
            s = sum(scores[a:b])
            if s > 0 and (best is None or s > best[0]):
                best = (s, a, b)
    if best is None:
        return []
    s, a, b = best
    return [*slow(scores[:a], first), (first + a, first + b, s), *slow(scores[b:], first + b)]


def test_maximal_segments_follow_their_definition():
    rng = random.Random(4)
    for _ in range(300):
        scores = [rng.choice([-1.0, -1.0, -1.0, rng.uniform(0.1, 5)]) for _ in range(rng.randint(0, 14))]
        where = [k for k, s in enumerate(scores) if s > 0]
        got = maximal_segments(where, [scores[k] for k in where], -1.0)
        assert [(a, b, round(s, 6)) for a, b, s in got] == [(a, b, round(s, 6)) for a, b, s in slow(scores)]


def corpus(llm, n=600):
    rng = random.Random(1)
    words = ["".join(rng.choice("aeioumnrst") for _ in range(6)) for _ in range(400)]
    bad = ["vilest", "rotten", "foulmouth"]
    rows, labels = [], []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(5):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", "s", "ed"]))
        rows.append((i, " ".join(text)))
        labels.append((i, int(toxic)))
    return llm.createDataFrame(rows, "doc_id long, text string"), llm.createDataFrame(labels, "doc_id long, toxic int"), dict(labels)


def test_held_out_rows_are_told_apart(llm):
    docs, labels, truth = corpus(llm)
    rows = score(docs, fit(docs, labels)).collect()
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0]
    assert len(held) > 60
    assert sum(r["predicted"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    hit = next(r for r in rows if r["predicted"])
    words = hit["text"].split()
    assert any(w.startswith(("vil", "rot", "foul")) for a, b in zip(hit["seg_from"], hit["seg_to"], strict=True) for w in words[a:b])
    kept = {r["doc_id"] for r in without_toxic(docs.selectExpr("doc_id", "text", "'a' as score"), labels).collect()}
    assert kept == {r["doc_id"] for r in rows if not r["predicted"]}


def test_held_out_labels_are_never_used(llm):
    docs, labels, _ = corpus(llm, 300)
    wrong = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, 1 - toxic, toxic) as toxic")
    a, b = fit(docs, labels), fit(docs, wrong)
    assert a.values.tolist() == b.values.tolist() and (a.slope, a.intercept, a.k) == (b.slope, b.intercept, b.k)


def test_every_form_that_passes_counts(llm):
    # 12 toxic and 100 clean texts of 60,000 words each, all of them equally telling
    words = "concat_ws(' ', transform(sequence(0, 59999), k -> concat(lower(hex(k)), {}))) as text"
    docs = llm.range(112, numPartitions=3).selectExpr("id as doc_id", words.format("if(id < 12, 'q', 'z')"), "cast(id < 12 as int) as toxic")
    docs = docs.selectExpr("doc_id", "concat(text, ' t', doc_id) as text", "toxic")
    model = fit(docs.select("doc_id", "text"), docs.select("doc_id", "toxic"))
    assert len(model.hashes) >= 60_000
    assert len(model.found(" ".join(f"{k:x}q" for k in range(60_000)))[1]) == 60_000


def test_parts_of_the_table_change_nothing(llm):
    docs, labels, _ = corpus(llm, 300)
    whole, cut = fit(docs, labels), fit(docs, labels, part=3)
    assert len(cut.parts()) > 2 and whole.hashes.tolist() == cut.hashes.tolist()
    assert (whole.other, whole.lam, whole.k, whole.slope) == (cut.other, cut.lam, cut.k, cut.slope)
    a, b = (sorted(tuple(r) for r in score(docs, m).select("doc_id", "score", "seg_from", "seg_score").collect()) for m in (whole, cut))
    assert a == b


def test_odd_rows(llm, messy, empty):
    docs, labels, _ = corpus(llm, 300)
    model = fit(docs, labels.selectExpr("doc_id", "if(doc_id % 10 = 3, null, toxic) as toxic", "1 as text"))
    rows = score(messy, model).collect()
    assert len(rows) == messy.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert {r["n_tokens"] for r in rows if not r["text"]} == {0}
    assert score(empty, model).count() == 0
    none = labels.where("false")
    assert [r["predicted"] for r in score(docs.limit(3), fit(docs, none)).collect()] == [0, 0, 0]
    assert without_toxic(empty, none).columns == empty.columns


def test_repeated_rows_teach_once(llm):
    docs, labels, _ = corpus(llm, 300)
    more = docs.unionAll(docs.where("doc_id % 3 = 1")).unionAll(docs.where("doc_id = 6").selectExpr("doc_id + 1000", "text"))
    # a second text under a labelled id is a witness of its own, and the first stays one
    other = more.unionAll(llm.createDataFrame([(12, "quite another text")], "doc_id long, text string"))
    a, b, c = fit(docs, labels), fit(more, labels), fit(other, labels)
    assert a.hashes.tolist() == b.hashes.tolist() and set(a.hashes.tolist()) <= set(c.hashes.tolist())


def brute_forms(text):
    """Distinct forms of a text: its words and their first 4 to 9 bytes where they are longer."""
    found = set()
    for w in re.findall(rb"[0-9a-z\x80-\xff]+", text.lower().encode()):
        found.add((0, w))
        found |= {(n, w[:n]) for n in range(4, 10) if len(w) > n}
    return found


def test_log_odds_against_brute_force(llm):
    """The values of the kept forms: Dirichlet prior, log-odds and their standard error, text by text."""
    docs, labels, truth = corpus(llm, 240)
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5}
    counts = [Counter(), Counter()]
    for i, text in texts.items():
        counts[truth[i]].update(brute_forms(text))
    forms = counts[0].keys() | counts[1].keys()
    n0, n1, v, floor = sum(counts[0].values()), sum(counts[1].values()), len(forms), 0.5
    wanted = []
    for f in forms:
        y0, y1 = counts[0][f], counts[1][f]
        a = floor + v * (y1 + y0) / ((n1 + n0) * 100)
        total = floor * v + v / 100
        odds = math.log((y1 + a) / (n1 + total - y1 - a)) - math.log((y0 + a) / (n0 + total - y0 - a))
        if odds / math.sqrt(1 / (y1 + a) + 1 / (y0 + a)) >= 3.3:
            wanted.append(odds)
    got = fit(docs, labels).values.tolist()
    assert len(wanted) > 5 and sorted(got) == pytest.approx(sorted(wanted), rel=1e-9)
