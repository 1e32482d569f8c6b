import random
import re

import numpy as np

from tabwright.llm import neardup
from tabwright.llm.components import components
from tabwright.llm.neardup import near_duplicates, signature, without_near_duplicates

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


class Sets:
    def __init__(self):
        self.up = {}

    def find(self, x):
        while self.up.setdefault(x, x) != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def brute(rows, t=0.8):
    shingles = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(FOLD))
        shingles.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    sets = Sets()
    for i in range(len(rows)):
        for j in range(i):
            a, b = shingles[i], shingles[j]
            if (a and b and len(a & b) >= t * len(a | b)) or (not a and not b and rows[i][1] and rows[i][1] == rows[j][1]):
                sets.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = sets.find(i)
        least[r] = min((x for x in (least.get(r), d) if x is not None), default=None)
    return sorted(((d, least[sets.find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def found(df):
    return sorted((tuple(r) for r in near_duplicates(df).collect()), key=repr)


def test_classes_against_all_pairs(prose, messy, empty):
    for df in (prose, messy):
        assert found(df) == brute([(r["doc_id"], r["text"]) for r in df.collect()])
    assert found(empty) == []
    kept = sorted(r["doc_id"] for r in without_near_duplicates(prose).collect())
    assert kept == sorted({c for _, c in brute([(r["doc_id"], r["text"]) for r in prose.collect()])})
    rest = without_near_duplicates(messy)
    assert rest.columns == messy.columns
    assert sorted(r["doc_id"] for r in rest.collect() if r["doc_id"]) == [1, 3, 4, 5, 6, 9, 10, 11]


def test_a_family_whose_copies_are_alike_only_through_the_original(llm):
    rng = random.Random(2)
    base = [f"w{rng.randrange(10**6)}" for _ in range(300)]
    rows = [(0, " ".join(base))]
    for k in range(1, 60):
        own = list(base)
        for at in rng.sample(range(300), 5):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((k, " ".join(own)))
    df = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)


def test_a_crowd_that_shares_a_passage_emits_no_pairs(llm, monkeypatch):
    rng = random.Random(6)
    passage = [f"p{k}" for k in range(75)]
    rows = [(k, " ".join([*passage, *(f"w{rng.randrange(10**6)}" for _ in range(25))])) for k in range(80)]
    rows += [(100 + k, text + " more") for k, text in rows[:10]]
    verified, similar = [], neardup._similar

    def counted(pairs, *more):
        verified.append(pairs.count())
        return similar(pairs, *more)

    monkeypatch.setattr(neardup, "_similar", counted)
    df = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows) and sum(verified) <= len(rows)


def test_rows_with_one_doc_id_are_told_apart(llm):
    rng = random.Random(12)
    alone, twice, null = ([f"w{rng.randrange(10**6)}" for _ in range(120)] for _ in range(3))
    near = lambda words: " ".join([*words[:-1], "other"])
    rows = [(1, " ".join(twice), "a"), (5, near(twice), "b"), (5, " ".join(alone), "c"), (5, None, "d")]
    rows += [(None, " ".join(null), "e"), (None, near(null), "f"), (None, None, "g"), (None, "", "h")]
    kept = sorted(r["tag"] for r in without_near_duplicates(llm.createDataFrame(rows, "doc_id long, text string, tag string")).collect())
    assert [t for t in kept if t not in "ef"] == ["a", "c", "d", "g", "h"] and len(kept) == 6


def test_near_copies_of_which_one_repeats_a_passage(llm):
    rng = random.Random(9)
    rows = []
    for k in range(40):
        words = [f"w{rng.randrange(10**6)}" for _ in range(204)]
        at = rng.randrange(180)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words + words[at : at + 20] * 20))]
    df = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows) == sorted(((d, d - d % 2) for d, _ in rows), key=repr)


def test_registers_agree_with_the_probability_jaccard():
    rng = np.random.default_rng(7)
    items = np.sort(rng.integers(0, 2**63, 300).astype(np.uint64))
    x, y = rng.integers(0, 4, 300).astype(float), rng.integers(0, 4, 300).astype(float)
    both = np.flatnonzero((x > 0) & (y > 0))
    wanted = sum(1 / np.maximum(x / x[k], y / y[k]).sum() for k in both)
    a, b = (signature(items[v > 0], v[v > 0], 4096) for v in (x, y))
    assert abs((a == b).mean() - wanted) < 0.03
    assert len(set(signature(items[:1], np.array([2.0]), 64).tolist())) == 1


def test_components(llm):
    rng = random.Random(3)
    for edges in ([(rng.randrange(400), rng.randrange(400)) for _ in range(230)], [(k, k + 1) for k in range(64)], [(0, k) for k in range(1, 200)], []):
        sets = Sets()
        for a, b in edges:
            sets.join(a, b)
        got = {r["node"]: r["root"] for r in components(llm.createDataFrame(edges, "a long, b long")).collect()}
        assert got == {n: sets.find(n) for a, b in edges if a != b for n in (a, b)}
