import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm import phrases
from tabwright.llm.grains import Bits
from tabwright.llm.phrases import collocations, frequent_phrases

FOLD = {i: i + 32 for i in range(65, 91)}


def counts(rows, longest=4):
    out = Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        out[lang, 0, ""] += 0
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            out[lang, 0, ""] += len(w)
            for n in range(1, longest + 1):
                for k in range(len(w) - n + 1):
                    out[lang, n, " ".join(w[k : k + n])] += 1
    return out


def brute(rows, least=30, longest=4, top=2000, inside=80):
    f = counts(rows, longest)
    cand = {(lang, p): c for (lang, n, p), c in f.items() if n >= 2 and c >= least}
    out = {}
    for (lang, p), a in cand.items():
        w = p.split(" ")
        if any(100 * c >= inside * a for (l2, q), c in cand.items() if l2 == lang and len(q.split(" ")) > len(w) and f" {p} " in f" {q} "):
            continue
        best = min((2000000 * a // (f[lang, k, " ".join(w[:k])] + f[lang, len(w) - k, " ".join(w[k:])]), k) for k in range(1, len(w)))
        k = best[1]
        out.setdefault(lang, []).append((-best[0], -a, p.encode(), p, f[lang, k, " ".join(w[:k])], f[lang, len(w) - k, " ".join(w[k:])]))
    return sorted(
        (lang, at + 1, x[3], -x[1], x[4], x[5], f[lang, 0, ""], -x[0]) for lang, found in out.items() for at, x in enumerate(sorted(found)[:top])
    )


def got(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).collect())


@pytest.fixture(scope="module")
def texts(llm):
    rng = random.Random(11)
    vocabulary = [f"w{k}" for k in range(60)]
    fixed = [["new", "York", "city", "hall"], ["de", "facto"], ["a", "b", "c"]]
    rows = []
    for k in range(400):
        words = []
        for _ in range(rng.randint(0, 30)):
            words += rng.choice(fixed) if rng.random() < 0.25 else [rng.choice(vocabulary[: rng.randint(1, 60)])]
            if rng.random() < 0.2:
                words[-1] += rng.choice([".", ", ", "\n", "!?", " \t "])
        rows.append((k, rng.choice(["en", "en", "de", None, "und"]), " ".join(words)))
    return llm.createDataFrame(rows, "doc_id long, lang string, text string").repartition(3)


def rows_of(df):
    return [(r["lang"], r["text"]) for r in df.select("lang", "text").collect()]


@pytest.mark.parametrize("options", [{}, {"least": 5}, {"least": 5, "longest": 3, "top": 7}, {"least": 3, "longest": 2}, {"least": 40, "inside": 20}])
def test_collocations_against_brute_force(texts, options):
    assert got(texts, **options) == brute(rows_of(texts), **options)


@pytest.mark.parametrize("sample", [1, 3, 50, 10**6])
def test_counts_are_exact_whatever_the_sample_misses(texts, sample):
    """A sample of nothing proposes nothing: every phrase longer than a word is then a border failure."""
    f = counts(rows_of(texts))
    wanted = sorted((lang, n, p, c) for (lang, n, p), c in f.items() if n == 0 or c >= 6)
    assert sorted(tuple(r) for r in frequent_phrases(texts, least=6, sample=sample).collect()) == wanted


def test_odd_rows(messy, empty):
    assert got(empty) == []
    rows = [(r["lang"], r["text"]) for r in messy.select("lang", "text").collect()]
    assert got(messy, least=2) == brute(rows, least=2)
    assert got(messy.withColumn("text", F.lit(None).cast("string"))) == []
    assert got(messy.withColumn("lang", F.lit(None).cast("string")), least=2) == brute([(None, t) for _, t in rows], least=2)
    with pytest.raises(ValueError):
        frequent_phrases(messy, longest=1)


def test_ties_follow_the_bytes_of_the_phrase(llm):
    rows = [("en", f"{x} {y}.") for x, y in (("b", "x"), ("ä", "x"), ("a", "x"), ("z", "x")) for _ in range(30)]
    found = got(llm.createDataFrame(rows, "lang string, text string"), top=3)
    assert [r[2] for r in found] == ["a x", "b x", "z x"] and found == brute(rows, top=3)


def test_bits_miss_no_key(llm):
    rng = np.random.default_rng(5)
    keys = rng.integers(-(2**63), 2**63, 5000)
    bits = Bits(llm.createDataFrame([(int(k),) for k in keys], "h long"))
    assert bits.has(keys.view(np.uint64)).all()
    assert bits.has(rng.integers(0, 2**63, 20_000).astype(np.uint64)).mean() < 0.1
    assert not Bits(llm.createDataFrame([], "h long")).has(keys.view(np.uint64)).any()


def test_many_hashes_are_given_out_in_parts(texts, monkeypatch):
    tally = phrases.Tally()
    h = np.array([5, 5, 9, 5, 9], dtype=np.uint64)
    g = np.array([1, 2, 1, 1, 1], dtype=np.uint32)
    tally.add(2, h, g)
    rows = [r for b in tally.rows() for r in zip(*(c.to_pylist() for c in b.columns))]
    assert sorted(rows)[-1] == (2, 9, 1, 2) and sum(r[3] for r in rows) == 5


def test_length_and_second_hash_travel_as_one_number(llm):
    from tabwright.llm.phrases import _packed, _unpacked

    rows = [(n, h, g, 1) for n in (0, 1, 4) for h in (-(2**63), 7) for g in (-(2**31), -1, 0, 2**31 - 1)]
    packed = _packed(llm.createDataFrame(rows, "n byte, h long, g int, c long"))
    assert packed.columns == ["h", "c", "k"]
    assert sorted(tuple(r) for r in _unpacked(packed).select("n", "h", "g", "c").collect()) == sorted(rows)


def test_tasks_do_not_spell_what_the_sample_has_spelt(llm, monkeypatch):
    spelt = []
    packed = phrases._packed
    monkeypatch.setattr(phrases, "_packed", lambda df: (spelt.append(df.where("n > 0").count()) if "phrase" in df.columns else None, packed(df))[1])
    rows = [("en", f"alpha beta gamma delta epsilon. k{k}") for k in range(512)]
    df = llm.createDataFrame(rows, "lang string, text string").repartition(32)
    f = counts(rows)
    wanted = sorted((lang, n, p, c) for (lang, n, p), c in f.items() if n == 0 or c >= 30)
    assert sorted(tuple(r) for r in frequent_phrases(df, least=30, sample=64).collect()) == wanted
    assert len(wanted) == 15 and sum(spelt) < 250  # 14 phrases in each of 32 tasks before
