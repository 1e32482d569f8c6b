import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.llm.lines import line_classes, without_repeated_lines

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def brute(rows, t=0.8):
    """{(doc_id, line): (class, links, removed)} by comparing every pair of different sets."""
    lines = [(d, k, frozenset(WORD.findall(x.translate(FOLD)))) for d, text in rows if text is not None for k, x in enumerate(text.split("\n"))]
    order = lambda d, k: (d is not None, d or 0, k)
    first = {}
    for d, k, s in sorted(lines, key=lambda r: order(*r[:2])):
        if s:
            first.setdefault(s, (d, k))
    sets = list(first)
    links = {s: [] for s in sets}
    for i, a in enumerate(sets):
        for b in sets[:i]:
            both = len(a & b)
            if both >= t * (len(a) + len(b) - both) - 1e-9:
                links[a].append(b)
                links[b].append(a)
    out = []
    for d, k, s in lines:
        if not s:
            out.append((d, k, None, None, 0, False))
        else:
            early = any(order(*first[x]) < order(*first[s]) for x in links[s])
            out.append((d, k, *first[s], len(links[s]), order(d, k) > order(*first[s]) or early))
    return sorted(out, key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in line_classes(df, **options).collect()), key=repr)


@pytest.mark.parametrize("hot,block", [(512, 384), (4, 3)])
def test_against_all_pairs(prose, hot, block):
    rows = [(r["doc_id"], r["text"]) for r in prose.collect()]
    wanted = brute(rows)
    assert sum(r[4] > 0 for r in wanted) > 50
    assert found(prose, hot=hot, block=block) == wanted


def test_odd_rows(messy, empty):
    rows = [(r["doc_id"], r["text"]) for r in messy.collect()]
    assert found(messy) == brute(rows)
    assert found(empty) == []
    assert without_repeated_lines(empty).columns == empty.columns


def test_texts_lose_later_lines(llm):
    df = llm.createDataFrame(
        [(1, "a b c d e\nfirst", 15), (2, "new\nA, b c d e!\nfirst\n", 22), (3, None, None), (4, "", 0)], "doc_id long, text string, n_chars long"
    ).selectExpr("'x' as line", "*", "'y' as removed")
    rows = {r["doc_id"]: (r["text"], r["n_chars"], r["line"], r["removed"]) for r in without_repeated_lines(df).collect()}
    assert rows == {1: ("a b c d e\nfirst", 15, "x", "y"), 2: ("new\n", 4, "x", "y"), 3: (None, None, "x", "y"), 4: ("", 0, "x", "y")}


def test_rows_with_one_doc_id_lose_their_own_lines_only(llm):
    rows = [(1, "common line of some words\nfirst"), (2, "intro of two\nfirst"), (2, "another start here\nunique words stay")]
    rows += [(None, "null one begins\nsecond of null one"), (None, "quite other text\nnull one begins"), (None, None)]
    kept = {(r["doc_id"], r["text"]) for r in without_repeated_lines(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    # nulls come first: each of the null rows has number 0 or 1 for the shared line, the later number goes
    assert kept == {*rows[:1], (2, "intro of two"), rows[2], rows[3], (None, "quite other text"), (None, None)}


def test_long_lines_with_some_common_words_are_no_candidates(llm, monkeypatch):
    """Of 60 lines of 100 words that share three quarters with others, only near copies reach the comparison of full sets."""
    from tabwright.llm import lines

    rng = random.Random(3)
    common, often = [f"common{k}" for k in range(50)], [f"often{k}" for k in range(90)]
    rows = []
    for k in range(60):
        rows.append((k, " ".join(rng.sample(common + rng.sample(often, 45) + [f"group{k % 6}x{j}" for j in range(5)], 100))))
    rows += [(100 + k, " ".join([*rows[k][1].split(" ")[5:], "changed"])) for k in range(10)]
    met = []
    stored = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: (met.append(df.count()) if name == "line-pairs" else None, stored(df, name))[1])
    df = llm.createDataFrame(rows, "doc_id long, text string")
    assert found(df) == brute(rows)
    assert 10 <= met[0] <= 20  # 10 links; maps that words do not toggle let 2,241 pairs pass


def test_near_copies_of_all_lengths(llm):
    """Lines on both sides of the width of their maps, one to eleven words of a hundred changed, in texts that are coded together."""
    rng = random.Random(4)
    rows = []
    for k, size in enumerate([1, 4, 5, 20, 64, 71, 72, 73, 80, 100, 150, 400]):
        line = [f"w{k}x{j}" for j in range(size)]
        for j in range(8):
            gone = rng.sample(range(size), size * j * 2 // 100 + (j % 2 and size > 4))
            rows.append((100 * k + j, "\n".join([" ".join(w for i, w in enumerate(line) if i not in gone), "", f"end of{k % 3}"])))
    wanted = brute(rows)
    assert sum(r[4] > 0 for r in wanted) > 60
    assert found(llm.createDataFrame(rows, "doc_id long, text string").coalesce(1)) == wanted


def test_order_by_line_and_code_where_upper_bits_do_not_settle_it():
    from tabwright.llm.lines import _by_line

    line = np.repeat(np.arange(3000), 2)
    code = (np.arange(6000, dtype=np.uint64) * np.uint64(7919)) % np.uint64(4096)
    assert (_by_line(line, code, 3000) == np.lexsort((code, line))).all()


def test_bit_sets_are_held_packed(llm):
    from tabwright.llm.common import BITS, bit_set, spot, spot_of, taken

    df = llm.range(0, 3000, 3).select(spot(F.col("id")).alias("s"))
    held = bit_set(df).value
    assert len(held) == 1 << (BITS - 3)
    wanted = {r["s"] for r in df.collect()}
    assert all(taken(held, spot_of(k)) == (spot_of(k) in wanted) for k in range(3000))


def test_words_of_many_lines_move_the_sets_that_are_alike_only(llm, monkeypatch):
    """Of 400 lines that share their rarest word, only near copies are compared by their full sets."""
    from tabwright.llm import lines

    rng = random.Random(8)
    often = [f"often{k}" for k in range(300)]
    rows = [(k, " ".join(["hub", *rng.sample(often, 24)])) for k in range(400)]
    rows += [(1000 + k, rows[k][1] + " changed") for k in range(8)]
    rows += [(2000 + k, " ".join(often)) for k in range(1000)]  # so that `hub` is the rarest word
    full = []
    stored = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: (full.append(df.count()) if name == "line-sets" else None, stored(df, name))[1])
    assert found(llm.createDataFrame(rows, "doc_id long, text string"), hot=64) == brute(rows)
    assert 16 <= full[0] <= 40  # all 408 when the sets of a frequent word moved with each pair of its blocks


@pytest.mark.parametrize("hot,block", [(512, 384), (4, 3)])
def test_words_dealt_into_parts(prose, monkeypatch, hot, block):
    from tabwright.llm import lines

    monkeypatch.setattr(lines, "TILE", 5)
    assert found(prose, hot=hot, block=block) == brute([(r["doc_id"], r["text"]) for r in prose.collect()])


def test_texts_with_a_word_of_many_lines_move_the_sets_that_are_alike_only(llm, monkeypatch):
    """As above for the step of the pipeline: its rows lose their later near copies."""
    from tabwright.llm import lines

    rng = random.Random(9)
    often = [f"often{k}" for k in range(300)]
    rows = [(k, " ".join(["hub", *rng.sample(often, 24)])) for k in range(200)]
    rows += [(1000 + k, "intro\n" + rows[k][1] + " changed") for k in range(6)]
    rows += [(2000 + k, " ".join(often)) for k in range(600)]
    full = []
    stored = lines.stored
    monkeypatch.setattr(lines, "stored", lambda df, name: (full.append(df.count()) if name == "line-sets" else None, stored(df, name))[1])
    kept = {r["doc_id"]: r["text"] for r in without_repeated_lines(llm.createDataFrame(rows, "doc_id long, text string"), hot=64).collect()}
    gone = {(d, k) for d, k, *_, removed in brute(rows) if removed}
    assert kept == {d: "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in rows}
    assert len(gone) >= 605 and 12 <= full[0] <= 40
