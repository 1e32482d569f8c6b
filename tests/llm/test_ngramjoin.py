import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tabwright.llm import ngramjoin
from tabwright.llm.ngramjoin import BITMAP, bitmap, ngram_components, prefix_length, shingle_sets, tile_pairs
from tabwright.llm.tiles import cell_counts, compare, counted

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = {i: i + 32 for i in range(65, 91)}


def sets_of(texts, size=5):
    out = []
    for text in texts:
        w = WORD.findall((text or "").translate(FOLD))
        out.append(frozenset(tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))) if w else frozenset())
    return out


def brute(rows, percent=80):
    sets = sets_of([t for _, t in rows])
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(i), find(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min((x for x in (least.get(find(i)), d) if x is not None), default=None)
    return sorted(((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)), key=repr)


def found(df, **options):
    return sorted((tuple(r) for r in ngram_components(df, **options).collect()), key=repr)


@pytest.mark.parametrize("options", [{}, {"stars": 0, "tile": 8}, {"stars": 1, "tile": 3, "percent": 60}])
def test_components_against_all_pairs(prose, options):
    assert found(prose, **options) == brute([(r["doc_id"], r["text"]) for r in prose.collect()], options.get("percent", 80))


def test_odd_rows(messy, empty):
    assert found(messy) == brute([(r["doc_id"], r["text"]) for r in messy.collect()])
    assert found(empty) == []
    assert found(messy.withColumn("text", messy["text"].substr(1, 0))) == sorted(((r["doc_id"], 0, r["doc_id"]) for r in messy.collect()), key=repr)
    with pytest.raises(ValueError):
        ngram_components(messy, percent=0)


def test_texts_that_share_a_passage_are_linked_only_by_their_own_words(llm):
    rng = random.Random(4)
    passage = [f"p{k}" for k in range(60)]
    rows = [(k, " ".join([f"w{rng.randrange(10**6)}" for _ in range(30)] + passage)) for k in range(40)]
    rows += [(100 + k, " ".join([*passage, *(f"s{k}x{j}" for j in range(k % 9))])) for k in range(40)]
    assert found(llm.createDataFrame(rows, "doc_id long, text string"), stars=0, tile=7) == brute(rows)


def test_stars_pass_over_drawn_members_that_cannot_link(llm):
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    base = draw(200)
    sets = {k: np.append(base, draw(1)) for k in range(10)} | {k: draw(201) for k in range(50, 58)}
    nodes = llm.createDataFrame([(k, 201, bytearray(bitmap(s))) for k, s in sets.items()], "node long, n long, bitmap binary")
    groups = [(100, range(10)), *((200 + k, [k, *range(10)]) for k in range(50, 58))]
    members = llm.createDataFrame([(t, k, 201, k) for t, g in groups for k in g], "token long, node long, n long, root long")
    for turn in range(3):
        pairs = [tuple(r) for r in ngramjoin._star(members, nodes, turn, 80).collect()]
        assert len(pairs) == 9 and {k for p in pairs for k in p} == set(range(10))


def test_sets_that_meet_in_several_groups_are_one_pair():
    one = [{"node": k, "root": k, "n": 3, "bitmap": bitmap(np.arange(3, dtype=np.uint64))} for k in (7, 5, 9)]
    sets = pa.list_(pa.struct([("node", pa.int64()), ("root", pa.int64()), ("n", pa.int64()), ("bitmap", pa.binary())]))
    batch = pa.RecordBatch.from_arrays([pa.array([True] * 3), pa.array([one, one[:2], one[::-1]], sets), pa.array([[]] * 3, sets)], names=["same", "x", "y"])
    (made,) = compare(80)(iter([batch]))
    assert sorted(zip(*(c.to_pylist() for c in made.columns), strict=True)) == [(5, 7), (5, 9), (7, 9)]
    assert [b.num_rows for b in compare(80)(iter([batch.slice(0, 0)]))] == [0]


def test_bounds():
    rng = np.random.default_rng(1)
    universe = np.sort(rng.integers(0, 2**63, 1200).astype(np.uint64))
    sets = [np.sort(rng.choice(universe, n, replace=False)) for n in rng.integers(900, 1200, 40)]
    for i in range(40):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            apart = len(sets[i]) + len(sets[j]) - 2 * shared
            x, y = (np.frombuffer(bitmap(s), dtype=np.uint64) for s in (sets[i], sets[j]))
            assert np.bitwise_count(x ^ y).sum() <= apart and len(x) == BITMAP // 64
    tile = (
        np.arange(40), np.arange(40), np.array([len(s) for s in sets]), np.stack([np.frombuffer(bitmap(s), dtype=np.uint64) for s in sets]),
    )
    x, y = tile_pairs(tile, tile, True, 80)
    passed = set(zip(x.tolist(), y.tolist(), strict=True))
    for i in range(40):
        for j in range(i):
            shared = len(np.intersect1d(sets[i], sets[j]))
            if 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                assert (j, i) in passed
    for n in range(1, 300):
        for percent in (50, 80, 100):
            need = -(-percent * n // 100)
            assert prefix_length(n, percent) == n - need + 1


def test_sets_of_odd_texts():
    texts = ["A b  C\td\ne F", None, "", " \n ", "one two", "x " * 50, "ÄÖ b c d e", "Ab\x0bc\x0cd e f g", "tail"]
    got = {row: len(s) for row, s in shingle_sets(texts, 5)}
    assert got == {k: len(s) for k, s in enumerate(sets_of(texts)) if s}
    long = " ".join(f"w{k}" for k in range(400_000))
    assert [(r, len(s)) for r, s in shingle_sets(["a b c d e f", long, "z"], 5)] == [(0, 2), (1, 399_996), (2, 1)]


def test_frequent_shingles_stand_last(llm):
    texts = llm.createDataFrame([(f"common words of all texts {k} a{k} b{k}",) for k in range(200)], "text string")
    classes = ngramjoin.frequency_classes(texts, 5).value
    (_, found_), = shingle_sets(["common words of all texts"], 5)
    assert classes[int(found_[0] >> np.uint64(44))] == int(4 * np.log2(201)) and (classes > 0).sum() > 500


def test_counts_of_cells_tell_long_sets_apart_and_lose_no_link():
    rng = np.random.default_rng(3)
    draw = lambda n: rng.integers(0, 2**63, n).astype(np.uint64)
    rows = []
    for n in (1024, 3000, 9000, 40_000):
        one, other = draw(n), draw(n)
        near = np.concatenate((one[n // 10 :], draw(n // 9)))  # a tenth is replaced: a Jaccard similarity of 0.8 and more
        rows += [(n, one, other), (n, one, near)]
    batch = pa.RecordBatch.from_pydict(
        {
            "a": list(range(len(rows) + 1)), "b": list(range(len(rows) + 1)), "n": [len(x) for _, x, _ in rows] + [None], "m": [len(y) for _, _, y in rows] + [9000],
            "x": [cell_counts(x) for _, x, _ in rows] + [None], "y": [cell_counts(y) for _, _, y in rows] + [cell_counts(draw(9000))],
        }
    )
    (kept,) = counted(80)([batch])
    # bitmaps pass the unrelated sets of 3000 and 9000 as well
    assert kept.column("a").to_pylist() == [1, 3, 5, 6, 7, 8]
    assert all(len(np.intersect1d(x, y)) >= 0.8 * len(np.union1d(x, y)) for _, x, y in rows[1::2])


def test_components_where_all_sets_have_counts(prose, monkeypatch):
    monkeypatch.setattr(ngramjoin, "LONG", 1)
    assert found(prose) == brute([(r["doc_id"], r["text"]) for r in prose.collect()])
