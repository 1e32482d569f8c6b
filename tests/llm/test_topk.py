import math

import numpy as np
import pytest

from tabwright.llm.topk import Best, Tree, search, top_k


def brute(rows, every, k):
    kept = []
    for i, v in rows:
        if i is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept.append((i, [math.floor(256 * float(x)) for x in v]))
    out = []
    for q, a in kept:
        if q % every == 0:
            scored = [(-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in kept if i != q]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(df, every, k):
    return sorted(tuple(r) for r in top_k(df, every, k).collect())


def test_clusters_ties_and_values_that_take_no_part(llm):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] + 0.05 * rng.normal(size=8)).astype(np.float32).tolist()) for i in range(900)]
    rows += [(i, [0.5] * 8) for i in range(900, 1200)]  # a quarter of all rows is one vector
    rows += [(1201, None), (1202, [None] * 8), (1203, [float("nan")] * 8), (1204, [float("inf")] * 8), (None, [1.0] * 8), (1205, [9.0, 9.0]), (1210, [])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "'x' as cell", "1 as label").repartition(5)
    assert found(df, 50, 5) == brute(rows, 50, 5)
    few = [r for r in rows if r[0] is not None and r[0] < 3]
    assert found(df.where("vec_id < 3"), 1, 5) == brute(few, 1, 5)
    assert found(df.where("false"), 50, 5) == []


def test_values_beyond_exact_doubles(llm):
    rows = [(i, [float(2**18 + i), -float(2**16) * i]) for i in range(60)]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 10, 4) == brute(rows, 10, 4)


def test_pruning_skips_far_nodes():
    rng = np.random.default_rng(1)
    far = np.repeat(rng.normal(size=(20, 16)) * 1000, 200, axis=0) + rng.normal(size=(4000, 16))
    data, queries = Tree(np.arange(4000), far.astype(np.int32)), Tree(np.arange(40), far[:4000:100].astype(np.int32), 2)
    best = Best(40, 5, np.full(40, -(1 << 63)))
    visits = []
    add = best.add
    best.add = lambda a, b, s, i: (visits.append(s.size), add(a, b, s, i))
    search(queries.ready(16), data.ready(16), best)
    assert sum(visits) < 0.5 * 40 * 4000


def test_large_components_take_part(llm):
    rows = [(0, [1.0, 1.0]), (1, [2.0, 1.0]), (2, [float(2**24), 0.0]), (3, [-float(2**22), 5.0]), (4, [0.25, -float(2**20)])]
    df = llm.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, 1, 5) == brute(rows, 1, 5)
    for v in ([float(2**56)], [float(2**40)]):  # a component, then a score beyond 64 bits
        with pytest.raises(Exception, match="64-bit"):
            found(llm.createDataFrame([(0, v), (1, v)], "vec_id long, embedding array<double>"), 1, 5)
