import random

import pytest

from tabwright.operators.clustering import dbscan, offsets, train_dbscan
from tabwright.operators.graph import connected


def brute(rows, eps, min_points):
    """{row number: cluster} with clusters numbered by their smallest core point."""
    near = [[j for j, q in enumerate(rows) if sum((a - b) * (a - b) for a, b in zip(p, q)) <= eps * eps] for p in rows]
    core = [i for i in range(len(rows)) if len(near[i]) >= min_points]
    root = {}
    for i in core:
        if i in root:
            continue
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in root:
                root[k] = i
                todo += [j for j in near[k] if len(near[j]) >= min_points]
    least = sorted({r: min(rows[i] for i in core if root[i] == r) for r in root.values()}.items(), key=lambda x: x[1])
    number = {r: k for k, (r, _) in enumerate(least)}
    return [number[root[i]] if i in root else min((number[root[j]] for j in near[i] if j in root), default=-1) for i in range(len(rows))]


def found(df, columns, *args, **options):
    return [r["cluster"] for r in dbscan(df, columns, *args, **options).orderBy("i").collect()]


def cloud(seed, width, n):
    rng = random.Random(seed)
    centres = [[rng.uniform(-6, 6) for _ in range(width)] for _ in range(4)]
    out = []
    for k in range(n):
        c = rng.choice(centres)
        out.append(tuple(rng.gauss(m, 0.6) for m in c) if k % 4 else tuple(rng.uniform(-8, 8) for _ in range(width)))
        if k % 5 == 0:
            out.append(out[-1])
    return out


@pytest.mark.parametrize(("width", "eps", "min_points"), [(1, 0.05, 3), (2, 0.4, 5), (2, 1.0, 12), (3, 0.9, 6)])
def test_clusters_against_all_pairs(spark, width, eps, min_points):
    rows = cloud(width, width, 260)
    columns = [f"x{j}" for j in range(width)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {', '.join(f'{c} double' for c in columns)}")
    assert found(df, columns, eps, min_points, cell=8) == brute(rows, eps, min_points)


def test_a_dense_cell_is_one_node_cut_into_blocks(spark):
    """Two crowded cells that touch only by an inner pair, a crowd of copies, and a border row between clusters."""
    rng = random.Random(2)
    rows = [(rng.uniform(0, 0.5), rng.uniform(0, 0.5)) for _ in range(400)] + [(rng.uniform(1.3, 1.8), rng.uniform(0, 0.5)) for _ in range(400)]
    rows += [(5.0, 5.0)] * 300 + [(5.9, 5.0), (0.9, 0.25), (9.0, 9.0)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, x double, y double")
    for eps in (0.81, 0.95, 1.0):
        assert found(df, ["x", "y"], eps, 20, cell=32) == brute(rows, eps, 20)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1, 1.0, None), (2, float("nan"), 1.0), (3, 1.0, 1.0)], "i int, x double, y double")
    assert found(df, ["x", "y"], 1.0, 1) == [None, None, 0] and found(df, ["x", "y"], 1.0, 2) == [None, None, -1]
    assert found(df.where("false"), ["x", "y"], 1.0) == []
    for bad in (([], 1.0), (["x"], 0.0), (["x"] * 9, 1.0)):
        with pytest.raises(ValueError):
            dbscan(df, *bad)


def test_table_is_filled_and_scaled(spark):
    df = spark.range(60).selectExpr("cast(id as int) i", "case when id = 7 then null when id < 30 then 1000.0D else 9000.0D + id end x", "id % 2 as y")
    got = {r["i"]: (r["cluster"], r["x"]) for r in train_dbscan(df, ["x"], 0.2).collect()}
    assert got[0][0] == got[29][0] != got[40][0] and got[7][1] is None


def test_every_cell_that_can_be_near_is_looked_at():
    rng = random.Random(1)
    for width in (1, 2, 3, 4):
        steps = {tuple(s) for s in offsets(width)}
        side = width**-0.5
        for _ in range(3000):
            p = [rng.uniform(0, 1) for _ in range(width)]
            d = [rng.gauss(0, 1) for _ in range(width)]
            size = rng.uniform(0, 1) / max(sum(v * v for v in d) ** 0.5, 1e-9)
            q = [a + b * size for a, b in zip(p, d)]
            step = tuple(int(b // side) - int(a // side) for a, b in zip(p, q))
            assert step in steps or not any(step)


def test_components(spark):
    rng = random.Random(3)
    for links in ([(rng.randrange(200), rng.randrange(200)) for _ in range(130)], [(k, k + 1) for k in range(70)], [(0, k) for k in range(1, 90)], []):
        up = {}

        def find(x):
            while up.setdefault(x, x) != x:
                x = up[x]
            return x

        for a, b in links:
            a, b = find(a), find(b)
            up[max(a, b)] = min(a, b)
        got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "a long, b long")).collect()}
        assert got == {n: find(n) for a, b in links if a != b for n in (a, b)}
