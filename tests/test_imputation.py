import random

import numpy as np
import pytest

from tabwright.operators import neighbors
from tabwright.operators.imputation import fit_iterative, iterative_impute, knn_impute
from tabwright.operators.oversampling import oversample_smote
from tabwright.operators.steps import apply_step

SHAPE = "id long, a double, b double, c double"


@pytest.fixture(scope="module")
def holes(spark):
    """600 rows, a third of them equal but for their gaps; `c` has many ties."""
    rng = random.Random(3)
    rows = []
    for i in range(600):
        a = rng.gauss(0, 3)
        row = [1.0, 2.0, 3.0] if i % 3 == 0 else [a, a * 2 + rng.gauss(0, 1), float(rng.randint(0, 6))]
        rows.append((i, *[None if rng.random() < 0.2 else v for v in row]))
    return rows, spark.createDataFrame(rows, SHAPE)


def brute_knn(rows, k):
    order = lambda x: tuple((v is not None, v or 0) for v in x)
    out = {}
    for i, *x in rows:
        out[i] = list(x)
        for j in (j for j in range(3) if x[j] is None):
            found = []
            for _, *y in rows:
                shared = [m for m in range(3) if x[m] is not None and y[m] is not None]
                if y[j] is not None and shared:
                    near = 0.0
                    for m in shared:
                        near += (x[m] - y[m]) ** 2
                    found.append((near * 3 / len(shared), order(y), y[j]))
            has = [y[j] for _, *y in rows if y[j] is not None]
            out[i][j] = np.mean([f[2] for f in sorted(found)[:k]]) if found else np.mean(has) if has else None
    return out


def filled(df):
    return {r["id"]: [r["a"], r["b"], r["c"]] for r in df.collect()}


@pytest.mark.parametrize(("k", "cell"), [(5, 16), (1, 2048), (40, 7)])
def test_knn_against_all_pairs(holes, k, cell):
    rows, df = holes
    got, want = filled(knn_impute(df, ["a", "b", "c"], k, cell)), brute_knn(rows, k)
    assert got.keys() == want.keys()
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9), rows[i]


def test_knn_of_odd_tables(spark):
    rows = [(1, None, None, None), (2, 5.0, None, None), (3, None, 7.0, None), (4, float("nan"), 9.0, None)]
    got = filled(knn_impute(spark.createDataFrame(rows, SHAPE), ["a", "b", "c"]))
    assert got == {1: [5.0, 8.0, None], 2: [5.0, 8.0, None], 3: [5.0, 7.0, None], 4: [5.0, 9.0, None]}
    assert filled(knn_impute(spark.createDataFrame([], SHAPE), ["a", "b", "c"])) == {}
    whole = spark.createDataFrame([(1, 1, 2.0, 3.0)], "id long, a int, b double, c double")
    assert filled(knn_impute(whole, ["a", "b"])) == {1: [1.0, 2.0, 3.0]}
    with pytest.raises(ValueError):
        knn_impute(whole.withColumn("s", whole["a"].cast("string")), ["s"])


def test_a_hot_cell_is_cut_into_blocks(spark):
    """Splits see a sample; a cell that holds far more rows than planned is still met block by block."""
    points = spark.range(900).selectExpr("id", "'' as label", "array(double(id % 30), double(id div 30)) as x", "1L as n")
    placed = points.selectExpr("*", "'11|' as part", "0L as cell")
    boxes = neighbors.Boxes.of(placed, 2)
    blocks = neighbors._blocks(placed, boxes, 50, "d").collect()
    assert boxes.rows.tolist() == [900] and len(blocks) >= 12
    assert sum(len(b["d"]) for b in blocks) == 900 and max(len(b["d"]) for b in blocks) < 120


def test_box_bounds_hold():
    rng = np.random.default_rng(8)
    a, b = rng.normal(size=(50, 4)), rng.normal(2, 1, size=(60, 4))
    boxes = neighbors.Boxes(np.array([0]), np.array(["x"]), b.min(axis=0)[None], b.max(axis=0)[None], np.array([60]), np.array([60]))
    for q in a:
        least = ((q - b) ** 2).sum(axis=1).min()
        assert boxes.gap(q, q)[0] <= least + 1e-12
    q = np.array([0.0, np.nan, 1.0, np.nan])
    least = ((q - b)[:, [0, 2]] ** 2).sum(axis=1).min() * 2
    assert boxes.gap(q, q)[0] <= least + 1e-12 and boxes.gap(np.full(4, np.nan), np.full(4, np.nan))[0] == np.inf


def test_chained_regressions_converge_to_the_plane(spark):
    """On a noiseless plane the true values come back, and a fitted step fills new rows and streams of batches alike."""
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(500):
        a, b = rng.uniform(-5, 5), rng.uniform(-5, 5)
        row = [a, b, 3 * a - 2 * b + 7]
        truth[i] = list(row)
        if i % 4 == 1:
            row[rng.randrange(3)] = None
        rows.append((i, *row))
    df = spark.createDataFrame(rows, SHAPE).repartition(3)
    for i, got in filled(iterative_impute(df, ["a", "b", "c"], rounds=60, tolerance=1e-9)).items():
        assert got == pytest.approx(truth[i], abs=1e-3)
    step = fit_iterative(df, ["a", "b", "c"], rounds=60, tolerance=1e-9)
    new = spark.createDataFrame([(1, 1.0, 1.0, None), (2, None, None, None)], SHAPE)
    got = filled(apply_step(new, step))
    assert got[1][2] == pytest.approx(8.0, abs=1e-3) and None not in got[2]


def test_chained_regressions_settle(holes):
    """Two of the columns nearly agree, so that their coefficients still trade places; the filled values rest."""
    _, df = holes
    runs = [filled(iterative_impute(df, ["a", "b", "c"], rounds=n, tolerance=0)) for n in (4, 12, 13)]
    moved = [max(abs(x - y) for i in runs[0] for x, y in zip(first[i], second[i])) for first, second in zip(runs, runs[1:])]
    assert moved[1] < 0.1 and moved[1] < moved[0] / 2
    assert len(fit_iterative(df, ["a", "b", "c"], rounds=50, tolerance=1e-1)["rounds"]) < 50


def test_chained_regressions_of_odd_tables(spark):
    rows = [(1, 1.0, None, 4.0), (2, 2.0, None, None), (3, None, None, 4.0)]
    got = filled(iterative_impute(spark.createDataFrame(rows, SHAPE), ["a", "b", "c"]))
    assert got[2][2] == pytest.approx(4.0) and got[1][1] is None and got[3][0] == pytest.approx(1.5, abs=0.51)
    assert filled(iterative_impute(spark.createDataFrame([], SHAPE), ["a", "b", "c"])) == {}


def test_synthetic_rows_lie_between_neighbours(spark):
    rng = random.Random(9)
    rows = [(i, "a" if i < 12 else "b" if i < 60 else "c" if i < 61 else None if i < 65 else "d", rng.gauss(0, 1), rng.gauss(5, 2)) for i in range(260)]
    df = spark.createDataFrame(rows, "id long, y string, u double, v double")
    got = oversample_smote(df, "y", ["u", "v"], ["id"], k=3, cell=9)
    assert sorted(map(tuple, got.where("not synthetic").drop("synthetic").collect())) == sorted(rows)
    made = got.where("synthetic").collect()
    sizes = {r["y"]: r["count"] for r in got.groupBy("y").count().collect()}
    assert sizes == {"a": 195, "b": 195, "c": 195, "d": 195, None: 4}
    own = {}
    for _, y, u, v in rows:
        own.setdefault(y, []).append((u, v))
    for r in made:
        points = own[r["y"]]
        ok = False
        for p in points:
            near = sorted((q for q in points if q != p), key=lambda q: (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2)[:3] or [p]
            for q in near:
                du, dv = q[0] - p[0], q[1] - p[1]
                share = (r["u"] - p[0]) / du if du else 0.0
                ok = ok or (-1e-9 <= share <= 1 + 1e-9 and abs(p[0] + share * du - r["u"]) < 1e-9 and abs(p[1] + share * dv - r["v"]) < 1e-9)
        assert ok and r["id"] is None
    again = oversample_smote(df.repartition(5), "y", ["u", "v"], ["id"], k=3)
    assert sorted(map(repr, again.where("synthetic").collect())) == sorted(map(repr, made))


def test_synthetic_rows_of_equal_points(spark):
    """A class of copies has its own kind as neighbours, however many there are."""
    df = spark.range(300).selectExpr("id", "case when id < 90 then 'few' else 'many' end as y", "case when id < 88 then 1.0D else double(id) end as u")
    made = oversample_smote(df, "y", ["u"], ["id"]).where("synthetic and u <> 1.0D").collect()
    assert all(1.0 < r["u"] < 90 for r in made) and len(made) < 20
    assert oversample_smote(df.where("false"), "y", ["u"], ["id"]).count() == 0


def test_queries_meet_few_cells(spark):
    """Donors are split along what queries can compare, so a query meets about as many cells however many donors there are."""
    rng = np.random.default_rng(4)
    for n in (2000, 16000):
        rows = rng.uniform(0, 100, size=(n, 3))
        forest = neighbors.Forest.fit(
            spark.createDataFrame([(i, "", x.tolist(), 1, 0) for i, x in enumerate(rows)], "id long, label string, x array<double>, n long, tree long"),
            {0: n}, {0: [0, 1]}, 3, 64,
        )
        cells = forest.descend(np.full(n, forest.roots[0]), rows)
        one = [np.flatnonzero(cells == c) for c in np.unique(cells)]
        forest.enclose(neighbors.Boxes(np.unique(cells), np.full(len(one), ""), np.array([rows[i].min(0) for i in one]), np.array([rows[i].max(0) for i in one]), *(np.array([len(i) for i in one]),) * 2))
        x = np.column_stack([rng.uniform(0, 100, size=(500, 2)), np.full(500, np.nan)])
        axes = np.array([0, 1])
        radius = forest.bound(0, x, axes, 5)
        query, _ = forest.reached(0, x, axes, radius)
        exact = np.sort(((x[:, None, :2] - rows[None, :, :2]) ** 2).sum(axis=2) * 3 / 2, axis=1)[:, 4]
        assert (radius >= exact - 1e-9).all() and len(query) < 4 * len(x)


def test_knn_of_many_rows_alike_in_what_is_shared(spark):
    """Thousands of donors at no distance: the ones with the smallest coordinates count, and few are moved."""
    rows = [(i, None if i % 50 == 0 else float((i * 37) % 1009), None if i % 3 == 0 else float(i % 4), float(i % 2)) for i in range(1500)]
    df = spark.createDataFrame(rows, SHAPE)
    got, want = filled(knn_impute(df, ["a", "b", "c"])), brute_knn(rows, 5)
    for i in want:
        assert got[i] == pytest.approx(want[i], abs=1e-9), rows[i]
