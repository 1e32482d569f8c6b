import random

import numpy as np
import pytest

from tabwright.plans.boosting import Growth, LeafwiseModel, Tree, train_gbt_leafwise


def table(spark, n, seed=1, whole=False):
    """y depends on where `a` is missing, on b beyond 3 and on both; c is noise."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        a = None if rng.random() < 0.3 else float(rng.randint(4, 6)) if whole else rng.uniform(0, 10)
        b, c = float(rng.randint(0, 7)), rng.gauss(0, 1)
        y = (8.0 if a is None else a * 0.5) + (4.0 if b > 3 else 0.0) + (3.0 if b > 3 and (a or 0) > 6 else 0.0) + rng.gauss(0, 0.2)
        rows.append((i, a, b, c, y, "hi" if y > 7 else "lo" if y < 3 else "mid"))
    return rows, spark.createDataFrame(rows, "i int, a double, b double, c double, y double, k string")


def serial_tree(x, g, h, edges, growth):
    """Best-first growth by plain loops."""
    bins = np.array([[len(e) + 1 if v is None else int(np.searchsorted(e, v, side="left")) for v, e in zip(r, edges)] for r in x])
    most = max(len(e) for e in edges) + 1
    lost = np.array([[v is None for v in r] for r in x])

    def best(rows):
        found = None
        total = g[rows].sum() ** 2 / (h[rows].sum() + growth.penalty)
        for missing_left in (True, False):
            for j in range(len(edges)):
                for cut in range(most - 1):
                    left = np.where(lost[rows, j], missing_left, bins[rows, j] <= cut)
                    a, b = rows[left], rows[~left]
                    if len(a) < growth.least_rows or len(b) < growth.least_rows:
                        continue
                    gain = g[a].sum() ** 2 / (h[a].sum() + growth.penalty) + g[b].sum() ** 2 / (h[b].sum() + growth.penalty) - total
                    if gain > 1e-12 and (found is None or gain > found[0] * (1 + 1e-9)):
                        found = (gain, j, cut, missing_left, a, b)
        return found

    leaves = [(np.arange(len(x)), best(np.arange(len(x))))]
    while len(leaves) < growth.leaves and any(f for _, f in leaves):
        at = max((k for k, (_, f) in enumerate(leaves) if f), key=lambda k: leaves[k][1][0])
        _, found = leaves.pop(at)
        leaves += [(found[4], best(found[4])), (found[5], best(found[5]))]
    out = np.zeros(len(x))
    for rows, _ in leaves:
        out[rows] = -growth.rate * g[rows].sum() / (h[rows].sum() + growth.penalty)
    return out


def test_trees_against_serial_growth(spark):
    rows, df = table(spark, 400)
    edges = [[1.0, 2.5, 4.0, 6.0, 8.0], [0.0, 1.0, 3.0, 5.0], [-1.0, 0.0, 1.0]]
    growth = Growth(rate=0.3, least_rows=15, leaves=6)
    model = train_gbt_leafwise(df.repartition(3), "y", ["a", "b", "c"], rounds=3, growth=growth, edges=edges)
    x, y = [r[1:4] for r in rows], np.array([r[4] for r in rows])
    margin = np.full(len(rows), y.mean())
    for _ in range(3):
        margin = margin + serial_tree(x, margin - y, np.ones(len(rows)), edges, growth)
    got = {r["i"]: r["prediction"] for r in model.predict(df).collect()}
    assert [got[i] for i in range(400)] == pytest.approx(margin.tolist(), abs=1e-6)
    assert all(len(t.feature) == 11 for t in model.trees[0])


def test_margins_are_kept_every_few_trees(spark, monkeypatch):
    _, df = table(spark, 300)
    edges = [[2.0, 5.0, 8.0], [1.0, 3.0, 5.0], [0.0]]
    growth = Growth(least_rows=10, leaves=4)
    one = train_gbt_leafwise(df, "y", ["a", "b", "c"], rounds=5, growth=growth, edges=edges)
    monkeypatch.setattr("tabwright.plans.boosting.KEEP", 2)
    two = train_gbt_leafwise(df, "y", ["a", "b", "c"], rounds=5, growth=growth, edges=edges)
    for s, t in zip(one.trees[0], two.trees[0], strict=True):
        assert (s.feature, s.bin, s.left) == (t.feature, t.bin, t.left) and s.value == pytest.approx(t.value)


def test_missing_values_teach_more_than_filled_ones(spark):
    """On new rows it beats the boosted trees that see medians instead of gaps."""
    from tabwright.plans.training import Trainer

    _, df = table(spark, 900, whole=True)
    _, new = table(spark, 500, seed=2, whole=True)
    model = train_gbt_leafwise(df, "y", ["a", "b", "c"], rounds=15, growth=Growth(rate=0.3, leaves=8))
    trainer = Trainer(df, "y", ["i"], ["a", "b", "c"], classification=False, rounds=15)
    trainer.train_model("gradient_boosting", cross_validate=False)
    error = lambda scored: scored.selectExpr("avg((y - prediction) * (y - prediction))").first()[0]
    ours, theirs = error(model.predict(new)), error(trainer.predict(new))
    trainer.release()
    assert ours < 0.5 * theirs
    shares = model.importance()
    assert shares["a"] > 0.2 and shares["c"] < 0.05 and sum(shares.values()) == pytest.approx(1)


@pytest.mark.parametrize("two", [True, False])
def test_classes_and_storage(spark, two):
    _, df = table(spark, 400)
    _, new = table(spark, 300, seed=5)
    if two:
        df, new = (d.withColumn("k", (d["y"] > 6).cast("int")) for d in (df, new))
    model = train_gbt_leafwise(df, "k", ["a", "b"], classification=True, rounds=6, growth=Growth(rate=0.5, leaves=6))
    again = LeafwiseModel.from_json(model.to_json())
    scored = again.predict(new)
    assert dict(scored.dtypes)["prediction"] == dict(df.dtypes)["k"]
    assert scored.where("prediction = k").count() > 255
    for r in scored.limit(20).collect():
        assert sum(r["probability"]) == pytest.approx(1) and len(r["probability"]) == (2 if two else 3)


def test_odd_tables(spark):
    df = spark.createDataFrame([(1.0, 2.0), (None, 3.0), (2.0, None)], "a double, y double")
    model = train_gbt_leafwise(df, "y", rounds=4)
    assert [r["prediction"] for r in model.predict(df).collect()] == pytest.approx([2.5] * 3) and len(model.trees[0]) == 1
    with pytest.raises(ValueError):
        train_gbt_leafwise(df.where("false"), "y")
    assert Tree(**{k: v for k, v in vars(model.trees[0][0]).items()}).feature == [-1]
