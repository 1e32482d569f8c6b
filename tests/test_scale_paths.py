"""The paths for large data, forced on small data, against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabwright.operators import lookup, metrics, ranking
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.splits import exact_split, hash_split, with_fold


@pytest.mark.parametrize("limit", [2, 20, 300, 10**6])
def test_quantiles_under_any_limit(spark, skewed, limit):
    df = skewed.withColumn("big", F.col("id") * 10_000_000_000 + 1)
    probs = [0.0, 0.01, 1 / 3, 0.5, 0.75, 1.0]
    columns = ["value", "big", "id"]
    pdf = df.select(*columns).toPandas()
    found = exact_quantiles(df, columns, probs, {c: 3000 for c in columns}, {c: pdf[c].nunique() for c in columns}, limit)
    for c in columns:
        assert found[c] == pytest.approx(list(np.quantile(pdf[c], probs)), rel=1e-12), c


@pytest.mark.parametrize("final", [1, 50, 10_000])
def test_cutoffs_select_exact_numbers(spark, skewed, monkeypatch, final):
    monkeypatch.setattr(ranking, "FINAL_BUCKET", final)
    monkeypatch.setattr(ranking, "PREFIX_STEP", 1)
    done = exact_split(skewed, ["id"], "label")
    sizes = {r["label"]: (r["n"], r["t"]) for r in done.groupBy("label").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()}
    assert all(t == int(0.2 * n + 0.5) for n, t in sizes.values())
    again = exact_split(skewed.repartition(11), ["id"], "label")
    assert {r["id"] for r in done.where("is_test").collect()} == {r["id"] for r in again.where("is_test").collect()}
    assert ranking.sample_rows(skewed, 777, "id").count() == 777
    assert ranking.sample_rows(skewed, 5000, "id").count() == 3000
    assert ranking.sample_rows(skewed, 0, "id").count() == 0


def test_hash_split_and_folds(spark, skewed):
    df = with_fold(hash_split(skewed, ["id"]), ["id"])
    share = df.where("is_test").count() / 3000
    assert 0.15 < share < 0.25
    assert sorted(r["fold"] for r in df.select("fold").distinct().collect()) == [0, 1, 2, 3, 4]


def test_numbering_by_range_partitions(spark, skewed):
    values = skewed.select(F.col("value").alias("v")).distinct()
    small = {r["v"]: r["code"] for r in ranking.numbered(values, "v", "code", 1000).collect()}
    large = {r["v"]: r["code"] for r in ranking.numbered(values, "v", "code", None).collect()}
    assert small == large == {v: i for i, v in enumerate(sorted(small))}


@pytest.mark.parametrize("lead", [0, 5000])
def test_long_texts_are_numbered_without_fetching_them(spark, lead):
    """Only a few short edges reach the driver, unless all texts begin alike."""
    values = spark.range(2000).select(F.concat(F.repeat(F.lit("a"), lead), F.md5(F.col("id").cast("string")), F.repeat(F.lit("é"), 3000)).alias("v"))
    edges = ranking._edges(values, "v", 4, 2000)
    assert edges == sorted(edges) and 2 <= len(edges) <= 3 and (lead or max(map(len, edges)) <= 256)
    codes = {r["v"]: r["code"] for r in ranking.numbered(values, "v", "code", None).collect()}
    assert codes == {v: i for i, v in enumerate(sorted(codes))} and len(codes) == 2000
    assert ranking.numbered(values.where("false"), "v", "code", None).count() == 0


@pytest.mark.parametrize("group", [None, "label"])
def test_running_total_by_range_partitions(spark, skewed, group):
    small = ranking.running_total(skewed, "id", "value", "t", 10, group)
    large = ranking.running_total(skewed, "id", "value", "t", 10**9, group)
    a = {r["id"]: round(r["t"], 6) for r in small.collect()}
    assert a == {r["id"]: round(r["t"], 6) for r in large.collect()}


def test_hot_keys_meet_a_broadcast(spark, skewed):
    mapping = skewed.groupBy(F.col("key").alias("value")).agg(F.count("*").alias("n"), F.avg("value").alias("m"))
    with_null = skewed.withColumn("key", F.when(F.col("id") != 5, F.col("key")))
    small = lookup.map_values(with_null, "key", mapping, (1000, 1000), "m", "n")
    large = lookup.map_values(with_null, "key", mapping, (10**9, 10**12), "m", "n")
    plain = lookup.map_values(with_null, "key", mapping, (10**9, 10**12), "m")
    expected = {r["id"]: r["m"] for r in small.collect()}
    assert len(expected) == 3000
    assert {r["id"]: r["m"] for r in large.collect()} == expected
    assert {r["id"]: r["m"] for r in plain.collect()} == expected
    wide = lookup.map_values(with_null, "key", mapping, (10, lookup.BROADCAST_BYTES + 1), "m", "n")
    assert {r["id"]: r["m"] for r in wide.collect()} == expected


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.mark.parametrize("bound", [10, 10**9])
def test_auc_equals_all_pairs(spark, monkeypatch, bound):
    pairs = [(i * 7 % 5 % 2, (i * 13 % 17) / 17) for i in range(120)]
    df = spark.createDataFrame(pairs, "y int, s double")
    if bound > 100_000:
        monkeypatch.setattr(metrics, "running_total", lambda d, o, v, out, b, g=None: ranking.running_total(d, o, v, out, bound, g))
    assert metrics.roc_auc(df, "y", "s").first()[0] == pytest.approx(brute_auc(pairs))
    both = df.selectExpr("y", "s as s1", "1 - s as s0")
    assert metrics.roc_auc_weighted(both, "y", {0: "s0", 1: "s1"}).first()[0] == pytest.approx(brute_auc(pairs))


def test_auc_of_perfect_and_constant_scores(spark):
    df = spark.range(100).selectExpr("cast(id >= 60 as int) as y", "id / 100 as s", "0.5D as c")
    assert metrics.roc_auc(df, "y", "s").first()[0] == 1.0
    assert metrics.roc_auc(df, "y", "c").first()[0] == 0.5
    assert metrics.roc_auc(df.where("y = 1"), "y", "s").first()[0] is None


def test_a_label_with_too_many_classes_is_refused_by_models(spark):
    from tabwright.plans.training import Trainer

    df = spark.range(2000).selectExpr("id", "cast(id as string) as y")
    with pytest.raises(ValueError, match="classes"):
        Trainer(df, "y", ["id"], ["id"], classification=True).labels  # noqa: B018


def test_any_number_of_classes(spark):
    """Undersampling and exact splits of 20,000 classes of one to four rows."""
    from tabwright.operators.splits import exact_split
    from tabwright.operators.transforms import undersample

    df = spark.range(50_000).selectExpr("id", "concat('k', id % 20000) as y", "id * 2 as v")
    assert undersample(df, "y", "id").groupBy("y").count().where("count <> 2").isEmpty()
    more = df.unionAll(spark.range(50_000, 50_010).selectExpr("id", "'k7' as y", "id as v"))
    split = exact_split(more, ["id"], "y", share=0.5).groupBy("y").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t"))
    assert split.where("t <> floor(n * 0.5 + 0.5)").isEmpty() and split.count() == 20_000


def test_cutoffs_of_uneven_groups(spark):
    from tabwright.operators.ranking import by_cutoff, group_cutoffs

    df = spark.range(9000).selectExpr("id", "case when id % 3 = 0 then 'hot' when id < 40 then null else concat('c', id % 50) end as y")
    wanted = spark.createDataFrame([("hot", 1234), ("c1", 0), ("c2", 10**6), ("c4", 7)], "g string, k long")
    hash_ = F.md5(F.col("id").cast("string"))
    chosen = by_cutoff(df, hash_, group_cutoffs(df, hash_, wanted, F.col("y")), F.col("y"), "in").where("in")
    sizes = {r["y"]: r["count"] for r in chosen.groupBy("y").count().collect()}
    assert sizes == {"hot": 1234, "c2": df.where("y = 'c2'").count(), "c4": 7}
    order = [r["id"] for r in df.where("y = 'hot'").orderBy(hash_).limit(1234).collect()]
    assert {r["id"] for r in chosen.where("y = 'hot'").collect()} == set(order)


def test_training_rows_and_texts_are_dealt_out(spark):
    """One row group is one partition; training and counting words must not stay in one task."""
    from tabwright.operators import textvec
    from tabwright.plans.training import Trainer

    cores = spark.sparkContext.defaultParallelism
    rows = spark.range(200).coalesce(1).selectExpr("id", "double(id % 7) as x", "double(id) as y")
    trainer = Trainer(rows, "y", ["id"], classification=False)
    assert trainer.data.rdd.getNumPartitions() >= cores
    trainer.data.unpersist()
    texts = spark.createDataFrame([("red fox red fox",), ("red dog",), (None,)], "t string").coalesce(1)
    counted = textvec.term_counts(texts, "t")
    assert {tuple(r) for r in counted.collect()} == {
        ("red", 3, 2), ("fox", 2, 1), ("dog", 1, 1), ("red fox", 2, 1), ("fox red", 1, 1), ("red dog", 1, 1),
    }
    assert "Join" not in counted._jdf.queryExecution().optimizedPlan().toString()
