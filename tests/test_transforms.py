import pytest
from pyspark.sql import functions as F

from tabwright.operators import steps as st
from tabwright.operators import textvec
from tabwright.operators import transforms as tr
from tabwright.operators.steps import apply_step
from tabwright.plans.preprocess import PreprocessPlan, auto_preprocess


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(400).selectExpr(
        "id",
        "case when id % 10 = 0 then null else (id * 37 % 401) * 1.5D end as income",
        "case when id % 4 = 0 then null when id % 3 = 0 then 'x' else 'y' end as city",
        "concat('v', id % 120) as code",
        "timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(id % 50 as int)) as day",
        "case when id % 5 = 0 then null when id % 2 = 0 then 'yes' else 'no' end as y",
    )


def test_scaled_columns_have_unit_spread(spark, people):
    df = tr.scale(people, ["income"])
    row = df.agg(F.avg("income").alias("m"), F.stddev_pop("income").alias("s")).first()
    assert row["m"] == pytest.approx(0, abs=1e-9) and row["s"] == pytest.approx(1)
    assert df.where("income is null").count() == 40
    flat = spark.range(5).selectExpr("4.0D as v")
    for method in ("standard", "minmax", "robust"):
        assert {r["v"] for r in tr.scale(flat, ["v"], method).collect()} == {0.0}


def test_one_hot_rows(people):
    full = tr.one_hot(people.select("id", "city"), ["city"])
    assert full.columns == ["id", "city_x", "city_y"]
    sums = full.select((F.col("city_x") + F.col("city_y")).alias("s"), "id").collect()
    assert all(r["s"] == (0 if r["id"] % 4 == 0 else 1) for r in sums)
    assert tr.one_hot(people.select("id", "city"), ["city"], drop_first=True).columns == ["id", "city_y"]


def test_numeric_values_are_ordered_as_numbers(spark):
    df = spark.range(12).selectExpr("cast(id as int) as v")
    assert tr.one_hot(df, ["v"], drop_first=True).columns == [f"v_{i}" for i in range(1, 12)]


def test_codes(people):
    done = tr.ordinal_encode(people.select("id", "code"), "code")
    expected = {v: i for i, v in enumerate(sorted({f"v{i}" for i in range(120)}))}
    assert all(r["code"] == expected[f"v{r['id'] % 120}"] for r in done.collect())
    assert {r["city"] for r in tr.category_codes(people.select("city"), "city").collect()} == {-1, 0, 1}


def test_median_and_mode(people):
    filled = tr.impute_mode(tr.impute_median(people, ["income"]), ["city"])
    assert filled.where("income is null or city is null").count() == 0
    assert filled.where("id = 10").first()["income"] == pytest.approx(people.toPandas()["income"].median())
    assert filled.where("id = 4").first()["city"] == "y"


def test_modes_of_every_type_come_back_in_type(spark):
    rows = [(True, 3, "2024-02-01", "2024-02-01 10:00:00")] * 2 + [(None, None, None, None)]
    df = spark.createDataFrame(rows, "b boolean, i int, d string, t string").selectExpr(
        "b", "i", "cast(d as date) as d", "cast(t as timestamp) as t", "cast(t as timestamp_ntz) as n"
    )
    done = tr.impute_mode(df, df.columns)
    assert done.dtypes == df.dtypes
    assert done.distinct().count() == 1


def test_keep_last_and_hot_key(spark, skewed):
    last = tr.keep_last(skewed, ["key"], "id")
    assert last.count() == skewed.select("key").distinct().count()
    assert last.where("key = 'hot'").first()["id"] == 2997


def test_group_rare_keeps_null_and_frequent(spark):
    df = spark.range(1000).selectExpr("case when id < 5 then 'rare' when id < 10 then null else concat('k', id % 3) end as v")
    counts = {r["v"]: r["count"] for r in tr.group_rare(df, "v").groupBy("v").count().collect()}
    assert counts["Other"] == 5 and counts[None] == 5 and len(counts) == 5


def test_undersample_is_exact_under_skew(skewed):
    done = tr.undersample(skewed, "label", "id")
    sizes = {r["count"] for r in done.groupBy("label").count().collect()}
    assert len(sizes) == 1 and sizes == {skewed.where("label = 'B'").count()}


def test_target_encoding_prior(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 0.0), ("b", 1.0)], "k string, y double")
    plain = {r["k"]: r["k_target"] for r in tr.target_encode(df, "k", "y").collect()}
    assert plain == {"a": 0.5, "b": 1.0}
    drawn = {r["k"]: r["k_target"] for r in tr.target_encode(df, "k", "y", prior=1.0).collect()}
    assert drawn["b"] == pytest.approx((1 + 2 / 3) / 2)


def test_plan_never_touches_the_target(people):
    plan = PreprocessPlan.fit(people, "y")
    done = plan.transform(people)
    assert {(r["id"], r["y"]) for r in done.select("id", "y").collect()} == {(r["id"], r["y"]) for r in people.select("id", "y").collect()}
    assert "y" not in plan.feature_names()
    assert done.where("income is null or city_x + city_y <> 1").count() == 0


def test_plan_survives_saving(spark, people, tmp_path):
    plan = PreprocessPlan.fit(people, mode="minimal")
    assert "codes" in [s["op"] for s in plan.steps]
    plan.save(spark, str(tmp_path / "plan"))
    loaded = PreprocessPlan.load(spark, str(tmp_path / "plan"))
    a, b = plan.transform(people), loaded.transform(people)
    assert a.columns == b.columns
    assert a.exceptAll(b).count() == 0
    assert loaded.step_table(spark).count() == len(plan.steps)


def test_plan_on_new_rows_with_unknown_values(spark, people):
    plan = PreprocessPlan.fit(people)
    new = spark.createDataFrame([(1000, None, "z", "nope", None, None)], people.schema)
    row = plan.transform(new).first()
    assert (row["city_x"], row["city_y"], row["code"]) == (0, 0, None)
    assert row["income"] is not None


def test_plan_on_a_stream_equals_batch(spark, people, tmp_path):
    from tabwright.streaming.apply import prepare_stream, stream_files

    plan = PreprocessPlan.fit(people)
    people.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = stream_files(spark, str(tmp_path / "in"), people.schema, files_per_trigger=1)
    prepare_stream(stream, plan, str(tmp_path / "out"), str(tmp_path / "offsets")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.exceptAll(plan.transform(people)).count() == 0 and out.count() == 400


def test_stream_drops_repeated_and_late_rows(spark, tmp_path):
    from tabwright.streaming.apply import prepare_stream, stream_files

    def write(name, rows):
        df = spark.createDataFrame(rows, "at string, v double").selectExpr("to_timestamp(at) as at", "v")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
        return df

    first = write("in", [("2024-01-01 10:00:00", 1.5), ("2024-01-01 10:00:00", 1.5), ("2024-01-01 10:05:00", 2.5)])
    plan = PreprocessPlan([{"op": "drop_duplicates"}], {}, {"columns": ["at", "v"], "target": None})
    stream = lambda: stream_files(spark, str(tmp_path / "in"), first.schema)
    with pytest.raises(ValueError):
        plan.transform(stream())
    run = lambda: prepare_stream(stream(), plan, str(tmp_path / "out"), str(tmp_path / "offsets"), time="at", delay="30 minutes").awaitTermination()
    run()
    # a repeat within the delay, a new row, and one that moves the watermark on
    write("in", [("2024-01-01 10:05:00", 2.5), ("2024-01-01 10:20:00", 3.5), ("2024-01-01 12:00:00", 4.5)])
    run()
    write("in", [("2024-01-01 09:00:00", 5.5), ("2024-01-01 12:00:00", 4.5), ("2024-01-01 11:45:00", 6.5)])  # the first is late
    run()
    got = sorted(r["v"] for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert got == [1.5, 2.5, 3.5, 4.5, 6.5]


def test_advanced_imputation_in_a_plan(spark):
    df = spark.range(400).selectExpr("id", "id * 37 % 211 * 1.5D as a", "case when id % 4 <> 1 then (id * 37 % 211) * 3.0D + (id % 3) end as b")
    median, chained = (PreprocessPlan.fit(df, advanced=a) for a in ("median", "iterative"))
    assert [s["op"] for s in median.steps if s["op"] in ("iterative", "fill_number")] == ["fill_number"]
    assert [s["op"] for s in chained.steps if s["op"] in ("iterative", "fill_number")] == ["iterative"]
    out = chained.transform(df)
    assert out.where("b is null").isEmpty()
    truth = df.selectExpr("id", "(id * 37 % 211) * 3.0D as t").join(out, "id").where("id % 4 = 1")
    assert truth.selectExpr("corr(t, b)").first()[0] > 0.99
    with pytest.raises(ValueError):
        PreprocessPlan.fit(df, advanced="guess")


def test_aggressive_mode_caps_outliers(spark):
    df = spark.range(1000).selectExpr("id", "case when id % 8 = 0 then id * 1000.0D else id % 300 * 1.0D end as v")
    plan = PreprocessPlan.fit(df, mode="aggressive")
    assert [s["op"] for s in plan.steps] == ["clip", "scale"]
    assert plan.steps[1]["method"] == "robust"
    with pytest.raises(ValueError):
        PreprocessPlan.fit(df, mode="none")


def test_configured_steps_on_unknown_values(spark, people):
    for encoder in ("onehot", "ordinal"):
        steps, tables = tr.configured(people, ["income"], ["city"], "most_frequent", "minmax", encoder)
        new = spark.createDataFrame([(1, 2.0, "z", "c", None, None)], people.schema)
        for step in steps:
            new = apply_step(new, step, tables)
        row = new.first().asDict()
        assert row.get("city", -1) == -1 and row.get("city_x", 0) == 0


def test_tfidf_rows_are_unit_vectors(spark):
    texts = ["The quick brown fox", "the quick red fox jumps", "lazy dogs", None, "quick dogs and a lazy fox"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    step = textvec.fit_tfidf(df, "t", 5)
    assert step["terms"] == ["dogs", "fox", "lazy", "quick"]
    rows = textvec.tfidf_columns(df, step).drop("t").collect()
    norms = [sum(v * v for k, v in r.asDict().items() if k != "i") for r in rows]
    assert norms[3] == 0 and all(n == pytest.approx(1) for i, n in enumerate(norms) if i != 3)


def test_vocabulary_looks_further_when_leading_terms_fail(spark):
    often = " ".join(f"w{i:03d} w{i:03d} w{i:03d}" for i in range(50))
    df = spark.createDataFrame([(often,), ("alpha beta",), ("alpha beta",)], "t string")
    found = [r["term"] for r in textvec.vocabulary(df, "t", max_terms=2).collect()]
    assert found == ["alpha", "alpha beta"]


def test_text_that_cannot_be_vectorized_stays(spark):
    df = spark.range(60).selectExpr("id", "concat('only', id, ' here', id) as t", "id % 3 as k").where("id >= 0")
    df = df.unionByName(df.where("id < 5"))  # not all distinct, so the column is text
    done = auto_preprocess(df)
    assert "t" in done.columns


def test_too_many_one_hot_columns_is_an_error(spark):
    with pytest.raises(ValueError):
        st.fit_one_hot(spark.range(600).selectExpr("cast(id as string) as v"), ["v"])
