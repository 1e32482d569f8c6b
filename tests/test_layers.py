import datetime as dt
import math

from pyspark.sql import functions as F

from tabwright import Profile
from tabwright.operators import steps as st
from tabwright.operators.lookup import map_values
from tabwright.operators.ranking import sample_share
from tabwright.operators.splits import hash_split
from tabwright.sources.runs import fingerprint


def jobs(spark, action):
    name = f"group-{action.__name__}"
    spark.sparkContext.setJobGroup(name, name)
    try:
        action()
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(name))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_sections_pay_for_what_they_show(spark, skewed):
    p = Profile(skewed)

    def schema():
        p.schema_table()
        p.dtype_counts()

    def nulls():
        p.missing_by_column()
        p.missing_summary()
        p.high_quality_columns()

    assert jobs(spark, schema) == 0
    assert jobs(spark, nulls) <= 2
    p.histogram()
    p.box_stats()
    p.correlation_matrix()
    p.overview()
    assert "rows" not in p.__dict__  # nothing has grouped all values


def test_no_column_is_left_out(spark):
    df = spark.range(50).select(*[(F.col("id") * k).alias(f"n{k}") for k in range(1, 15)], *[F.concat(F.lit("v"), F.col("id") % 3).alias(f"s{k}") for k in range(9)])
    p = Profile(df)
    assert p.histogram().select("column_name").distinct().count() == 14
    assert p.category_counts().select("column_name").distinct().count() == 9


def test_infinite_and_tiny_values(spark):
    df = spark.createDataFrame([(float(k), 1e-170 * k) for k in range(1, 20)] + [(math.inf, 1e-170)], "x double, tiny double")
    p = Profile(df)
    facts = {r["column_name"]: r for r in p.facts.collect()}
    assert facts["x"]["mean"] == facts["x"]["max_num"] == math.inf and facts["x"]["min_num"] == 1.0 and facts["x"]["std"] is None
    assert facts["tiny"]["skewness"] is not None and 0 < facts["tiny"]["std"] < 1e-168
    bins = p.histogram(bins=6).where("column_name = 'x'").orderBy("bin").collect()
    assert [r["bin_start"] for r in bins] == [1.0, 4.0, 7.0, 10.0, 13.0, 16.0] and sum(r["n"] for r in bins) == 19
    stats = p.numeric_stats().where("column_name = 'x'").first()
    assert stats is None or stats["outliers_zscore"] == 0


def test_dates_become_columns(spark):
    df = spark.createDataFrame([(dt.date(2024, 1, 1),), (dt.date(2024, 1, 2),), (None,)], "d date")
    out = st.apply_step(df, st.fit_one_hot(df, ["d"])[0])
    assert out.columns == ["d_2024-01-01", "d_2024-01-02"]
    assert sorted(tuple(r) for r in out.collect()) == [(0, 0), (0, 1), (1, 0)]


def test_fingerprints_tell_cells_apart(spark):
    frames = [spark.createDataFrame([r], "a string, b string") for r in [("a|b", "c"), ("a", "b|c"), (None, "c"), ("\\N", "c"), ("-", "c")]]
    assert len({fingerprint(f).first()["fingerprint"] for f in frames}) == len(frames)


def test_small_shares_select_rows(spark):
    ids = spark.range(4_000_000)
    assert 1 <= sample_share(ids, 2e-6, "id").count() <= 25
    assert 20 <= hash_split(ids.limit(1_000_000), ["id"], 5e-5).where("is_test").count() <= 90


def test_lookups_read_the_input_once(spark, skewed):
    df, large = skewed, (10**9, 10**12)
    wanted = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).collect()
    counts = {r["key"]: r["n"] for r in wanted}
    for k in range(3):
        table = skewed.groupBy(F.col("key").alias("value")).agg(F.count(F.lit(1)).alias("n"))
        df = map_values(df, "key", table.withColumn("code", F.col("n") * 2), large, f"c{k}", "n", source="code")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Range (0, 3000") == 1
    rows = df.collect()
    assert len(rows) == 3000 and all(r["c0"] == r["c1"] == r["c2"] == 2 * counts[r["key"]] for r in rows)
