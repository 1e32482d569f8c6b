import datetime as dt
import math
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tabwright.operators.insights import Insights
from tabwright.operators.needs import Needs
from tabwright.operators.profile import Profile


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(7)
    n = 400
    x = rng.gamma(2.0, 3.0, n).round(3)
    pdf = pd.DataFrame({"x": x, "y": (2 * x + rng.normal(0, 1, n)).round(3), "k": rng.integers(0, 60, n), "z": np.ones(n)})
    pdf.loc[::9, "x"] = np.nan
    pdf.loc[::7, "y"] = np.nan
    return pdf


def test_statistics_equal_pandas(spark, frame):
    p = Profile(spark.createDataFrame(frame))
    found = {r["column_name"]: r for r in p.facts.join(p.spread_table, "column_name").collect()}
    for c in ("x", "y", "k"):
        s = frame[c]
        expected = {
            "mean": s.mean(), "std": s.std(), "skewness": s.skew(), "kurtosis": s.kurtosis(), "median": s.median(),
            "q25": s.quantile(0.25), "q75": s.quantile(0.75), "min_num": s.min(), "max_num": s.max(),
        }
        for name, value in expected.items():
            assert found[c][name] == pytest.approx(value, rel=1e-9), (c, name)
        assert found[c]["unique_count"] == s.nunique()
        assert found[c]["null_count"] == s.isna().sum()
        iqr = s.quantile(0.75) - s.quantile(0.25)
        outside = (s < s.quantile(0.25) - 1.5 * iqr) | (s > s.quantile(0.75) + 1.5 * iqr)
        assert found[c]["outliers_iqr"] == outside.sum()
    assert found["z"]["std"] == 0 and found["z"]["outliers_zscore"] == 0 and found["z"]["skewness"] is None


def test_correlation_is_pairwise_complete(spark, frame):
    pairs = {(r["col1"], r["col2"]): r["correlation"] for r in Profile(spark.createDataFrame(frame)).correlation_pairs}
    assert pairs["x", "y"] == pytest.approx(frame["x"].corr(frame["y"]), rel=1e-9)
    assert pairs["x", "k"] == pytest.approx(frame["x"].corr(frame["k"]), rel=1e-9)
    assert pairs["k", "z"] is None


def test_wide_correlation_takes_the_vector_pass(spark):
    df = spark.range(200).select(*[(F.pow(F.col("id") % (7 + i), F.lit(1 + i % 2)) + i).alias(f"c{i}") for i in range(27)])
    pairs = {(r["col1"], r["col2"]): r["correlation"] for r in Profile(df).correlation_pairs}
    pdf = df.toPandas()
    assert len(pairs) == 27 * 26 // 2
    for a, b in (("c0", "c1"), ("c3", "c20"), ("c25", "c26")):
        assert pairs[a, b] == pytest.approx(pdf[a].corr(pdf[b]), rel=1e-6)


def test_every_physical_type(spark):
    day, moment = dt.date(2024, 1, 1), dt.datetime(2024, 1, 1, 10, 0, 0)
    rows = [
        (1, 2.5, Decimal("1.10"), True, "a", day, moment, {"k": 1}, [1.0]),
        (2, math.nan, Decimal("2.20"), False, "", day + dt.timedelta(3), moment + dt.timedelta(hours=47), None, None),
        (3, None, None, None, None, None, None, {"k": 2}, [2.0]),
    ]
    ddl = "i int, f double, d decimal(10,2), b boolean, s string, day date, t timestamp, m map<string,int>, a array<double>"
    p = Profile(spark.createDataFrame(rows, ddl))
    facts = {r["column_name"]: r for r in p.facts.collect()}
    assert facts["f"]["null_count"] == 2  # NaN counts as missing
    assert facts["d"]["mean"] == pytest.approx(1.65)
    assert facts["b"]["type"] == "boolean"
    assert facts["s"]["empty_strings"] == 1
    assert (facts["day"]["range_days"], facts["t"]["range_days"]) == (3, 1)
    assert facts["m"]["type"] == facts["a"]["type"] == "unsupported"
    assert (facts["m"]["null_count"], facts["a"]["null_count"]) == (1, 1)
    assert p.overview_row["missing_cells"] == 9
    assert p.rows_with_missing == 2


def test_duplicates_tell_null_positions_apart(spark):
    rows = [(None, 1), (1, None), (1, None), (None, None), (None, None), (0, 1)]
    assert Profile(spark.createDataFrame(rows, "a int, b int")).duplicate_rows == 2


@pytest.mark.parametrize("missing, severity", [(50, "low"), (51, "moderate"), (200, "moderate"), (201, "high"), (500, "high"), (501, "critical")])
def test_missing_severity_edges(spark, missing, severity):
    df = spark.range(1000).select("id", F.when(F.col("id") >= missing, F.col("id") % 5).alias("v"))
    assert Profile(df).missing_by_column().first()["severity"] == severity


def test_one_row_and_all_null(spark):
    p = Profile(spark.createDataFrame([(1, None, 2.0)], "a int, n string, f double"))
    assert p.overview_row["missing_cells"] == 1
    assert p.types["n"] == "categorical_nominal"
    assert p.quality_row["overall"] == pytest.approx(86.7, abs=0.05)
    assert p.numeric_stats().count() >= 0


def test_ties_go_to_the_smaller_value(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), ("a",), ("c",)], "v string")
    top = [(r["value"], r["n"]) for r in Profile(df).top_categories(2).orderBy("rank").collect()]
    assert top == [("a", 2), ("b", 2)]


def test_hot_values_and_repartition_do_not_change_facts(spark, skewed):
    a, b = Profile(skewed), Profile(skewed.repartition(13, "value"))
    assert a.facts.select("unique_count", "top_count", "type").collect() == b.facts.select("unique_count", "top_count", "type").collect()
    assert a.by_name["key"]["top_count"] == 1000


def test_hybrid_counts_keep_types(spark):
    df = spark.range(20000).selectExpr("id", "id % 7000 as d", "cast(id % 30 as string) as s", "id * 1.5 as f")
    exact, hybrid = Profile(df), Profile(df, distinct="hybrid")
    assert exact.types == hybrid.types
    assert hybrid.by_name["d"]["unique_count"] == pytest.approx(7000, rel=0.05)
    assert hybrid.by_name["id"]["unique_count"] == 20000


def test_histogram_closes_the_last_bin_and_skips_nulls(spark):
    df = spark.createDataFrame([(float(i),) for i in range(11)] + [(None,)], "v double")
    counts = [r["n"] for r in Profile(df).histogram(5).orderBy("bin").collect()]
    assert counts == [2, 2, 2, 2, 3]
    constant = spark.createDataFrame([(4.0,)] * 3, "v double")
    assert sum(r["n"] for r in Profile(constant).histogram(5).collect()) == 3


def test_findings_of_a_constant_target(spark):
    df = spark.range(300).selectExpr("id", "0 as attrition", "cast(id % 3 as string) as department")
    found = Insights(Profile(df)).findings().where("category = 'constant'").collect()
    assert [r["message"] for r in found] == ['column "attrition" is constant']
    assert Needs(Profile(df), "attrition").class_imbalance().count() == 0


@pytest.mark.parametrize("major, fires", [(300, False), (301, True)])
def test_class_imbalance_edge(spark, major, fires):
    df = spark.range(100 + major).select("id", F.when(F.col("id") < 100, "a").otherwise("b").alias("y"))
    assert (Needs(Profile(df), "y").class_imbalance().count() == 1) == fires
