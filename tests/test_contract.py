"""The registered queries: a quick part against DuckDB, the rest by shape of the registry."""

import os

import pytest

import __spark_entry__ as entry
from checks.compare import connect, differences

DATA = "/root/testdata/sf0.001"
QUICK = [
    "basic_stats", "top_categories", "missing_by_column", "histogram", "duplicates", "one_hot", "category_codes", "group_rare",
    "undersample", "stratified_split", "classification_metrics", "roc_auc", "regression_metrics", "validate_urls", "sample_cap",
    "dataset_fingerprint", "union_chunks",
]


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries)
    assert len(queries) > 150 and set(QUICK) <= set(oracles)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not mounted")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_sql(spark, name):
    assert differences(entry.queries()[name](spark, DATA), connect(DATA), entry.oracle_sql()[name]) == []
