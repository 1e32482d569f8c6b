"""Threshold edges of the semantic types, on hand-written facts."""

import pytest

from tabwright.functions.semantics import target_candidates, with_semantic_type
from tabwright.operators.facts import FACTS_DDL
from tabwright.session import local_table


def typed(spark, id_rule="reference", **facts):
    base = {
        "position": 0, "column_name": "v", "dtype": "string", "kind": "string", "is_integer": False, "total": 1000,
        "non_null": 1000, "null_count": 0, "unique_count": 10, "avg_length": 5.0,
    }
    row = with_semantic_type(local_table(spark, [{**base, **facts}], FACTS_DDL), id_rule).first()
    return row["type"], row["subtype"]


INTEGER = {"kind": "numeric", "dtype": "bigint", "is_integer": True}
REAL = {"kind": "numeric", "dtype": "double"}


@pytest.mark.parametrize(
    "facts, expected",
    [
        ({"unique_count": 20}, ("categorical_nominal", "low_cardinality")),
        ({"unique_count": 21}, ("categorical_nominal", "medium_cardinality")),
        ({"unique_count": 99}, ("categorical_nominal", "medium_cardinality")),
        ({"unique_count": 100}, ("categorical_nominal", "categorical")),
        ({"unique_count": 100, "total": 2000, "non_null": 2000}, ("categorical_nominal", "medium_cardinality")),
        ({"unique_count": 101, "total": 2000, "non_null": 2000}, ("categorical_nominal", "categorical")),
        ({"unique_count": 500}, ("categorical_nominal", "categorical")),
        ({"unique_count": 501}, ("text", "free_text")),
        ({"unique_count": 301, "avg_length": 50.5}, ("text", "free_text")),
        ({"unique_count": 300, "avg_length": 50.5}, ("categorical_nominal", "categorical")),
        ({"unique_count": 301, "avg_length": 50.0}, ("categorical_nominal", "categorical")),
        ({"unique_count": 950, "column_name": "user_id"}, ("text", "free_text")),
        ({"unique_count": 951, "column_name": "user_id"}, ("id", "sequential")),
        ({"unique_count": 951, "column_name": "width"}, ("id", "sequential")),
        ({"unique_count": 951, "non_null": 951, "null_count": 49}, ("id", "sequential")),
        ({"unique_count": 951}, ("text", "free_text")),
        ({"unique_count": 10, "uuid_share": 0.81}, ("id", "uuid")),
        ({"unique_count": 10, "uuid_share": 0.8}, ("categorical_nominal", "low_cardinality")),
        ({"unique_count": 10, "date_share": 1.0}, ("datetime", "datetime")),
        ({"unique_count": 10, "date_share": 0.999}, ("categorical_nominal", "low_cardinality")),
        ({"unique_count": 2, "min_label": "No", "max_label": "Yes"}, ("boolean", "boolean")),
        ({"unique_count": 2, "min_label": "No", "max_label": "yes"}, ("categorical_nominal", "low_cardinality")),
        ({"unique_count": 0, "non_null": 0, "null_count": 1000}, ("categorical_nominal", "low_cardinality")),
        ({**INTEGER, "unique_count": 20}, ("categorical_ordinal", "ordinal_numeric")),
        ({**INTEGER, "unique_count": 21}, ("numeric_discrete", "discrete")),
        ({**INTEGER, "unique_count": 1, "min_label": "0", "max_label": "0"}, ("boolean", "boolean")),
        ({**INTEGER, "unique_count": 1, "min_label": "2", "max_label": "2"}, ("categorical_ordinal", "ordinal_numeric")),
        ({**REAL, "unique_count": 49}, ("categorical_ordinal", "ordinal_encoded")),
        ({**REAL, "unique_count": 50}, ("numeric_continuous", "continuous")),
        ({**REAL, "unique_count": 50, "total": 2000, "non_null": 2000}, ("categorical_ordinal", "ordinal_encoded")),
        ({**REAL, "unique_count": 51, "total": 2000, "non_null": 2000}, ("numeric_continuous", "continuous")),
        ({**REAL, "unique_count": 1000}, ("id", "sequential")),
        ({"kind": "datetime", "dtype": "timestamp", "unique_count": 1000}, ("id", "sequential")),
        ({"kind": "other", "dtype": "map<string,int>", "unique_count": 0}, ("unsupported", "other")),
    ],
)
def test_edges(spark, facts, expected):
    assert typed(spark, **facts) == expected


def test_strict_ids_leave_reals_alone(spark):
    assert typed(spark, "strict", **REAL, unique_count=1000)[0] == "numeric_continuous"
    assert typed(spark, "strict", **INTEGER, unique_count=1000)[0] == "id"


def test_target_order(spark):
    rows = [
        {"position": 0, "column_name": "a", "kind": "string", "total": 100, "non_null": 100, "unique_count": 3},
        {"position": 1, "column_name": "label", "kind": "string", "total": 100, "non_null": 100, "unique_count": 2},
        {"position": 2, "column_name": "b", "kind": "string", "total": 100, "non_null": 100, "unique_count": 5},
        {"position": 3, "column_name": "c", "kind": "string", "total": 100, "non_null": 100, "unique_count": 1},
    ]
    typed_rows = with_semantic_type(local_table(spark, rows, FACTS_DDL))
    assert [r["column_name"] for r in target_candidates(typed_rows).collect()] == ["label", "b", "a"]
