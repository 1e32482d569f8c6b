"""Semantic type of a column, as expressions over the facts table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The eight semantic types.
CONTINUOUS = "numeric_continuous"
DISCRETE = "numeric_discrete"
ORDINAL = "categorical_ordinal"
NOMINAL = "categorical_nominal"
DATETIME = "datetime"
TEXT = "text"
ID = "id"
BOOLEAN = "boolean"
NUMERIC_TYPES = [CONTINUOUS, DISCRETE]
CATEGORY_TYPES = [NOMINAL, ORDINAL, BOOLEAN]

# Name parts that hint at an identifier or at a target.
ID_PARTS = ["id", "pk", "uuid", "guid", "key", "index", "identifier"]
TARGET_PARTS = ["target", "label", "y", "class", "category", "output", "prediction"]

# Two-valued text sets that mean a boolean, as (smaller, larger).
BOOLEAN_PAIRS = [("False", "True"), ("false", "true"), ("no", "yes"), ("No", "Yes"), ("N", "Y"), ("n", "y")]


def _name_hits(parts: list[str]) -> Column:
    lowered = F.lower("column_name")
    hits = [F.when(lowered.contains(p), 1).otherwise(0) for p in parts]
    total = hits[0]
    for hit in hits[1:]:
        total = total + hit
    return total


def with_semantic_type(facts: DataFrame, id_rule: str = "reference") -> DataFrame:
    """Add `type` and `subtype`. `id_rule='strict'` lets only integers and strings be ids by value."""
    kind, unique, total = F.col("kind"), F.col("unique_count"), F.col("total")
    ratio = F.when(total > 0, unique / total).otherwise(0.0)
    uuid = F.coalesce(F.col("uuid_share"), F.lit(0.0)) > 0.8
    named_id = (_name_hits(ID_PARTS) > 0) & (ratio > 0.95)
    valued_id = (unique == F.col("non_null")) & (ratio > 0.95)
    if id_rule == "strict":
        eligible = F.col("is_integer") | (kind == "string")
        named_id, valued_id = named_id & eligible, valued_id & eligible
    pair = F.struct("min_label", "max_label")
    text_pairs = F.array(*[F.struct(F.lit(a).alias("min_label"), F.lit(b).alias("max_label")) for a, b in BOOLEAN_PAIRS])
    is_boolean = (kind == "boolean") | (
        F.col("is_integer") & F.col("min_label").isin("0", "1") & F.col("max_label").isin("0", "1")
    ) | ((kind == "string") & (unique == 2) & F.array_contains(text_pairs, pair))
    long_text = (F.col("avg_length") > 50) & (ratio > 0.3)
    cases = [
        (kind == "other", "unsupported", kind),
        (F.col("non_null") == 0, NOMINAL, F.lit("low_cardinality")),
        (named_id | valued_id | uuid, ID, F.when(uuid, "uuid").otherwise("sequential")),
        ((kind == "datetime") | (F.col("date_share") == 1.0), DATETIME, F.lit("datetime")),
        (is_boolean, BOOLEAN, F.lit("boolean")),
        (F.col("is_integer") & (unique <= 20), ORDINAL, F.lit("ordinal_numeric")),
        (F.col("is_integer"), DISCRETE, F.lit("discrete")),
        ((kind == "numeric") & (ratio < 0.05) & (unique <= 50), ORDINAL, F.lit("ordinal_encoded")),
        (kind == "numeric", CONTINUOUS, F.lit("continuous")),
        (unique <= 20, NOMINAL, F.lit("low_cardinality")),
        ((unique <= 100) & (ratio < 0.1), NOMINAL, F.lit("medium_cardinality")),
        ((ratio > 0.5) | long_text, TEXT, F.lit("free_text")),
    ]
    type_, subtype = None, None
    for test, label, sub in cases:
        type_ = F.when(test, label) if type_ is None else type_.when(test, label)
        subtype = F.when(test, sub) if subtype is None else subtype.when(test, sub)
    return facts.withColumns(
        {"type": type_.otherwise(NOMINAL), "subtype": subtype.otherwise("categorical")}
    )


def target_candidates(facts: DataFrame) -> DataFrame:
    """Columns that could be a target, best first by score, distinct values and position."""
    hits = _name_hits(TARGET_PARTS)
    classes = F.col("type").isin(CATEGORY_TYPES) & F.col("unique_count").between(2, 100)
    continuous = F.col("type") == CONTINUOUS
    return (
        facts.where(classes | continuous)
        .select(
            "position",
            "column_name",
            "type",
            (hits + F.when(classes, 2).otherwise(1)).cast("bigint").alias("score"),
            F.when(continuous, 0).otherwise(F.col("unique_count")).cast("bigint").alias("classes"),
        )
        .orderBy(F.desc("score"), F.desc("classes"), "position")
    )
