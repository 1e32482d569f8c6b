"""Replace a column's values by a fitted mapping, whatever the size of the mapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import named
from tabwright.session import BROADCAST_ROWS, cut_lineage

HOT_SHARE = 0.001  # a value above this share of rows is hot; there are at most 1000 of them
BROADCAST_BYTES = 64 * 1024 * 1024
SALTS = 1024


def value_bound(df: DataFrame, column: str) -> tuple[int, int]:
    """(rows, bytes) that a table of the column's distinct values stays below."""
    row = df.agg(
        F.approx_count_distinct(named(column)).alias("n"),
        F.max(F.octet_length(named(column).cast("string"))).alias("width"),
    ).first()
    rows = int(row["n"] * 1.2) + 1  # the sketch's deviation is 5 %
    return rows, rows * ((row["width"] or 0) + 16)


def map_values(
    df: DataFrame,
    column: str,
    mapping: DataFrame,
    bound: tuple[int, int],
    out: str,
    weight: str | None = None,
    source: str | None = None,
) -> DataFrame:
    """Left join of `mapping` (value, <source or out>[, weight]) onto `df[column]`, as column `out`.

    `bound` is the mapping's largest number of rows and bytes. Within BROADCAST_ROWS and
    BROADCAST_BYTES it is broadcast. A larger one is joined by shuffle in one pass over `df`: hot values (known
    from `weight`, the value's row count) first meet a broadcast of those few, and their rows, like
    rows with null, then carry a salt that no mapping row has, so no task receives a hot key.
    """
    mapping = mapping.select(
        F.col("value").alias("_value"),
        named(source or out).alias("_mapped"),
        *([named(weight).alias("_weight")] if weight else []),
    )
    return _mapped(df, named(column), mapping, bound, weight is not None).select(
        *[named(c) for c in df.columns], F.col("_mapped").alias(out)
    )


def _mapped(df: DataFrame, key, mapping: DataFrame, bound: tuple[int, int], weighted: bool) -> DataFrame:
    pairs = mapping.select("_value", "_mapped")
    if bound[0] <= BROADCAST_ROWS and bound[1] <= BROADCAST_BYTES:
        return _joined(df, key, F.broadcast(pairs))
    if not weighted:
        return _joined(df, key, pairs)
    mapping = cut_lineage(mapping)  # used three times below
    sizes = mapping.agg(F.sum("_weight").alias("total")).first()
    hot = mapping.where(F.col("_weight") > HOT_SHARE * (sizes["total"] or 0))  # at most 1 / HOT_SHARE values
    width = hot.agg(F.sum(F.octet_length(F.col("_value").cast("string"))).alias("b")).first()["b"]
    if not width or width > BROADCAST_BYTES:  # none, or too long to send; the join is then left to skew handling
        return _joined(df, key, pairs)
    few = hot.select(F.col("_value").alias("_hot_value"), F.col("_mapped").alias("_hot_mapped"))
    salted = df.join(F.broadcast(few), key == F.col("_hot_value"), "left")
    away = F.pmod(F.xxhash64(*[named(c) for c in df.columns]), F.lit(SALTS)) + 1
    salted = salted.withColumn("_salt", F.when(F.col("_hot_value").isNotNull() | key.isNull(), away).otherwise(F.lit(0)))
    cold = mapping.select("_value", "_mapped").withColumn("_cold", F.lit(0).cast("bigint"))
    joined = salted.join(cold, (key == F.col("_value")) & (F.col("_salt") == F.col("_cold")), "left")
    mapped = F.when(F.col("_hot_value").isNotNull(), F.col("_hot_mapped")).otherwise(F.col("_mapped"))
    return joined.select(*[named(c) for c in df.columns], mapped.alias("_mapped"))


def _joined(df: DataFrame, key, pairs: DataFrame) -> DataFrame:
    return df.join(pairs, key == F.col("_value"), "left").drop("_value")
