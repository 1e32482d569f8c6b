"""Reproducible train/test splits and folds that do not depend on partitioning."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import named, order_hash, row_digest
from tabwright.operators.ranking import below_share, by_cutoff, group_cutoffs, group_sizes, hash_bucket, hash_cutoffs, within_cutoff

TEST_SHARE, SEED, FOLDS = 0.2, 42, 5


def row_keys(df: DataFrame, keys: list[str] | None) -> list[Column]:
    """Key columns, or a digest of the whole row."""
    return [named(k) for k in keys] if keys else row_digest(df)


def hash_split(df: DataFrame, keys: list[str] | None = None, share: float = TEST_SHARE, seed: int = SEED) -> DataFrame:
    """Add `is_test` by a hash threshold: one narrow projection, stratified in expectation."""
    return df.withColumn("is_test", below_share(share, seed, *row_keys(df, keys)))


def exact_split(
    df: DataFrame, keys: list[str], label: str | None = None, share: float = TEST_SHARE, seed: int = SEED
) -> DataFrame:
    """Add `is_test` with exact sizes: per class the nearest whole number, else ceil(share * n).

    `keys` must identify a row; there may be any number of classes. Only counts per hash prefix are shuffled.
    """
    hash_ = order_hash(F.lit(str(seed)), *[named(k) for k in keys])
    if label is None:
        wanted = {"": math.ceil(share * df.count())}
        return df.withColumn("is_test", within_cutoff(hash_, hash_cutoffs(df, hash_, wanted)))
    group = named(label)
    wanted = group_sizes(df, group).select("g", F.floor(F.lit(share) * F.col("n") + 0.5).alias("k"))
    return by_cutoff(df, hash_, group_cutoffs(df, hash_, wanted, group), group, "is_test")


def with_fold(df: DataFrame, keys: list[str] | None = None, folds: int = FOLDS, seed: int = SEED) -> DataFrame:
    """Add `fold` in [0, folds), independent of the split with the same seed."""
    return df.withColumn("fold", hash_bucket(folds, seed + 1, *row_keys(df, keys)).cast("int"))
