"""Synthetic minority rows between near neighbours of one class."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import columns_of, named, nan_to_null, order_hash
from tabwright.operators.neighbors import CELL, distinct_points, nearest
from tabwright.operators.ranking import by_cutoff, group_cutoffs, group_sizes
from tabwright.session import cut_lineage

NEIGHBORS = 5
SEED = 42


def _number(hash_: Column, start: int) -> Column:
    """32 bits of an md5 as a number."""
    return F.conv(F.substring(hash_, start, 8), 16, 10).cast("bigint")


def oversample_smote(
    df: DataFrame, target: str, features: list[str], keys: list[str], k: int = NEIGHBORS, seed: int = SEED, cell: int = CELL
) -> DataFrame:
    """The rows of `df` and as many synthetic ones as each class lacks to the largest, with a flag `synthetic`.

    A class's rows take turns in the order of their hash; each copy lies at a hashed place between its row and a hashed one
    of the row's k nearest of the class (Euclidean over `features`), so a run gives the same rows again. `keys` must
    identify a row. Features become doubles; in synthetic rows all other columns but the target are null.
    The only row of a class is copied; a missing feature of either end stays missing; rows without a
    target are kept and not multiplied.
    """
    wrong = [c for c in features if c not in columns_of(df, "numeric")]
    if wrong or not features:
        raise ValueError(f"not a numeric column: {', '.join(wrong) or 'none is named'}")
    df = nan_to_null(df)
    real = df.select(*[named(c).cast("double").alias(c) if c in features else named(c) for c in df.columns])
    labelled = real.where(named(target).isNotNull())
    sizes = group_sizes(labelled, named(target))
    most = sizes.agg(F.max("n")).first()[0] or 0
    lack = F.lit(most) - F.col("n")
    classes = cut_lineage(sizes.where(lack > 0).select("g", F.floor(lack / F.col("n")).alias("_each"), (lack % F.col("n")).alias("k")))
    label = named(target).cast("string")
    hash_ = order_hash(F.lit(str(seed)), *[named(c) for c in keys])
    minor = labelled.join(classes.select(F.col("g").alias("_class"), "_each"), label == F.col("_class"))
    minor = by_cutoff(minor, hash_, group_cutoffs(minor, hash_, classes.select("g", "k"), named(target)), named(target), "_more")
    x = F.array(*[named(c) for c in features])
    drawn = minor.select(
        label.alias("_label"), x.alias("_x"), hash_.alias("_hash"), named(target).alias("_target"),
        (F.col("_each") + F.col("_more").cast("int")).cast("int").alias("_copies"),
    )
    drawn = drawn.where(F.col("_copies") > 0).withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))

    points = distinct_points(minor, [named(c) for c in features], named(target))
    hits = nearest(points, points, len(features), k, without_self=True, cell=cell)
    near = hits.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("before", "n", "x"))).alias("near"))  # k at most
    graph = points.join(near, F.col("id") == F.col("query"), "left").select("label", "x", "near")

    met = drawn.join(graph, (F.col("_label") == F.col("label")) & (F.col("_x") == F.col("x")))
    dice = F.md5(F.concat_ws("|", "_hash", F.col("_copy").cast("string")))
    last = F.element_at("near", -1)
    known = F.least(last["before"] + last["n"], F.lit(k))
    met = met.withColumns({"_turn": F.pmod(_number(dice, 1), known), "_share": _number(dice, 9) / F.lit(float(1 << 32))})
    other = F.filter("near", lambda h: (h["before"] <= F.col("_turn")) & (F.col("_turn") < h["before"] + h["n"]))[0]["x"]
    met = met.withColumn("_other", F.when(F.col("near").isNull(), F.col("_x")).otherwise(other))
    share = F.coalesce("_share", F.lit(0.0))
    made = {c: F.col("_x")[i] + share * (F.col("_other")[i] - F.col("_x")[i]) for i, c in enumerate(features)}
    made[target] = F.col("_target")
    types = {f.name: f.dataType for f in real.schema.fields}
    rows = met.select(*[made.get(c, F.lit(None)).cast(types[c]).alias(c) for c in real.columns])
    return real.withColumn("synthetic", F.lit(False)).unionAll(rows.withColumn("synthetic", F.lit(True)))
