"""Exact selection and ranking without a single-task sort.

Selection (`hash_cutoffs`): the k rows with the smallest hash per group, found by counting
rows per hash prefix, descending only into the prefix that holds the k-th row. Counts are
combined map-side, so a group with a third of all rows costs no more than any other.

Ranking (`numbered`): values are range-partitioned, numbered inside each partition and
shifted by the sizes of the partitions before it. Texts are cut into ranges by short edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import named, order_hash
from tabwright.session import cut_lineage, stored

PREFIX_STEP = 3  # hex digits per level: 4096 buckets
FINAL_BUCKET = 50_000  # most hashes of all groups together fetched at the last level
MAX_GROUPS = 1_000  # a label with more values is no class label
HASH_LENGTH = 32
EDGE_SAMPLE = 20  # sampled texts for each range partition
EDGE_LENGTH = 256


def class_counts(df: DataFrame, label: Column) -> dict[str, int]:
    """{class as text: rows} of a label column, nulls left out; fails on more than MAX_GROUPS classes."""
    counted = df.where(label.isNotNull()).groupBy(label.cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    rows = counted.limit(MAX_GROUPS + 1).collect()
    if len(rows) > MAX_GROUPS:
        raise ValueError(f"the label has more than {MAX_GROUPS} classes")
    return {r["g"]: r["n"] for r in rows}


def hash_cutoffs(df: DataFrame, hash_: Column, wanted: dict, group: Column | None = None) -> dict:
    """{group: largest hash that still belongs to its `wanted[group]` smallest}.

    `None` as a cutoff means the group is kept whole. Groups are class labels or the like;
    hashes must be unique per row for the count to be exact.
    """
    key = F.lit("") if group is None else group.cast("string")
    base = df.select(key.alias("g"), hash_.alias("h"))
    left = {str(g): k for g, k in wanted.items()}
    found: dict[str, str | None] = {g: "" for g, k in left.items() if k <= 0}
    prefix: dict[str, str] = {}
    todo = {g: k for g, k in left.items() if k > 0}
    length = 0
    while todo:
        length += PREFIX_STEP
        narrowed = base.where(_in_prefix({g: prefix.get(g, "") for g in todo}))
        counts = narrowed.groupBy("g", F.substring("h", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        running = F.sum("n").over(Window.partitionBy("g").orderBy("p"))
        need = F.create_map(*[x for g, k in todo.items() for x in (F.lit(g), F.lit(k))])
        edge = (
            counts.withColumn("upto", running)
            .where((F.col("upto") >= need[F.col("g")]) & (F.col("upto") - F.col("n") < need[F.col("g")]))
            .collect()
        )
        edges = {r["g"]: r for r in edge}
        last = {}
        for g in list(todo):
            if g not in edges:  # fewer rows than wanted
                found[g] = None
                todo.pop(g)
                continue
            prefix[g] = edges[g]["p"]
            todo[g] -= edges[g]["upto"] - edges[g]["n"]
            if edges[g]["n"] <= max(FINAL_BUCKET // len(left), 1) or length >= HASH_LENGTH:
                last[g] = todo.pop(g)
        if last:
            hashes = base.where(_in_prefix({g: prefix[g] for g in last}))
            if length >= HASH_LENGTH:
                hashes = hashes.distinct()
            bucket: dict[str, list] = {}
            for r in hashes.collect():
                bucket.setdefault(r["g"], []).append(r["h"])
            for g, k in last.items():
                ordered = sorted(bucket[g])
                found[g] = ordered[min(k, len(ordered)) - 1]
    return found


def group_cutoffs(df: DataFrame, hash_: Column, wanted: DataFrame, group: Column) -> DataFrame:
    """(g, cutoff) for any number of groups: rows with a hash up to `cutoff` are the `k` smallest of their group.

    wanted: (g, k) with the group as text. Rows are counted by hash prefix, and only prefixes in which a group's
    k-th row lies are looked into further, so what moves is counts; the groups stay a table.
    """
    base = df.select(group.cast("string").alias("g"), hash_.alias("h"))
    state = wanted.where("k > 0").select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.lit("").alias("_p"))
    found = wanted.where("k <= 0").select("g", F.lit("").alias("cutoff"))
    for length in range(PREFIX_STEP, HASH_LENGTH + PREFIX_STEP, PREFIX_STEP):
        inside = base.join(state, (F.col("g") == F.col("_g")) & F.col("h").startswith(F.col("_p")))
        counts = inside.groupBy("g", "_k", F.substring("h", 1, length).alias("p")).agg(F.count(F.lit(1)).alias("n"))
        upto = F.sum("n").over(Window.partitionBy("g").orderBy("p"))
        edge = counts.withColumn("upto", upto).where("upto >= _k and upto - n < _k")
        edge = cut_lineage(edge.select("g", "p", "n", (F.col("_k") - F.col("upto") + F.col("n")).alias("k")))
        # fewer rows than wanted: the group is kept whole ("g" lies above every hash)
        found = found.unionAll(state.join(edge, F.col("_g") == F.col("g"), "left_anti").select(F.col("_g"), F.lit("g")))
        last = (F.col("k") == F.col("n")) | F.lit(length >= HASH_LENGTH)
        found = found.unionAll(edge.where(last).select("g", F.concat("p", F.lit("g"))))
        state = edge.where(~last).select(F.col("g").alias("_g"), F.col("k").alias("_k"), F.col("p").alias("_p"))
        if state.isEmpty():
            break
    return cut_lineage(found)


def by_cutoff(df: DataFrame, hash_: Column, cutoffs: DataFrame, group: Column, out: str) -> DataFrame:
    """Append `out`: does the row belong to the selected ones of its group; false for rows without a group.

    Spark broadcasts the cutoffs where they are small and splits a hot group where they are not.
    """
    held = cutoffs.select(F.col("g").alias("_g"), F.col("cutoff").alias("_cutoff"))
    met = df.join(held, group.cast("string") == F.col("_g"), "left")
    return met.withColumn(out, F.coalesce(hash_ <= F.col("_cutoff"), F.lit(False))).drop("_g", "_cutoff")


def group_sizes(df: DataFrame, group: Column) -> DataFrame:
    """(g, n): rows of each group, as text; rows without one are left out."""
    return df.where(group.isNotNull()).groupBy(group.cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for item in values.items() for x in item])


def _in_prefix(prefixes: dict[str, str]) -> Column:
    """Rows of the given groups whose hash starts with the group's prefix."""
    return F.coalesce(F.col("h").startswith(_literal_map(prefixes)[F.col("g")]), F.lit(False))


def within_cutoff(hash_: Column, cutoffs: dict, group: Column | None = None) -> Column:
    """True for the selected rows; a narrow filter with one literal per group."""
    # a hash consists of hex digits, so "g" lies above and "" below every hash
    limits = {g: "g" if cutoff is None else cutoff for g, cutoff in cutoffs.items()}
    if group is None:
        return hash_ <= F.lit(limits[""])
    return hash_ <= F.coalesce(_literal_map(limits)[group.cast("string")], F.lit(""))


def sample_rows(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """Exactly n rows (or all, when there are fewer), chosen by the hash of unique keys."""
    hash_ = order_hash(*[named(k) for k in keys])
    return df.where(within_cutoff(hash_, hash_cutoffs(df, hash_, {"": n})))


def sample_share(df: DataFrame, share: float, *keys: str, seed: int = 42) -> DataFrame:
    """About `share` of the rows by a hash threshold; one narrow filter, any size of data and of share."""
    return df.where(below_share(share, seed, *[named(k) for k in keys]))


def _edges(values: DataFrame, column: str, parts: int, about: int) -> list[str]:
    """Texts that cut the values into ranges of about equal size, as short as that allows.

    They come from a hashed sample that is sorted in one task; only its cut edges reach the driver.
    """
    share = int((1 << 30) * min(1.0, EDGE_SAMPLE * parts / max(about, 1)))
    some = values.select(named(column).alias("_v")).where(F.pmod(F.xxhash64(named(column)), F.lit(1 << 30)) < share)
    longest, length = some.agg(F.max(F.length("_v"))).first()[0] or 0, EDGE_LENGTH
    while True:
        cut = some.select(F.substring("_v", 1, length).alias("_v")).agg(F.array_sort(F.collect_list("_v")).alias("_all"))
        place = F.transform(F.sequence(F.lit(1), F.lit(parts - 1)), lambda i: F.floor(i * F.size("_all") / parts).cast("int"))
        edges = F.array_distinct(F.transform(place, lambda i: F.get("_all", i)))
        found = [e for e in cut.select(edges.alias("e")).first()["e"] if e is not None] if parts > 1 else []
        if length >= longest or 2 * len(found) >= parts - 1:
            return found
        length *= 8  # many values begin alike


def _in_order(values: DataFrame, column: str, about: int | None) -> DataFrame:
    """The rows in range partitions by a column; Spark's own ranges would fetch whole sampled texts to the driver."""
    if not isinstance(values.schema[column].dataType, T.StringType):
        return values.repartitionByRange(F.col(column))
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges = F.array(*[F.lit(e) for e in _edges(values, column, parts, values.count() if about is None else about)]).cast("array<string>")
    at = F.size(F.filter(edges, lambda e: e <= named(column)))
    return values.repartitionById(parts, at)


def numbered(values: DataFrame, column: str, out: str, bound: int | None, about: int | None = None) -> DataFrame:
    """0-based position of every row in the order of the distinct `column`.

    `bound` is the known number of rows; below 100k one window is cheap and bounded. `about` is a rough number of them,
    which saves a count of texts.
    """
    if bound is not None and bound <= 100_000:
        return values.withColumn(out, (F.row_number().over(Window.orderBy(column)) - 1).cast("bigint"))
    placed = _in_order(values, column, about).sortWithinPartitions(column).withColumn("_id", F.monotonically_increasing_id())
    # the id holds the partition and, in its low 33 bits, the row in it
    split = stored(placed.withColumns({"_part": F.shiftright("_id", 33), "_row": F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))}).drop("_id"), "numbered")
    sizes = split.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")
    offsets = sizes.select("_part", before.alias("_before"))  # one row per partition
    return (
        split.join(F.broadcast(offsets), "_part")
        .withColumn(out, (F.col("_before") + F.col("_row")).cast("bigint"))
        .drop("_part", "_row", "_before")
    )


def running_total(df: DataFrame, order: str, value: str, out: str, bound: int, group: str | None = None) -> DataFrame:
    """Sum of `value` over the rows before each row in `order` (per `group`); order values are unique.

    `bound` is the largest number of rows: up to 100k one window per group is enough,
    beyond that every range partition sums itself and adds what lies before it.
    """
    keys = [group] if group else []
    if bound <= 100_000:
        before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return df.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)))
    ranged = df.repartitionByRange(*[F.col(k) for k in keys], F.col(order)).withColumn("_part", F.spark_partition_id())
    split = cut_lineage(ranged)
    sums = split.groupBy(*keys, "_part").agg(F.sum(value).alias("_sum"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, "_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        split.withColumn("_own", F.coalesce(F.sum(value).over(inside), F.lit(0)))
        .join(F.broadcast(offsets), [*keys, "_part"])
        .withColumn(out, F.col("_before") + F.col("_own"))
        .drop("_part", "_own", "_before")
    )


def _seeded(seed: int, *keys: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]))


def below_share(share: float, seed: int, *keys: Column) -> Column:
    """True for about `share` of the keys: 60 bits of an md5 of seed and keys, below share x 2^60."""
    return F.conv(F.substring(_seeded(seed, *keys), 1, 15), 16, 10).cast("bigint") < F.lit(int(share * 2**60))


def hash_bucket(buckets: int, seed: int, *keys: Column) -> Column:
    """Reproducible bucket of a row: 32 bits of an md5 of seed and keys, modulo `buckets`."""
    return F.pmod(F.conv(F.substring(_seeded(seed, *keys), 1, 8), 16, 10).cast("bigint"), F.lit(buckets))
