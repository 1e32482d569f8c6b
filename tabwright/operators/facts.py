"""Column facts: one row per column, from two scans of the data.

Scan 1 aggregates counts, moments, lengths and patterns to one row per column.
Scan 2 counts every distinct value once: the columns are unpivoted into three typed
families (whole numbers, reals, texts), grouped with map-side combining, and reduced to
one row per column (distinct values, mode, entropy terms). A value that fills a third of
the rows is one partial row per task, so hot values do not skew the shuffle.
"""

from __future__ import annotations

import functools
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import (
    DIGITS_PATTERN,
    INTEGERS,
    UUID_PATTERN,
    as_time,
    dtype_name,
    exact_key,
    kind_of,
    named,
)
from tabwright.functions.semantics import with_semantic_type
from tabwright.session import batches, local_table

COLUMNS_PER_JOB = 60
MICROS_PER_DAY = 86_400_000_000
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"

# Distinct-count modes: every column exactly, or a 1 % sketch first and the exact count
# only where the sketch lies near a rule's threshold.
EXACT, HYBRID = "exact", "hybrid"

FACTS_DDL = """
position int, column_name string, dtype string, kind string, is_integer boolean,
total bigint, non_null bigint, null_count bigint, null_pct double, unique_count bigint,
mean double, std double, std_pop double, min_num double, max_num double,
skewness double, kurtosis double, zeros bigint, negative bigint, max_abs double,
avg_length double, max_length bigint, min_length bigint, empty_strings bigint,
uuid_share double, digit_share double, date_share double,
min_label string, max_label string, min_date string, max_date string, range_days bigint,
top_count bigint, top_value string, entropy double, balance double, bytes bigint
"""


def _long(df: DataFrame, columns: dict[int, Column]) -> DataFrame:
    """(slot, x): the given columns below each other, nulls left out."""
    listed = [c.alias(str(i)) for i, c in columns.items()]
    if len(listed) == 1:
        long = df.select(F.lit(str(next(iter(columns)))).alias("slot"), listed[0].alias("x"))
    else:
        long = df.select(*listed).unpivot([], [str(i) for i in columns], "slot", "x")
    return long.where("x is not null")


def numeric_scan(df: DataFrame, fields: list, shape: bool = True) -> dict[int, dict]:
    """{position: count, mean, extremes and, with `shape`, population deviation, skewness, kurtosis}.

    Powers of the distance to the mean are plain sums, which costs a second narrow pass but
    far less work per value than running moments, and is the more exact method.
    """
    x = F.col("x")
    finite = F.when(F.abs(x) < float("inf"), x)
    numbers = {i: named(f.name).cast("double") for i, f in fields}
    first = _long(df, numbers).groupBy("slot").agg(
        F.count(x).alias("non_null"),
        F.avg(x).alias("mean"),
        F.min(x).alias("min_num"),
        F.max(x).alias("max_num"),
        F.min(finite).alias("min_finite"),
        F.max(finite).alias("max_finite"),
        F.count_if(x == 0).alias("zeros"),
        F.count_if(x < 0).alias("negative"),
    )
    found = {int(r["slot"]): r.asDict() for r in first.collect()}
    if not shape or not found:
        return found
    for own in found.values():  # a column with an infinite value has no spread
        own |= {"std_pop": None, "skew_pop": None, "kurt_pop": None}
    # distances as shares of the largest one: their powers neither vanish nor overflow
    scales = {i: max(r["max_num"] - r["mean"], r["mean"] - r["min_num"]) for i, r in found.items()}
    plain = [i for i, scale in scales.items() if math.isfinite(scale)]
    centred = {i: (numbers[i] - F.lit(found[i]["mean"])) / F.lit(scales[i] or 1.0) for i in plain}
    if not centred:
        return found
    second = _long(df, centred).groupBy("slot").agg(
        F.avg(x * x).alias("m2"), F.avg(x * x * x).alias("m3"), F.avg(x * x * x * x).alias("m4")
    )
    for r in second.collect():
        own = found[int(r["slot"])]
        flat = own["min_num"] == own["max_num"] or not r["m2"]  # rounding may leave a trace of spread
        own["std_pop"] = 0.0 if flat else r["m2"] ** 0.5 * scales[int(r["slot"])]
        own["skew_pop"] = None if flat else r["m3"] / r["m2"] ** 1.5
        own["kurt_pop"] = None if flat else r["m4"] / r["m2"] ** 2 - 3
    return found


def _string_scan(df: DataFrame, fields: list) -> dict[int, dict]:
    x, length, time = F.col("x"), F.length("x"), F.col("t")
    read = _long(df, {i: named(f.name).cast("string") for i, f in fields}).withColumn("t", as_time(x))
    found = read.groupBy("slot").agg(
        F.count(x).alias("non_null"),
        F.avg(length).alias("avg_length"),
        F.max(length).cast("bigint").alias("max_length"),
        F.min(length).cast("bigint").alias("min_length"),
        F.count_if(x == "").alias("empty_strings"),
        F.count_if(x.rlike(UUID_PATTERN)).alias("uuids"),
        F.count_if(x.rlike(DIGITS_PATTERN)).alias("digits"),
        F.count(time).alias("dates"),
        F.date_format(F.min(time), TIME_FORMAT).alias("min_date"),
        F.date_format(F.max(time), TIME_FORMAT).alias("max_date"),
        F.floor((F.unix_micros(F.max(time)) - F.unix_micros(F.min(time))) / MICROS_PER_DAY).alias("range_days"),
        F.sum(F.octet_length(x).cast("bigint")).alias("text_bytes"),
    )
    return {int(r["slot"]): r.asDict() for r in found.collect()}


def _other_scan(df: DataFrame, fields: list) -> dict:
    """Row count, and the non-null count and time range of columns that are neither number nor text."""
    exprs = [F.count(F.lit(1)).alias("total")]
    for i, f in fields:
        c = named(f.name)
        exprs.append(F.count(c).alias(f"{i}:non_null"))
        if kind_of(f.dataType) == "datetime":
            span = exact_key(f.name, f.dataType)[1]
            unit = 1 if f.dataType.typeName() == "date" else MICROS_PER_DAY
            exprs += [
                F.date_format(F.min(c), TIME_FORMAT).alias(f"{i}:min_date"),
                F.date_format(F.max(c), TIME_FORMAT).alias(f"{i}:max_date"),
                F.floor((F.max(span) - F.min(span)) / unit).alias(f"{i}:range_days"),
            ]
    return df.agg(*exprs).first().asDict()


def non_null_counts(df: DataFrame) -> dict:
    """Rows, and present values of every column, in one narrow pass per COLUMNS_PER_JOB columns."""
    total, present = 0, {}
    for group in batches(list(df.columns), COLUMNS_PER_JOB):
        row = df.agg(F.count(F.lit(1)).alias("total"), *[F.count(named(c)).alias(f"c{i}") for i, c in enumerate(group)]).first()
        total = row["total"]
        present |= {c: row[f"c{i}"] for i, c in enumerate(group)}
    return {"total": total, "non_null": present}


def scan(df: DataFrame, approx: bool = False) -> list[dict]:
    """Raw aggregates per column; every column is read once, by the scan of its kind.

    Numbers and texts are each unpivoted and aggregated by column, so the generated
    code stays the size of one column's aggregate however wide the table is.
    """
    rows = []
    total = None
    for group in batches(list(enumerate(df.schema.fields)), COLUMNS_PER_JOB):
        found: dict[int, dict] = {i: {"non_null": 0} for i, _ in group}
        for kind, scanner in (("numeric", numeric_scan), ("string", _string_scan)):
            fields = [(i, f) for i, f in group if kind_of(f.dataType) == kind]
            if fields:
                for i, r in scanner(df, fields).items():
                    found[i] |= r
        others = [(i, f) for i, f in group if kind_of(f.dataType) not in ("numeric", "string")]
        if others or total is None:
            counted = _other_scan(df, others)
            total = counted.pop("total")
            for key, value in counted.items():
                i, name = key.split(":")
                found[int(i)][name] = value
        if approx:
            sketched = [(i, f) for i, f in group if kind_of(f.dataType) != "other"]
            row = df.agg(*[F.approx_count_distinct(named(f.name), 0.01).alias(str(i)) for i, f in sketched]).first()
            for i, _ in sketched:
                found[i]["sketch"] = row[str(i)]
        for i, f in group:
            rows.append(
                {
                    "position": i,
                    "column_name": f.name,
                    "dtype": dtype_name(f.dataType),
                    "kind": kind_of(f.dataType),
                    "is_integer": isinstance(f.dataType, INTEGERS),
                    "width": _width(f),
                    "total": total,
                    **found[i],
                }
            )
    return rows


def _width(field) -> int:
    fixed = {"boolean": 1, "tinyint": 1, "smallint": 2, "int": 4, "float": 4, "date": 4}
    return fixed.get(field.dataType.simpleString(), 8)


def value_counts(df: DataFrame, columns: list[str], labels: bool = False) -> dict[str, DataFrame]:
    """{family: (slot, value, n)}: how often every non-null value of every column occurs.

    With `labels` long texts are kept as they are, so that they can be shown.
    """
    families: dict[str, list] = {}
    for i, f in enumerate(df.schema.fields):
        if f.name in set(columns) and kind_of(f.dataType) != "other":
            family, key = exact_key(f.name, f.dataType)
            if labels and family == "text":
                key = named(f.name).cast("string")
            families.setdefault(family, []).append((str(i), key.alias(str(i))))
    counted = {}
    for family, members in families.items():
        names, keys = zip(*members)
        if len(names) == 1:
            long = df.select(F.lit(names[0]).alias("slot"), *[k.alias("value") for k in keys])
        else:
            long = df.select(*keys).unpivot([], list(names), "slot", "value")
        counted[family] = long.where("value is not null").groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    return counted


def _value_facts(df: DataFrame, columns: list[str], non_null: dict[int, int]) -> dict[int, dict]:
    """Distinct count, largest count and entropy per column; labels where there are at most two values.

    All aggregation buffers have a fixed width, so both groupings are hash aggregates.
    """
    if not columns:
        return {}
    share = F.col("n") / F.element_at(
        F.create_map(*[x for i, n in non_null.items() for x in (F.lit(str(i)), F.lit(max(n, 1)))]), F.col("slot")
    )
    parts = [
        counted.groupBy("slot").agg(
            F.count(F.lit(1)).alias("unique_count"),
            F.max("n").alias("top_count"),
            (-F.sum(share * F.log2(share + F.lit(1e-10)))).alias("entropy"),
        )
        for counted in value_counts(df, columns).values()
    ]
    found = {int(r["slot"]): r.asDict() for r in functools.reduce(DataFrame.unionByName, parts).collect()}
    few = [df.columns[i] for i, v in found.items() if v["unique_count"] <= 2]
    if few:
        labelled = [
            c.select("slot", F.col("value").cast("string").alias("value"), "n")
            for c in value_counts(df, few, labels=True).values()
        ]
        seen: dict[int, list] = {}
        for r in functools.reduce(DataFrame.unionByName, labelled).collect():  # two rows per column
            seen.setdefault(int(r["slot"]), []).append((r["value"], r["n"]))
        for i, values in seen.items():
            values.sort()
            found[i] |= {
                "min_label": values[0][0],
                "max_label": values[-1][0],
                "top_value": min(values, key=lambda v: (-v[1], v[0]))[0],
            }
    return found


def collect_facts(df: DataFrame, distinct: str = EXACT, scanned: list[dict] | None = None) -> list[dict]:
    """Facts of every column as driver-side rows (bounded by the number of columns)."""
    rows = scanned or scan(df, approx=distinct == HYBRID)
    wanted = [r["column_name"] for r in rows if r["kind"] != "other"]
    if distinct == HYBRID:
        wanted = [r["column_name"] for r in rows if r["kind"] != "other" and _near_threshold(r)]
    non_null = {r["position"]: r["non_null"] for r in rows}
    values: dict[int, dict] = {}
    for group in batches(wanted, COLUMNS_PER_JOB):
        values |= _value_facts(df, group, non_null)
    return [_finish(r, values.get(r["position"], {})) for r in rows]


def value_bytes(r: dict) -> int:
    """Bytes of the values of a column: text as UTF-8, everything else by the width of its type."""
    return r.get("text_bytes") or 0 if r["kind"] == "string" else r["width"] * r["non_null"]


def _near_threshold(row: dict) -> bool:
    """Does a rule depend on the exact distinct count, given a 1 % sketch of it?"""
    sketch, ratio = row["sketch"], row["sketch"] / max(row["total"], 1)
    if sketch <= 150 or ratio >= 0.85:
        return True
    return row["kind"] == "string" and ratio < 0.55  # may be nominal, whose balance is reported


def _finish(r: dict, v: dict) -> dict:
    n, total = r["non_null"], r["total"]
    unique = v.get("unique_count", min(r.get("sketch", 0), n))
    top = v.get("top_count")
    balance = None
    if top is not None:
        spare = max(1 - 1 / unique, 1e-10)
        balance = 0.0 if unique <= 1 else max(0.0, min(1.0, 1 - (top / n - 1 / unique) / spare))
    g1, g2 = r.get("skew_pop"), r.get("kurt_pop")
    skew = kurt = None
    if g1 is not None and n > 2:
        skew = g1 * (n * (n - 1)) ** 0.5 / (n - 2)
    if g2 is not None and n > 3:
        kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)
    out = {
        **r,
        "null_count": total - n,
        "null_pct": (total - n) / total * 100 if total else 0.0,
        "unique_count": unique,
        "std": r["std_pop"] * (n / (n - 1)) ** 0.5 if r.get("std_pop") is not None and n > 1 else None,
        "skewness": skew,
        "kurtosis": kurt,
        "top_count": top,
        "top_value": v.get("top_value"),
        "entropy": v.get("entropy"),
        "balance": balance,
        "min_label": v.get("min_label"),
        "max_label": v.get("max_label"),
        "bytes": value_bytes(r),
    }
    for share, count in (("uuid_share", "uuids"), ("digit_share", "digits"), ("date_share", "dates")):
        out[share] = out[count] / n if count in out and n else None
    if r.get("min_num") is not None:
        out["max_abs"] = max(abs(r["min_num"]), abs(r["max_num"]))
    return out


def facts_table(df: DataFrame, rows: list[dict], id_rule: str = "reference") -> DataFrame:
    """The facts as a DataFrame with the semantic type and subtype of every column."""
    names = [part.split()[0] for part in FACTS_DDL.replace("\n", " ").split(",")]
    plain = [{k: r.get(k) for k in names} for r in rows]
    return with_semantic_type(local_table(df.sparkSession, plain, FACTS_DDL), id_rule)


def top_values(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """(position, column_name, rank, value, n) of the k most frequent values; ties by value.

    The rank filter is pushed below the shuffle by Spark (window group limit), so each task
    forwards at most k rows per column.
    """
    parts = []
    for counted in value_counts(df, columns, labels=True).values():
        rank = F.row_number().over(Window.partitionBy("slot").orderBy(F.desc("n"), F.asc("value")))
        ranked = counted.withColumn("rank", rank).where(F.col("rank") <= k)
        parts.append(ranked.select("slot", "rank", F.col("value").cast("string").alias("value"), "n"))
    ranked = functools.reduce(DataFrame.unionByName, parts)
    return ranked.select(
        F.col("slot").cast("int").alias("position"),
        F.element_at(F.array(*[F.lit(c) for c in df.columns]), F.col("slot").cast("int") + 1).alias("column_name"),
        "rank",
        "value",
        "n",
    )
