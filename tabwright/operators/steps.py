"""Fitted preparation steps: plain dictionaries of literals, and how they apply to a DataFrame.

A step is JSON-able. Only `codes` refers to a table (value, code), because a column may
have any number of distinct values.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabwright.functions.columns import as_time, columns_of, kind_of, kinds, named
from tabwright.operators.facts import numeric_scan, top_values
from tabwright.operators.lookup import map_values, value_bound
from tabwright.operators.profile import FENCE
from tabwright.operators.quantiles import exact_quantiles
from tabwright.operators.ranking import numbered
from tabwright.operators.textvec import tfidf_columns
from tabwright.session import batches

MAX_ONE_HOT = 500  # output columns a single column may turn into


# ---- statistics -------------------------------------------------------------------


def counts_of(df: DataFrame, columns: list[str]) -> dict[str, int]:
    found: dict[str, int] = {}
    for group in batches(columns, 200):
        row = df.agg(*[F.count(named(c)).alias(str(i)) for i, c in enumerate(group)]).first()
        found |= {c: row[i] for i, c in enumerate(group)}
    return found


def quantiles_of(df: DataFrame, columns: list[str], probs: list[float]) -> dict[str, list]:
    """Exact quantiles; a sketch of the distinct counts only decides how they are computed."""
    if not columns:
        return {}
    counts = counts_of(df, columns)
    sketch = df.agg(*[F.approx_count_distinct(named(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return exact_quantiles(df, columns, probs, counts, {c: sketch[i] for i, c in enumerate(columns)})


def moments_of(df: DataFrame, columns: list[str], shape: bool = True) -> dict[str, dict]:
    place = {f.name: i for i, f in enumerate(df.schema.fields)}
    fields = [(place[c], df.schema[c]) for c in columns]
    found = numeric_scan(df, fields, shape) if fields else {}
    return {c: found.get(place[c], {}) for c in columns}


def null_shares(df: DataFrame) -> dict[str, float]:
    counts = counts_of(df.withColumn("_one", F.lit(1)), [*df.columns, "_one"])
    total = counts.pop("_one")
    return {c: 1 - n / total if total else 0.0 for c, n in counts.items()}


def modes_of(df: DataFrame, columns: list[str]) -> dict[str, str]:
    """Most frequent value as text, the smallest of tied ones; absent for an all-null column."""
    usable = [c for c in columns if kinds(df)[c] != "other"]
    if not usable:
        return {}
    return {r["column_name"]: r["value"] for r in top_values(df, usable, 1).collect()}


def literal(text: str, dtype: T.DataType) -> Column:
    """A value as `top_values` names it, back in its column's type."""
    if isinstance(dtype, T.DateType):
        return F.date_from_unix_date(F.lit(int(text)))
    if isinstance(dtype, T.TimestampType):
        return F.timestamp_micros(F.lit(int(text)))
    if isinstance(dtype, T.TimestampNTZType):  # through text, so that no time zone is involved
        moment = dt.datetime(1970, 1, 1) + dt.timedelta(microseconds=int(text))
        return F.lit(moment.isoformat(sep=" ")).cast(dtype)
    return F.lit(text).cast(dtype)


# ---- fitting ----------------------------------------------------------------------


def fit_median(df: DataFrame, columns: list[str]) -> dict:
    medians = quantiles_of(df, columns, [0.5])
    return {"op": "fill_number", "values": {c: v[0] for c, v in medians.items() if v[0] is not None}}


def fit_mode(df: DataFrame, columns: list[str], fallback: str = "Unknown") -> dict:
    modes = modes_of(df, columns)
    texts = set(columns_of(df, "string"))
    values = {c: modes.get(c, fallback if c in texts else None) for c in columns}
    return {"op": "fill_mode", "values": {c: v for c, v in values.items() if v is not None}}


def fit_clip_iqr(df: DataFrame, columns: list[str]) -> dict:
    bounds = {}
    for c, (q1, q3) in quantiles_of(df, columns, [0.25, 0.75]).items():
        if q1 is not None:
            bounds[c] = [q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)]
    return {"op": "clip", "bounds": bounds}


def fit_clip_share(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> dict:
    found = quantiles_of(df, columns, [low, high])
    return {"op": "clip", "bounds": {c: v for c, v in found.items() if v[0] is not None}}


def fit_scale(df: DataFrame, columns: list[str], method: str) -> dict:
    """standard (population deviation), minmax, robust (median, IQR) or maxabs; a zero spread becomes 1."""
    scales = {}
    if method == "robust":
        for c, (q1, q2, q3) in quantiles_of(df, columns, [0.25, 0.5, 0.75]).items():
            if q1 is not None:
                scales[c] = [q2, (q3 - q1) or 1.0]
    else:
        for c, m in moments_of(df, columns, shape=method == "standard").items():
            if not m:
                continue
            if method == "standard":
                scales[c] = [m["mean"], m["std_pop"] or 1.0]
            elif method == "minmax":
                scales[c] = [m["min_num"], (m["max_num"] - m["min_num"]) or 1.0]
            elif method == "maxabs":
                scales[c] = [0.0, max(abs(m["min_num"]), abs(m["max_num"])) or 1.0]
            else:
                raise ValueError(f"unknown scaling method {method!r}")
    return {"op": "scale", "method": method, "columns": scales}


def fit_one_hot(df: DataFrame, columns: list[str], drop_first: bool = False) -> list[dict]:
    """One step per column with its sorted distinct values."""
    if not columns:
        return []
    found: dict[str, list] = {c: [] for c in columns}
    for r in top_values(df, columns, MAX_ONE_HOT + 1).collect():
        found[r["column_name"]].append(_native(r["value"], df.schema[r["column_name"]].dataType))
    steps = []
    for c in columns:
        values = sorted(found[c])
        if len(values) > MAX_ONE_HOT:
            raise ValueError(f"column {c} has more than {MAX_ONE_HOT} values; use codes or group rare values first")
        steps.append({"op": "one_hot", "column": c, "values": values[1:] if drop_first else values})
    return steps


def _shown(value, dtype: T.DataType) -> str:
    """A distinct value in the name of its column."""
    start = dt.datetime(1970, 1, 1)
    if isinstance(dtype, T.DateType):
        return str((start + dt.timedelta(days=int(value))).date())
    if kind_of(dtype) == "datetime":
        return (start + dt.timedelta(microseconds=int(value))).isoformat()
    return str(value)


def _native(text: str, dtype: T.DataType):
    if isinstance(dtype, T.BooleanType):
        return text == "1"
    if kind_of(dtype) == "datetime":
        return text  # days or microseconds
    if kind_of(dtype) == "numeric":
        return float(text) if isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)) else int(text)
    return text


def fit_codes(df: DataFrame, column: str, missing: int | None = None) -> tuple[dict, DataFrame]:
    """Step and its table (value, code, n): 0-based position among the sorted distinct values."""
    counted = (
        df.where(named(column).isNotNull())
        .groupBy(named(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    bound = value_bound(df, column)
    rows = counted.count() if bound[0] <= 100_000 else None
    step = {"op": "codes", "column": column, "bound": list(bound), "missing": missing}
    return step, numbered(counted, "value", "code", rows, bound[0])


# ---- applying ---------------------------------------------------------------------


def apply_step(df: DataFrame, step: dict, tables: dict[str, DataFrame] | None = None) -> DataFrame:
    return _APPLY[step["op"]](df, step, tables or {})


def _replace(df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return df.select(*[new[c].alias(c) if c in new else named(c) for c in df.columns])


def _drop_duplicates(df, step, tables):
    nested = columns_of(df, "other")
    if not nested:
        return df.dropDuplicates()
    keys = {f"_key{i}": F.to_json(F.struct(named(c))) for i, c in enumerate(nested)}
    plain = [c for c in df.columns if c not in nested]
    return df.withColumns(keys).dropDuplicates([*plain, *keys]).drop(*keys)


def _drop(df, step, tables):
    return df.select(*[named(c) for c in df.columns if c not in set(step["columns"])])


def date_features(column: str, dtype: T.DataType, weekend: bool = False) -> list[Column]:
    c = as_time(named(column)) if kind_of(dtype) == "string" else named(column)
    parts = {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "dayofweek": F.weekday(c),
        "quarter": F.quarter(c),
    }
    if weekend:
        parts["is_weekend"] = (F.weekday(c) >= 5).cast("int")
    return [e.alias(f"{column}_{k}") for k, e in parts.items()]


def _date_parts(df, step, tables):
    gone = [c for c in step["columns"] if c in df.columns]
    added = [e for c in gone for e in date_features(c, df.schema[c].dataType, step.get("weekend", False))]
    return df.select(*[named(c) for c in df.columns if c not in gone], *added)


def _fill_number(df, step, tables):
    types = {f.name: f.dataType for f in df.schema.fields}
    new = {}
    for c, v in step["values"].items():
        if c in types:
            # a fractional fill widens an integer column, as it would in any numeric engine
            whole = isinstance(types[c], (T.FloatType, T.DoubleType, T.DecimalType)) or float(v).is_integer()
            new[c] = F.coalesce(named(c), F.lit(v).cast(types[c] if whole else "double"))
    return _replace(df, new)


def _fill_mode(df, step, tables):
    types = {f.name: f.dataType for f in df.schema.fields}
    return _replace(df, {c: F.coalesce(named(c), literal(v, types[c])) for c, v in step["values"].items() if c in types})


def _clip(df, step, tables):
    new = {}
    for c, (low, high) in step["bounds"].items():
        x = named(c).cast("double")
        new[c] = F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(float(high))), F.lit(float(low))))
    return _replace(df, new)


def _one_hot(df, step, tables):
    c = step["column"]
    dtype = df.schema[c].dataType
    wanted = [literal(v, dtype) if kind_of(dtype) == "datetime" else F.lit(v) for v in step["values"]]
    flags = [
        F.coalesce((named(c) == w).cast("int"), F.lit(0)).alias(f"{c}_{_shown(v, dtype)}")
        for w, v in zip(wanted, step["values"])
    ]
    return df.select(*[named(x) for x in df.columns if x != c], *flags)


def _codes(df, step, tables):
    c = step["column"]
    coded = map_values(df, c, tables[c], tuple(step["bound"]), "_code", "n", source="code")
    code = F.col("_code") if step["missing"] is None else F.coalesce("_code", F.lit(step["missing"]).cast("bigint"))
    return coded.select(*[code.alias(c) if x == c else named(x) for x in df.columns])


def _scale(df, step, tables):
    new = {c: (named(c).cast("double") - F.lit(float(a))) / F.lit(float(b)) for c, (a, b) in step["columns"].items()}
    return _replace(df, new)


def _tfidf(df, step, tables):
    return tfidf_columns(df, step)


def _iterative(df, step, tables):
    from tabwright.operators.imputation import apply_iterative  # it is built on this module

    return apply_iterative(df, step)


_APPLY = {
    "drop_duplicates": _drop_duplicates,
    "drop": _drop,
    "date_parts": _date_parts,
    "fill_number": _fill_number,
    "fill_mode": _fill_mode,
    "clip": _clip,
    "one_hot": _one_hot,
    "codes": _codes,
    "scale": _scale,
    "tfidf": _tfidf,
    "iterative": _iterative,
}
