"""Column facts, types and spread written as plain SQL, from the rules and not from the library."""

from __future__ import annotations

from checks.views import COLUMNS, view_sql

INTEGRAL = ("int", "bigint")
UUID = "(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"
ISO = "^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}.*)?$"
ID_TEST = " OR ".join(
    f"contains(lower(column_name), '{p}')" for p in ["id", "pk", "uuid", "guid", "key", "index", "identifier"]
)
TARGET_HITS = " + ".join(
    f"CAST(contains(lower(column_name), '{p}') AS INT)"
    for p in ["target", "label", "y", "class", "category", "output", "prediction"]
)


def _kind(dtype: str) -> str:
    return "numeric" if dtype in ("int", "bigint", "double") else "datetime" if dtype == "timestamp" else dtype


def _base_row(pos: int, name: str, dtype: str) -> str:
    c, kind = f'"{name}"', _kind(dtype)
    numeric = (
        f"avg({c})::DOUBLE, stddev_samp({c})::DOUBLE, stddev_pop({c})::DOUBLE, min({c})::DOUBLE, max({c})::DOUBLE, "
        f"skewness({c})::DOUBLE, kurtosis({c})::DOUBLE, count(*) FILTER ({c} = 0), count(*) FILTER ({c} < 0)"
        if kind == "numeric"
        else ", ".join(["NULL::DOUBLE"] * 7 + ["NULL::BIGINT"] * 2)
    )
    text = (
        f"avg(length({c}))::DOUBLE, max(length({c}))::BIGINT, min(length({c}))::BIGINT, count(*) FILTER ({c} = ''), "
        f"avg(CAST(regexp_matches({c}, '{UUID}') AS INT))::DOUBLE, "
        f"avg(CAST(regexp_matches(replace(replace({c}, '.', ''), '-', ''), '^[0-9]+$') AS INT))::DOUBLE, "
        f"avg(CASE WHEN regexp_matches({c}, '{ISO}') AND try_cast({c} AS TIMESTAMP) IS NOT NULL THEN 1 "
        f"WHEN {c} IS NOT NULL THEN 0 END)::DOUBLE"
        if kind == "string"
        else ", ".join(["NULL::DOUBLE"] + ["NULL::BIGINT"] * 3 + ["NULL::DOUBLE"] * 3)
    )
    times = (
        f"strftime(min({c}), '%Y-%m-%d %H:%M:%S'), strftime(max({c}), '%Y-%m-%d %H:%M:%S'), "
        f"CAST(floor((epoch_us(max({c})) - epoch_us(min({c}))) / 86400000000.0) AS BIGINT)"
        if kind == "datetime"
        else "NULL::VARCHAR, NULL::VARCHAR, NULL::BIGINT"
    )
    width = {"int": 4, "bigint": 8, "double": 8, "timestamp": 8}.get(dtype)
    size = f"coalesce(sum(strlen({c})), 0)::BIGINT" if kind == "string" else f"{width} * count({c})"
    return (
        f"SELECT {pos} AS position, '{name}' AS column_name, '{dtype}' AS dtype, '{kind}' AS kind, "
        f"{'true' if dtype in INTEGRAL else 'false'} AS is_integer, count(*) AS total, count({c}) AS non_null, "
        f"count(*) - count({c}) AS null_count, count(DISTINCT {c}) AS unique_count, {numeric}, {text}, {times}, "
        f"{size} AS bytes, min({c})::VARCHAR AS min_label, max({c})::VARCHAR AS max_label FROM t"
    )


HEAD = (
    "position, column_name, dtype, kind, is_integer, total, non_null, null_count, unique_count, mean, std, std_pop, "
    "min_num, max_num, skewness, kurtosis, zeros, negative, avg_length, max_length, min_length, empty_strings, "
    "uuid_share, digit_share, date_share, min_date, max_date, range_days, bytes, min_label, max_label"
)


def facts_cte(view: str, spread: bool = False) -> str:
    """WITH clause: t, vc (value counts), facts (typed) and, if asked, spread (quartiles, outliers)."""
    columns = COLUMNS[view]
    base = " UNION ALL ".join(_base_row(i, n, d) for i, (n, d) in enumerate(columns))
    vc = " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, CAST("{n}" AS VARCHAR) AS value, count(*) AS n,
            row_number() OVER (ORDER BY count(*) DESC, "{n}") AS rank
            FROM t WHERE "{n}" IS NOT NULL GROUP BY "{n}" """
        for n, _ in columns
    )
    cte = f"""
WITH t AS ({view_sql(view)}),
vc AS ({vc}),
base({HEAD}) AS ({base}),
shares AS (
  SELECT v.column_name, max(n) AS top_count, arg_min(value, rank) AS top_value,
         -sum(n / non_null * log2(n / non_null + 1e-10)) AS entropy,
         CASE WHEN max(unique_count) <= 1 THEN 0.0 ELSE greatest(0.0, least(1.0,
           1 - (max(n) / max(non_null) - 1 / max(unique_count)) / greatest(1 - 1 / max(unique_count), 1e-10))) END AS balance
  FROM vc v JOIN base b ON v.column_name = b.column_name GROUP BY v.column_name),
ratios AS (
  SELECT base.*, null_count / total * 100 AS null_pct, unique_count / total AS ratio, top_count, top_value, entropy,
         balance
  FROM base LEFT JOIN shares ON base.column_name = shares.column_name),
facts AS (
  SELECT *, CASE
    WHEN non_null = 0 THEN 'categorical_nominal'
    WHEN ratio > 0.95 AND (({ID_TEST}) OR unique_count = non_null) THEN 'id'
    WHEN uuid_share > 0.8 THEN 'id'
    WHEN kind = 'datetime' OR date_share = 1 THEN 'datetime'
    WHEN is_integer AND min_label IN ('0', '1') AND max_label IN ('0', '1') THEN 'boolean'
    WHEN kind = 'string' AND unique_count = 2 AND min_label || '/' || max_label IN
      ('False/True', 'false/true', 'no/yes', 'No/Yes', 'N/Y', 'n/y') THEN 'boolean'
    WHEN is_integer THEN CASE WHEN unique_count <= 20 THEN 'categorical_ordinal' ELSE 'numeric_discrete' END
    WHEN kind = 'numeric' THEN
      CASE WHEN ratio < 0.05 AND unique_count <= 50 THEN 'categorical_ordinal' ELSE 'numeric_continuous' END
    WHEN unique_count <= 20 OR (unique_count <= 100 AND ratio < 0.1) THEN 'categorical_nominal'
    WHEN ratio > 0.5 OR (avg_length > 50 AND ratio > 0.3) THEN 'text'
    ELSE 'categorical_nominal' END AS type
  FROM ratios)"""
    if spread:
        cte += f",\nspread AS ({_spread(columns)})"
    return cte


def _spread(columns) -> str:
    parts = []
    for name, dtype in columns:
        if _kind(dtype) != "numeric":
            continue
        c = f'"{name}"'
        parts.append(
            f"""SELECT '{name}' AS column_name, q25, median, q75, iqr, lo AS lower_fence, hi AS upper_fence,
            (SELECT count(*) FROM t WHERE {c} < lo OR {c} > hi) AS outliers_iqr,
            (SELECT count(*) FROM t WHERE sd > 0 AND abs(({c} - mu) / sd) > 3) AS outliers_zscore,
            (SELECT min({c})::DOUBLE FROM t WHERE {c} >= lo) AS whisker_low,
            (SELECT max({c})::DOUBLE FROM t WHERE {c} <= hi) AS whisker_high
            FROM (SELECT *, q75 - q25 AS iqr, q25 - 1.5 * (q75 - q25) AS lo, q75 + 1.5 * (q75 - q25) AS hi
                  FROM (SELECT quantile_cont({c}::DOUBLE, 0.25) AS q25, quantile_cont({c}::DOUBLE, 0.5) AS median,
                               quantile_cont({c}::DOUBLE, 0.75) AS q75, stddev_pop({c}) AS sd, avg({c}) AS mu
                        FROM t))"""
        )
    return " UNION ALL ".join(parts)


SUBTYPE = """CASE
  WHEN non_null = 0 THEN 'low_cardinality'
  WHEN type = 'id' THEN CASE WHEN uuid_share > 0.8 THEN 'uuid' ELSE 'sequential' END
  WHEN type = 'datetime' THEN 'datetime'
  WHEN type = 'boolean' THEN 'boolean'
  WHEN is_integer THEN CASE WHEN unique_count <= 20 THEN 'ordinal_numeric' ELSE 'discrete' END
  WHEN kind = 'numeric' THEN CASE WHEN ratio < 0.05 AND unique_count <= 50 THEN 'ordinal_encoded' ELSE 'continuous' END
  WHEN unique_count <= 20 THEN 'low_cardinality'
  WHEN unique_count <= 100 AND ratio < 0.1 THEN 'medium_cardinality'
  WHEN type = 'text' THEN 'free_text' ELSE 'categorical' END"""
