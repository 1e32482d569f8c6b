"""Single transforms: fit on a DataFrame and apply to it in one call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import columns_of, kinds, named, nan_to_null, order_hash
from tabwright.operators import steps as st
from tabwright.operators.lookup import map_values, value_bound
from tabwright.operators.profile import FENCE
from tabwright.operators.ranking import by_cutoff, group_cutoffs, group_sizes
from tabwright.operators.steps import apply_step


def drop_duplicates(df: DataFrame) -> DataFrame:
    return apply_step(df, {"op": "drop_duplicates"})


def keep_last(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the largest `order` per key; aggregated map-side, so hot keys cost nothing extra."""
    row = F.struct(*[named(c) for c in df.columns])
    best = df.groupBy(*[named(k) for k in keys]).agg(F.max_by(row, named(order)).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def datetime_features(df: DataFrame, columns: list[str], weekend: bool = False) -> DataFrame:
    return apply_step(df, {"op": "date_parts", "columns": columns, "weekend": weekend})


def drop_sparse_columns(df: DataFrame, share: float = 0.5) -> DataFrame:
    sparse = [c for c, s in st.null_shares(df).items() if s > share]
    return apply_step(df, {"op": "drop", "columns": sparse})


def impute_median(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_step(df, st.fit_median(df, columns))


def impute_mode(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_step(df, st.fit_mode(df, columns))


def cap_outliers_iqr(df: DataFrame, columns: list[str]) -> DataFrame:
    return apply_step(df, st.fit_clip_iqr(df, columns))


def winsorize(df: DataFrame, columns: list[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    return apply_step(df, st.fit_clip_share(df, columns, low, high))


def filter_outliers_iqr(df: DataFrame, column: str) -> DataFrame:
    """Rows inside the IQR fence of one column; null rows go."""
    q1, q3 = st.quantiles_of(df, [column], [0.25, 0.75])[column]
    return df.where(named(column).between(q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)))


def log1p(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[F.log1p(named(c)).alias(c) if c in columns else named(c) for c in df.columns])


def one_hot(df: DataFrame, columns: list[str], drop_first: bool = False) -> DataFrame:
    for step in st.fit_one_hot(df, columns, drop_first):
        df = apply_step(df, step)
    return df


def ordinal_encode(df: DataFrame, column: str, missing: int | None = None) -> DataFrame:
    """Position of each value among the sorted distinct values; null stays null unless `missing` is set."""
    step, table = st.fit_codes(df, column, missing)
    return apply_step(df, step, {column: table})


def category_codes(df: DataFrame, column: str) -> DataFrame:
    return ordinal_encode(df, column, missing=-1)


def scale(df: DataFrame, columns: list[str], method: str = "standard") -> DataFrame:
    return apply_step(df, st.fit_scale(df, columns, method))


def group_rare(df: DataFrame, column: str, share: float = 0.01, label: str = "Other") -> DataFrame:
    """Values below `share` of the non-null rows become one label.

    At most 1/share values reach the threshold, so the kept ones are literals.
    """
    counted = df.where(named(column).isNotNull()).groupBy(named(column).alias("value")).count()
    total = st.counts_of(df, [column])[column]
    kept = [r["value"] for r in counted.where(F.col("count") >= share * total).collect()]
    value = F.when(named(column).isNull() | named(column).isin(kept), named(column)).otherwise(label)
    return df.select(*[value.alias(c) if c == column else named(c) for c in df.columns])


def _value_table(df: DataFrame, column: str, *aggregates) -> tuple[DataFrame, tuple[int, int]]:
    counted = (
        df.where(named(column).isNotNull())
        .groupBy(named(column).alias("value"))
        .agg(F.count(F.lit(1)).alias("n"), *aggregates)
    )
    return counted, value_bound(df, column)


def frequency_encode(df: DataFrame, column: str) -> DataFrame:
    """Append `{column}_freq`, the row count of the value."""
    table, bound = _value_table(df, column, F.count(F.lit(1)).alias(f"{column}_freq"))
    return map_values(df, column, table, bound, f"{column}_freq", "n")


def target_encode(df: DataFrame, column: str, target: str, prior: float = 0.0) -> DataFrame:
    """Append `{column}_target`, the mean target of the value, drawn to the global mean by `prior` rows."""
    out, y = f"{column}_target", named(target).cast("double")
    mean = F.avg(y)
    if prior:
        overall = df.agg(F.avg(y)).first()[0]
        mean = (F.sum(y) + F.lit(prior * overall)) / (F.count(y) + F.lit(prior))
    table, bound = _value_table(df, column, mean.alias(out))
    return map_values(df, column, table, bound, out, "n")


def class_weights(df: DataFrame, target: str, out: str = "class_weight") -> DataFrame:
    """Append n / (k * n_class)."""
    counts = df.where(named(target).isNotNull()).groupBy(named(target).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).first()
    table = counts.withColumn(out, F.lit(total["n"]) / (F.lit(total["k"]) * F.col("n")))
    return map_values(df, target, table, value_bound(df, target), out, "n")


def undersample(df: DataFrame, target: str, *keys: str) -> DataFrame:
    """Every class reduced to exactly the size of the smallest, chosen by the hash of unique keys."""
    labelled = df.where(named(target).isNotNull())
    sizes = group_sizes(labelled, named(target))
    least = sizes.agg(F.min("n")).first()[0]
    hash_ = order_hash(*[named(k) for k in keys])
    cutoffs = group_cutoffs(labelled, hash_, sizes.select("g", F.lit(least or 0).alias("k")), named(target))
    return by_cutoff(labelled, hash_, cutoffs, named(target), "_kept").where("_kept").drop("_kept")


def fill_constant(df: DataFrame, number: str = "mean", text: str = "Unknown") -> DataFrame:
    """Strings get a label, numbers their mean or median."""
    shares = st.null_shares(df)
    numeric = [c for c in columns_of(df, "numeric") if shares[c] > 0]
    if number == "median":
        step = st.fit_median(df, numeric)
    else:
        means = {c: m.get("mean") for c, m in st.moments_of(df, numeric, shape=False).items()}
        step = {"op": "fill_number", "values": {c: v for c, v in means.items() if v is not None}}
    return apply_step(df, step).fillna(text, subset=columns_of(df, "string"))


def cast_numeric(df: DataFrame, columns: list[str]) -> DataFrame:
    """Text to number; what cannot be read becomes null."""
    return df.select(*[named(c).try_cast("double").alias(c) if c in columns else named(c) for c in df.columns])


def select_by_type(df: DataFrame, *wanted: str) -> DataFrame:
    """Only columns of the given physical kinds (numeric, string, boolean, datetime)."""
    return df.select(*[named(c) for c in columns_of(df, *wanted)])


def quick_clean(df: DataFrame) -> DataFrame:
    """Drop duplicates, drop columns that are more than half null, impute every remaining null."""
    clean = drop_duplicates(nan_to_null(df))
    shares = st.null_shares(clean)
    clean = apply_step(clean, {"op": "drop", "columns": [c for c, s in shares.items() if s > 0.5]})
    holes = [c for c in clean.columns if shares[c] > 0]
    numeric = [c for c in holes if kinds(clean)[c] == "numeric"]
    filled = apply_step(clean, st.fit_median(clean, numeric)) if numeric else clean
    rest = [c for c in holes if c not in numeric]
    return apply_step(filled, st.fit_mode(clean, rest)) if rest else filled


def prepare_numeric(df: DataFrame, target: str | None = None) -> DataFrame:
    """Numbers scaled, strings with at most 10 values one-hot without the first, other strings dropped."""
    df = nan_to_null(df)
    numeric, texts = columns_of(df, "numeric"), columns_of(df, "string")
    df = df.select(*[named(c) for c in df.columns if c in numeric or c in texts])
    candidates = [c for c in texts if c != target]
    few: list[str] = []
    if candidates:
        seen: dict[str, int] = {}
        for r in st.top_values(df, candidates, 11).collect():
            seen[r["column_name"]] = seen.get(r["column_name"], 0) + 1
        few = [c for c in candidates if seen.get(c, 0) <= 10]
    wide = one_hot(df, few, drop_first=True)
    wide = apply_step(wide, {"op": "drop", "columns": [c for c in texts if c not in few]})
    return apply_step(wide, st.fit_scale(df, [c for c in numeric if c != target], "standard"))


def configured(
    df: DataFrame,
    numeric: list[str],
    categorical: list[str],
    impute: str = "median",
    scaler: str = "standard",
    encoder: str = "onehot",
) -> tuple[list[dict], dict[str, DataFrame]]:
    """Steps of a configured preparation: impute and scale numbers, fill and encode categories.

    impute: median, mean, most_frequent or constant (0); encoder: onehot (an unknown value
    is all zeros) or ordinal (an unknown value is -1). Columns not named are dropped.
    """
    df = nan_to_null(df)
    found: list[dict] = [{"op": "drop", "columns": [c for c in df.columns if c not in {*numeric, *categorical}]}]
    if impute == "median":
        found.append(st.fit_median(df, numeric))
    elif impute == "mean":
        shares = st.null_shares(df)
        values = {c: m.get("mean") for c, m in st.moments_of(df, numeric, shape=False).items() if shares[c] > 0}
        found.append({"op": "fill_number", "values": {c: v for c, v in values.items() if v is not None}})
    elif impute == "most_frequent":
        found.append(st.fit_mode(df, numeric))
    elif impute == "constant":
        found.append({"op": "fill_number", "values": dict.fromkeys(numeric, 0)})
    else:
        raise ValueError(f"unknown imputation {impute!r}")
    found.append(st.fit_mode(df, categorical))
    filled = df
    for step in found:
        filled = apply_step(filled, step)
    found.append(st.fit_scale(filled, numeric, scaler))
    tables: dict[str, DataFrame] = {}
    if encoder == "onehot":
        found += st.fit_one_hot(filled, categorical)
    elif encoder == "ordinal":
        for c in categorical:
            step, tables[c] = st.fit_codes(filled, c, missing=-1)
            found.append(step)
    else:
        raise ValueError(f"unknown encoder {encoder!r}")
    return found, tables
