"""Profile of a dataset: every section is a small DataFrame over shared facts."""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions import semantics as sem
from tabwright.functions.columns import columns_of, dtype_name, kinds, named, nan_to_null, row_digest
from tabwright.operators.facts import EXACT, HYBRID, collect_facts, facts_table, non_null_counts, scan, top_values, value_bytes
from tabwright.operators.quantiles import exact_quantiles
from tabwright.session import batches, local_table

QUARTILES = [0.25, 0.5, 0.75]
BOUND_COLUMNS_PER_JOB = 8
WIDE, PAIRS_PER_JOB = 24, 40  # above WIDE columns all pairs come from one vector pass
# Outlier fence, z limit, correlation limits, missing-value severity limits.
FENCE, Z_LIMIT = 1.5, 3.0
HIGH_CORRELATION, STRONG_CORRELATION = 0.7, 0.8
SEVERITY_LIMITS = [(50, "critical"), (20, "high"), (5, "moderate")]


def severity_of(pct):
    label = F.lit("low")
    for limit, name in reversed(SEVERITY_LIMITS):
        label = F.when(pct > limit, name).otherwise(label)
    return label


class Profile:
    """Facts are computed once, on first use, in layers, so that no section pays for more than it shows.

    schema   no job at all
    counts   rows and non-null values per column, one narrow pass
    scanned  moments, extremes, lengths and patterns, narrow passes
    rows     all facts; adds the grouping of all values, the only shuffle

    distinct: 'exact' or 'hybrid' (a sketch decides which columns need the exact count).
    id_rule:  'reference' or 'strict' (only integers and strings are ids by value).
    """

    def __init__(self, df: DataFrame, distinct: str = EXACT, id_rule: str = "reference"):
        self.raw = df
        self.df = nan_to_null(df)
        self.spark = df.sparkSession
        self.distinct = distinct
        self.id_rule = id_rule

    # ---- shared facts -------------------------------------------------------------

    @functools.cached_property
    def counts(self) -> dict:
        """{"total": rows, "non_null": {column: present values}}."""
        for layer in ("rows", "scanned"):
            if layer in self.__dict__:
                own = self.__dict__[layer]
                return {"total": own[0]["total"], "non_null": {r["column_name"]: r["non_null"] for r in own}}
        return non_null_counts(self.df)

    @functools.cached_property
    def scanned(self) -> list[dict]:
        return self.rows if "rows" in self.__dict__ else scan(self.df, approx=self.distinct == HYBRID)

    @functools.cached_property
    def by_scan(self) -> dict[str, dict]:
        return {r["column_name"]: r for r in self.scanned}

    @functools.cached_property
    def rows(self) -> list[dict]:
        return collect_facts(self.df, self.distinct, self.__dict__.get("scanned"))

    @functools.cached_property
    def facts(self) -> DataFrame:
        """Typed facts, one row per column."""
        return facts_table(self.df, self.rows, self.id_rule)

    @functools.cached_property
    def types(self) -> dict[str, str]:
        return {r["column_name"]: r["type"] for r in self.facts.select("column_name", "type").collect()}

    @functools.cached_property
    def by_name(self) -> dict[str, dict]:
        return {r["column_name"]: r for r in self.rows}

    @functools.cached_property
    def n_rows(self) -> int:
        return self.counts["total"]

    def of_type(self, *types: str) -> list[str]:
        return [c for c in self.df.columns if self.types[c] in types]

    @functools.cached_property
    def numeric_columns(self) -> list[str]:
        return columns_of(self.df, "numeric")

    @functools.cached_property
    def quartiles(self) -> dict[str, list]:
        return exact_quantiles(
            self.df,
            self.numeric_columns,
            QUARTILES,
            self.counts["non_null"],
            {c: self._distinct_bound(c) for c in self.numeric_columns},
        )

    def _distinct_bound(self, column: str) -> int:
        """At most so many distinct values: the exact count if it is there, else what the scan proves."""
        if "rows" in self.__dict__:
            return self.by_name[column]["unique_count"]
        r = self.by_scan[column]
        if r["is_integer"] and r["non_null"]:
            return min(r["non_null"], int(r["max_num"] - r["min_num"]) + 1)
        return r["non_null"]

    @functools.cached_property
    def spread(self) -> dict[str, dict]:
        """Quartiles, fences, outlier counts and whiskers per numeric column."""
        found = {}
        filled = [c for c in self.numeric_columns if self.counts["non_null"][c]]
        for group in batches(filled, BOUND_COLUMNS_PER_JOB):
            exprs = []
            for i, c in enumerate(group):
                q1, _, q3 = self.quartiles[c]
                low, high = q1 - FENCE * (q3 - q1), q3 + FENCE * (q3 - q1)
                x, mean, sd = named(c).cast("double"), self.by_scan[c]["mean"], self.by_scan[c]["std_pop"]
                z = F.count_if(F.abs((x - F.lit(mean)) / F.lit(sd)) > Z_LIMIT) if sd else F.lit(0).cast("bigint")
                exprs += [
                    F.count_if((x < low) | (x > high)).alias(f"o{i}"),
                    z.alias(f"z{i}"),
                    F.min(F.when(x >= low, x)).alias(f"l{i}"),
                    F.max(F.when(x <= high, x)).alias(f"h{i}"),
                ]
            r = self.df.agg(*exprs).first()
            for i, c in enumerate(group):
                q1, q2, q3 = self.quartiles[c]
                found[c] = {
                    "q25": q1,
                    "median": q2,
                    "q75": q3,
                    "iqr": q3 - q1,
                    "lower": q1 - FENCE * (q3 - q1),
                    "upper": q3 + FENCE * (q3 - q1),
                    "outliers_iqr": r[f"o{i}"],
                    "outliers_zscore": r[f"z{i}"],
                    "whisker_low": r[f"l{i}"],
                    "whisker_high": r[f"h{i}"],
                }
        return found

    @functools.cached_property
    def spread_table(self) -> DataFrame:
        ddl = (
            "column_name string, q25 double, median double, q75 double, iqr double, lower double, upper double, "
            "outliers_iqr bigint, outliers_zscore bigint, whisker_low double, whisker_high double"
        )
        return local_table(self.spark, [{"column_name": c, **s} for c, s in self.spread.items()], ddl)

    # ---- typing -------------------------------------------------------------------

    def column_types(self) -> DataFrame:
        return self.facts.select("position", "column_name", "type", "subtype")

    def columns_by_type(self, type_: str) -> DataFrame:
        return self.facts.where(F.col("type") == type_).select("position", "column_name", "subtype")

    def type_counts(self) -> DataFrame:
        return self.facts.groupBy("type").agg(F.count(F.lit(1)).alias("n_columns"))

    def target_candidates(self) -> DataFrame:
        return sem.target_candidates(self.facts)

    @functools.cached_property
    def suggested_target(self) -> str | None:
        best = self.target_candidates().first()
        return best["column_name"] if best else None

    # ---- sections -----------------------------------------------------------------

    @functools.cached_property
    def duplicate_rows(self) -> int:
        """Rows beyond the first of each identical row; only 16-byte digests are shuffled."""
        distinct = self.df.select(*row_digest(self.df)).distinct().count()
        return self.n_rows - distinct

    @functools.cached_property
    def rows_with_missing(self) -> int:
        holes = self.columns_with_nulls
        if not holes:
            return 0
        missing = functools.reduce(lambda a, b: a | b, [named(c).isNull() for c in holes])
        return self.df.agg(F.count_if(missing)).first()[0]

    @functools.cached_property
    def columns_with_nulls(self) -> list[str]:
        """Only these need to be read again by anything that looks at nulls."""
        return [c for c, n in self.counts["non_null"].items() if n < self.n_rows]

    @functools.cached_property
    def missing_cells(self) -> int:
        return sum(self.n_rows - n for n in self.counts["non_null"].values())

    @functools.cached_property
    def overview_row(self) -> dict:
        cells = self.n_rows * len(self.df.columns)
        return {
            "n_rows": self.n_rows,
            "n_columns": len(self.df.columns),
            "total_cells": cells,
            "missing_cells": self.missing_cells,
            "missing_pct": self.missing_cells / cells * 100 if cells else 0.0,
            "duplicate_rows": self.duplicate_rows,
            "bytes": sum(value_bytes(r) for r in self.scanned),
        }

    def overview(self) -> DataFrame:
        ddl = (
            "n_rows bigint, n_columns bigint, total_cells bigint, missing_cells bigint, missing_pct double, "
            "duplicate_rows bigint, bytes bigint"
        )
        return local_table(self.spark, [self.overview_row], ddl)

    def basic_stats(self) -> DataFrame:
        return self.facts.select(
            "column_name",
            F.col("non_null").alias("count"),
            F.col("null_count").alias("missing"),
            F.col("null_pct").alias("missing_pct"),
            F.col("unique_count").alias("unique"),
        )

    def numeric_stats(self) -> DataFrame:
        """Full statistics of the continuous and discrete columns."""
        return (
            self.facts.where(F.col("type").isin(sem.NUMERIC_TYPES))
            .join(F.broadcast(self.spread_table), "column_name")
            .select(
                "column_name",
                F.col("non_null").alias("count"),
                "mean",
                "median",
                "std",
                F.col("min_num").alias("min"),
                F.col("max_num").alias("max"),
                (F.col("max_num") - F.col("min_num")).alias("range"),
                "q25",
                "q75",
                "iqr",
                "skewness",
                "kurtosis",
                "zeros",
                (F.col("zeros") / F.col("non_null") * 100).alias("zeros_pct"),
                "negative",
                "outliers_iqr",
                "outliers_zscore",
            )
        )

    def describe(self) -> DataFrame:
        """count, mean, std, min, quartiles and max of every numeric column."""
        return self.facts.join(F.broadcast(self.spread_table), "column_name").select(
            "column_name",
            F.col("non_null").alias("count"),
            "mean",
            "std",
            F.col("min_num").alias("min"),
            "q25",
            F.col("median").alias("q50"),
            "q75",
            F.col("max_num").alias("max"),
        )

    def box_stats(self) -> DataFrame:
        return self.spread_table.select(
            "column_name", "q25", "median", "q75", "whisker_low", "whisker_high", F.col("outliers_iqr").alias("outliers")
        )

    def top_categories(self, k: int = 10) -> DataFrame:
        """The k most frequent values of every nominal, ordinal and boolean column."""
        columns = self.of_type(*sem.CATEGORY_TYPES)
        columns = [c for c in columns if self.by_name[c]["non_null"]]
        return self._with_share(top_values(self.df, columns, k))

    def category_counts(self, max_columns: int | None = None, k: int = 15) -> DataFrame:
        """Top values of the (first) string columns with at most 30 distinct values."""
        columns = [c for c, kind in kinds(self.df).items() if kind == "string"]
        few = [c for c in columns if 0 < self.by_name[c]["unique_count"] <= 30][:max_columns]
        return top_values(self.df, few, k).select("column_name", "rank", "value", "n")

    def _with_share(self, top: DataFrame) -> DataFrame:
        counts = F.array(*[F.lit(r["non_null"]) for r in self.rows])
        share = F.col("n") / F.element_at(counts, F.col("position") + 1)
        return top.select("column_name", "rank", "value", "n", (share * 100).alias("pct"))

    def category_balance(self) -> DataFrame:
        return self.facts.where(F.col("type").isin(sem.CATEGORY_TYPES)).select(
            "column_name", "type", "unique_count", "entropy", F.col("balance").alias("balance_score")
        )

    def text_stats(self) -> DataFrame:
        return self.facts.where((F.col("type") == sem.TEXT) & (F.col("non_null") > 0)).select(
            "column_name",
            "avg_length",
            "max_length",
            "min_length",
            "empty_strings",
            (F.col("empty_strings") / F.col("non_null") * 100).alias("empty_pct"),
        )

    def datetime_stats(self) -> DataFrame:
        return self.facts.where((F.col("type") == sem.DATETIME) & (F.col("non_null") > 0)).select(
            "column_name", "min_date", "max_date", "range_days"
        )

    @functools.cached_property
    def correlation_pairs(self) -> list[dict]:
        """Pearson correlation of every pair of numeric columns, each over its complete pairs."""
        columns = self.numeric_columns
        if len(columns) < 2:
            return []
        present = self.counts["non_null"]
        complete = [c for c in columns if 0 < present[c] == self.n_rows and self.by_scan[c]["std_pop"] is not None]
        pairs: dict[tuple[str, str], float | None] = {}
        if len(complete) > 1 and self.n_rows > 1:
            varying = [c for c in complete if self.by_scan[c]["std_pop"]]
            pairs |= {p: None for p in itertools.combinations(complete, 2)}
            if len(varying) > WIDE:
                pairs |= _dense_correlation(self.df, varying)
            else:
                for group in batches(list(itertools.combinations(varying, 2)), PAIRS_PER_JOB):
                    pairs |= _scaled_products(self.df, group, self.by_scan)
        rest = [p for p in itertools.combinations(columns, 2) if p not in pairs]
        usable = {c for c in columns if self.by_scan[c].get("std_pop") and math.isfinite(self.by_scan[c]["std_pop"])}
        masked = [c for c in dict.fromkeys(c for p in rest for c in p) if c in usable]
        if len(masked) > 1:
            found = _masked_correlation(self.df, masked, self.by_scan)
            pairs |= {p: found[p] for p in rest if p in found}
        # columns with infinite values, and pairs whose shared rows hardly vary
        for group in batches([p for p in rest if p not in pairs], 500):
            pairs |= _pairwise_correlation(self.df, group)
        place = {c: i for i, c in enumerate(columns)}
        return [
            {"i": place[a], "j": place[b], "col1": a, "col2": b, "correlation": r}
            for (a, b), r in sorted(pairs.items(), key=lambda kv: (place[kv[0][0]], place[kv[0][1]]))
        ]

    @functools.cached_property
    def correlation_table(self) -> DataFrame:
        return local_table(
            self.spark, self.correlation_pairs, "i int, j int, col1 string, col2 string, correlation double"
        )

    def correlation_matrix(self) -> DataFrame:
        """Full matrix in long form, diagonal included."""
        pairs = self.correlation_table
        varying = [{"col1": c, "col2": c, "correlation": 1.0} for c in self.numeric_columns if self.by_scan[c].get("std_pop")]
        own = local_table(self.spark, varying, "col1 string, col2 string, correlation double")
        upper = pairs.select("col1", "col2", "correlation")
        lower = pairs.select(F.col("col2").alias("col1"), F.col("col1").alias("col2"), "correlation")
        return upper.unionByName(lower).unionByName(own)

    def high_correlations(self) -> DataFrame:
        size = F.abs("correlation")
        return (
            self.correlation_table.where(size > HIGH_CORRELATION)
            .select(
                "i",
                "j",
                "col1",
                "col2",
                "correlation",
                F.when(size > STRONG_CORRELATION, "strong").otherwise("moderate").alias("strength"),
            )
            .orderBy(F.desc(size), "i", "j")
        )

    def missing_by_column(self) -> DataFrame:
        """Columns with missing values: count, rounded percentage and severity."""
        pct = F.round("null_pct", 2)
        return self._null_table().where(F.col("missing") > 0).select(
            "position", "column_name", "missing", pct.alias("missing_pct"), severity_of(pct).alias("severity")
        )

    def _null_table(self) -> DataFrame:
        rows = [
            {"position": i, "column_name": c, "missing": self.n_rows - n, "null_pct": (self.n_rows - n) / max(self.n_rows, 1) * 100}
            for i, (c, n) in enumerate(self.counts["non_null"].items())
        ]
        return local_table(self.spark, rows, "position int, column_name string, missing bigint, null_pct double")

    def missing_summary(self) -> DataFrame:
        cells = self.n_rows * len(self.df.columns)
        with_missing = len(self.columns_with_nulls)
        row = {
            "total_missing": self.missing_cells,
            "missing_pct": self.missing_cells / cells * 100 if cells else 0.0,
            "columns_with_missing": with_missing,
            "complete_columns": len(self.df.columns) - with_missing,
            "rows_with_missing": self.rows_with_missing,
            "rows_complete": self.n_rows - self.rows_with_missing,
        }
        ddl = (
            "total_missing bigint, missing_pct double, columns_with_missing bigint, complete_columns bigint, "
            "rows_with_missing bigint, rows_complete bigint"
        )
        return local_table(self.spark, [row], ddl)

    def missing_ranked(self) -> DataFrame:
        return self.missing_by_column().orderBy(F.desc("missing"), "position")

    def missing_pattern(self) -> DataFrame:
        """Every combination of null flags (one digit per column, in order) and its row count."""
        holes = set(self.columns_with_nulls)
        flags = F.concat(
            *[F.when(named(c).isNull(), "1").otherwise("0") if c in holes else F.lit("0") for c in self.df.columns]
        )
        return self.df.groupBy(flags.alias("pattern")).agg(F.count(F.lit(1)).alias("n_rows"))

    @functools.cached_property
    def duplicate_row(self) -> dict:
        pct = self.duplicate_rows / self.n_rows * 100 if self.n_rows else 0.0
        return {"total_duplicates": self.duplicate_rows, "duplicate_pct": pct, "is_critical": pct > 10}

    def duplicates(self) -> DataFrame:
        return local_table(
            self.spark, [self.duplicate_row], "total_duplicates bigint, duplicate_pct double, is_critical boolean"
        )

    @functools.cached_property
    def quality_row(self) -> dict:
        """Completeness, uniqueness and consistency in percent, weighted 0.4 / 0.3 / 0.3.

        A Spark column has one type, so every column is consistent.
        """
        if not self.n_rows:
            return {"overall": 0.0, "completeness": 0.0, "uniqueness": 0.0, "consistency": 0.0}
        complete = max(0.0, 1 - self.missing_cells / (self.n_rows * len(self.df.columns)))
        unique = max(0.0, 1 - self.duplicate_rows / self.n_rows)
        overall = complete * 0.4 + unique * 0.3 + 0.3
        return {
            "overall": round(overall * 100, 1),
            "completeness": round(complete * 100, 1),
            "uniqueness": round(unique * 100, 1),
            "consistency": 100.0,
        }

    def quality_score(self) -> DataFrame:
        return local_table(
            self.spark, [self.quality_row], "overall double, completeness double, uniqueness double, consistency double"
        )

    def column_profile(self, column: str) -> DataFrame:
        spread = self.spread_table.drop("lower", "upper", "whisker_low", "whisker_high")
        return self.facts.where(F.col("column_name") == column).join(F.broadcast(spread), "column_name", "left")

    def high_quality_columns(self, threshold: float = 80.0) -> DataFrame:
        """Columns whose share of present values, in percent, is above the threshold."""
        present = 100 - F.col("null_pct")
        return self._null_table().where(present > threshold).select("position", "column_name", present.alias("completeness"))

    def dtype_counts(self) -> DataFrame:
        return self.schema_table().groupBy("dtype").agg(F.count(F.lit(1)).alias("n_columns"))

    def schema_table(self) -> DataFrame:
        rows = [
            {"position": i, "column_name": f.name, "dtype": dtype_name(f.dataType)} for i, f in enumerate(self.df.schema.fields)
        ]
        return local_table(self.spark, rows, "position int, column_name string, dtype string")

    def histogram(self, bins: int = 30, max_columns: int | None = None) -> DataFrame:
        """Equal-width bins of the (first) numeric columns over their finite values; the last bin is closed."""
        columns = [c for c in self.numeric_columns[:max_columns] if self.by_scan[c].get("min_finite") is not None]
        keys, frame = [], []
        for i, c in enumerate(columns):
            low, high = self.by_scan[c]["min_finite"], self.by_scan[c]["max_finite"]
            if low == high:  # a constant column gets one unit-wide range around its value
                low, high = low - 0.5, high + 0.5
            width = (high - low) / bins
            x = named(c).cast("double")
            place = F.least(F.floor((x - low) / width), F.lit(bins - 1).cast("bigint"))
            # least() skips nulls, so a null must be kept out of the last bin by hand
            keys.append(F.when(F.abs(x) < float("inf"), place).alias(str(i)))
            frame += [
                {"slot": str(i), "column_name": c, "bin": b, "bin_start": low + b * width} for b in range(bins)
            ]
        if len(columns) == 1:
            long = self.df.select(F.lit("0").alias("slot"), keys[0].alias("bin"))
        else:
            long = self.df.select(*keys).unpivot([], [str(i) for i in range(len(columns))], "slot", "bin")
        counted = long.where("bin is not null").groupBy("slot", "bin").agg(F.count(F.lit(1)).alias("n"))
        frame = local_table(self.spark, frame, "slot string, column_name string, bin bigint, bin_start double")
        return frame.join(counted, ["slot", "bin"], "left").select(
            "column_name", "bin", "bin_start", F.coalesce("n", F.lit(0).cast("bigint")).alias("n")
        )


def _scaled_products(df: DataFrame, pairs: list[tuple[str, str]], facts: dict[str, dict]) -> dict:
    """Columns without nulls: means of products of standardised values, inside generated code."""
    z = {c: (named(c).cast("double") - F.lit(facts[c]["mean"])) / F.lit(facts[c]["std_pop"]) for p in pairs for c in p}
    place = {c: f"z{i}" for i, c in enumerate(z)}
    scaled = df.select(*[e.alias(place[c]) for c, e in z.items()])
    row = scaled.agg(*[F.avg(F.col(place[a]) * F.col(place[b])).alias(str(i)) for i, (a, b) in enumerate(pairs)]).first()
    return {p: row[i] for i, p in enumerate(pairs)}


def _dense_correlation(df: DataFrame, columns: list[str]) -> dict:
    """Many columns without nulls: one pass over assembled vectors, a k x k matrix comes back."""
    stage = VectorAssembler(inputCols=[f"c{i}" for i in range(len(columns))], outputCol="v")
    vectors = stage.transform(df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)]))
    matrix = Correlation.corr(vectors, "v").first()[0].toArray()
    return {
        (columns[i], columns[j]): float(matrix[i][j]) for i, j in itertools.combinations(range(len(columns)), 2)
    }


def _masked_correlation(df: DataFrame, columns: list[str], facts: dict[str, dict]) -> dict:
    """Columns with nulls: counts, sums, squares and products over the rows that both columns have, as matrix products
    of blocks of rows; k x k sums per task are shuffled. Pairs that hardly vary there are left out.
    """
    k = len(columns)
    mean, spread = (np.array([facts[c][f] for c in columns], dtype=float) for f in ("mean", "std_pop"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((4, k, k))
        for batch in batches:
            z = (np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns]) - mean) / spread
            there = ~np.isnan(z)
            z, there = np.where(there, z, 0.0), there.astype(float)
            total += np.stack([there.T @ there, z.T @ there, (z * z).T @ there, z.T @ z])
        cells = [pa.array(t.ravel()) for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k)), *cells], names=["at", "n", "s", "q", "p"])

    numbers = df.select(*[named(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    sums = numbers.mapInArrow(run, "at long, n double, s double, q double, p double").groupBy("at").agg(*[F.sum(c).alias(c) for c in "nsqp"])
    n, s, q, p = total = np.zeros((4, k, k))
    for r in sums.collect():  # k x k rows
        total[:, r["at"] // k, r["at"] % k] = r["n"], r["s"], r["q"], r["p"]
    found = {}
    for i, j in itertools.combinations(range(k), 2):
        if not n[i, j]:
            found[columns[i], columns[j]] = None
            continue
        m = n[i, j]
        mx, my, qx, qy = s[i, j] / m, s[j, i] / m, q[i, j] / m, q[j, i] / m
        vx, vy = qx - mx * mx, qy - my * my
        if vx > 1e-6 * qx and vy > 1e-6 * qy:
            found[columns[i], columns[j]] = float((p[i, j] / m - mx * my) / math.sqrt(vx * vy))
    return found


def _pairwise_correlation(df: DataFrame, pairs: list[tuple[str, str]]) -> dict:
    """Columns with nulls: each pair is aggregated over the rows where both are present."""
    tagged = [
        F.struct(F.lit(i).alias("slot"), named(a).cast("double").alias("x"), named(b).cast("double").alias("y"))
        for i, (a, b) in enumerate(pairs)
    ]
    long = df.select(F.inline(F.array(*tagged))).where("x is not null and y is not null")
    # corr() fails on a constant side; its own definition with a guarded division gives null
    r = F.try_divide(F.covar_pop("x", "y"), F.stddev_pop("x") * F.stddev_pop("y"))
    found = {row["slot"]: row["r"] for row in long.groupBy("slot").agg(r.alias("r")).collect()}
    return {p: found.get(i) for i, p in enumerate(pairs)}
