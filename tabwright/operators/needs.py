"""Preparation needs: which steps a dataset requires before modelling."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import semantics as sem
from tabwright.operators.facts import top_values
from tabwright.operators.profile import Profile
from tabwright.session import local_table

NEED_DDL = (
    "rule int, item int, type string, severity string, columns array<string>, description string, "
    "suggested_action string, details map<string,string>"
)
SEVERITIES = ["required", "recommended", "optional"]
# Required needs of these types can be met automatically.
AUTOMATIC = ["missing_values", "encoding", "scaling", "duplicate_removal"]
IMBALANCE_RATIO = 3

# Fixed order of preparation steps: (need type, step title, Spark form).
STEPS = [
    ("duplicate_removal", "remove duplicate rows", "df.dropDuplicates()"),
    ("missing_values", "handle missing values", "coalesce(c, <median or mode>)"),
    ("datetime", "extract date features", "year(c), month(c), dayofmonth(c), weekday(c), quarter(c)"),
    ("outlier_treatment", "treat outliers", "least(greatest(c, q1 - 1.5*iqr), q3 + 1.5*iqr)"),
    ("encoding", "encode categories", "case when c = <value> then 1 else 0 end"),
    ("text_vectorization", "vectorize text", "CountVectorizer + IDF + Normalizer"),
    ("feature_selection", "reduce cardinality", "case when share < 0.01 then 'Other' else c end"),
    ("scaling", "scale numbers", "(c - center) / scale"),
    ("class_imbalance", "balance classes", "n / (k * n_class) as weight"),
]


def _names():
    return F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"])


def _details(**pairs):
    items = []
    for k, v in pairs.items():
        items += [F.lit(k), v if not isinstance(v, str) else F.lit(v)]
    return F.create_map(*items)


class Needs:
    def __init__(self, profile: Profile, target: str | None = None):
        self.p = profile
        self.target = target
        self.spark = profile.spark

    @functools.cached_property
    def _features(self) -> DataFrame:
        return self.p.facts.where(F.col("column_name") != (self.target or ""))

    def _grouped(self, rows: DataFrame, rule, item, type_, severity, text, action, details) -> DataFrame:
        """One need row for a non-empty set of columns."""
        return (
            rows.agg(F.count(F.lit(1)).alias("n"), _names().alias("columns"))
            .where("n > 0")
            .select(
                F.lit(rule).alias("rule"),
                F.lit(item).alias("item"),
                F.lit(type_).alias("type"),
                F.lit(severity).alias("severity"),
                "columns",
                F.format_string("%d " + text, "n").alias("description"),
                F.lit(action).alias("suggested_action"),
                details.alias("details"),
            )
        )

    def missing(self) -> DataFrame:
        levels = [
            ("critical", "required", "column(s) with more than 50%% missing", "drop the columns", "drop_column"),
            ("high", "required", "column(s) with 20-50%% missing", "impute carefully", "advanced_imputation"),
            ("moderate", "recommended", "column(s) with 5-20%% missing", "impute median or mode", "simple_imputation"),
        ]
        by_column = self.p.missing_by_column()
        return _union(
            self._grouped(
                by_column.where(F.col("severity") == level), 1, i, "missing_values", severity, text, action,
                _details(strategy=strategy),
            )
            for i, (level, severity, text, action, strategy) in enumerate(levels)
        )

    def encoding(self) -> DataFrame:
        kinds = [
            (sem.NOMINAL, "nominal column(s) to encode", "one-hot, or target encoding for many values", "nominal"),
            (sem.ORDINAL, "ordinal column(s) to encode", "ordered codes", "ordinal"),
        ]
        return _union(
            self._grouped(
                self._features.where(F.col("type") == type_), 2, i, "encoding", "required", text, action,
                _details(encoding_type=label),
            )
            for i, (type_, text, action, label) in enumerate(kinds)
        )

    def scaling(self) -> DataFrame:
        numeric = self._features.where(F.col("type").isin(sem.NUMERIC_TYPES)).join(
            F.broadcast(self.p.spread_table.select("column_name", "outliers_iqr")), "column_name", "left"
        )
        robust = F.filter(F.col("all_rows"), lambda x: x["outliers_iqr"] > 0)
        rows = F.array_sort(F.collect_list(F.struct("position", "column_name", "outliers_iqr")))
        name = lambda x: x["column_name"]
        has_outliers = F.size(robust) > 0
        chosen = F.when(has_outliers, F.transform(robust, name)).otherwise(F.transform("all_rows", name))
        return (
            numeric.agg(rows.alias("all_rows"))
            .where(F.size("all_rows") > 0)
            .select(
                F.lit(3).alias("rule"),
                F.lit(0).alias("item"),
                F.lit("scaling").alias("type"),
                F.lit("recommended").alias("severity"),
                chosen.alias("columns"),
                F.format_string(
                    "%d %s",
                    F.size(chosen),
                    F.when(has_outliers, "numeric column(s) with outliers").otherwise("numeric column(s) to scale"),
                ).alias("description"),
                F.when(has_outliers, "robust scaling").otherwise("standard or min-max scaling").alias("suggested_action"),
                _details(
                    scaler=F.when(has_outliers, "robust").otherwise("standard"),
                    all_numeric=F.array_join(F.transform("all_rows", name), ", "),
                ).alias("details"),
            )
        )

    def outliers(self) -> DataFrame:
        """Continuous columns, the target included."""
        listed = (
            self.p.facts.where(F.col("type") == sem.CONTINUOUS)
            .join(F.broadcast(self.p.spread_table), "column_name")
            .where(F.col("outliers_iqr") / F.col("non_null") * 100 > 10)
        )
        return self._grouped(
            listed, 4, 0, "outlier_treatment", "recommended", "column(s) with more than 10%% outliers",
            "cap, transform or remove outliers", _details(method="iqr"),
        )

    def text(self) -> DataFrame:
        return self._grouped(
            self.p.facts.where(F.col("type") == sem.TEXT), 5, 0, "text_vectorization", "recommended",
            "text column(s) to vectorize", "TF-IDF", _details(methods="tfidf"),
        )

    def duplicates(self) -> DataFrame:
        row, pct = self.p.duplicate_row, self.p.duplicate_row["duplicate_pct"]
        found = []
        if pct > 1:
            found.append(
                {
                    "rule": 6,
                    "item": 0,
                    "type": "duplicate_removal",
                    "severity": "required" if pct > 10 else "recommended",
                    "columns": ["__all__"],
                    "description": f"{row['total_duplicates']} duplicate rows ({pct:.1f}%)",
                    "suggested_action": "remove duplicate rows",
                    "details": {"duplicate_count": str(row["total_duplicates"])},
                }
            )
        return local_table(self.spark, found, NEED_DDL)

    def cardinality(self) -> DataFrame:
        listed = self._features.where((F.col("type") == sem.NOMINAL) & (F.col("unique_count") > 50))
        return self._grouped(
            listed, 7, 0, "feature_selection", "optional", "column(s) with more than 50 categories",
            "group rare values or use target encoding", _details(threshold="50"),
        )

    def class_imbalance(self) -> DataFrame:
        empty = local_table(self.spark, [], NEED_DDL)
        if self.target is None or self.p.types[self.target] not in (sem.NOMINAL, sem.BOOLEAN):
            return empty
        top = [r["n"] for r in top_values(self.p.df, [self.target], 2).orderBy("rank").collect()]
        if len(top) < 2 or top[0] / top[1] <= IMBALANCE_RATIO:
            return empty
        row = {
            "rule": 8,
            "item": 0,
            "type": "class_imbalance",
            "severity": "recommended",
            "columns": [self.target],
            "description": f"largest class is {top[0] / top[1]:.1f} times the second",
            "suggested_action": "class weights, undersampling or a stratified split",
            "details": {"imbalance_ratio": f"{top[0] / top[1]:.4f}"},
        }
        return local_table(self.spark, [row], NEED_DDL)

    @functools.cached_property
    def rows(self) -> list[dict]:
        parts = [
            self.missing(), self.encoding(), self.scaling(), self.outliers(), self.text(), self.duplicates(),
            self.cardinality(), self.class_imbalance(),
        ]
        found = [r.asDict() for r in _union(parts).collect()]
        return sorted(found, key=lambda r: (r["rule"], r["item"]))

    def table(self, severity: str | None = None, type_: str | None = None) -> DataFrame:
        found = local_table(self.spark, self.rows, NEED_DDL)
        if severity:
            found = found.where(F.col("severity") == severity)
        if type_:
            found = found.where(F.col("type") == type_)
        return found

    def columns_of(self, type_: str, **details: str) -> list[str]:
        """Columns named by the needs of one type (and with the given details)."""
        return [
            c
            for r in self.rows
            if r["type"] == type_ and all(r["details"].get(k) == v for k, v in details.items())
            for c in r["columns"]
        ]

    def type_counts(self) -> DataFrame:
        return self.table().groupBy("type").agg(F.count(F.lit(1)).alias("n"))

    def summary(self) -> DataFrame:
        level = F.col("severity")
        blocked = (level == "required") & ~F.col("type").isin(AUTOMATIC)
        return self.table().agg(
            F.count(F.lit(1)).alias("total_needs"),
            *[F.count_if(level == s).alias(s) for s in SEVERITIES],
            (F.count_if(blocked) == 0).alias("can_auto_process"),
        )

    def mode_advice(self) -> DataFrame:
        auto = F.col("can_auto_process") & (F.col("required") <= 3)
        return self.summary().select(
            F.col("can_auto_process").alias("auto_suitable"),
            F.when(auto, "auto").otherwise("diy").alias("recommendation"),
            F.col("total_needs").alias("steps"),
        )

    def plan(self) -> DataFrame:
        """The preparation steps this dataset needs, in working order."""
        order = local_table(
            self.spark,
            [{"place": i, "type": t, "title": title, "how": how} for i, (t, title, how) in enumerate(STEPS)],
            "place int, type string, title string, how string",
        )
        worst = F.min(F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")))
        needs = self.table().select("type", "severity", F.explode("columns").alias("column"))
        dates = self.p.facts.where(F.col("type") == sem.DATETIME).select(
            F.lit("datetime").alias("type"), F.lit("recommended").alias("severity"), F.col("column_name").alias("column")
        )
        steps = needs.unionByName(dates).groupBy("type").agg(
            F.element_at(F.array(*map(F.lit, SEVERITIES)), worst.cast("int")).alias("severity"),
            F.array_join(F.array_sort(F.collect_set("column")), ", ").alias("columns"),
        )
        number = F.row_number().over(Window.orderBy("place"))  # at most nine steps
        return order.join(steps, "type").select(number.alias("step"), "title", "severity", "columns", "how")


def _union(parts) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)
