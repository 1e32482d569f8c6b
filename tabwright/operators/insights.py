"""Ranked findings and suggestions: rules over the facts of a profile.

Every rule returns rows of one schema; `item` orders the rows of a rule.
findings:    rule, item, category, severity, message, details
suggestions: rule, item, action, reason, priority, how
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabwright.functions import semantics as sem
from tabwright.operators.profile import Profile
from tabwright.session import local_table

FINDING_DDL = "rule int, item int, category string, severity string, message string, details string"
SUGGESTION_DDL = "rule int, item int, action string, reason string, priority string, how string"

# Rule thresholds in percent, shares or counts.
OUTLIER_PCT, SEVERE_OUTLIER_PCT = 10, 20
SEVERE_BALANCE, LOW_BALANCE = 0.3, 0.5
MANY_VALUES, RARE_VALUES = 50, 100
PRIORITIES = ["critical", "high", "medium", "low"]
LAST = 1_000_000  # item of a suggestion that follows those for single columns


def _finding(rule, category, severity, message, item=None, details=None):
    return [
        F.lit(rule).alias("rule"),
        (F.lit(0) if item is None else item).cast("int").alias("item"),
        F.lit(category).alias("category"),
        severity.alias("severity"),
        message.alias("message"),
        (F.lit("") if details is None else details).alias("details"),
    ]


def _suggestion(rule, item, action, reason, priority, how):
    return [
        F.lit(rule).alias("rule"),
        item.cast("int").alias("item"),
        action.alias("action"),
        F.lit(reason).alias("reason"),
        F.lit(priority).alias("priority"),
        how.alias("how"),
    ]


def names_in_order():
    """Column names of a group joined in column order (bounded by the width of the table)."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"])
    return F.array_join(listed, ", ")


class Insights:
    def __init__(self, profile: Profile):
        self.p = profile
        self.spark = profile.spark

    def _rows(self, *rows: tuple) -> DataFrame:
        names = ["rule", "item", "category", "severity", "message", "details"]
        return local_table(self.spark, [dict(zip(names, r)) for r in rows], FINDING_DDL)

    def _advice(self, *rows: tuple) -> DataFrame:
        names = ["rule", "item", "action", "reason", "priority", "how"]
        return local_table(self.spark, [dict(zip(names, r)) for r in rows], SUGGESTION_DDL)

    # ---- 1 missing values ---------------------------------------------------------

    def missing(self) -> DataFrame:
        if not self.p.overview_row["missing_cells"]:
            return self._rows((1, 0, "missing_values", "info", "no missing values", ""))
        grouped = self.p.missing_by_column().groupBy(F.col("severity").alias("level")).agg(
            F.count(F.lit(1)).alias("n"), names_in_order().alias("columns")
        )
        level = F.col("level")
        span = F.when(level == "critical", "more than 50%").when(level == "high", "20-50%").otherwise("5-20%")
        return grouped.where(level != "low").select(
            *_finding(
                1,
                "missing_values",
                item=F.when(level == "critical", 0).when(level == "high", 1).otherwise(2),
                severity=F.when(level == "moderate", "medium").otherwise(level),
                message=F.concat(F.col("n").cast("string"), F.lit(" column(s) with "), span, F.lit(" missing values")),
                details=F.col("columns"),
            )
        )

    def missing_suggestions(self) -> DataFrame:
        by_column = self.p.missing_by_column()
        rank = F.row_number().over(Window.orderBy("position"))  # one row per column
        drops = by_column.where("severity = 'critical'").withColumn("item", rank)
        drop = drops.select(
            *_suggestion(
                1,
                F.col("item"),
                F.format_string('drop column "%s"', "column_name"),
                "more than half of its values are missing",
                "high",
                F.format_string('df.drop("%s")', "column_name"),
            )
        )
        fills = by_column.where("severity in ('high', 'moderate')").groupBy("severity").count()
        fill = fills.select(
            F.lit(1).alias("rule"),
            F.when(F.col("severity") == "high", LAST).otherwise(LAST + 1).alias("item"),  # behind all dropped columns
            F.when(F.col("severity") == "high", "impute columns with 20-50% missing values")
            .otherwise("impute columns with 5-20% missing values")
            .alias("action"),
            F.lit("most models need complete rows").alias("reason"),
            F.when(F.col("severity") == "high", "high").otherwise("medium").alias("priority"),
            F.lit("median for numbers, mode for the rest").alias("how"),
        )
        return drop.unionByName(fill)

    # ---- 2 duplicates -------------------------------------------------------------

    def duplicates(self) -> DataFrame:
        n, pct = self.p.duplicate_row["total_duplicates"], self.p.duplicate_row["duplicate_pct"]
        if n == 0:
            return self._rows((2, 0, "duplicates", "info", "no duplicate rows", ""))
        if pct > 1:
            level = "critical" if pct > 10 else "medium"
            return self._rows((2, 0, "duplicates", level, f"{n} duplicate rows ({pct:.1f}%)", str(n)))
        return self._rows()

    def duplicate_suggestions(self) -> DataFrame:
        pct = self.p.duplicate_row["duplicate_pct"]
        if pct > 1:
            level = "critical" if pct > 10 else "medium"
            return self._advice(
                (2, 0, "remove duplicate rows", "repeated rows bias statistics and models", level, "df.dropDuplicates()")
            )
        return self._advice()

    # ---- 3 quality ----------------------------------------------------------------

    def quality(self) -> DataFrame:
        score = self.p.quality_row["overall"]
        level = "info" if score >= 90 else "low" if score >= 70 else "medium" if score >= 50 else "critical"
        return self._rows((3, 0, "quality", level, f"quality score {score:.1f}", f"{score:.1f}"))

    # ---- 4 target -----------------------------------------------------------------

    def _target(self) -> DataFrame:
        return self.p.facts.where(F.col("column_name") == (self.p.suggested_target or ""))

    def target(self) -> DataFrame:
        if self.p.suggested_target is None:
            return self._rows((4, 0, "target", "info", "no target column found", ""))
        classes = F.col("unique_count")
        is_class = F.col("type").isin(sem.CATEGORY_TYPES)
        many = is_class & (classes > 20)
        kind = (
            F.when(~is_class, "regression")
            .when(classes == 2, "binary_classification")
            .when(classes <= 20, "multiclass_classification")
            .otherwise("high_cardinality_target")
        )
        main = self._target().select(
            *_finding(
                4,
                "target",
                severity=F.when(many, "medium").otherwise("info"),
                message=F.format_string('column "%s" looks like a target: %s', "column_name", kind),
                details=kind,
            )
        )
        skewed = self._skewed_target().select(
            *_finding(
                4,
                "target",
                item=F.lit(1),
                severity=F.lit("high"),
                message=F.format_string('target "%s" has imbalanced classes', "column_name"),
                details=F.format_string("%.4f", "balance"),
            )
        )
        return main.unionByName(skewed)

    def _skewed_target(self) -> DataFrame:
        return self._target().where(F.col("type").isin(sem.NOMINAL, sem.BOOLEAN) & (F.col("balance") < LOW_BALANCE))

    def target_suggestions(self) -> DataFrame:
        return self._skewed_target().select(
            *_suggestion(
                4,
                F.lit(0),
                F.format_string('balance the classes of "%s"', "column_name"),
                "a dominant class biases the model",
                "high",
                F.lit("class weights, undersampling or a stratified split"),
            )
        )

    # ---- 5 correlations -----------------------------------------------------------

    def correlations(self) -> DataFrame:
        if len(self.p.numeric_columns) < 2:
            return self._rows()
        pairs = self.p.high_correlations()
        if pairs.isEmpty():
            return self._rows((5, 0, "correlations", "info", "no correlation above 0.7", ""))
        listed = F.transform(
            F.array_sort(F.collect_list(F.struct((-F.abs("correlation")).alias("size"), "i", "j", "col1", "col2"))),
            lambda x: F.concat(x["col1"], F.lit(" ~ "), x["col2"]),
        )
        grouped = pairs.groupBy("strength").agg(F.count(F.lit(1)).alias("n"), F.array_join(listed, ", ").alias("top"))
        strong = F.col("strength") == "strong"
        return grouped.select(
            *_finding(
                5,
                "correlations",
                item=F.when(strong, 0).otherwise(1),
                severity=F.when(strong, "high").otherwise("medium"),
                message=F.concat(
                    F.col("n").cast("string"), F.lit(" "), F.col("strength"), F.lit("ly correlated column pair(s)")
                ),
                details=F.when(strong, F.col("top")).otherwise(""),
            )
        )

    def correlation_suggestions(self) -> DataFrame:
        found = self.p.high_correlations().where("strength = 'strong'").limit(1)
        return found.select(
            *_suggestion(
                5,
                F.lit(0),
                F.lit("drop or combine strongly correlated columns"),
                "collinear features make linear models unstable",
                "high",
                F.lit("keep one column of each pair"),
            )
        )

    # ---- 6 imbalance --------------------------------------------------------------

    def imbalance(self) -> DataFrame:
        severe = F.col("balance") < SEVERE_BALANCE
        return (
            self.p.facts.where(F.col("type").isin(sem.NOMINAL, sem.ORDINAL) & (F.col("balance") < LOW_BALANCE))
            .select(
                *_finding(
                    6,
                    "imbalance",
                    item=F.col("position"),
                    severity=F.when(severe, "high").otherwise("medium"),
                    message=F.format_string(
                        'column "%s" is %s imbalanced', "column_name", F.when(severe, "severely").otherwise("moderately")
                    ),
                    details=F.format_string("%.4f", "balance"),
                )
            )
        )

    # ---- 7 outliers ---------------------------------------------------------------

    def _outlier_columns(self) -> DataFrame:
        share = F.col("outliers_iqr") / F.col("non_null") * 100
        return (
            self.p.facts.where(F.col("type").isin(sem.NUMERIC_TYPES))
            .join(F.broadcast(self.p.spread_table), "column_name")
            .withColumn("outlier_pct", share)
            .where(F.col("outlier_pct") > OUTLIER_PCT)
        )

    def outliers(self) -> DataFrame:
        listed = self._outlier_columns()
        severe = F.col("outlier_pct") > SEVERE_OUTLIER_PCT
        totals = listed.agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(severe).alias("n_severe"),
            names_in_order().alias("columns"),
        ).where("n > 0")
        severe_names = listed.where(severe).groupBy().agg(
            F.count(F.lit(1)).alias("n"), names_in_order().alias("columns")
        )
        first = severe_names.where("n > 0").select(
            *_finding(
                7,
                "outliers",
                severity=F.lit("high"),
                message=F.format_string("%d column(s) with more than 20%% outliers", "n"),
                details=F.col("columns"),
            )
        )
        second = totals.select(
            *_finding(
                7,
                "outliers",
                item=F.lit(1),
                severity=F.when(F.col("n_severe") > 0, "low").otherwise("medium"),
                message=F.format_string("%d numeric column(s) with more than 10%% outliers", "n"),
                details=F.col("columns"),
            )
        )
        return first.unionByName(second)

    def outlier_suggestions(self) -> DataFrame:
        return self._outlier_columns().limit(1).select(
            *_suggestion(
                7,
                F.lit(0),
                F.lit("review outliers"),
                "extreme values dominate means and distances",
                "medium",
                F.lit("log transform, IQR capping or robust scaling"),
            )
        )

    # ---- 8 numbers stored as text -------------------------------------------------

    def _numeric_text(self) -> DataFrame:
        return self.p.facts.where((F.col("kind") == "string") & (F.col("digit_share") > 0.9))

    def numeric_text(self) -> DataFrame:
        return self._numeric_text().select(
            *_finding(
                8,
                "data_types",
                item=F.col("position"),
                severity=F.lit("medium"),
                message=F.format_string('column "%s" holds numbers as text', "column_name"),
                details=F.lit("numeric"),
            )
        )

    def numeric_text_suggestions(self) -> DataFrame:
        return self._numeric_text().select(
            *_suggestion(
                8,
                F.col("position"),
                F.format_string('cast "%s" to a number', "column_name"),
                "text cannot be averaged or scaled",
                "medium",
                F.format_string("try_cast(%s as double)", "column_name"),
            )
        )

    # ---- 9 cardinality ------------------------------------------------------------

    def cardinality(self) -> DataFrame:
        return self.p.facts.where((F.col("type") == sem.NOMINAL) & (F.col("unique_count") > MANY_VALUES)).select(
            *_finding(
                9,
                "cardinality",
                item=F.col("position"),
                severity=F.lit("medium"),
                message=F.format_string('column "%s" has %d distinct values', "column_name", "unique_count"),
                details=F.col("unique_count").cast("string"),
            )
        )

    def cardinality_suggestions(self) -> DataFrame:
        return self.p.facts.where((F.col("type") == sem.NOMINAL) & (F.col("unique_count") > RARE_VALUES)).select(
            *_suggestion(
                9,
                F.col("position"),
                F.format_string('group rare values of "%s"', "column_name"),
                "many categories make sparse features",
                "medium",
                F.lit("values below 1% of rows become 'Other'"),
            )
        )

    # ---- 10 constant columns ------------------------------------------------------

    def constant(self) -> DataFrame:
        one = F.col("unique_count") == 1
        near = (F.col("unique_count") == 2) & (F.col("non_null") > 100) & (F.col("top_count") / F.col("non_null") > 0.99)
        return self.p.facts.where(one | near).select(
            *_finding(
                10,
                "constant",
                item=F.col("position"),
                severity=F.when(one, "high").otherwise("medium"),
                message=F.when(one, F.format_string('column "%s" is constant', "column_name")).otherwise(
                    F.format_string('column "%s" is nearly constant', "column_name")
                ),
                details=F.when(one, "").otherwise(F.col("top_value")),
            )
        )

    def constant_suggestions(self) -> DataFrame:
        return self.p.facts.where("unique_count = 1").select(
            *_suggestion(
                10,
                F.col("position"),
                F.format_string('drop constant column "%s"', "column_name"),
                "a constant carries no information",
                "high",
                F.format_string('df.drop("%s")', "column_name"),
            )
        )

    # ---- 11 all together ----------------------------------------------------------

    @functools.cached_property
    def _collected(self) -> tuple[list[dict], list[dict]]:
        """All findings and suggestions; a few rows per column at most."""
        findings = [
            self.missing(),
            self.duplicates(),
            self.quality(),
            self.target(),
            self.correlations(),
            self.imbalance(),
            self.outliers(),
            self.numeric_text(),
            self.cardinality(),
            self.constant(),
        ]
        suggestions = [
            self.missing_suggestions(),
            self.duplicate_suggestions(),
            self.target_suggestions(),
            self.correlation_suggestions(),
            self.outlier_suggestions(),
            self.numeric_text_suggestions(),
            self.cardinality_suggestions(),
            self.constant_suggestions(),
        ]
        union = functools.partial(functools.reduce, DataFrame.unionByName)
        return (
            [r.asDict() for r in union(findings).collect()],
            [r.asDict() for r in union(suggestions).collect()],
        )

    def findings(self) -> DataFrame:
        return local_table(self.spark, self._collected[0], FINDING_DDL).orderBy("rule", "item")

    def suggestions(self) -> DataFrame:
        """Ordered by priority, then by rule."""
        rank = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
        return local_table(self.spark, self._collected[1], SUGGESTION_DDL).orderBy(rank, "rule", "item")

    def critical_issues(self) -> DataFrame:
        return self.findings().where(F.col("severity").isin("critical", "high"))

    def severity_counts(self) -> DataFrame:
        return self.findings().groupBy("severity").agg(F.count(F.lit(1)).alias("n"))

    def summary(self) -> DataFrame:
        findings = self.findings().agg(
            F.count(F.lit(1)).alias("total_insights"),
            F.count_if(F.col("severity") == "critical").alias("critical_issues"),
            F.count_if(F.col("severity") == "high").alias("high_priority"),
        )
        return findings.withColumn("total_suggestions", F.lit(len(self._collected[1])).cast("bigint"))

    def digest(self) -> DataFrame:
        """The first 3 critical and 3 high findings and the first 5 suggestions."""
        ranked = self.findings().where(F.col("severity").isin("critical", "high")).withColumn(
            "rank", F.row_number().over(Window.partitionBy("severity").orderBy("rule", "item"))
        )
        issues = ranked.where("rank <= 3").select(
            F.concat(F.lit("finding_"), F.col("severity")).alias("part"), "rank", F.col("message").alias("line")
        )
        order = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
        advice = local_table(self.spark, self._collected[1], SUGGESTION_DDL).withColumn(
            "rank", F.row_number().over(Window.orderBy(order, "rule", "item"))
        )
        advice = advice.where("rank <= 5").select(F.lit("suggestion").alias("part"), "rank", F.col("action").alias("line"))
        return issues.unionByName(advice)
