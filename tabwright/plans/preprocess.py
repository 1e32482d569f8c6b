"""Preparation plan: fitted once as literals, applied as one projection to batch or stream."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession

from tabwright.functions import semantics as sem
from tabwright.functions.columns import named, nan_to_null
from tabwright.operators import steps as st
from tabwright.operators.imputation import fit_iterative
from tabwright.operators.needs import Needs
from tabwright.operators.profile import Profile
from tabwright.operators.steps import apply_step
from tabwright.operators.textvec import fit_tfidf
from tabwright.session import local_table

MODES = ("minimal", "balanced", "aggressive")
ADVANCED = ("median", "iterative")
FEW, MANY = 10, 50  # up to FEW values: one-hot; up to MANY: one-hot without the first; above: codes


class PreprocessPlan:
    """Ordered steps: duplicates, dates, missing values, outliers, encoding, scaling, text."""

    def __init__(self, steps: list[dict], tables: dict[str, DataFrame], meta: dict):
        self.steps = steps
        self.tables = tables
        self.meta = meta

    # ---- fitting ------------------------------------------------------------------

    @classmethod
    def fit(
        cls, df: DataFrame, target: str | None = None, mode: str = "balanced", profile: Profile | None = None, advanced: str = "median"
    ) -> PreprocessPlan:
        """advanced: what fills numbers with 20-50 % missing, `median` or `iterative` (chained regressions on all numeric columns)."""
        if mode not in MODES:
            raise ValueError(f"mode must be one of {MODES}")
        if advanced not in ADVANCED:
            raise ValueError(f"advanced must be one of {ADVANCED}")
        profile = profile or Profile(df)
        needs = Needs(profile, target)
        types = {c: t for c, t in profile.types.items() if c != target}
        steps: list[dict] = []
        tables: dict[str, DataFrame] = {}
        current = profile.df

        def add(step: dict) -> None:
            nonlocal current
            steps.append(step)
            current = apply_step(current, step, tables)

        def of(*wanted: str) -> list[str]:
            return [c for c, t in types.items() if t in wanted and c not in dropped]

        dropped: set[str] = set()
        held = None
        if needs.columns_of("duplicate_removal"):
            add({"op": "drop_duplicates"})
            current = held = current.persist()  # every later statistic reads the distinct rows
        dates = of(sem.DATETIME)
        if dates:
            add({"op": "date_parts", "columns": dates})

        # the target and the date columns (replaced by their parts) are never imputed
        fixed = {target, *dates}
        sparse = [c for c in needs.columns_of("missing_values", strategy="drop_column") if c not in fixed]
        if sparse:
            add({"op": "drop", "columns": sparse})
            dropped |= set(sparse)
        holes = [
            c
            for strategy in ("advanced_imputation", "simple_imputation")
            for c in needs.columns_of("missing_values", strategy=strategy)
            if c not in fixed
        ]
        numeric = of(*sem.NUMERIC_TYPES)
        by_median = [c for c in holes if c in numeric]
        by_mode = [c for c in holes if c not in numeric and c in current.columns]
        fills = []
        if advanced == "iterative" and set(by_median) & set(needs.columns_of("missing_values", strategy="advanced_imputation")):
            add(fit_iterative(current, numeric))
            by_median = []
        if by_median:
            fills.append(st.fit_median(current, by_median))
        if by_mode:
            fills.append(st.fit_mode(current, by_mode))
        for step in fills:
            add(step)

        outliers = [c for c in needs.columns_of("outlier_treatment") if c in numeric]
        if mode == "aggressive" and outliers:
            add(st.fit_clip_iqr(current, outliers))

        categories = of(*sem.CATEGORY_TYPES)
        size = {c: profile.by_name[c]["unique_count"] for c in categories}
        encoded = st.fit_one_hot(current, [c for c in categories if size[c] <= FEW])
        encoded += st.fit_one_hot(current, [c for c in categories if FEW < size[c] <= MANY], drop_first=True)
        fitted = {step["column"]: step for step in encoded}
        before = current
        for c in categories:
            if c in fitted:
                add(fitted[c])
            else:
                step, tables[c] = st.fit_codes(before, c)
                add(step)

        if numeric:
            robust = mode == "aggressive" or bool(outliers)
            method = "robust" if robust else "minmax" if mode == "minimal" else "standard"
            add(st.fit_scale(before, numeric, method))

        texts = of(sem.TEXT)
        vectors = [v for v in (fit_tfidf(before, c, before.count()) for c in texts) if v]
        for step in vectors:
            add(step)
        if vectors:
            add({"op": "drop", "columns": texts})

        if held is not None:
            held.unpersist()
        summary = needs.summary().first()
        meta = {
            "mode": mode,
            "target": target,
            "original_rows": profile.n_rows,
            "original_columns": len(profile.df.columns),
            "numeric": numeric,
            "categorical": categories,
            "text": texts,
            "needs_detected": summary["total_needs"],
            "needs_required": summary["required"],
            "columns": current.columns,
        }
        return cls(steps, tables, meta)

    # ---- use ----------------------------------------------------------------------

    def transform(self, df: DataFrame, time: str | None = None, delay: str = "10 minutes") -> DataFrame:
        """Apply to a static or streaming DataFrame.

        On a stream, a plan that drops duplicates needs the name of a `time` column: equal rows are dropped as long as
        they come within `delay` of each other, which bounds the state; rows later than that are dropped as late.
        """
        out = nan_to_null(df)
        for step in self.steps:
            if step["op"] == "drop_duplicates" and df.isStreaming:
                if time is None:
                    raise ValueError("this plan drops duplicates: name the time column of the stream")
                columns = out.columns
                marked = out.withColumn("_time", named(time).cast("timestamp")).withWatermark("_time", delay)
                out = marked.dropDuplicatesWithinWatermark(columns).drop("_time")
            else:
                out = apply_step(out, step, self.tables)
        return out

    def feature_names(self) -> list[str]:
        return [c for c in self.meta["columns"] if c != self.meta["target"]]

    def step_table(self, spark: SparkSession) -> DataFrame:
        rows = [
            {"step": i + 1, "op": s["op"], "columns": ", ".join(_touched(s))} for i, s in enumerate(self.steps)
        ]
        return local_table(spark, rows, "step int, op string, columns string")

    def summary(self, processed: DataFrame) -> DataFrame:
        """Shapes, mode, steps and need counts; `processed` is counted once."""
        features = set(self.feature_names())
        row = {
            "original_rows": self.meta["original_rows"],
            "original_columns": self.meta["original_columns"],
            "processed_rows": processed.count(),
            "processed_columns": len(processed.columns),
            "mode": self.meta["mode"],
            "steps_applied": len(self.steps),
            "needs_detected": self.meta["needs_detected"],
            "needs_required": self.meta["needs_required"],
            "numeric_features": len([c for c in self.meta["numeric"] if c in features]),
            "categorical_features": len(self.meta["categorical"]),
            "text_features": len(self.meta["text"]),
        }
        ddl = (
            "original_rows bigint, original_columns bigint, processed_rows bigint, processed_columns bigint, mode string, "
            "steps_applied bigint, needs_detected bigint, needs_required bigint, numeric_features bigint, "
            "categorical_features bigint, text_features bigint"
        )
        return local_table(processed.sparkSession, [row], ddl)

    # ---- saving -------------------------------------------------------------------

    def save(self, spark: SparkSession, path: str) -> None:
        """A JSON document of literals, and one Parquet table per coded column."""
        names = {c: f"codes_{i}" for i, c in enumerate(self.tables)}
        document = json.dumps({"steps": self.steps, "meta": self.meta, "tables": names})
        spark.range(0, 1, 1, 1).selectExpr("id").withColumn("id", _text(document)).write.mode("overwrite").text(
            os.path.join(path, "plan")
        )
        for column, name in names.items():
            self.tables[column].write.mode("overwrite").parquet(os.path.join(path, name))

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> PreprocessPlan:
        document = json.loads(spark.read.text(os.path.join(path, "plan"), wholetext=True).first()[0])
        tables = {c: spark.read.parquet(os.path.join(path, name)) for c, name in document["tables"].items()}
        return cls(document["steps"], tables, document["meta"])


def _text(document: str):
    from pyspark.sql import functions as F

    return F.lit(document)


def _touched(step: dict) -> list[str]:
    if "column" in step:
        return [step["column"]]
    for key in ("columns", "values", "bounds"):
        if key in step:
            return list(step[key])
    return []


def auto_preprocess(df: DataFrame, target: str | None = None, mode: str = "balanced", advanced: str = "median") -> DataFrame:
    """Fit a plan on the data and apply it to the same data."""
    return PreprocessPlan.fit(df, target, mode, advanced=advanced).transform(df)
