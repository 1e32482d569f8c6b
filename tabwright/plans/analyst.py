"""One object for the whole way: analyze, preprocess, train, report."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.operators.insights import Insights
from tabwright.operators.needs import Needs
from tabwright.operators.profile import Profile
from tabwright.operators.tasks import TRAINABLE, TaskAdvice
from tabwright.plans.preprocess import PreprocessPlan
from tabwright.plans.training import Trainer
from tabwright.session import local_table
from tabwright.sources import writers


class Analyst:
    """Chainable: Analyst(df, "target").analyze().preprocess().train().report(path)."""

    def __init__(self, df: DataFrame, target: str | None = None):
        if not isinstance(df, DataFrame):
            raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")
        if df.isEmpty():
            raise ValueError("the DataFrame is empty")
        self.df = df
        self.target = target
        self.profile: Profile | None = None
        self.insights: Insights | None = None
        self.plan: PreprocessPlan | None = None
        self.processed: DataFrame | None = None
        self.trainer: Trainer | None = None
        self.leaderboard: DataFrame | None = None

    def analyze(self) -> Analyst:
        self.profile = Profile(self.df)
        self.insights = Insights(self.profile)
        return self

    def preprocess(self, mode: str = "balanced") -> Analyst:
        if self.profile is None:
            self.analyze()
        self.plan = PreprocessPlan.fit(self.df, self.target, mode, self.profile)
        self.processed = self.plan.transform(self.df)
        return self

    def train(self, models: list[str] | None = None, **options) -> Analyst:
        if self.target is None:
            raise ValueError("training needs a target")
        data = self.processed if self.processed is not None else self.df
        advice = TaskAdvice(Profile(data), self.target)
        if advice.task_type not in TRAINABLE:
            raise ValueError(f"no automatic training for {advice.task_type}")
        self.trainer = Trainer(data, self.target, classification=advice.task_type != "regression", **options)
        self.leaderboard = self.trainer.train_all(models)
        return self

    def summary(self) -> DataFrame:
        """(item, value) pairs of what is known so far."""
        rows: list[tuple[str, str]] = []
        if self.target:
            rows.append(("target", self.target))
        if self.profile is not None:
            o = self.profile.overview_row
            rows += [
                ("rows", str(o["n_rows"])),
                ("columns", str(o["n_columns"])),
                ("quality", f"{self.profile.quality_row['overall']:.1f}"),
                ("missing_pct", f"{o['missing_pct']:.1f}"),
            ]
            suggested = self.profile.suggested_target
            if suggested:
                rows.append(("suggested_target", f"{suggested} ({self.profile.types[suggested]})"))
        if self.processed is not None:
            rows.append(("processed_columns", str(len(self.processed.columns))))
        if self.trainer is not None and self.trainer.results:
            best = max(self.trainer.results, key=lambda r: r["score"])
            rows.append(("best_model", f"{best['model']} ({best['main_metric']}: {best['score']:.4f})"))
        return local_table(self.df.sparkSession, [{"item": k, "value": v} for k, v in rows], "item string, value string")

    def dataset_class(self) -> DataFrame:
        """missing_heavy (> 30 % missing), large_clean (> 100,000 rows) or small_clean."""
        return self._profile.overview().select(
            F.when(F.col("missing_pct") > 30, "missing_heavy")
            .when(F.col("n_rows") > 100_000, "large_clean")
            .otherwise("small_clean")
            .alias("dataset_class")
        )

    def quick_suggestions(self) -> DataFrame:
        """At most two short messages: missing share and the strongest high correlation."""
        missing = self._profile.overview().where("missing_pct > 5").select(
            F.lit(1).alias("item"), F.format_string("%.1f%% missing values, consider imputation", "missing_pct").alias("message")
        )
        strongest = self._profile.high_correlations().limit(1).select(
            F.lit(2).alias("item"),
            F.format_string("%s and %s are highly correlated (%.2f)", "col1", "col2", "correlation").alias("message"),
        )
        return missing.unionByName(strongest)

    @property
    def _profile(self) -> Profile:
        if self.profile is None:
            self.analyze()
        return self.profile

    @functools.cached_property
    def needs(self) -> Needs:
        return Needs(self._profile, self.target)

    def result_tables(self) -> dict[str, DataFrame]:
        p = self._profile
        tables = {
            "overview": p.overview(),
            "column_facts": p.facts,
            "numeric_stats": p.numeric_stats(),
            "correlations": p.correlation_matrix(),
            "missing": p.missing_by_column(),
            "duplicates": p.duplicates(),
            "quality": p.quality_score(),
            "findings": self.insights.findings(),
            "suggestions": self.insights.suggestions(),
            "needs": self.needs.table(),
            "plan": self.needs.plan(),
            "summary": self.summary(),
        }
        if self.leaderboard is not None:
            tables["leaderboard"] = self.leaderboard
        return tables

    def report(self, path: str) -> DataFrame:
        """Write every result table and the data below `path`; returns (table, location)."""
        written = writers.write_result_tables(self.result_tables(), path)
        data = self.processed if self.processed is not None else self.df
        writers.write_csv(data, f"{path}/data")
        rows = [{"table": w.rsplit("/", 1)[1], "location": w} for w in written] + [{"table": "data", "location": f"{path}/data"}]
        return local_table(self.df.sparkSession, rows, "table string, location string")


def run_complete_analysis(df: DataFrame, target: str | None, path: str, mode: str = "balanced") -> DataFrame:
    """Analyze, preprocess and write the report; training is a separate call."""
    return Analyst(df, target).analyze().preprocess(mode).report(path)
