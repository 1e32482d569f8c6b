"""Baseline models on Spark ML: prepare, split, fit, score, cross-validate, rank."""

from __future__ import annotations

import functools
import time
from concurrent.futures import ThreadPoolExecutor
from statistics import fmean, pstdev

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, OneVsRest, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.feature import IndexToString, SQLTransformer, StringIndexerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import columns_of, named, nan_to_null, quoted
from tabwright.operators import metrics, splits
from tabwright.operators import steps as st
from tabwright.operators.profile import Profile
from tabwright.operators.ranking import class_counts
from tabwright.operators.tasks import CLASSIFICATION, REGRESSION, TRAINABLE, TaskAdvice
from tabwright.operators.textvec import fit_tfidf, tfidf_vector
from tabwright.session import local_table
from tabwright.sources.readers import spread

LINEAR = ("logistic_regression", "linear_regression", "ridge")
CLASSIFIERS = ["logistic_regression", "random_forest", "gradient_boosting"]
REGRESSORS = ["linear_regression", "ridge", "random_forest", "gradient_boosting"]
# the two boosters of the usual baseline set are one model here
ALIASES = {"xgboost": "gradient_boosting", "lightgbm": "gradient_boosting"}
BOARD_DDL = (
    "rank int, model string, main_metric string, score double, cv_mean double, cv_std double, training_seconds double, "
    "metrics map<string,double>"
)


def _number(value: float) -> str:
    return f"CAST('{value!r}' AS DOUBLE)"


class Trainer:
    """Numeric features only; medians, means and deviations come from the training rows.

    keys: columns that identify a row for the hash split; the whole row when left out.
    features: numeric columns to use; all but the target when left out.
    """

    def __init__(
        self,
        df: DataFrame,
        target: str,
        keys: list[str] | None = None,
        features: list[str] | None = None,
        test_share: float = splits.TEST_SHARE,
        seed: int = splits.SEED,
        folds: int = splits.FOLDS,
        trees: int = 100,
        rounds: int = 100,
        max_depth: int = 10,
        classification: bool | None = None,
        parallelism: int = 4,
    ):
        self.target, self.seed, self.folds = target, seed, folds
        self.trees, self.rounds, self.max_depth = trees, rounds, max_depth
        self.parallelism = parallelism
        clean = nan_to_null(df)
        self.spark = df.sparkSession
        numeric = [c for c in columns_of(clean, "numeric") if c != target]
        self.features = numeric if features is None else features
        if not self.features:
            raise ValueError("no numeric feature column")
        if classification is None:
            classification = TaskAdvice(Profile(df), target).task_type in CLASSIFICATION
        self.classification = classification
        labelled = clean.where(named(target).isNotNull())
        split = splits.with_fold(splits.hash_split(labelled, keys, test_share, seed), keys, folds, seed)
        used = dict.fromkeys([*(keys or []), *self.features, target])
        # read by every statistic, fit and fold: only the used columns are kept, dealt out to all cores
        self.data = spread(split.select(*[named(c) for c in used], "is_test", "fold")).persist()
        self.train = self.data.where("not is_test").drop("is_test")
        self.test = self.data.where("is_test").drop("is_test", "fold")
        self.models: dict[str, PipelineModel] = {}
        self.results: list[dict] = []
        self.failures: dict[str, str] = {}

    # ---- preparation --------------------------------------------------------------

    @functools.cached_property
    def labels(self) -> list[str]:
        """Class labels in the order of their values."""
        found = class_counts(self.data, named(self.target))
        return sorted(found, key=float) if self.target in columns_of(self.data, "numeric") else sorted(found)

    @functools.cached_property
    def preparation(self) -> PipelineModel:
        """Filled and scaled feature vectors, and the numeric label."""
        medians = {c: v[0] for c, v in st.quantiles_of(self.train, self.features, [0.5]).items()}
        filled = self.train.select(
            *[F.coalesce(named(c).cast("double"), F.lit(medians[c] or 0.0)).alias(c) for c in self.features]
        )
        moments = st.moments_of(filled, self.features)
        raw, scaled = [], []
        for i, c in enumerate(self.features):
            value = f"coalesce(CAST({quoted(c)} AS DOUBLE), {_number(float(medians[c] or 0.0))})"
            mean, spread = moments[c]["mean"], moments[c]["std_pop"] or 1.0
            raw.append(f"{value} AS _x{i}")
            scaled.append(f"({value} - {_number(mean)}) / {_number(spread)} AS _s{i}")
        n = range(len(self.features))
        stages = [
            SQLTransformer(statement=f"SELECT *, {', '.join(raw + scaled)} FROM __THIS__"),
            VectorAssembler(inputCols=[f"_x{i}" for i in n], outputCol="_raw"),
            VectorAssembler(inputCols=[f"_s{i}" for i in n], outputCol="_scaled"),
        ]
        return PipelineModel(stages)

    @functools.cached_property
    def label_stage(self):
        if self.classification:
            return StringIndexerModel.from_labels(self.labels, "_target_text", "_label", handleInvalid="skip")
        return SQLTransformer(statement=f"SELECT *, CAST({quoted(self.target)} AS DOUBLE) AS _label FROM __THIS__")

    def _vectors(self, df: DataFrame) -> DataFrame:
        ready = self.preparation.transform(df)
        if self.classification:
            ready = ready.withColumn("_target_text", named(self.target).cast("string"))
        ready = self.label_stage.transform(ready)
        fold = ["fold"] if "fold" in df.columns else []
        return ready.select("_label", "_raw", "_scaled", *fold)

    # ---- models -------------------------------------------------------------------

    def estimator(self, name: str, n_train: int, label_deviation: float = 1.0):
        columns = {
            "featuresCol": "_scaled" if name in LINEAR else "_raw", "labelCol": "_label", "predictionCol": "_prediction",
        }
        if name == "logistic_regression":
            # the penalty of a C = 1 fit, per row
            return LogisticRegression(maxIter=1000, regParam=1.0 / n_train, standardization=False, **columns)
        if name == "linear_regression":
            return LinearRegression(solver="normal", regParam=0.0, **columns)
        if name == "ridge":
            # Spark scales the penalty by the label's deviation; this is alpha = 1
            penalty = label_deviation / n_train
            return LinearRegression(solver="normal", standardization=False, regParam=penalty, **columns)
        if name == "random_forest":
            forest = RandomForestClassifier if self.classification else RandomForestRegressor
            return forest(numTrees=self.trees, maxDepth=self.max_depth, seed=self.seed, **columns)
        if name == "gradient_boosting":
            if not self.classification:
                return GBTRegressor(maxIter=self.rounds, seed=self.seed, **columns)
            boosted = GBTClassifier(maxIter=self.rounds, seed=self.seed, **columns)
            return boosted if len(self.labels) == 2 else OneVsRest(classifier=boosted, **columns)
        raise ValueError(f"unknown model {name!r}")

    @functools.cached_property
    def _train_vectors(self) -> DataFrame:
        return self._vectors(self.train).persist()

    @functools.cached_property
    def _train_stats(self) -> dict:
        row = self._train_vectors.groupBy("fold").agg(
            F.count(F.lit(1)).alias("n"), F.sum("_label").alias("s"), F.sum(F.col("_label") * F.col("_label")).alias("ss")
        )
        return {r["fold"]: r.asDict() for r in row.collect()}

    def _size(self, without: int | None = None) -> tuple[int, float]:
        """Rows and label deviation of the training part, optionally without one fold."""
        used = [r for fold, r in self._train_stats.items() if fold != without]
        n = sum(r["n"] for r in used)
        mean = sum(r["s"] for r in used) / n
        return n, max(sum(r["ss"] for r in used) / n - mean * mean, 0.0) ** 0.5 or 1.0

    def train_model(self, name: str, cross_validate: bool = True) -> dict:
        """Fit on the training part, score on the test part, then cross-validate on the training part."""
        name = ALIASES.get(name, name)
        vectors = self._train_vectors
        n, deviation = self._size()
        start = time.monotonic()
        fitted = self.estimator(name, n, deviation).fit(vectors)
        seconds = time.monotonic() - start
        stages = [*self.preparation.stages, fitted]
        if self.classification:
            stages.append(IndexToString(inputCol="_prediction", outputCol="predicted_label", labels=self.labels))
        self.models[name] = PipelineModel(stages)
        scored = fitted.transform(self._vectors(self.test))
        found = self._metrics(scored)
        main = "f1_weighted" if self.classification else "r2"
        scores = self.cross_validate(name) if cross_validate else []
        result = {
            "model": name,
            "main_metric": main,
            "score": found[main],
            "metrics": found,
            "training_seconds": seconds,
            "cv_scores": scores,
            "cv_mean": fmean(scores) if scores else None,
            "cv_std": pstdev(scores) if scores else None,
        }
        self.results.append(result)
        return result

    def _metrics(self, scored: DataFrame) -> dict[str, float]:
        if not self.classification:
            return metrics.regression_metrics(scored, "_label", "_prediction").first().asDict()
        found = metrics.classification_metrics(scored, "_label", "_prediction").first().asDict()
        column = "probability" if "probability" in scored.columns else "rawPrediction"
        parts = [vector_to_array(column)[i].alias(f"p{i}") for i in range(len(self.labels))]
        scores = scored.select("_label", *parts)
        if len(self.labels) == 2:
            auc = metrics.roc_auc(scores, "_label", "p1", 1.0)
        else:
            auc = metrics.roc_auc_weighted(scores, "_label", {float(i): f"p{i}" for i in range(len(self.labels))})
        value = auc.first()[0]
        return found | ({"roc_auc": value} if value is not None else {})

    def cross_validate(self, name: str) -> list[float]:
        """Main metric per fold; the folds run side by side."""

        def one(fold: int) -> float | None:
            n, deviation = self._size(without=fold)
            held = self._train_vectors.where(F.col("fold") == fold)
            model = self.estimator(name, n, deviation).fit(self._train_vectors.where(F.col("fold") != fold))
            scored = model.transform(held)
            if self.classification:
                return metrics.classification_metrics(scored, "_label", "_prediction").first()["f1_weighted"]
            return metrics.regression_metrics(scored, "_label", "_prediction").first()["r2"]

        folds = sorted(self._train_stats)
        with ThreadPoolExecutor(self.parallelism) as pool:
            return [s for s in pool.map(one, folds) if s is not None]

    # ---- results ------------------------------------------------------------------

    def train_all(self, names: list[str] | None = None, cross_validate: bool = True) -> DataFrame:
        """Train the named (or default) models; one that fails is recorded and skipped."""
        chosen = list(dict.fromkeys(ALIASES.get(n, n) for n in names or (CLASSIFIERS if self.classification else REGRESSORS)))
        for name in chosen:
            try:
                self.train_model(name, cross_validate)
            except Exception as error:  # a model that cannot be fitted must not stop the others
                self.failures[name] = str(error)
        self.release()
        return self.leaderboard()

    def release(self) -> None:
        """Drop the cached training data; trained models and results stay usable."""
        self._train_vectors.unpersist()
        self.data.unpersist()

    def leaderboard(self) -> DataFrame:
        ordered = sorted(self.results, key=lambda r: -r["score"])
        rows = [{**r, "rank": i + 1} for i, r in enumerate(ordered)]
        return local_table(self.spark, rows, BOARD_DDL)

    def comparison(self) -> DataFrame:
        return self.leaderboard().select(
            "model",
            F.round("score", 4).alias("score"),
            F.round("cv_mean", 4).alias("cv_mean"),
            F.round("cv_std", 4).alias("cv_std"),
            F.round("training_seconds", 2).alias("seconds"),
        )

    @property
    def best(self) -> str:
        if not self.results:
            raise ValueError("no model is trained")
        return max(self.results, key=lambda r: r["score"])["model"]

    def predict(self, df: DataFrame, name: str | None = None) -> DataFrame:
        """The rows of a static or streaming DataFrame with `prediction` appended."""
        scored = self.models[name or self.best].transform(nan_to_null(df))
        out = F.col("_prediction")
        if self.classification:  # labels come back in the target's own type
            out = F.col("predicted_label").cast(self.data.schema[self.target].dataType)
        return scored.select(*[named(c) for c in df.columns], out.alias("prediction"))

    def feature_importance(self, name: str | None = None, k: int = 10) -> DataFrame:
        """The k features with the largest importance (trees) or absolute coefficient (linear)."""
        chosen = name or self.best
        model = next(s for s in self.models[chosen].stages if hasattr(s, "predictionCol") and hasattr(s, "featuresCol"))
        if hasattr(model, "featureImportances"):
            weights = list(model.featureImportances.toArray())
        elif hasattr(model, "coefficientMatrix"):
            weights = list(abs(model.coefficientMatrix.toArray()).mean(axis=0))
        elif hasattr(model, "coefficients"):
            weights = list(abs(model.coefficients.toArray()))
        else:  # one-vs-rest: mean over the binary models
            parts = [m.featureImportances.toArray() for m in model.models]
            weights = list(sum(parts) / len(parts))
        rows = [{"feature": c, "importance": float(w)} for c, w in zip(self.features, weights)]
        table = local_table(self.spark, rows, "feature string, importance double")
        return table.orderBy(F.desc("importance"), "feature").limit(k)


# ---- other baselines --------------------------------------------------------------


def train_text_baseline(df: DataFrame, text: str, target: str, keys: list[str] | None = None, seed: int = splits.SEED):
    """TF-IDF and logistic regression: (predictions of the test part, metrics table)."""
    labelled = splits.hash_split(df.where(named(target).isNotNull()), keys, seed=seed)
    train, test = labelled.where("not is_test"), labelled.where("is_test")
    step = fit_tfidf(train, text, train.count())
    if step is None:
        raise ValueError(f"no term of {text} occurs in two documents")
    labels = sorted(class_counts(train, named(target)))
    indexer = StringIndexerModel.from_labels(labels, "_target_text", "_label", handleInvalid="skip")

    def ready(part):
        return indexer.transform(tfidf_vector(part, step, "_features").withColumn("_target_text", named(target).cast("string")))

    model = LogisticRegression(
        featuresCol="_features", labelCol="_label", predictionCol="_prediction", maxIter=1000,
        regParam=1.0 / max(train.count(), 1), standardization=False,
    ).fit(ready(train))
    scored = model.transform(ready(test))
    return scored.select(*[named(c) for c in df.columns], "_label", "_prediction"), metrics.classification_metrics(
        scored, "_label", "_prediction"
    )


def train_kmeans(df: DataFrame, columns: list[str] | None = None, k: int | None = None, seed: int = splits.SEED):
    """K-Means over scaled columns: (rows with `cluster`, silhouette). k defaults to min(10, n // 10)."""
    clean = nan_to_null(df)
    columns = columns or columns_of(clean, "numeric")
    if k is None:
        k = max(2, min(10, clean.count() // 10))
    filled = st.apply_step(clean, st.fit_median(clean, columns))
    scaled = st.apply_step(filled, st.fit_scale(filled, columns, "standard"))
    vectors = VectorAssembler(inputCols=[f"_c{i}" for i in range(len(columns))], outputCol="_features").transform(
        scaled.select("*", *[named(c).alias(f"_c{i}") for i, c in enumerate(columns)])
    )
    model = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(vectors)
    clustered = model.transform(vectors)
    silhouette = ClusteringEvaluator(featuresCol="_features", predictionCol="cluster").evaluate(clustered)
    return clustered.select(*[named(c) for c in df.columns], "cluster"), silhouette


def full_modeling(df: DataFrame, target: str | None, models: list[str] | None = None, **options) -> dict:
    """Task, recommendations and, for tabular supervised tasks, a trained leaderboard."""
    advice = TaskAdvice(Profile(df), target)
    found = {"task": advice.task_info(), "facts": advice.dataset_facts(), "recommendations": advice.recommendations()}
    if target is None:
        return found | {"message": "a target column is needed for training"}
    if advice.task_type not in TRAINABLE:
        return found | {"message": f"no automatic training for {advice.task_type}"}
    trainer = Trainer(df, target, classification=advice.task_type != REGRESSION, **options)
    return found | {"leaderboard": trainer.train_all(models), "trainer": trainer, "flags": advice.task_flags()}

