"""Model metrics as aggregates over predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import named
from tabwright.operators.ranking import running_total


def confusion(df: DataFrame, label: str, prediction: str) -> DataFrame:
    return df.groupBy(named(label).alias("label"), named(prediction).alias("prediction")).agg(F.count(F.lit(1)).alias("n"))


def classification_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """accuracy and weighted precision, recall and F1; a division by zero counts as 0."""
    cells = confusion(df, label, prediction)
    # one pass: each cell adds to its true class and to its predicted class
    both = cells.select(
        F.inline(
            F.array(
                F.struct(
                    F.col("label").cast("string").alias("class"),
                    F.col("n").alias("support"),
                    F.lit(0).cast("bigint").alias("predicted"),
                    F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hits"),
                ),
                F.struct(
                    F.col("prediction").cast("string").alias("class"),
                    F.lit(0).cast("bigint").alias("support"),
                    F.col("n").alias("predicted"),
                    F.lit(0).cast("bigint").alias("hits"),
                ),
            )
        )
    )
    per_class = both.groupBy("class").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hits")])
    precision = F.when(F.col("predicted") > 0, F.col("hits") / F.col("predicted")).otherwise(0.0)
    recall = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("hits") > 0, 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-300))).otherwise(0.0)
    total = F.sum("support")
    return per_class.agg(
        (F.sum("hits") / total).alias("accuracy"),
        (F.sum(precision * F.col("support")) / total).alias("precision_weighted"),
        (F.sum(recall * F.col("support")) / total).alias("recall_weighted"),
        (F.sum(f1 * F.col("support")) / total).alias("f1_weighted"),
    )


def _auc(levels: DataFrame, bound: int, group: str | None = None) -> DataFrame:
    """AUC from (score, pos, neg) levels; equal scores count half."""
    below = running_total(levels, "score", "neg", "neg_below", bound, group)
    area = F.sum(F.col("pos") * (F.col("neg_below") + F.col("neg") / 2))
    sums = below.groupBy(*([group] if group else [])).agg(
        area.alias("area"), F.sum("pos").alias("p"), F.sum("neg").alias("n")
    )
    auc = F.when((F.col("p") > 0) & (F.col("n") > 0), F.col("area") / (F.col("p").cast("double") * F.col("n")))
    return sums.withColumn("roc_auc", auc)


def roc_auc(df: DataFrame, label: str, score: str, positive=1) -> DataFrame:
    """Exact area under the ROC curve of a binary label."""
    hit = (named(label) == F.lit(positive)).cast("bigint")
    levels = df.groupBy(named(score).alias("score")).agg(F.sum(hit).alias("pos"), F.sum(1 - hit).alias("neg"))
    bound = int(df.agg(F.approx_count_distinct(named(score))).first()[0] * 1.2) + 1
    return _auc(levels, bound).select("roc_auc")


def roc_auc_weighted(df: DataFrame, label: str, scores: dict) -> DataFrame:
    """One-vs-rest AUC of every class, averaged by class support. `scores` is {class: column}."""
    cells = [
        F.struct(
            F.lit(str(c)).alias("class"),
            named(s).alias("score"),
            (named(label).cast("string") == str(c)).cast("bigint").alias("hit"),
        )
        for c, s in scores.items()
    ]
    long = df.select(F.inline(F.array(*cells)))
    levels = long.groupBy("class", "score").agg(F.sum("hit").alias("pos"), F.sum(1 - F.col("hit")).alias("neg"))
    sketch = [F.approx_count_distinct(named(s)).alias(str(i)) for i, s in enumerate(scores.values())]
    bound = int(max(df.agg(*sketch).first()) * 1.2) + 1
    per_class = _auc(levels, bound, "class")
    return per_class.agg((F.sum(F.col("roc_auc") * F.col("p")) / F.sum("p")).alias("roc_auc"))


def regression_metrics(df: DataFrame, label: str, prediction: str) -> DataFrame:
    """mse, rmse, mae, r2 and mape in one aggregate."""
    y, p = named(label).cast("double"), named(prediction).cast("double")
    mse = F.avg((y - p) * (y - p))
    spread = F.var_pop(y)
    return df.agg(
        mse.alias("mse"),
        F.sqrt(mse).alias("rmse"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.when(spread > 0, 1 - mse / spread).otherwise(F.when(mse == 0, 1.0).otherwise(0.0)).alias("r2"),
        (F.avg(F.abs(F.try_divide(y - p, y + F.lit(1e-10)))) * 100).alias("mape"),
    )
