"""Task detection, recommendation, splits, metrics, baselines and the facade."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from checks.facts_sql import facts_cte
from checks.profiling import TARGET_SQL, distinct_rows
from checks.registry import register
from checks.views import load, view_sql
from tabwright.operators import metrics, splits, tasks
from tabwright.operators.insights import Insights
from tabwright.operators.profile import Profile
from tabwright.operators.tasks import TaskAdvice
from tabwright.plans.analyst import Analyst
from tabwright.plans.preprocess import PreprocessPlan
from tabwright.plans.training import Trainer, full_modeling, train_kmeans, train_text_baseline
from tabwright.session import scratch_path
from tabwright.streaming.apply import prepare_stream, stream_files

CLASSES = "('categorical_nominal', 'categorical_ordinal', 'boolean')"


def task_sql(target):
    """Task of a view, from its facts."""
    return f""", s AS (SELECT count(*) FILTER (type = 'text') AS texts, count(*) FILTER (type = 'datetime') AS dates,
      count(*) FILTER (type LIKE 'numeric%') AS numbers, max(total) AS n,
      max(type) FILTER (column_name = '{target or ''}') AS tt, max(unique_count) FILTER (column_name = '{target or ''}') AS nc
      FROM facts),
    task AS (SELECT CASE
      WHEN texts > 0 THEN CASE WHEN tt IS NULL THEN 'clustering' WHEN tt IN {CLASSES} THEN 'nlp_classification'
        ELSE 'nlp_regression' END
      WHEN dates > 0 AND tt LIKE 'numeric%' THEN 'time_series'
      WHEN tt LIKE 'numeric%' OR tt = 'datetime' THEN 'regression'
      WHEN tt IN {CLASSES} THEN CASE WHEN nc = 2 THEN 'binary_classification' ELSE 'multiclass_classification' END
      WHEN tt IS NULL AND numbers >= 2 THEN 'clustering' ELSE 'unknown' END AS task_type, texts, n, tt, nc FROM s)"""


for view, target in (
    ("lineitem", "l_returnflag"), ("orders", "o_totalprice"), ("labels", "quality"), ("documents", None),
    ("labels_docs", "quality"), ("labels_docs", "n_chars"), ("part", "p_retailprice"), ("customer", None), ("events", "ts"),
):

    @register(
        f"detect_task_{view}_{target or 'none'}",
        facts_cte(view)
        + task_sql(target)
        + f"""SELECT task_type, coalesce(tt, '') AS target_type, coalesce(CASE WHEN tt IN {CLASSES} THEN nc END, -1) AS n_classes,
        coalesce(CASE WHEN texts = 0 AND task_type = 'clustering' THEN CAST(least(10, floor(n / 10)) AS BIGINT) END, -1)
        AS suggested_k FROM task""",
    )
    def detect_task(spark, sf, view=view, target=target):
        info = TaskAdvice(Profile(load(spark, sf, view)), target).task_info()
        return info.select(
            "task_type",
            F.coalesce("target_type", F.lit("")).alias("target_type"),
            F.coalesce("n_classes", F.lit(-1)).cast("bigint").alias("n_classes"),
            F.coalesce("suggested_k", F.lit(-1)).cast("bigint").alias("suggested_k"),
        )


def data_facts(target):
    return f""", df AS (SELECT max(total) AS n_samples, count(*) - {1 if target else 0} AS n_features,
      sum(null_count) / sum(total) * 100 AS missing_pct, sum(null_count) > 0 AS has_missing,
      (SELECT max(outliers_iqr) FROM spread WHERE column_name <> '{target or ''}') / max(total) > 0.05 AS has_outliers,
      count(*) - {1 if target else 0} < 50 AS needs_interpretability, max(total) > 100000 AS speed_critical FROM facts)"""


for view, target in (("orders_missing", "o_totalprice"), ("lineitem_outlier", "l_returnflag")):

    @register(f"dataset_facts_{view}", facts_cte(view, True) + data_facts(target) + "SELECT * FROM df", "missing_pct")
    def dataset_facts(spark, sf, view=view, target=target):
        return TaskAdvice(Profile(load(spark, sf, view)), target).dataset_facts()


def quote(v):
    return "'" + v.replace("'", "''") + "'"


CATALOGUE_SQL = "catalogue(place, model_key, model_name, tasks, complexity, interpretability, miss, outl, train, infer, memory, best_for, advantages) AS (VALUES " + ", ".join(
    f"({r['place']}, {quote(r['model_key'])}, {quote(r['model_name'])}, {quote(','.join(r['tasks']))}, {quote(r['complexity'])}, "
    f"{quote(r['interpretability'])}, {r['handles_missing']}, {r['handles_outliers']}, {quote(r['training_speed'])}, "
    f"{quote(r['inference_speed'])}, {quote(r['memory'])}, {quote(r['best_for'])}, {quote(r['advantages'])})"
    for r in tasks.catalogue_rows()
) + ")"


def ranked_sql(target):
    return (
        task_sql(target)
        + data_facts(target)
        + f""", {CATALOGUE_SQL}, scored AS (SELECT c.*, greatest(0.0, 100.0
      + CASE WHEN n_samples < 1000 THEN CASE complexity WHEN 'low' THEN 20 WHEN 'high' THEN -30 ELSE 0 END
             WHEN n_samples > 100000 THEN CASE WHEN train = 'fast' THEN 15 ELSE 0 END
               + CASE WHEN memory IN ('low', 'very_low') THEN 10 ELSE 0 END ELSE 0 END
      + CASE WHEN has_missing THEN CASE WHEN miss THEN 15 ELSE -20 END ELSE 0 END
      + CASE WHEN has_outliers THEN CASE WHEN outl THEN 10 ELSE -15 END ELSE 0 END
      + CASE WHEN needs_interpretability THEN CASE interpretability WHEN 'very_high' THEN 20 WHEN 'high' THEN 15
          WHEN 'medium' THEN 5 WHEN 'low' THEN -10 ELSE -20 END ELSE 0 END
      + CASE WHEN speed_critical THEN CASE WHEN train LIKE '%fast' THEN 15 ELSE 0 END + CASE WHEN infer LIKE '%fast' THEN 10
          ELSE 0 END ELSE 0 END)::DOUBLE AS score
      FROM catalogue c, df, task WHERE contains(',' || c.tasks || ',', ',' || task_type || ',')),
    ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY score DESC, place) AS INT) AS rank FROM scored)"""
    )


for view, target in (("part", "p_retailprice"), ("labels", "quality"), ("lineitem_outlier", "l_returnflag"), ("labels_docs", "quality")):

    @register(
        f"recommend_models_{view}",
        facts_cte(view, True) + ranked_sql(target) + "SELECT rank, model_key, model_name, score FROM ranked WHERE rank <= 3",
    )
    def recommend(spark, sf, view=view, target=target):
        found = TaskAdvice(Profile(load(spark, sf, view)), target).recommendations()
        return found.select("rank", "model_key", "model_name", "score")


@register(
    "expected_performance",
    facts_cte("part", True)
    + ranked_sql("p_retailprice")
    + """SELECT model_key, CASE WHEN regexp_matches(model_name, 'XGBoost|LightGBM|BERT') THEN 'high' WHEN model_name LIKE
    'Random Forest%' THEN 'medium-high' WHEN complexity = 'low' THEN 'baseline' ELSE 'medium' END AS expected,
    CASE WHEN regexp_matches(model_name, 'XGBoost|LightGBM|BERT') THEN 'medium' WHEN model_name LIKE 'Random Forest%'
      OR complexity = 'low' THEN 'high' ELSE 'medium' END AS confidence FROM ranked WHERE rank <= 5""",
)
def expected_performance(spark, sf):
    found = TaskAdvice(Profile(load(spark, sf, "part")), "p_retailprice").recommendations(5)
    return found.select("model_key", "expected", "confidence")


@register(
    "recommend_reason",
    facts_cte("customer", True)
    + ranked_sql(None)
    + """SELECT model_key, concat_ws(' | ', 'best for: ' || best_for, CASE WHEN miss AND outl THEN
    'data: takes missing values, robust to outliers' WHEN miss THEN 'data: takes missing values' WHEN outl THEN
    'data: robust to outliers' END, 'training: ' || train || ', inference: ' || infer, 'complexity: ' || complexity ||
    ', interpretability: ' || interpretability, 'advantages: ' || advantages) AS reason FROM ranked WHERE rank <= 5""",
)
def recommend_reason(spark, sf):
    found = TaskAdvice(Profile(load(spark, sf, "customer"))).recommendations(5)
    return found.select("model_key", "reason")


@register(
    "recommend_summary",
    facts_cte("part", True)
    + ranked_sql("p_retailprice")
    + """SELECT task_type, (SELECT least(count(*), 5) FROM ranked) AS n_recommendations, rank, model_name AS name,
    round(score, 1) AS score FROM ranked, task WHERE rank <= 3""",
)
def recommend_summary(spark, sf):
    return TaskAdvice(Profile(load(spark, sf, "part")), "p_retailprice").recommendation_summary()


@register(
    "modeling_report",
    facts_cte("lineitem_outlier")
    + task_sql("l_returnflag")
    + """SELECT task_type, true AS is_supervised, task_type LIKE '%classification' AS is_classification,
    task_type IN ('regression', 'nlp_regression') AS is_regression, task_type = 'clustering' AS is_clustering,
    CASE WHEN n > 1000 THEN 'full' ELSE 'quick' END AS advice FROM task""",
)
def modeling_report(spark, sf):
    return TaskAdvice(Profile(load(spark, sf, "lineitem_outlier")), "l_returnflag").task_flags()


# ---- splits and folds -------------------------------------------------------------


@register(
    "stratified_split",
    """WITH r AS (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority
      ORDER BY md5('42|' || o_orderkey)) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)
    SELECT o_orderkey, o_orderpriority, r <= floor(0.2 * n + 0.5) AS is_test FROM r""",
)
def stratified_split(spark, sf):
    return splits.exact_split(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), ["o_orderkey"], "o_orderpriority")


@register(
    "plain_split",
    """SELECT p_partkey, row_number() OVER (ORDER BY md5('42|' || p_partkey)) <= ceil(0.2 * count(*) OVER ()) AS is_test FROM part""",
)
def plain_split(spark, sf):
    return splits.exact_split(load(spark, sf, "part").select("p_partkey"), ["p_partkey"])


def bucket(seed, *keys):
    text = " || '|' || ".join([f"'{seed}'", *keys])
    return f"CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT)"


def below(share, seed, *keys):
    text = " || '|' || ".join([f"'{seed}'", *keys])
    return f"CAST('0x' || substr(md5({text}), 1, 15) AS BIGINT) < CAST(floor({share}::DOUBLE * 1152921504606846976) AS BIGINT)"


@register(
    "hash_split",
    f"SELECT o_orderkey, {below(0.2, 42, 'o_orderkey')} AS is_test, CAST({bucket(43, 'o_orderkey')} % 5 AS INT) AS fold FROM orders",
)
def hash_split(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey")
    return splits.with_fold(splits.hash_split(df, ["o_orderkey"]), ["o_orderkey"])


# ---- metrics ----------------------------------------------------------------------


def metrics_sql(view):
    return f"""WITH p AS ({view_sql(view)}), k AS (SELECT label AS c FROM p UNION SELECT prediction FROM p),
    m AS (SELECT c, count(*) FILTER (label = c) AS s, count(*) FILTER (prediction = c) AS q,
      count(*) FILTER (label = c AND prediction = c) AS h FROM k, p GROUP BY c),
    v AS (SELECT s, h, CASE WHEN q > 0 THEN h / q ELSE 0 END AS pr, CASE WHEN s > 0 THEN h / s ELSE 0 END AS re FROM m)
    SELECT sum(h) / sum(s) AS accuracy, sum(pr * s) / sum(s) AS precision_weighted, sum(re * s) / sum(s) AS recall_weighted,
    sum(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END * s) / sum(s) AS f1_weighted FROM v"""


for view, suffix in (("pred_rule", ""), ("flag_rule", "_multiclass")):

    @register(
        "classification_metrics" + suffix, metrics_sql(view),
        "accuracy precision_weighted recall_weighted f1_weighted", 6,
    )
    def classification_metrics(spark, sf, view=view):
        return metrics.classification_metrics(load(spark, sf, view), "label", "prediction")


def auc_sql(source):
    return f"""(SELECT sum(pos * (coalesce(below, 0) + neg / 2)) / (sum(pos) * sum(neg)) FROM (
      SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS below FROM (
        SELECT score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM ({source}) GROUP BY score)))"""


@register(
    "roc_auc",
    f"WITH p AS ({view_sql('pred_rule')}) SELECT {auc_sql('SELECT score, label = 1 AS hit FROM p')} AS roc_auc",
    "roc_auc",
    6,
)
def roc_auc(spark, sf):
    return metrics.roc_auc(load(spark, sf, "pred_rule"), "label", "score")


AUC_CLASSES = " + ".join(
    f"""(SELECT count(*) FROM p WHERE label = '{c}') * {auc_sql(f"SELECT score_{c} AS score, label = '{c}' AS hit FROM p")}"""
    for c in "ANR"
)


@register(
    "roc_auc_multiclass",
    f"WITH p AS ({view_sql('flag_rule')}) SELECT ({AUC_CLASSES}) / (SELECT count(*) FROM p) AS roc_auc",
    "roc_auc",
    6,
)
def roc_auc_multiclass(spark, sf):
    return metrics.roc_auc_weighted(load(spark, sf, "flag_rule"), "label", {c: f"score_{c}" for c in "ANR"})


REGRESSION = """avg((y - p) ^ 2) AS mse, sqrt(avg((y - p) ^ 2)) AS rmse, avg(abs(y - p)) AS mae,
  1 - avg((y - p) ^ 2) / var_pop(y) AS r2, avg(abs((y - p) / (y + 1e-10))) * 100 AS mape"""
REGRESSION_DOUBLES = "mse rmse mae r2 mape"


@register(
    "regression_metrics",
    f"SELECT {REGRESSION} FROM (SELECT y, y_hat AS p FROM ({view_sql('pred_rule')}))",
    REGRESSION_DOUBLES,
)
def regression_metrics(spark, sf):
    return metrics.regression_metrics(load(spark, sf, "pred_rule"), "y", "y_hat")


# ---- training ---------------------------------------------------------------------

SPLIT = f"""d AS (SELECT l_quantity AS x, l_extendedprice AS y, {below(0.2, 42, 'l_orderkey', 'l_linenumber', 'l_partkey')} AS is_test,
  {bucket(43, 'l_orderkey', 'l_linenumber', 'l_partkey')} % 5 AS fold FROM lineitem)"""
LINE_KEYS = ["l_orderkey", "l_linenumber", "l_partkey"]


def line_trainer(spark, sf):
    return Trainer(load(spark, sf, "lineitem"), "l_extendedprice", LINE_KEYS, ["l_quantity"], classification=False)


def one_model(name, trainer):
    trainer.train_model(name, cross_validate=False)
    return metrics.regression_metrics(trainer.predict(trainer.test), trainer.target, "prediction")


@register(
    "train_linear",
    f"""WITH {SPLIT}, m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE NOT is_test)
    SELECT {REGRESSION} FROM (SELECT y, a * x + b AS p FROM d, m WHERE is_test)""",
    REGRESSION_DOUBLES,
    2,
)
def train_linear(spark, sf):
    return one_model("linear_regression", line_trainer(spark, sf))


@register(
    "train_ridge",
    f"""WITH {SPLIT}, m AS (SELECT avg(x) AS mu, stddev_pop(x) AS sd, avg(y) AS b, covar_pop(y, x) / stddev_pop(x) * count(*)
      / (count(*) + 1) AS w FROM d WHERE NOT is_test)
    SELECT {REGRESSION} FROM (SELECT y, w * (x - mu) / sd + b AS p FROM d, m WHERE is_test)""",
    REGRESSION_DOUBLES,
    2,
)
def train_ridge(spark, sf):
    return one_model("ridge", line_trainer(spark, sf))


@register(
    "cross_validate",
    f"""WITH {SPLIT}, f AS (SELECT range AS f FROM range(5)),
    m AS (SELECT f, regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d, f WHERE NOT is_test AND fold <> f GROUP BY f)
    SELECT CAST(f AS INT) AS fold, 1 - avg((y - a * x - b) ^ 2) / var_pop(y) AS r2 FROM d, m WHERE NOT is_test AND fold = f GROUP BY f""",
    "r2",
    6,
)
def cross_validate(spark, sf):
    scores = line_trainer(spark, sf).cross_validate("linear_regression")
    return spark.range(1).select(F.posexplode(F.array(*map(F.lit, scores))).alias("fold", "r2"))


@register(
    "prepare_features",
    f"""WITH o AS (SELECT *, {below(0.2, 42, 'o_orderkey')} AS is_test FROM ({view_sql('orders_missing')})
      WHERE o_orderpriority IS NOT NULL),
    f AS (SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM o WHERE NOT is_test)) AS v
      FROM o WHERE NOT is_test)
    SELECT o_orderkey, v AS filled, (v - (SELECT avg(v) FROM f)) / (SELECT stddev_pop(v) FROM f) AS scaled FROM f""",
    "filled scaled",
)
def prepare_features(spark, sf):
    trainer = Trainer(load(spark, sf, "orders_missing"), "o_orderpriority", ["o_orderkey"], ["o_totalprice"], classification=True)
    ready = trainer.preparation.transform(trainer.train)
    return ready.select("o_orderkey", vector_to_array("_raw")[0].alias("filled"), vector_to_array("_scaled")[0].alias("scaled"))


def quality_trainer(spark, sf):
    docs = load(spark, sf, "documents").drop("text").join(load(spark, sf, "labels"), "doc_id")
    return Trainer(docs, "quality", ["doc_id"], ["n_chars", "toxic"], classification=True)


def model_scores(spark, trainer, name):
    result = trainer.train_model(name, cross_validate=False)
    rows = [F.struct(F.lit(k).alias("metric"), F.lit(v).alias("value")) for k, v in sorted(result["metrics"].items())]
    return spark.range(1).select(F.inline(F.array(*rows)))


@register("train_logistic")
def train_logistic(spark, sf):
    return model_scores(spark, quality_trainer(spark, sf), "logistic_regression")


@register("train_random_forest")
def train_random_forest(spark, sf):
    return model_scores(spark, quality_trainer(spark, sf), "random_forest")


@register("train_gbt")
def train_gbt(spark, sf):
    return model_scores(spark, quality_trainer(spark, sf), "gradient_boosting")


@register(
    "leaderboard",
    f"""WITH {SPLIT}, f AS (SELECT range - 1 AS f FROM range(6)),
    z AS (SELECT d.*, (x - mu) / sd AS z FROM d, (SELECT avg(x) AS mu, stddev_pop(x) AS sd FROM d WHERE NOT is_test)),
    m AS (SELECT f, 'linear_regression' AS model, regr_slope(y, z) AS w, regr_intercept(y, z) AS b FROM z, f
        WHERE NOT is_test AND fold <> f GROUP BY f
      UNION ALL SELECT f, 'ridge', w, my - w * mz FROM (SELECT f, covar_pop(y, z) * count(*) / (var_pop(z) * count(*) + 1) AS w,
        avg(y) AS my, avg(z) AS mz FROM z, f WHERE NOT is_test AND fold <> f GROUP BY f)),
    s AS (SELECT model, f, 1 - avg((y - w * z - b) ^ 2) / var_pop(y) AS r2 FROM z, m
      WHERE CASE WHEN f = -1 THEN is_test ELSE NOT is_test AND fold = f END GROUP BY model, f)
    SELECT model, 'r2' AS main_metric, max(r2) FILTER (f = -1) AS score, avg(r2) FILTER (f >= 0) AS cv_mean,
    stddev_pop(r2) FILTER (f >= 0) AS cv_std FROM s GROUP BY model""",
    "score cv_mean cv_std",
    6,
)
def leaderboard(spark, sf):
    trainer = line_trainer(spark, sf)
    return trainer.train_all(["linear_regression", "ridge"]).select("model", "main_metric", "score", "cv_mean", "cv_std")


@register(
    "predict",
    f"""WITH {SPLIT}, m AS (SELECT regr_slope(y, x) AS a, regr_intercept(y, x) AS b FROM d WHERE NOT is_test)
    SELECT l_orderkey, l_linenumber, a * l_quantity + b AS prediction FROM lineitem, m""",
    "prediction",
    3,
)
def predict(spark, sf):
    trainer = line_trainer(spark, sf)
    trainer.train_model("linear_regression", cross_validate=False)
    return trainer.predict(load(spark, sf, "lineitem")).select("l_orderkey", "l_linenumber", "prediction")


@register("feature_importance")
def feature_importance(spark, sf):
    trainer = Trainer(load(spark, sf, "part"), "p_retailprice", ["p_partkey"], classification=False)
    trainer.train_model("random_forest", cross_validate=False)
    return trainer.feature_importance()


@register("train_text_baseline")
def text_baseline(spark, sf):
    return train_text_baseline(load(spark, sf, "labels_docs"), "text", "quality", ["doc_id"])[1]


@register("train_kmeans")
def kmeans(spark, sf):
    clustered, silhouette = train_kmeans(load(spark, sf, "customer"), ["c_acctbal", "c_nationkey"])
    return clustered.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).withColumn("silhouette", F.lit(silhouette))


@register("full_modeling")
def full(spark, sf):
    found = full_modeling(load(spark, sf, "part"), "p_retailprice", ["linear_regression", "ridge", "random_forest"], keys=["p_partkey"])
    return found["leaderboard"].drop("metrics", "training_seconds")


# ---- facade -----------------------------------------------------------------------


@register(
    "summary_table",
    facts_cte("customer_text_num")
    + f""", best AS (SELECT column_name, type FROM ({TARGET_SQL}) ORDER BY score DESC, classes DESC, position LIMIT 1)
    SELECT 'target' AS item, 'c_near' AS value FROM facts HAVING count(*) > 0
    UNION ALL SELECT 'rows', max(total) || '' FROM facts UNION ALL SELECT 'columns', count(*) || '' FROM facts
    UNION ALL SELECT 'quality', printf('%.1f', (0.4 * (1 - sum(null_count) / sum(total)) + 0.3 * (1 - (max(total) -
      {distinct_rows('customer_text_num')}) / max(total)) + 0.3) * 100) FROM facts
    UNION ALL SELECT 'missing_pct', printf('%.1f', sum(null_count) / sum(total) * 100) FROM facts
    UNION ALL SELECT 'suggested_target', column_name || ' (' || type || ')' FROM best""",
)
def summary_table(spark, sf):
    return Analyst(load(spark, sf, "customer_text_num"), "c_near").analyze().summary()


@register(
    "findings_digest",
    facts_cte("orders_missing")
    + """SELECT 'finding_' || level AS part, CAST(1 AS INT) AS rank, count(*) || ' column(s) with ' || span || ' missing values' AS line
    FROM (SELECT CASE WHEN round(null_pct, 2) > 50 THEN 'critical' ELSE 'high' END AS level, CASE WHEN round(null_pct, 2) > 50 THEN
      'more than 50%' ELSE '20-50%' END AS span FROM facts WHERE round(null_pct, 2) > 20) GROUP BY level, span
    UNION ALL SELECT 'suggestion', CAST(row_number() OVER (ORDER BY p) AS INT), a FROM (
      SELECT 1 AS p, 'drop column "' || column_name || '"' AS a FROM facts WHERE round(null_pct, 2) > 50
      UNION ALL SELECT 2, 'impute columns with 20-50% missing values' FROM facts WHERE round(null_pct, 2) > 20 AND
        round(null_pct, 2) <= 50 HAVING count(*) > 0
      UNION ALL SELECT 3, 'impute columns with 5-20% missing values' FROM facts WHERE round(null_pct, 2) > 5 AND
        round(null_pct, 2) <= 20 HAVING count(*) > 0)""",
)
def findings_digest(spark, sf):
    return Insights(Profile(load(spark, sf, "orders_missing"))).digest()


@register(
    "dataset_class",
    facts_cte("lineitem")
    + """SELECT CASE WHEN sum(null_count) / sum(total) > 0.3 THEN 'missing_heavy' WHEN max(total) > 100000 THEN 'large_clean'
    ELSE 'small_clean' END AS dataset_class FROM facts""",
)
def dataset_class(spark, sf):
    return Analyst(load(spark, sf, "lineitem")).dataset_class()


@register(
    "quick_suggestions",
    facts_cte("orders_missing")
    + """SELECT CAST(1 AS INT) AS item, printf('%.1f', sum(null_count) / sum(total) * 100) || '% missing values, consider imputation'
    AS message FROM facts HAVING sum(null_count) / sum(total) > 0.05""",
)
def quick_suggestions(spark, sf):
    return Analyst(load(spark, sf, "orders_missing")).quick_suggestions()


@register(
    "run_report",
    "SELECT unnest(['overview', 'column_facts', 'numeric_stats', 'correlations', 'missing', 'duplicates', 'quality', 'findings', "
    "'suggestions', 'needs', 'plan', 'summary', 'data']) AS \"table\" FROM (SELECT 1 FROM orders LIMIT 1)",
)
def run_report(spark, sf):
    analyst = Analyst(load(spark, sf, "orders_missing"), "o_totalprice").analyze().preprocess()
    return analyst.report(scratch_path(spark, "report")).select("table")


@register(
    "facade",
    f"""WITH m AS ({view_sql('orders_missing')}) SELECT count(*) AS n_rows, CAST(13 AS BIGINT) AS n_columns FROM m""",
)
def facade(spark, sf):
    analyst = Analyst(load(spark, sf, "orders_missing")).analyze().preprocess("balanced")
    return analyst.processed.agg(
        F.count(F.lit(1)).alias("n_rows"), F.lit(len(analyst.processed.columns)).cast("bigint").alias("n_columns")
    )


@register(
    "stream_prepare",
    """WITH s AS (SELECT avg(p_retailprice) AS m, stddev_pop(p_retailprice) AS d FROM part)
    SELECT p_partkey, (p_retailprice - m) / d AS p_retailprice FROM part, s""",
    "p_retailprice",
    6,
)
def stream_prepare(spark, sf):
    """Fit on the table, then run the same plan over the table as a stream of files."""
    columns = ["p_partkey", "p_retailprice"]
    table = load(spark, sf, "part").select(*columns)
    source = scratch_path(spark, "parts")
    table.repartition(4).write.parquet(source)
    plan = PreprocessPlan.fit(table)
    out = scratch_path(spark, "prepared")
    stream = stream_files(spark, source, table.schema, files_per_trigger=2)
    prepare_stream(stream, plan, out, scratch_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out)
