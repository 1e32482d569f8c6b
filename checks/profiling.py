"""Typing, profile, findings and needs."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.facts_sql import SUBTYPE, TARGET_HITS, facts_cte
from checks.registry import register
from checks.views import COLUMNS, load, view_sql
from tabwright.operators.insights import Insights
from tabwright.operators.needs import Needs
from tabwright.operators.profile import Profile


def profile_of(view):
    return lambda spark, sf: Profile(load(spark, sf, view))


def section(name, view, method, sql, doubles="", digits=4, spread=False, args=()):
    """A query that is one section of the profile of one view."""

    @register(name, facts_cte(view, spread) + sql, doubles, digits)
    def run(spark, sf):
        return getattr(Profile(load(spark, sf, view)), method)(*args)


# ---- column typing (C1-C9) --------------------------------------------------------


@register(
    "column_facts",
    facts_cte("lineitem")
    + f"SELECT column_name, dtype, total, null_count, null_pct, unique_count, type, {SUBTYPE} AS subtype FROM facts",
    "null_pct",
)
def column_facts(spark, sf):
    return Profile(load(spark, sf, "lineitem")).facts.select(
        "column_name", "dtype", "total", "null_count", "null_pct", "unique_count", "type", "subtype"
    )


for table in ("orders", "events", "documents", "labels", "part", "customer", "conversations"):

    @register(f"column_types_{table}", facts_cte(table) + f"SELECT column_name, type, {SUBTYPE} AS subtype FROM facts")
    def column_types(spark, sf, table=table):
        return Profile(load(spark, sf, table)).column_types().drop("position")


@register("is_id", facts_cte("events") + "SELECT column_name, type = 'id' AS is_id FROM facts")
def is_id(spark, sf):
    return Profile(load(spark, sf, "events")).facts.select("column_name", (F.col("type") == "id").alias("is_id"))


UUID_VIEW = """SELECT c_custkey, CASE WHEN c_custkey % 10 = 0 THEN c_name ELSE
  substr(md5(CAST(c_custkey AS VARCHAR(20))), 1, 8) || '-' || substr(md5(CAST(c_custkey AS VARCHAR(20))), 9, 4) || '-' ||
  substr(md5(CAST(c_custkey AS VARCHAR(20))), 13, 4) || '-' || substr(md5(CAST(c_custkey AS VARCHAR(20))), 17, 4) || '-' ||
  substr(md5(CAST(c_custkey AS VARCHAR(20))), 21, 12) END AS c_uuid, c_mktsegment FROM customer"""


@register(
    "is_uuid",
    f"""WITH t AS ({UUID_VIEW}), s AS (
      SELECT 'c_uuid' AS column_name, avg(CAST(regexp_matches(c_uuid,
        '(?i)^[0-9a-f]{{8}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{4}}-[0-9a-f]{{12}}$') AS INT)) AS uuid_share FROM t
      UNION ALL SELECT 'c_mktsegment', 0.0)
    SELECT column_name, uuid_share, CASE WHEN uuid_share > 0.8 THEN 'uuid' ELSE 'low_cardinality' END AS subtype FROM s""",
    "uuid_share",
)
def is_uuid(spark, sf):
    load(spark, sf, "customer").createOrReplaceTempView("customer")
    facts = Profile(spark.sql(UUID_VIEW)).facts
    return facts.where("kind = 'string'").select("column_name", "uuid_share", "subtype")


DATE_VIEW = """SELECT o_orderkey, o_orderdate, CAST(o_orderdate AS DATE) AS o_day,
  CAST(CAST(o_orderdate AS DATE) AS VARCHAR(20)) AS o_text, CAST(o_custkey AS VARCHAR(20)) AS o_code FROM orders"""


@register(
    "is_datetime",
    f"""WITH t AS ({DATE_VIEW})
    SELECT 'o_orderdate' AS column_name, true AS is_datetime FROM t HAVING count(*) > 0
    UNION ALL SELECT 'o_day', count(o_day) > 0 FROM t
    UNION ALL SELECT 'o_text', count(o_text) = count(try_cast(o_text AS DATE)) FROM t
    UNION ALL SELECT 'o_code', count(o_code) = count(try_cast(o_code AS DATE)) FROM t""",
)
def is_datetime(spark, sf):
    load(spark, sf, "orders").createOrReplaceTempView("orders")
    facts = Profile(spark.sql(DATE_VIEW)).facts.where("column_name <> 'o_orderkey'")
    return facts.select("column_name", (F.col("type") == "datetime").alias("is_datetime"))


BOOLEAN_VIEW = """SELECT doc_id, quality, toxic, 0 AS zero, quality = 1 AS truth,
  CASE WHEN toxic = 1 THEN 'Yes' ELSE 'No' END AS answer, CASE WHEN quality = 1 THEN 'yes' ELSE 'No' END AS mixed
  FROM labels"""


@register(
    "is_boolean",
    f"""WITH t AS ({BOOLEAN_VIEW}), c AS (
      SELECT 'quality' AS column_name, list_sort(list(DISTINCT CAST(quality AS VARCHAR))) AS v FROM t
      UNION ALL SELECT 'toxic', list_sort(list(DISTINCT CAST(toxic AS VARCHAR))) FROM t
      UNION ALL SELECT 'zero', list_sort(list(DISTINCT CAST(zero AS VARCHAR))) FROM t
      UNION ALL SELECT 'truth', list_sort(list(DISTINCT CAST(truth AS VARCHAR))) FROM t
      UNION ALL SELECT 'answer', list_sort(list(DISTINCT answer)) FROM t
      UNION ALL SELECT 'mixed', list_sort(list(DISTINCT mixed)) FROM t)
    SELECT column_name, v IN (['0'], ['1'], ['0', '1'], ['false', 'true'], ['No', 'Yes'], ['no', 'yes']) AS is_boolean
    FROM c""",
)
def is_boolean(spark, sf):
    load(spark, sf, "labels").createOrReplaceTempView("labels")
    facts = Profile(spark.sql(BOOLEAN_VIEW)).facts.where("column_name <> 'doc_id'")
    return facts.select("column_name", (F.col("type") == "boolean").alias("is_boolean"))


@register(
    "numeric_class",
    facts_cte("lineitem", True)
    + f"""SELECT f.column_name, type, {SUBTYPE} AS subtype, unique_count AS cardinality, min_num, max_num, mean, median,
      std, skewness, kurtosis FROM facts f JOIN spread s ON f.column_name = s.column_name""",
    "min_num max_num mean median std skewness kurtosis",
)
def numeric_class(spark, sf):
    p = Profile(load(spark, sf, "lineitem"))
    return p.facts.join(F.broadcast(p.spread_table), "column_name").select(
        "column_name", "type", "subtype", F.col("unique_count").alias("cardinality"), "min_num", "max_num", "mean",
        "median", "std", "skewness", "kurtosis",
    )


@register(
    "text_class",
    facts_cte("documents")
    + f"""SELECT column_name, type, {SUBTYPE} AS subtype, unique_count AS cardinality, avg_length, max_length, min_length
      FROM facts WHERE kind = 'string'""",
    "avg_length",
)
def text_class(spark, sf):
    facts = Profile(load(spark, sf, "documents")).facts.where("kind = 'string'")
    return facts.select(
        "column_name", "type", "subtype", F.col("unique_count").alias("cardinality"), "avg_length", "max_length",
        "min_length",
    )


section("type_counts", "lineitem", "type_counts", "SELECT type, count(*) AS n_columns FROM facts GROUP BY type")


@register(
    "columns_by_type",
    facts_cte("lineitem") + "SELECT column_name FROM facts WHERE type = 'categorical_ordinal'",
)
def columns_by_type(spark, sf):
    return Profile(load(spark, sf, "lineitem")).columns_by_type("categorical_ordinal").select("column_name")


TARGET_SQL = f"""SELECT column_name, type,
  CAST({TARGET_HITS} + CASE WHEN type = 'numeric_continuous' THEN 1 ELSE 2 END AS BIGINT) AS score,
  CASE WHEN type = 'numeric_continuous' THEN 0 ELSE unique_count END AS classes, position
  FROM facts WHERE type = 'numeric_continuous' OR
  (type IN ('categorical_nominal', 'categorical_ordinal', 'boolean') AND unique_count BETWEEN 2 AND 100)"""


@register("target_candidates", facts_cte("lineitem") + f"SELECT column_name, type, score, classes FROM ({TARGET_SQL})")
def target_candidates(spark, sf):
    return Profile(load(spark, sf, "lineitem")).target_candidates().drop("position")


@register(
    "suggest_target",
    facts_cte("labels_docs")
    + f"SELECT column_name, score FROM ({TARGET_SQL}) ORDER BY score DESC, classes DESC, position LIMIT 1",
)
def suggest_target(spark, sf):
    return Profile(load(spark, sf, "labels_docs")).target_candidates().limit(1).select("column_name", "score")


# ---- profile (P1-P25) -------------------------------------------------------------


def distinct_rows(view):
    return f"(SELECT count(*) FROM (SELECT DISTINCT * FROM ({view_sql(view)})))"


for name, view in (("overview", "orders_missing"), ("overview_duplicates", "events_dup")):
    section(
        name, view, "overview",
        f"""SELECT max(total) AS n_rows, count(*) AS n_columns, CAST(sum(total) AS BIGINT) AS total_cells,
        CAST(sum(null_count) AS BIGINT) AS missing_cells, sum(null_count) / sum(total) * 100 AS missing_pct,
        max(total) - {distinct_rows(view)} AS duplicate_rows, CAST(sum(bytes) AS BIGINT) AS bytes FROM facts""",
        "missing_pct",
    )

section(
    "basic_stats", "orders_missing", "basic_stats",
    """SELECT column_name, non_null AS count, null_count AS missing, null_pct AS missing_pct, unique_count AS "unique"
    FROM facts""", "missing_pct",
)

NUMERIC_STATS = """SELECT f.column_name, non_null AS count, mean, median, std, min_num AS min, max_num AS max,
  max_num - min_num AS range, q25, q75, iqr, skewness, kurtosis, zeros, zeros / non_null * 100 AS zeros_pct, negative,
  outliers_iqr, outliers_zscore FROM facts f JOIN spread s ON f.column_name = s.column_name
  WHERE type IN ('numeric_continuous', 'numeric_discrete')"""
NUMERIC_DOUBLES = "mean median std min max range q25 q75 iqr skewness kurtosis zeros_pct"

for view in ("lineitem", "orders_missing", "lineitem_outlier"):
    suffix = "" if view == "lineitem" else "_" + view.split("_")[1]
    section("numeric_stats" + suffix, view, "numeric_stats", NUMERIC_STATS, NUMERIC_DOUBLES, spread=True)


@register(
    "skew_kurtosis",
    facts_cte("events") + "SELECT column_name, skewness, kurtosis FROM facts WHERE type LIKE 'numeric%'",
    "skewness kurtosis",
)
def skew_kurtosis(spark, sf):
    p = Profile(load(spark, sf, "events"))
    return p.facts.where("type like 'numeric%'").select("column_name", "skewness", "kurtosis")


@register(
    "outliers_iqr",
    facts_cte("lineitem_outlier", True)
    + "SELECT column_name, lower_fence, upper_fence, outliers_iqr FROM spread",
    "lower_fence upper_fence",
    6,
)
def outliers_iqr(spark, sf):
    p = Profile(load(spark, sf, "lineitem_outlier"))
    return p.spread_table.select(
        "column_name", F.col("lower").alias("lower_fence"), F.col("upper").alias("upper_fence"), "outliers_iqr"
    )


@register(
    "outliers_zscore", facts_cte("lineitem_outlier", True) + "SELECT column_name, outliers_zscore FROM spread"
)
def outliers_zscore(spark, sf):
    return Profile(load(spark, sf, "lineitem_outlier")).spread_table.select("column_name", "outliers_zscore")


section(
    "describe", "lineitem", "describe",
    """SELECT f.column_name, non_null AS count, mean, std, min_num AS min, q25, median AS q50, q75, max_num AS max
    FROM facts f JOIN spread s ON f.column_name = s.column_name""",
    "mean std min q25 q50 q75 max", spread=True,
)

TOP_SQL = """SELECT v.column_name, CAST(v.rank AS INT) AS rank, v.value, v.n, v.n / f.non_null * 100 AS pct
  FROM vc v JOIN facts f ON v.column_name = f.column_name
  WHERE f.type IN ('categorical_nominal', 'categorical_ordinal', 'boolean') AND v.rank <= 10"""
section("top_categories", "lineitem", "top_categories", TOP_SQL, "pct")
section("top_categories_missing", "orders_missing", "top_categories", TOP_SQL, "pct")

BALANCE_SQL = """SELECT column_name, type, unique_count, entropy, balance AS balance_score FROM facts
  WHERE type IN ('categorical_nominal', 'categorical_ordinal', 'boolean')"""
section("entropy", "lineitem", "category_balance", BALANCE_SQL, "entropy balance_score", 6)
section("balance_score", "labels_docs", "category_balance", BALANCE_SQL, "entropy balance_score", 6)

section(
    "text_stats", "documents", "text_stats",
    """SELECT column_name, avg_length, max_length, min_length, empty_strings,
    empty_strings / non_null * 100 AS empty_pct FROM facts WHERE type = 'text'""",
    "avg_length empty_pct",
)
section(
    "datetime_stats", "orders_missing", "datetime_stats",
    "SELECT column_name, min_date, max_date, range_days FROM facts WHERE type = 'datetime'",
)


def _pairs(view, ordered=False):
    names = [n for n, d in COLUMNS[view] if d in ("int", "bigint", "double")]
    return " UNION ALL ".join(
        f"""SELECT {i} AS i, {j} AS j, '{a}' AS col1, '{b}' AS col2, {'1.0' if a == b else f'corr("{a}", "{b}")'}
        AS correlation FROM t {'HAVING count(*) > 0' if a == b else ''}"""
        for i, a in enumerate(names)
        for j, b in enumerate(names)
        if not ordered or i < j
    )


for view in ("lineitem", "lineitem_wide", "orders_missing"):
    suffix = {"lineitem": "", "lineitem_wide": "_wide", "orders_missing": "_missing"}[view]
    section(
        "correlation_matrix" + suffix, view, "correlation_matrix",
        f"SELECT col1, col2, correlation FROM ({_pairs(view)})", "correlation",
    )


@register(
    "high_correlations",
    f"""WITH t AS ({view_sql('lineitem_wide')}) SELECT col1, col2, correlation,
    CASE WHEN abs(correlation) > 0.8 THEN 'strong' ELSE 'moderate' END AS strength
    FROM ({_pairs('lineitem_wide', True)}) WHERE abs(correlation) > 0.7""",
    "correlation",
)
def high_correlations(spark, sf):
    return Profile(load(spark, sf, "lineitem_wide")).high_correlations().drop("i", "j")


SEVERITY_SQL = """CASE WHEN round(null_pct, 2) > 50 THEN 'critical' WHEN round(null_pct, 2) > 20 THEN 'high'
  WHEN round(null_pct, 2) > 5 THEN 'moderate' ELSE 'low' END"""


@register(
    "missing_by_column",
    facts_cte("orders_missing")
    + f"""SELECT column_name, null_count AS missing, round(null_pct, 2) AS missing_pct, {SEVERITY_SQL} AS severity
    FROM facts WHERE null_count > 0""",
    "missing_pct",
)
def missing_by_column(spark, sf):
    return Profile(load(spark, sf, "orders_missing")).missing_by_column().drop("position")


ANY_NULL = " OR ".join(f"{n} IS NULL" for n, _ in COLUMNS["orders_missing"])
section(
    "missing_summary", "orders_missing", "missing_summary",
    f"""SELECT CAST(sum(null_count) AS BIGINT) AS total_missing, sum(null_count) / sum(total) * 100 AS missing_pct,
    count(*) FILTER (null_count > 0) AS columns_with_missing, count(*) FILTER (null_count = 0) AS complete_columns,
    (SELECT count(*) FROM t WHERE {ANY_NULL}) AS rows_with_missing,
    (SELECT count(*) FROM t WHERE NOT ({ANY_NULL})) AS rows_complete FROM facts""",
    "missing_pct",
)


@register(
    "missing_ranked",
    facts_cte("orders_missing")
    + """SELECT CAST(row_number() OVER (ORDER BY null_count DESC, position) AS INT) AS rank, column_name,
    null_count AS missing FROM facts WHERE null_count > 0""",
)
def missing_ranked(spark, sf):
    from pyspark.sql import Window

    ranked = Profile(load(spark, sf, "orders_missing")).missing_ranked()
    place = F.row_number().over(Window.orderBy(F.desc("missing"), "position"))  # one row per column
    return ranked.select(place.alias("rank"), "column_name", "missing")


section(
    "duplicates", "events_dup", "duplicates",
    f"""SELECT max(total) - {distinct_rows('events_dup')} AS total_duplicates,
    (max(total) - {distinct_rows('events_dup')}) / max(total) * 100 AS duplicate_pct,
    (max(total) - {distinct_rows('events_dup')}) / max(total) > 0.1 AS is_critical FROM facts""",
    "duplicate_pct",
)

QUALITY = """SELECT round((c * 0.4 + u * 0.3 + 0.3) * 100, 1) AS overall, round(c * 100, 1) AS completeness,
  round(u * 100, 1) AS uniqueness, 100.0::DOUBLE AS consistency FROM (
  SELECT 1 - sum(null_count) / sum(total) AS c, 1 - (max(total) - {d}) / max(total) AS u FROM facts)"""
for name, view in (("quality_score", "orders_missing"), ("quality_score_duplicates", "events_dup")):
    section(name, view, "quality_score", QUALITY.format(d=distinct_rows(view)))


@register(
    "column_profile",
    facts_cte("orders_missing", True)
    + """SELECT f.column_name, type, non_null, null_count, unique_count, mean, median, q25, q75, outliers_iqr
    FROM facts f JOIN spread s ON f.column_name = s.column_name WHERE f.column_name = 'o_totalprice'""",
    "mean median q25 q75",
)
def column_profile(spark, sf):
    return Profile(load(spark, sf, "orders_missing")).column_profile("o_totalprice").select(
        "column_name", "type", "non_null", "null_count", "unique_count", "mean", "median", "q25", "q75", "outliers_iqr"
    )


@register(
    "high_quality_columns",
    facts_cte("orders_missing") + "SELECT column_name, 100 - null_pct AS completeness FROM facts WHERE 100 - null_pct > 80",
    "completeness",
)
def high_quality_columns(spark, sf):
    return Profile(load(spark, sf, "orders_missing")).high_quality_columns(80.0).drop("position")


section("dtype_counts", "lineitem", "dtype_counts", "SELECT dtype, count(*) AS n_columns FROM facts GROUP BY dtype")


def _histogram(view, bins):
    names = [n for n, d in COLUMNS[view] if d in ("int", "bigint", "double")]
    return f"WITH t AS ({view_sql(view)}) " + " UNION ALL ".join(
        f"""SELECT '{n}' AS column_name, b.bin, lo + b.bin * w AS bin_start, coalesce(h.n, 0) AS n
        FROM (SELECT range AS bin FROM range({bins})) b
        CROSS JOIN (SELECT min("{n}")::DOUBLE AS lo, (max("{n}")::DOUBLE - min("{n}")::DOUBLE) / {bins} AS w FROM t) e
        LEFT JOIN (SELECT CAST(least(floor(("{n}"::DOUBLE - lo) / w), {bins - 1}) AS BIGINT) AS bin, count(*) AS n
          FROM t, (SELECT min("{n}")::DOUBLE AS lo, (max("{n}")::DOUBLE - min("{n}")::DOUBLE) / {bins} AS w FROM t)
          WHERE "{n}" IS NOT NULL GROUP BY 1) h ON b.bin = h.bin"""
        for n in names
    )


@register("histogram", _histogram("lineitem", 30), "bin_start")
def histogram(spark, sf):
    return Profile(load(spark, sf, "lineitem")).histogram(30)


@register("histogram_fine", _histogram("orders_missing", 50), "bin_start")
def histogram_fine(spark, sf):
    return Profile(load(spark, sf, "orders_missing")).histogram(50)


section(
    "box_stats", "lineitem_outlier", "box_stats",
    "SELECT column_name, q25, median, q75, whisker_low, whisker_high, outliers_iqr AS outliers FROM spread",
    "q25 median q75 whisker_low whisker_high", spread=True,
)


@register(
    "category_counts",
    facts_cte("documents")
    + """SELECT v.column_name, CAST(v.rank AS INT) AS rank, v.value, v.n FROM vc v JOIN facts f
    ON v.column_name = f.column_name WHERE f.kind = 'string' AND f.unique_count <= 30 AND v.rank <= 15""",
)
def category_counts(spark, sf):
    return Profile(load(spark, sf, "documents")).category_counts()


FLAGS = " || ".join(f"CASE WHEN {n} IS NULL THEN '1' ELSE '0' END" for n, _ in COLUMNS["orders_missing"])


@register(
    "missing_pattern",
    f"WITH t AS ({view_sql('orders_missing')}) SELECT {FLAGS} AS pattern, count(*) AS n_rows FROM t GROUP BY 1",
)
def missing_pattern(spark, sf):
    return Profile(load(spark, sf, "orders_missing")).missing_pattern()


# ---- findings (I1-I11) ------------------------------------------------------------

LISTED = "string_agg(column_name, ', ' ORDER BY position)"


def finding(name, view, method, sql, spread=False):
    @register(name, facts_cte(view, spread) + sql)
    def run(spark, sf):
        found = getattr(Insights(Profile(load(spark, sf, view))), method)()
        return found.select("category", "severity", "message", "details")


INSIGHT_MISSING = f"""SELECT 'missing_values' AS category, level AS severity,
  count(*) || ' column(s) with ' || span || ' missing values' AS message, {LISTED} AS details FROM (
  SELECT *, CASE WHEN round(null_pct, 2) > 50 THEN 'critical' WHEN round(null_pct, 2) > 20 THEN 'high' ELSE 'medium' END
    AS level, CASE WHEN round(null_pct, 2) > 50 THEN 'more than 50%' WHEN round(null_pct, 2) > 20 THEN '20-50%'
    ELSE '5-20%' END AS span FROM facts WHERE round(null_pct, 2) > 5) GROUP BY level, span"""
finding("insight_missing", "orders_missing", "missing", INSIGHT_MISSING)
finding(
    "insight_missing_none", "orders", "missing",
    """SELECT 'missing_values' AS category, 'info' AS severity, 'no missing values' AS message, '' AS details FROM facts
    HAVING sum(null_count) = 0""",
)

INSIGHT_DUPLICATES = """SELECT 'duplicates' AS category,
  CASE WHEN d = 0 THEN 'info' WHEN d / n > 0.1 THEN 'critical' ELSE 'medium' END AS severity,
  CASE WHEN d = 0 THEN 'no duplicate rows' ELSE d || ' duplicate rows (' || printf('%.1f', d / n * 100) || '%)' END AS message,
  CASE WHEN d = 0 THEN '' ELSE d || '' END AS details
  FROM (SELECT max(total) AS n, max(total) - {d} AS d FROM facts) WHERE d = 0 OR d / n > 0.01"""
for name, view in (("insight_duplicates", "events_dup"), ("insight_duplicates_none", "orders")):
    finding(name, view, "duplicates", INSIGHT_DUPLICATES.format(d=distinct_rows(view)))

finding(
    "insight_quality", "orders_missing", "quality",
    f"""SELECT 'quality' AS category, CASE WHEN s >= 90 THEN 'info' WHEN s >= 70 THEN 'low' WHEN s >= 50 THEN 'medium'
    ELSE 'critical' END AS severity, 'quality score ' || printf('%.1f', s) AS message, printf('%.1f', s) AS details
    FROM (SELECT overall AS s FROM ({QUALITY.format(d=distinct_rows('orders_missing'))}))""",
)

INSIGHT_TARGET = f"""SELECT category, severity, message, details FROM (
  SELECT 'target' AS category, CASE WHEN label = 'high_cardinality_target' THEN 'medium' ELSE 'info' END AS severity,
    'column "' || column_name || '" looks like a target: ' || label AS message, label AS details
  FROM (SELECT f.*, CASE WHEN f.type = 'numeric_continuous' THEN 'regression' WHEN unique_count = 2 THEN
      'binary_classification' WHEN unique_count <= 20 THEN 'multiclass_classification' ELSE 'high_cardinality_target' END
      AS label FROM facts f JOIN best ON f.column_name = best.column_name)
  UNION ALL
  SELECT 'target', 'high', 'target "' || f.column_name || '" has imbalanced classes', printf('%.4f', balance)
  FROM facts f JOIN best ON f.column_name = best.column_name
  WHERE f.type IN ('categorical_nominal', 'boolean') AND balance < 0.5)"""
for name, view in (("insight_target", "labels_docs"), ("insight_target_ordinal", "lineitem"), ("insight_target_orders", "orders")):
    finding(
        name, view, "target",
        f", best AS (SELECT column_name FROM ({TARGET_SQL}) ORDER BY score DESC, classes DESC, position LIMIT 1) "
        + INSIGHT_TARGET,
    )

finding(
    "insight_correlation", "lineitem_wide", "correlations",
    f""", pairs AS (SELECT *, CASE WHEN abs(correlation) > 0.8 THEN 'strong' ELSE 'moderate' END AS strength
      FROM ({_pairs('lineitem_wide', True)}) WHERE abs(correlation) > 0.7),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY strength ORDER BY abs(correlation) DESC, i, j) AS r FROM pairs)
    SELECT 'correlations' AS category, CASE WHEN strength = 'strong' THEN 'high' ELSE 'medium' END AS severity,
    count(*) || ' ' || strength || 'ly correlated column pair(s)' AS message,
    CASE WHEN strength = 'strong' THEN string_agg(col1 || ' ~ ' || col2, ', ' ORDER BY r) ELSE '' END AS details
    FROM ranked GROUP BY strength""",
)

IMBALANCE = """SELECT 'imbalance' AS category, CASE WHEN balance < 0.3 THEN 'high' ELSE 'medium' END AS severity,
  'column "' || column_name || '" is ' || CASE WHEN balance < 0.3 THEN 'severely' ELSE 'moderately' END || ' imbalanced'
  AS message, printf('%.4f', balance) AS details FROM facts
  WHERE type IN ('categorical_nominal', 'categorical_ordinal') AND balance < 0.5"""
finding("insight_imbalance", "customer_text_num", "imbalance", IMBALANCE)

finding(
    "insight_outliers", "lineitem_outlier", "outliers",
    f""", listed AS (SELECT f.*, outliers_iqr / non_null * 100 AS pct FROM facts f JOIN spread s
      ON f.column_name = s.column_name WHERE type IN ('numeric_continuous', 'numeric_discrete')
      AND outliers_iqr / non_null * 100 > 10)
    SELECT 'outliers' AS category, 'high' AS severity, count(*) || ' column(s) with more than 20% outliers' AS message,
    {LISTED} AS details FROM listed WHERE pct > 20 HAVING count(*) > 0
    UNION ALL SELECT 'outliers', CASE WHEN max(pct) > 20 THEN 'low' ELSE 'medium' END,
    count(*) || ' numeric column(s) with more than 10% outliers', {LISTED} FROM listed HAVING count(*) > 0""",
    spread=True,
)
finding(
    "insight_numeric_text", "customer_text_num", "numeric_text",
    """SELECT 'data_types' AS category, 'medium' AS severity, 'column "' || column_name || '" holds numbers as text' AS
    message, 'numeric' AS details FROM facts WHERE kind = 'string' AND digit_share > 0.9""",
)
finding(
    "insight_cardinality", "part", "cardinality",
    """SELECT 'cardinality' AS category, 'medium' AS severity, 'column "' || column_name || '" has ' || unique_count ||
    ' distinct values' AS message, unique_count || '' AS details FROM facts
    WHERE type = 'categorical_nominal' AND unique_count > 50""",
)
finding(
    "insight_constant", "customer_text_num", "constant",
    """SELECT 'constant' AS category, CASE WHEN unique_count = 1 THEN 'high' ELSE 'medium' END AS severity,
    'column "' || column_name || '" is ' || CASE WHEN unique_count = 1 THEN 'constant' ELSE 'nearly constant' END AS message,
    CASE WHEN unique_count = 1 THEN '' ELSE top_value END AS details FROM facts
    WHERE unique_count = 1 OR (unique_count = 2 AND non_null > 100 AND top_count / non_null > 0.99)""",
)

# For customer_text_num these rules apply: missing (none), duplicates (none), quality, target,
# correlations (none above 0.7), imbalance, numeric text, constant columns.
SEVERITIES_SQL = f""", best AS (SELECT column_name FROM ({TARGET_SQL}) ORDER BY score DESC, classes DESC, position LIMIT 1),
  found AS (
    SELECT 'info' AS severity FROM facts HAVING sum(null_count) = 0
    UNION ALL SELECT 'info' FROM facts HAVING max(total) = {distinct_rows('customer_text_num')}
    UNION ALL SELECT 'info' FROM facts HAVING sum(null_count) = 0
    UNION ALL SELECT severity FROM ({INSIGHT_TARGET})
    UNION ALL SELECT 'info' FROM t HAVING abs(corr(c_custkey, c_nationkey)) <= 0.7
    UNION ALL SELECT severity FROM ({IMBALANCE})
    UNION ALL SELECT 'medium' FROM facts WHERE kind = 'string' AND digit_share > 0.9
    UNION ALL SELECT 'medium' FROM facts WHERE type = 'categorical_nominal' AND unique_count > 50
    UNION ALL SELECT CASE WHEN unique_count = 1 THEN 'high' ELSE 'medium' END FROM facts
      WHERE unique_count = 1 OR (unique_count = 2 AND non_null > 100 AND top_count / non_null > 0.99))"""


@register(
    "insight_summary", facts_cte("customer_text_num") + SEVERITIES_SQL + "SELECT severity, count(*) AS n FROM found GROUP BY severity"
)
def insight_summary(spark, sf):
    return Insights(Profile(load(spark, sf, "customer_text_num"))).severity_counts()


@register(
    "insight_totals",
    facts_cte("customer_text_num")
    + SEVERITIES_SQL
    + """SELECT count(*) AS total_insights, count(*) FILTER (severity = 'critical') AS critical_issues,
    count(*) FILTER (severity = 'high') AS high_priority FROM found""",
)
def insight_totals(spark, sf):
    return Insights(Profile(load(spark, sf, "customer_text_num"))).summary().drop("total_suggestions")


@register(
    "suggestions",
    facts_cte("orders_missing")
    + """SELECT 'drop column "' || column_name || '"' AS action, 'high' AS priority FROM facts WHERE round(null_pct, 2) > 50
    UNION ALL SELECT 'impute columns with 20-50% missing values', 'high' FROM facts
      WHERE round(null_pct, 2) > 20 AND round(null_pct, 2) <= 50 HAVING count(*) > 0
    UNION ALL SELECT 'impute columns with 5-20% missing values', 'medium' FROM facts
      WHERE round(null_pct, 2) > 5 AND round(null_pct, 2) <= 20 HAVING count(*) > 0""",
)
def suggestions(spark, sf):
    return Insights(Profile(load(spark, sf, "orders_missing"))).suggestions().select("action", "priority")


# ---- needs (N1-N11) ---------------------------------------------------------------


def need(name, view, method, sql, target=None, spread=False, detail=None):
    @register(name, facts_cte(view, spread) + sql)
    def run(spark, sf):
        found = getattr(Needs(Profile(load(spark, sf, view)), target), method)()
        columns = F.array_join("columns", ", ").alias("columns")
        details = [F.col("details")[detail].alias(detail)] if detail else []
        return found.select("type", "severity", columns, *details)


def _need_sql(type_, severity, where, extra="", source="facts"):
    return f"SELECT '{type_}' AS type, '{severity}' AS severity, {LISTED} AS columns{extra} FROM {source} WHERE {where} HAVING count(*) > 0"


NEED_MISSING = " UNION ALL ".join(
    _need_sql("missing_values", severity, where, f", '{strategy}' AS strategy")
    for severity, where, strategy in [
        ("required", "round(null_pct, 2) > 50", "drop_column"),
        ("required", "round(null_pct, 2) > 20 AND round(null_pct, 2) <= 50", "advanced_imputation"),
        ("recommended", "round(null_pct, 2) > 5 AND round(null_pct, 2) <= 20", "simple_imputation"),
    ]
)
need("need_missing", "orders_missing", "missing", NEED_MISSING, detail="strategy")


def _need_encoding(target):
    return " UNION ALL ".join(
        _need_sql("encoding", "required", f"type = 'categorical_{k}' AND column_name <> '{target}'", f", '{k}' AS encoding_type")
        for k in ("nominal", "ordinal")
    )


need("need_encoding", "lineitem", "encoding", _need_encoding("l_returnflag"), "l_returnflag", detail="encoding_type")

SCALED = """, num AS (SELECT f.*, outliers_iqr FROM facts f JOIN spread s ON f.column_name = s.column_name
  WHERE type IN ('numeric_continuous', 'numeric_discrete') AND f.column_name <> '{target}')
  SELECT 'scaling' AS type, 'recommended' AS severity,
  coalesce(string_agg(column_name, ', ' ORDER BY position) FILTER (outliers_iqr > 0),
           string_agg(column_name, ', ' ORDER BY position)) AS columns,
  CASE WHEN max(outliers_iqr) > 0 THEN 'robust' ELSE 'standard' END AS scaler FROM num HAVING count(*) > 0"""
need("need_scaling", "lineitem", "scaling", SCALED.format(target=""), spread=True, detail="scaler")
need("need_scaling_robust", "lineitem_outlier", "scaling", SCALED.format(target=""), spread=True, detail="scaler")
need(
    "need_outliers", "lineitem_outlier", "outliers",
    _need_sql(
        "outlier_treatment", "recommended", "type = 'numeric_continuous' AND outliers_iqr / non_null * 100 > 10",
        source="(SELECT f.*, outliers_iqr FROM facts f JOIN spread s ON f.column_name = s.column_name)",
    ),
    spread=True,
)
need("need_text", "documents", "text", _need_sql("text_vectorization", "recommended", "type = 'text'"))
NEED_DUPLICATES = """SELECT 'duplicate_removal' AS type, CASE WHEN d / n > 0.1 THEN 'required' ELSE 'recommended' END AS severity,
  '__all__' AS columns, d || '' AS duplicate_count FROM (SELECT max(total) AS n, max(total) - {d} AS d FROM facts)
  WHERE d / n > 0.01"""
need(
    "need_duplicates", "events_dup", "duplicates", NEED_DUPLICATES.format(d=distinct_rows("events_dup")),
    detail="duplicate_count",
)
need(
    "need_cardinality", "part", "cardinality",
    _need_sql("feature_selection", "optional", "type = 'categorical_nominal' AND unique_count > 50 AND column_name <> 'p_retailprice'"),
    "p_retailprice",
)
need(
    "need_class_imbalance", "customer_text_num", "class_imbalance",
    """SELECT 'class_imbalance' AS type, 'recommended' AS severity, 'c_near' AS columns,
    printf('%.4f', a.n / b.n) AS imbalance_ratio FROM vc a, vc b
    WHERE a.column_name = 'c_near' AND a.rank = 1 AND b.column_name = 'c_near' AND b.rank = 2 AND a.n / b.n > 3""",
    "c_near", detail="imbalance_ratio",
)

# All need rows of orders_missing (target o_totalprice) as (type, severity).
NEED_ROWS = f""", rows AS (
  SELECT type, severity FROM ({NEED_MISSING})
  UNION ALL SELECT type, severity FROM ({_need_encoding('o_totalprice')})
  UNION ALL SELECT 'scaling', 'recommended' FROM facts WHERE type LIKE 'numeric%' AND column_name <> 'o_totalprice'
    HAVING count(*) > 0
  UNION ALL SELECT 'outlier_treatment', 'recommended' FROM facts f JOIN spread s ON f.column_name = s.column_name
    WHERE type = 'numeric_continuous' AND outliers_iqr / non_null > 0.1 HAVING count(*) > 0
  UNION ALL SELECT 'text_vectorization', 'recommended' FROM facts WHERE type = 'text' HAVING count(*) > 0
  UNION ALL SELECT type, severity FROM ({NEED_DUPLICATES.format(d=distinct_rows('orders_missing'))})
  UNION ALL SELECT 'feature_selection', 'optional' FROM facts WHERE type = 'categorical_nominal' AND unique_count > 50
    HAVING count(*) > 0)"""
NEED_SUMMARY = """SELECT count(*) AS total_needs, count(*) FILTER (severity = 'required') AS required,
  count(*) FILTER (severity = 'recommended') AS recommended, count(*) FILTER (severity = 'optional') AS optional,
  count(*) FILTER (severity = 'required' AND type NOT IN ('missing_values', 'encoding', 'scaling', 'duplicate_removal')) = 0
  AS can_auto_process FROM rows"""


def _orders_needs(spark, sf):
    return Needs(Profile(load(spark, sf, "orders_missing")), "o_totalprice")


@register("needs_summary", facts_cte("orders_missing", True) + NEED_ROWS + NEED_SUMMARY)
def needs_summary(spark, sf):
    return _orders_needs(spark, sf).summary()


@register("needs_by_type", facts_cte("orders_missing", True) + NEED_ROWS + "SELECT type, count(*) AS n FROM rows GROUP BY type")
def needs_by_type(spark, sf):
    return _orders_needs(spark, sf).type_counts()


@register(
    "mode_advice",
    facts_cte("orders_missing", True)
    + NEED_ROWS
    + f"""SELECT can_auto_process AS auto_suitable, CASE WHEN can_auto_process AND required <= 3 THEN 'auto' ELSE 'diy' END
    AS recommendation, total_needs AS steps FROM ({NEED_SUMMARY})""",
)
def mode_advice(spark, sf):
    return _orders_needs(spark, sf).mode_advice()


@register(
    "preprocess_plan",
    facts_cte("orders_missing", True)
    + """, steps AS (
    SELECT 1 AS place, 'handle missing values' AS title, CASE WHEN max(round(null_pct, 2)) > 20 THEN 'required' ELSE 'recommended'
      END AS severity, string_agg(column_name, ', ' ORDER BY column_name) AS columns FROM facts WHERE round(null_pct, 2) > 5
    UNION ALL SELECT 2, 'extract date features', 'recommended', string_agg(column_name, ', ' ORDER BY column_name) FROM facts
      WHERE type = 'datetime'
    UNION ALL SELECT 4, 'encode categories', 'required', string_agg(column_name, ', ' ORDER BY column_name) FROM facts
      WHERE type IN ('categorical_nominal', 'categorical_ordinal') AND column_name <> 'o_totalprice'
    UNION ALL SELECT 7, 'scale numbers', 'recommended', string_agg(column_name, ', ' ORDER BY column_name) FROM facts
      WHERE type LIKE 'numeric%' AND column_name <> 'o_totalprice')
    SELECT CAST(row_number() OVER (ORDER BY place) AS INT) AS step, title, severity, columns FROM steps WHERE columns IS NOT NULL""",
)
def preprocess_plan(spark, sf):
    return _orders_needs(spark, sf).plan().drop("how")
