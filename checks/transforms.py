"""Single transforms, text vectors and the fitted plan."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.facts_sql import facts_cte
from checks.registry import register
from checks.views import load, view_sql
from tabwright.operators import steps as st
from tabwright.operators import textvec
from tabwright.operators import transforms as tr
from tabwright.operators.steps import apply_step
from tabwright.plans.preprocess import PreprocessPlan, auto_preprocess
from tabwright.session import scratch_path
from tabwright.sources.readers import spread

MISSING, DUP, OUTLIER = (view_sql(v) for v in ("orders_missing", "events_dup", "lineitem_outlier"))


def on(view, *columns):
    """Load a view, optionally with only some of its columns."""
    return lambda spark, sf: load(spark, sf, view).select(*columns) if columns else load(spark, sf, view)


@register("drop_duplicates", f"SELECT DISTINCT * FROM ({DUP})")
def drop_duplicates(spark, sf):
    return tr.drop_duplicates(load(spark, sf, "events_dup"))


def date_sql(c, weekend=False):
    parts = [
        f"CAST(year({c}) AS INT) AS {c}_year", f"CAST(month({c}) AS INT) AS {c}_month", f"CAST(day({c}) AS INT) AS {c}_day",
        f"CAST(isodow({c}) - 1 AS INT) AS {c}_dayofweek", f"CAST(quarter({c}) AS INT) AS {c}_quarter",
    ]
    return ", ".join(parts + ([f"CAST(isodow({c}) >= 6 AS INT) AS {c}_is_weekend"] if weekend else []))


@register("datetime_features", f"SELECT o_orderkey, {date_sql('o_orderdate')} FROM ({MISSING})")
def datetime_features(spark, sf):
    return tr.datetime_features(load(spark, sf, "orders_missing").select("o_orderkey", "o_orderdate"), ["o_orderdate"])


@register("is_weekend", f"SELECT o_orderkey, {date_sql('o_orderdate', True)} FROM ({MISSING})")
def is_weekend(spark, sf):
    df = load(spark, sf, "orders_missing").select("o_orderkey", "o_orderdate")
    return tr.datetime_features(df, ["o_orderdate"], weekend=True)


@register("drop_sparse_columns", f"SELECT * EXCLUDE (o_orderstatus) FROM ({MISSING})")
def drop_sparse_columns(spark, sf):
    return tr.drop_sparse_columns(load(spark, sf, "orders_missing"))


@register(
    "impute_median",
    f"""WITH t AS ({MISSING}) SELECT o_orderkey, coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t))
    AS o_totalprice FROM t""",
    "o_totalprice",
)
def impute_median(spark, sf):
    return tr.impute_median(load(spark, sf, "orders_missing").select("o_orderkey", "o_totalprice"), ["o_totalprice"])


MODE = "(SELECT {c} FROM t WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} LIMIT 1)"


@register(
    "impute_mode",
    f"""WITH t AS ({MISSING}) SELECT o_orderkey, coalesce(o_orderpriority, {MODE.format(c='o_orderpriority')})
    AS o_orderpriority FROM t""",
)
def impute_mode(spark, sf):
    df = load(spark, sf, "orders_missing").select("o_orderkey", "o_orderpriority")
    return tr.impute_mode(df, ["o_orderpriority"])


CLIP = """WITH t AS ({view}), q AS (SELECT quantile_cont({c}, {a}) AS a, quantile_cont({c}, {b}) AS b FROM t)
  SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_returnflag, greatest(least({c}, {hi}), {lo}) AS {c} FROM t, q"""
FENCES = {"lo": "a - 1.5 * (b - a)", "hi": "b + 1.5 * (b - a)", "a": 0.25, "b": 0.75}


@register(
    "cap_outliers_iqr", CLIP.format(view=OUTLIER, c="l_extendedprice", **FENCES), "l_extendedprice"
)
def cap_outliers_iqr(spark, sf):
    return tr.cap_outliers_iqr(load(spark, sf, "lineitem_outlier"), ["l_extendedprice"])


@register(
    "winsorize_pct", CLIP.format(view=OUTLIER, c="l_extendedprice", a=0.01, b=0.99, lo="a", hi="b"), "l_extendedprice"
)
def winsorize_pct(spark, sf):
    return tr.winsorize(load(spark, sf, "lineitem_outlier"), ["l_extendedprice"])


@register(
    "filter_outliers_iqr",
    f"""WITH t AS ({OUTLIER}), q AS (SELECT quantile_cont(l_extendedprice, 0.25) AS a, quantile_cont(l_extendedprice, 0.75)
    AS b FROM t) SELECT t.* FROM t, q WHERE l_extendedprice BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a)""",
    "l_extendedprice",
)
def filter_outliers_iqr(spark, sf):
    return tr.filter_outliers_iqr(load(spark, sf, "lineitem_outlier"), "l_extendedprice")


@register("log1p", "SELECT p_partkey, ln(1 + p_retailprice) AS p_retailprice FROM part", "p_retailprice", 6)
def log1p(spark, sf):
    return tr.log1p(load(spark, sf, "part").select("p_partkey", "p_retailprice"), ["p_retailprice"])


def flags(column, values, table_prefix=""):
    return ", ".join(
        f"""CAST(coalesce({column} = {v!r}, false) AS INT) AS "{column}_{v}" """ for v in values
    )


PRIORITY = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
STATUS = ["F", "O", "P"]


@register("one_hot", f"SELECT o_orderkey, {flags('o_orderpriority', PRIORITY)} FROM ({MISSING})")
def one_hot(spark, sf):
    return tr.one_hot(load(spark, sf, "orders_missing").select("o_orderkey", "o_orderpriority"), ["o_orderpriority"])


@register("one_hot_drop_first", f"SELECT o_orderkey, {flags('o_orderpriority', PRIORITY[1:])} FROM ({MISSING})")
def one_hot_drop_first(spark, sf):
    df = load(spark, sf, "orders_missing").select("o_orderkey", "o_orderpriority")
    return tr.one_hot(df, ["o_orderpriority"], drop_first=True)


@register("ordinal_encode", "SELECT p_partkey, dense_rank() OVER (ORDER BY p_name) - 1 AS p_name FROM part")
def ordinal_encode(spark, sf):
    return tr.ordinal_encode(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@register(
    "ordinal_encode_text",
    "SELECT doc_id, dense_rank() OVER (ORDER BY text) - 1 AS text FROM documents",
)
def ordinal_encode_text(spark, sf):
    return tr.ordinal_encode(load(spark, sf, "documents").select("doc_id", "text"), "text")


@register(
    "category_codes",
    f"""WITH t AS ({MISSING}) SELECT o_orderkey, CASE WHEN o_orderpriority IS NULL THEN -1 ELSE
    dense_rank() OVER (ORDER BY o_orderpriority NULLS LAST) - 1 END AS o_orderpriority FROM t""",
)
def category_codes(spark, sf):
    return tr.category_codes(load(spark, sf, "orders_missing").select("o_orderkey", "o_orderpriority"), "o_orderpriority")


SCALES = {
    "standard": ("avg({c})", "stddev_pop({c})"),
    "minmax": ("min({c})", "max({c}) - min({c})"),
    "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)"),
    "maxabs": ("0 * count(*)", "max(abs({c}))"),
}


def scaled(c, method, table="t"):
    a, b = (x.format(c=c) for x in SCALES[method])
    return f"({c} - (SELECT {a} FROM {table})) / (SELECT {b} FROM {table}) AS {c}"


for method in SCALES:

    @register(
        f"scale_{method}",
        f"""WITH t AS (SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem)
        SELECT l_orderkey, {scaled('l_extendedprice', method)}, {scaled('l_quantity', method)} FROM t""",
        "l_extendedprice l_quantity",
        6,
    )
    def scale(spark, sf, method=method):
        df = load(spark, sf, "lineitem").select("l_orderkey", "l_extendedprice", "l_quantity")
        return tr.scale(df, ["l_extendedprice", "l_quantity"], method)


@register(
    "group_rare",
    """WITH c AS (SELECT p_name, count(*) / (SELECT count(*) FROM part) AS share FROM part GROUP BY p_name)
    SELECT p_partkey, CASE WHEN share < 0.01 THEN 'Other' ELSE part.p_name END AS p_name FROM part JOIN c
    ON part.p_name = c.p_name""",
)
def group_rare(spark, sf):
    return tr.group_rare(load(spark, sf, "part").select("p_partkey", "p_name"), "p_name")


@register(
    "frequency_encode",
    f"""WITH t AS ({MISSING}) SELECT t.o_orderkey, t.o_orderpriority, f.n AS o_orderpriority_freq FROM t LEFT JOIN
    (SELECT o_orderpriority, count(*) AS n FROM t GROUP BY 1) f ON t.o_orderpriority = f.o_orderpriority""",
)
def frequency_encode(spark, sf):
    df = load(spark, sf, "orders_missing").select("o_orderkey", "o_orderpriority")
    return tr.frequency_encode(df, "o_orderpriority")


@register(
    "target_encode",
    """SELECT p_partkey, p_brand, p_retailprice, avg(p_retailprice) OVER (PARTITION BY p_brand) AS p_brand_target
    FROM part""",
    "p_brand_target",
)
def target_encode(spark, sf):
    df = load(spark, sf, "part").select("p_partkey", "p_brand", "p_retailprice")
    return tr.target_encode(df, "p_brand", "p_retailprice")


@register(
    "fill_constant",
    f"""WITH t AS ({MISSING}) SELECT o_orderkey, coalesce(o_totalprice, (SELECT avg(o_totalprice) FROM t)) AS o_totalprice,
    coalesce(o_orderpriority, 'Unknown') AS o_orderpriority, coalesce(o_orderstatus, 'Unknown') AS o_orderstatus FROM t""",
    "o_totalprice",
)
def fill_constant(spark, sf):
    return tr.fill_constant(
        load(spark, sf, "orders_missing").select("o_orderkey", "o_totalprice", "o_orderpriority", "o_orderstatus")
    )


@register(
    "drop_duplicates_keep_last",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice FROM (
    SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""",
)
def drop_duplicates_keep_last(spark, sf):
    df = load(spark, sf, "lineitem").withColumn("ord", F.struct("l_partkey", "l_suppkey", "l_extendedprice"))
    df = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "ord")
    return tr.keep_last(df, ["l_orderkey", "l_linenumber"], "ord").drop("ord")


@register(
    "cast_numeric",
    "SELECT c_custkey, try_cast(c_name AS DOUBLE) IS NULL AS bad_name, c_acctbal FROM customer",
)
def cast_numeric(spark, sf):
    df = load(spark, sf, "customer").select("c_custkey", "c_name", F.col("c_acctbal").cast("string").alias("c_acctbal"))
    done = tr.cast_numeric(df, ["c_name", "c_acctbal"])
    return done.select("c_custkey", F.col("c_name").isNull().alias("bad_name"), "c_acctbal")


@register(
    "class_weights",
    """SELECT l_orderkey, l_linenumber, l_returnflag, n / (k * nc) AS class_weight FROM lineitem JOIN (
    SELECT l_returnflag AS flag, count(*) AS nc FROM lineitem GROUP BY 1) ON l_returnflag = flag,
    (SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem)""",
    "class_weight",
    6,
)
def class_weights(spark, sf):
    return tr.class_weights(load(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag"), "l_returnflag")


@register(
    "undersample",
    """SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY
    md5(CAST(o_orderkey AS VARCHAR))) AS r FROM orders) WHERE r <= (SELECT min(n) FROM (SELECT count(*) AS n FROM orders
    GROUP BY o_orderpriority))""",
)
def undersample(spark, sf):
    return tr.undersample(load(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "o_orderkey")


@register("select_by_type", "SELECT p_partkey, p_size, p_retailprice FROM part")
def select_by_type(spark, sf):
    return tr.select_by_type(load(spark, sf, "part"), "numeric")


# ---- text -------------------------------------------------------------------------

# English stop words, written out on this side.
STOP_WORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself "
    "it its itself they them their theirs themselves what which who whom this that these those am is are was were be "
    "been being have has had having do does did doing a an the and but if or because as until while of at by for with "
    "about against between into through during before after above below to from up down in out on off over under again "
    "further then once here there when where why how all any both each few more most other some such no nor not only "
    "own same so than too very s t can will just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd "
    "she'd we'd they'd i'm you're he's she's it's we're they're i've we've you've they've isn't aren't wasn't weren't "
    "haven't hasn't hadn't don't doesn't didn't won't wouldn't shan't shouldn't mustn't can't couldn't cannot could "
    "here's how's let's ought that's there's what's when's where's who's why's would"
).split()
STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
TERMS = f"""words AS (SELECT doc_id, list_filter(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}'),
    lambda w: w NOT IN ({STOPS})) AS w FROM documents),
  grams AS (SELECT doc_id, list_concat(w, CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)),
    lambda i: w[i] || ' ' || w[i + 1]) ELSE [] END) AS g FROM words),
  tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(g) AS term FROM grams) GROUP BY doc_id, term),
  counts AS (SELECT term, CAST(sum(n) AS BIGINT) AS corpus_count, count(*) AS doc_count FROM tf GROUP BY term),
  vocab AS (SELECT * FROM counts WHERE doc_count >= 2 ORDER BY corpus_count DESC, term LIMIT 100)"""


def _texts(spark, sf):
    return spread(load(spark, sf, "documents").select("doc_id", "text"))


@register("term_counts", f"WITH {TERMS} SELECT term, corpus_count, doc_count FROM counts")
def term_counts(spark, sf):
    return textvec.term_counts(_texts(spark, sf), "text")


@register("tfidf_vocabulary", f"WITH {TERMS} SELECT term, corpus_count, doc_count FROM vocab")
def tfidf_vocabulary(spark, sf):
    return textvec.vocabulary(_texts(spark, sf), "text")


@register(
    "tfidf",
    f"""WITH {TERMS}, idf AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + doc_count)) + 1 AS idf FROM vocab),
    w AS (SELECT doc_id, tf.term, n * idf AS x FROM tf JOIN idf ON tf.term = idf.term)
    SELECT doc_id, term, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS weight FROM w""",
    "weight",
    6,
)
def tfidf(spark, sf):
    df = _texts(spark, sf)
    step = textvec.fit_tfidf(df, "text", df.count())
    wide = textvec.tfidf_columns(df, step).drop("text")
    cells = [F.struct(F.lit(t).alias("term"), F.col(f"text_tfidf_{i}").alias("weight")) for i, t in enumerate(step["terms"])]
    return wide.select("doc_id", F.inline(F.array(*cells))).where("weight > 0")


# ---- chains -----------------------------------------------------------------------


@register(
    "quick_clean",
    f"""WITH t AS (SELECT DISTINCT * FROM ({MISSING})) SELECT o_orderkey, o_custkey,
    coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM t)) AS o_totalprice,
    coalesce(o_orderdate, {MODE.format(c='o_orderdate')}) AS o_orderdate,
    coalesce(o_orderpriority, {MODE.format(c='o_orderpriority')}) AS o_orderpriority FROM t""",
    "o_totalprice",
)
def quick_clean(spark, sf):
    return tr.quick_clean(load(spark, sf, "orders_missing"))


@register(
    "prepare_numeric",
    f"""WITH t AS (SELECT * FROM customer) SELECT {scaled('c_custkey', 'standard')}, {scaled('c_nationkey', 'standard')},
    c_acctbal, {flags('c_mktsegment', SEGMENTS[1:])} FROM t""",
    "c_custkey c_nationkey",
    6,
)
def prepare_numeric(spark, sf):
    return tr.prepare_numeric(load(spark, sf, "customer"), "c_acctbal")


ORDERS_PREPARED = f"""WITH t AS (SELECT * REPLACE (
      coalesce(o_totalprice, (SELECT quantile_cont(o_totalprice, 0.5) FROM m)) AS o_totalprice,
      coalesce(o_orderpriority, (SELECT o_orderpriority FROM m WHERE o_orderpriority IS NOT NULL GROUP BY 1
        ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority) FROM m)
  SELECT o_orderkey, {{custkey}}, {{price}}, {date_sql('o_orderdate')}, {flags('o_orderpriority', PRIORITY)} FROM t"""
for mode, method in (("minimal", "minmax"), ("balanced", "standard"), ("aggressive", "robust")):
    body = ORDERS_PREPARED.format(custkey=scaled("o_custkey", method), price=scaled("o_totalprice", method))

    @register(
        f"auto_preprocess_{mode}", f"WITH m AS ({MISSING}) SELECT * FROM ({body})", "o_custkey o_totalprice", 6
    )
    def auto(spark, sf, mode=mode):
        return auto_preprocess(load(spark, sf, "orders_missing"), mode=mode)


@register(
    "auto_preprocess_target",
    f"""WITH t AS ({MISSING}), f AS (SELECT * REPLACE (coalesce(o_orderpriority, (SELECT o_orderpriority FROM t
      WHERE o_orderpriority IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority) FROM t)
    SELECT o_orderkey, {scaled('o_custkey', 'standard', 'f')}, o_totalprice, {date_sql('o_orderdate')},
    {flags('o_orderpriority', PRIORITY)} FROM f""",
    "o_custkey",
    6,
)
def auto_target(spark, sf):
    return auto_preprocess(load(spark, sf, "orders_missing"), "o_totalprice")


EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]


@register(
    "auto_preprocess_duplicates",
    f"""WITH t AS (SELECT DISTINCT * FROM ({DUP})) SELECT {scaled('user_id', 'standard')}, {scaled('value', 'standard')},
    {flags('event_type', EVENT_TYPES)}, dense_rank() OVER (ORDER BY props) - 1 AS props FROM t""",
    "user_id value",
    6,
)
def auto_duplicates(spark, sf):
    return auto_preprocess(load(spark, sf, "events_dup"))


LABELLED = view_sql("labels_docs")


@register(
    "auto_preprocess_text",
    f"""WITH documents AS ({LABELLED}), {TERMS}, s AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd,
      quantile_cont(n_chars, 0.5) AS q2, quantile_cont(n_chars, 0.75) - quantile_cont(n_chars, 0.25) AS iqr FROM documents)
    SELECT doc_id, quality, (n_chars - m) / sd AS n_chars,
    CAST(doc_id IN (SELECT doc_id FROM tf JOIN vocab ON tf.term = vocab.term) AS INT)::DOUBLE AS length FROM documents, s""",
    "n_chars length",
    6,
)
def auto_text(spark, sf):
    """The TF-IDF columns are checked by the length of each row's vector."""
    done = auto_preprocess(load(spark, sf, "labels_docs"), "quality")
    weights = [F.col(f"`{c}`") for c in done.columns if c.startswith("text_tfidf_")]
    squared = F.aggregate(F.array(*weights), F.lit(0.0), lambda a, x: a + x * x)
    return done.select("doc_id", "quality", "n_chars", F.sqrt(squared).alias("length"))


@register("feature_names", "SELECT unnest(['o_orderkey', 'o_custkey', 'o_orderdate_year', 'o_orderdate_month', 'o_orderdate_day', "
          "'o_orderdate_dayofweek', 'o_orderdate_quarter', "
          + ", ".join(f"'o_orderpriority_{v}'" for v in PRIORITY) + "]) AS feature FROM (SELECT 1 FROM orders LIMIT 1)")
def feature_names(spark, sf):
    plan = PreprocessPlan.fit(load(spark, sf, "orders_missing"), "o_totalprice")
    return spark.range(1).select(F.explode(F.array(*map(F.lit, plan.feature_names()))).alias("feature"))


@register(
    "transform_summary",
    facts_cte("orders_missing")
    + """SELECT max(total) AS original_rows, count(*) AS original_columns, max(total) AS processed_rows,
    CAST(13 AS BIGINT) AS processed_columns, 'balanced' AS mode, 2::BIGINT AS numeric_features FROM facts""",
)
def transform_summary(spark, sf):
    df = load(spark, sf, "orders_missing")
    plan = PreprocessPlan.fit(df)
    return plan.summary(plan.transform(df)).select(
        "original_rows", "original_columns", "processed_rows", "processed_columns", "mode", "numeric_features"
    )


@register(
    "save_plan",
    f"WITH m AS ({MISSING}) SELECT * FROM ({ORDERS_PREPARED.format(custkey=scaled('o_custkey', 'standard'), price=scaled('o_totalprice', 'standard'))})",
    "o_custkey o_totalprice",
    6,
)
def save_plan(spark, sf):
    """Fit, save, load and apply the loaded plan."""
    df = load(spark, sf, "orders_missing")
    path = scratch_path(spark, "plan")
    PreprocessPlan.fit(df).save(spark, path)
    return PreprocessPlan.load(spark, path).transform(df)


def configured_query(spark, sf, **options):
    df = load(spark, sf, "orders_missing")
    steps, tables = tr.configured(df, ["o_totalprice", "o_custkey"], ["o_orderpriority"], **options)
    out = df
    for step in steps:
        out = apply_step(out, step, tables)
    return out


FILLED = f"""m AS ({MISSING}), t AS (SELECT o_custkey, coalesce(o_totalprice, (SELECT {{fill}}(o_totalprice) FROM m)) AS o_totalprice,
  coalesce(o_orderpriority, (SELECT o_orderpriority FROM m WHERE o_orderpriority IS NOT NULL GROUP BY 1
    ORDER BY count(*) DESC, 1 LIMIT 1)) AS o_orderpriority FROM m)"""


@register(
    "configurable_onehot",
    f"""WITH {FILLED.format(fill='median')} SELECT {scaled('o_custkey', 'robust')}, {scaled('o_totalprice', 'robust')},
    {flags('o_orderpriority', PRIORITY)} FROM t""",
    "o_custkey o_totalprice",
    6,
)
def configurable_onehot(spark, sf):
    return configured_query(spark, sf, impute="median", scaler="robust", encoder="onehot")


@register(
    "configurable_ordinal",
    f"""WITH {FILLED.format(fill='avg')} SELECT {scaled('o_custkey', 'maxabs')}, {scaled('o_totalprice', 'maxabs')},
    dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS o_orderpriority FROM t""",
    "o_custkey o_totalprice",
    6,
)
def configurable_ordinal(spark, sf):
    return configured_query(spark, sf, impute="mean", scaler="maxabs", encoder="ordinal")
