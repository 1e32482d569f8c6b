"""Queries of density clusters and of leaf-wise boosted trees, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.registry import register
from checks.transforms import date_sql, scaled
from checks.views import load
from tabwright.operators.clustering import dbscan
from tabwright.plans.boosting import Growth, train_gbt_leafwise
from tabwright.plans.preprocess import PreprocessPlan
from tabwright.session import scratch_path
from tabwright.streaming.apply import prepare_stream, stream_files

SQUARE = "(a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9"

DBSCAN_SQL = f"""WITH RECURSIVE
p AS (SELECT c_custkey, c_acctbal / 100 AS x, CAST(c_nationkey AS DOUBLE) * 10 AS y FROM customer),
near AS (SELECT a.c_custkey AS i, b.c_custkey AS j FROM p a JOIN p b ON {SQUARE}),
core AS (SELECT i FROM near GROUP BY i HAVING count(*) >= 4),
link AS (SELECT i, j FROM near WHERE i IN (FROM core) AND j IN (FROM core)),
reach AS (SELECT i, i AS j FROM core UNION SELECT reach.i, link.j FROM reach JOIN link ON reach.j = link.i),
least AS (SELECT reach.i, min([x, y]) AS low FROM reach JOIN p ON reach.j = p.c_custkey GROUP BY reach.i),
named AS (SELECT i, dense_rank() OVER (ORDER BY low) - 1 AS cluster FROM least),
edge AS (SELECT near.i, min(cluster) AS cluster FROM near JOIN named ON named.i = near.j GROUP BY near.i)
SELECT c_custkey, x, y, coalesce(named.cluster, edge.cluster, -1) AS cluster
FROM p LEFT JOIN named ON named.i = c_custkey LEFT JOIN edge ON edge.i = c_custkey"""


@register("dbscan", DBSCAN_SQL, "x y", 6)
def dbscan_query(spark, sf):
    points = load(spark, sf, "customer").selectExpr("c_custkey", "c_acctbal / 100 AS x", "CAST(c_nationkey AS DOUBLE) * 10 AS y")
    return dbscan(points, ["x", "y"], eps=3.0, min_points=4)


QUANTITIES = [5.0 * k for k in range(1, 10)]
DISCOUNTS = [0.015, 0.035, 0.055, 0.075]


def _stumps_sql(rounds: int) -> str:
    """Trees of one split each: every split of every feature and side for missing values is tried."""
    parts = [
        """m0 AS (SELECT l_extendedprice / 1000 AS y, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS quantity, l_discount AS discount,
        (SELECT avg(l_extendedprice / 1000) FROM lineitem) AS f FROM lineitem)""",
        f"""cuts AS (SELECT feature, place, CAST(edge AS DOUBLE) AS edge FROM (SELECT 'quantity' AS feature, 0 AS place, unnest({QUANTITIES}) AS edge UNION ALL
        SELECT 'discount', 1, unnest({DISCOUNTS})))""",
    ]
    for n in range(rounds):
        long = " UNION ALL ".join(f"SELECT '{c}' AS feature, {c} AS v, f - y AS g FROM m{n}" for c in ("quantity", "discount"))
        parts.append(
            f"""s{n} AS (SELECT c.feature, c.place, c.edge, l.missing_left,
            sum(CASE WHEN coalesce(t.v <= c.edge, l.missing_left) THEN g ELSE 0 END) AS lg, count(*) FILTER (coalesce(t.v <= c.edge, l.missing_left)) AS ln,
            sum(g) AS g, count(*) AS n FROM cuts c JOIN ({long}) t USING (feature), (VALUES (true), (false)) l(missing_left) GROUP BY ALL)"""
        )
        parts.append(
            f"""b{n} AS (SELECT *, lg * lg / (ln + 1) + (g - lg) * (g - lg) / (n - ln + 1) - g * g / (n + 1) AS gain,
            -0.1 * lg / (ln + 1) AS left_value, -0.1 * (g - lg) / (n - ln + 1) AS right_value FROM s{n}
            WHERE ln >= 20 AND n - ln >= 20 ORDER BY round(gain, 4) DESC, missing_left DESC, place, edge LIMIT 1)"""
        )
        parts.append(
            f"""m{n + 1} AS (SELECT y, quantity, discount, f + CASE WHEN coalesce(CASE b.feature WHEN 'quantity' THEN quantity ELSE discount END <= b.edge,
            b.missing_left) THEN left_value ELSE right_value END AS f FROM m{n}, b{n} b)"""
        )
    found = " UNION ALL ".join(
        f"SELECT {n} AS tree, feature, edge, missing_left, gain, left_value, right_value FROM b{n}" for n in range(rounds)
    )
    return f"WITH {', '.join(parts)} {found}"


@register("train_gbt_leafwise", _stumps_sql(3), "gain left_value right_value", 3)
def gbt_leafwise(spark, sf):
    rows = load(spark, sf, "lineitem").selectExpr(
        "l_extendedprice / 1000 AS y", "CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS quantity", "l_discount AS discount"
    )
    model = train_gbt_leafwise(rows, "y", ["quantity", "discount"], rounds=3, growth=Growth(leaves=2), edges=[QUANTITIES, DISCOUNTS])
    nodes = model.nodes(spark)
    split = nodes.where("feature is not null")
    for side in ("left", "right"):
        leaf = nodes.selectExpr("tree AS t", "node AS n", f"value AS {side}_value")
        split = split.join(leaf, (F.col("tree") == F.col("t")) & (F.col(f"{side}_node") == F.col("n"))).drop("t", "n")
    return split.select("tree", "feature", "edge", "missing_left", "gain", "left_value", "right_value")


@register("gbt_leafwise_predictions")
def gbt_leafwise_predictions(spark, sf):
    """Trees of many leaves over quantile bins, applied to all rows."""
    rows = load(spark, sf, "orders_holes")
    model = train_gbt_leafwise(rows, "price", ["customer", "slot"], rounds=3, growth=Growth(leaves=8))
    return model.predict(rows)


@register(
    "stream_prepare_duplicates",
    f"""WITH t AS (SELECT DISTINCT event_id, ts, value FROM events)
    SELECT event_id, {date_sql('ts')}, {scaled('value', 'standard')} FROM t""",
    "value",
    6,
)
def stream_prepare_duplicates(spark, sf):
    """Every 20th event comes again in another file; the stream drops what it has seen within the delay."""
    events = load(spark, sf, "events").select("event_id", "ts", "value")
    source, out = scratch_path(spark, "events"), scratch_path(spark, "prepared")
    events.unionAll(events.where("event_id % 20 = 0")).repartition(4).write.parquet(source)
    rows = spark.read.parquet(source)
    plan = PreprocessPlan.fit(rows)
    stream = stream_files(spark, source, rows.schema, files_per_trigger=1)
    prepare_stream(stream, plan, out, scratch_path(spark, "offsets"), time="ts", delay="3650 days").awaitTermination()
    return spark.read.parquet(out)
