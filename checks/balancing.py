"""Queries of imputation from other columns and of synthetic minority rows, with their SQL."""

from __future__ import annotations

from checks.registry import register
from checks.views import DERIVED, load
from tabwright.operators import imputation, oversampling

HOLES = ["price", "customer", "slot"]


def _near(a: str, b: str, columns: list[str]) -> str:
    """Squared distance over the columns both have, scaled up to all."""
    square = " + ".join(f"coalesce(({a}.{c} - {b}.{c}) * ({a}.{c} - {b}.{c}), 0)" for c in columns)
    shared = " + ".join(f"CAST({a}.{c} IS NOT NULL AND {b}.{c} IS NOT NULL AS INT)" for c in columns)
    return f"({square}) * {len(columns)} / nullif({shared}, 0)"


def _knn_sql(columns: list[str], gaps: list[str], k: int) -> str:
    order = "[near, " + ", ".join(f"coalesce(d_{c}, -1e300)" for c in columns) + "]"
    parts, fill = [f"t AS ({DERIVED['orders_holes']})"], []
    same = lambda a, b: " AND ".join(f"{a}.{c} IS NOT DISTINCT FROM {b}.{c}" for c in columns)
    for g in gaps:
        donors = ", ".join(f"d.{c} AS d_{c}" for c in columns)
        parts.append(
            f"""{g}_fill AS (SELECT {', '.join(columns)}, list_avg(arg_min(d_{g}, {order}, {k})) AS v FROM (
            SELECT {', '.join(f'q.{c}' for c in columns)}, {donors}, {_near('q', 'd', columns)} AS near
            FROM (SELECT DISTINCT {', '.join(columns)} FROM t WHERE {g} IS NULL) q, t d WHERE d.{g} IS NOT NULL)
            WHERE near IS NOT NULL GROUP BY {', '.join(columns)})"""
        )
        fill.append(g)
    chosen = ", ".join(
        f"coalesce(t.{c}, {c}_fill.v, (SELECT avg({c}) FROM t)) AS {c}" if c in gaps else f"t.{c}" for c in columns
    )
    joins = " ".join(f"LEFT JOIN {g}_fill ON {same('t', g + '_fill')}" for g in fill)
    return f"WITH {', '.join(parts)} SELECT o_orderkey, {chosen} FROM t {joins}"


@register("knn_impute", _knn_sql(HOLES, ["price", "customer"], 5), "price customer slot", 6)
def knn_impute(spark, sf):
    return imputation.knn_impute(load(spark, sf, "orders_holes"), HOLES)


def _iterative_sql(rounds: int) -> str:
    """Least squares on the two other columns in closed form, round after round."""
    parts = [
        f"t AS ({DERIVED['orders_holes']})",
        """r0 AS (SELECT o_orderkey, price, customer, slot, coalesce(price, (SELECT avg(price) FROM t)) AS f_price,
        coalesce(customer, (SELECT avg(customer) FROM t)) AS f_customer, slot AS f_slot FROM t)""",
    ]

    def fit(target: str, a: str, b: str, n: int) -> str:
        a, b, y = f"f_{a}", f"f_{b}", f"f_{target}"
        return f"""fit_{target}{n} AS (SELECT *, my - wa * ma - wb * mb AS w0 FROM (SELECT my, ma, mb,
        (sbb * say - sab * sby) / (saa * sbb - sab * sab) AS wa, (saa * sby - sab * say) / (saa * sbb - sab * sab) AS wb FROM (
        SELECT avg({y}) AS my, avg({a}) AS ma, avg({b}) AS mb, var_pop({a}) AS saa, var_pop({b}) AS sbb, covar_pop({a}, {b}) AS sab,
        covar_pop({a}, {y}) AS say, covar_pop({b}, {y}) AS sby FROM r{n} WHERE {target} IS NOT NULL)))"""

    for n in range(rounds):
        parts += [fit("price", "customer", "slot", n), fit("customer", "price", "slot", n)]
        parts.append(
            f"""r{n + 1} AS (SELECT o_orderkey, price, customer, slot, f_slot, f_price,
            coalesce(customer, c.w0 + c.wa * f_price + c.wb * f_slot) AS f_customer
            FROM (SELECT * REPLACE (coalesce(price, p.w0 + p.wa * f_customer + p.wb * f_slot) AS f_price) FROM r{n}, fit_price{n} p),
            fit_customer{n} c)"""
        )
    return f"WITH {', '.join(parts)} SELECT o_orderkey, f_price AS price, f_customer AS customer, slot FROM r{rounds}"


@register("iterative_impute_one_round", _iterative_sql(1), "price customer slot", 6)
def iterative_impute_one_round(spark, sf):
    return imputation.iterative_impute(load(spark, sf, "orders_holes"), HOLES, rounds=1)


@register("iterative_impute", _iterative_sql(3), "price customer slot", 6)
def iterative_impute(spark, sf):
    return imputation.iterative_impute(load(spark, sf, "orders_holes"), HOLES, rounds=3, tolerance=0)


SMOTE_SQL = f"""WITH t AS ({DERIVED['part_classes']}),
n AS (SELECT class, count(*) AS n, max(count(*)) OVER () - count(*) AS lack FROM t GROUP BY class),
r AS (SELECT t.*, n, lack, md5('42|' || p_partkey) AS h, row_number() OVER (PARTITION BY class ORDER BY md5('42|' || p_partkey)) AS place
      FROM t JOIN n USING (class)),
c AS (SELECT *, unnest(range(0, lack // n + CASE WHEN place <= lack % n THEN 1 ELSE 0 END)) AS copy FROM r),
near AS (SELECT a.p_partkey, arg_min({{'size': b.size, 'price': b.price}}, [{_near('a', 'b', ['size', 'price'])}, b.size, b.price], 5) AS others
         FROM t a JOIN t b ON a.class = b.class AND a.p_partkey <> b.p_partkey GROUP BY a.p_partkey),
dice AS (SELECT c.*, others, CAST('0x' || substr(md5(h || '|' || copy), 1, 8) AS BIGINT) % len(others) + 1 AS turn,
                CAST('0x' || substr(md5(h || '|' || copy), 9, 8) AS BIGINT) / 4294967296.0::DOUBLE AS share
         FROM c JOIN near USING (p_partkey))
SELECT p_partkey, class, size, price, p_brand, false AS synthetic FROM t
UNION ALL
SELECT NULL, class, size + share * (others[turn].size - size), price + share * (others[turn].price - price), NULL, true FROM dice"""


@register("oversample_smote", SMOTE_SQL, "size price", 6)
def oversample_smote(spark, sf):
    return oversampling.oversample_smote(load(spark, sf, "part_classes"), "class", ["size", "price"], ["p_partkey"])
