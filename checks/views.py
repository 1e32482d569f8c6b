"""The driver's tables and derived dirty views, as Spark DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# view -> SQL over the driver's tables (both engines run the same text)
DERIVED = {
    "orders_missing": """
        SELECT o_orderkey, o_custkey,
               CASE WHEN o_orderkey % 5 = 0 THEN o_orderstatus END AS o_orderstatus,
               CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice END AS o_totalprice,
               CASE WHEN o_orderkey % 50 <> 0 THEN o_orderdate END AS o_orderdate,
               CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS o_orderpriority
        FROM orders""",
    "orders_holes": """
        SELECT o_orderkey, CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice / 1000 END AS price,
               CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_custkey AS DOUBLE) / 10 END AS customer,
               CAST(o_orderkey % 97 AS DOUBLE) AS slot
        FROM orders""",
    "part_classes": """
        SELECT p_partkey, CASE WHEN p_partkey % 10 = 0 THEN 'a' WHEN p_partkey % 10 < 4 THEN 'b' ELSE 'c' END AS class,
               CAST(p_size AS DOUBLE) AS size, p_retailprice / 10 AS price, p_brand
        FROM part""",
    "events_dup": """
        SELECT user_id, event_type, value, props FROM events
        UNION ALL
        SELECT user_id, event_type, value, props FROM events WHERE event_id % 20 = 0""",
    "lineitem_outlier": """
        SELECT l_orderkey, l_partkey, l_quantity, l_discount, l_returnflag,
               CASE WHEN l_orderkey % 8 = 0 THEN l_extendedprice * 50 ELSE l_extendedprice END AS l_extendedprice
        FROM lineitem""",
    "customer_text_num": """
        SELECT c_custkey, c_nationkey, CAST(c_acctbal AS VARCHAR(40)) AS c_acctbal, c_mktsegment,
               'x' AS c_constant, CASE WHEN c_custkey = 1 THEN 'b' ELSE 'a' END AS c_near
        FROM customer""",
    "labels_docs": """
        SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "lineitem_wide": """
        SELECT l_extendedprice, l_quantity, l_extendedprice * (1 - l_discount) AS net_price,
               l_quantity * 0.5 + l_tax AS half_quantity, l_discount, l_tax,
               CASE WHEN l_orderkey % 7 <> 0 THEN l_extendedprice * (1 + l_tax) END AS gross_price
        FROM lineitem""",
    "pred_rule": """
        SELECT l_orderkey, l_linenumber, l_partkey,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label,
               CASE WHEN (l_orderkey * 7 + l_partkey + CASE WHEN l_returnflag = 'R' THEN 3 ELSE 0 END) % 10 >= 6
                    THEN 1 ELSE 0 END AS prediction,
               ((l_orderkey * 7 + l_partkey + CASE WHEN l_returnflag = 'R' THEN 300 ELSE 0 END) % 1009) / 1009.0E0 AS score,
               l_extendedprice AS y,
               l_extendedprice * 0.9 + l_quantity * 40 AS y_hat
        FROM lineitem""",
    "flag_rule": """
        SELECT l_orderkey, l_linenumber, l_returnflag AS label,
               CASE WHEN (l_orderkey + l_partkey) % 4 = 0 THEN l_returnflag
                    WHEN l_partkey % 3 = 0 THEN 'A' WHEN l_partkey % 3 = 1 THEN 'N' ELSE 'R' END AS prediction,
               (l_partkey % 101) / 101.0E0 AS score_A, (l_orderkey % 103) / 103.0E0 AS score_N,
               ((l_orderkey + 7 * l_partkey) % 107) / 107.0E0 AS score_R
        FROM lineitem""",
}

# columns of each table or view as (name, type); the types are the profile's type names
COLUMNS = {
    "region": [("r_regionkey", "int"), ("r_name", "string")],
    "nation": [("n_nationkey", "int"), ("n_name", "string"), ("n_regionkey", "int")],
    "customer": [
        ("c_custkey", "bigint"), ("c_name", "string"), ("c_nationkey", "int"), ("c_acctbal", "double"),
        ("c_mktsegment", "string"),
    ],
    "part": [
        ("p_partkey", "bigint"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"), ("p_size", "int"),
        ("p_retailprice", "double"),
    ],
    "orders": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp"), ("o_orderpriority", "string"),
    ],
    "orders_missing": [
        ("o_orderkey", "bigint"), ("o_custkey", "bigint"), ("o_orderstatus", "string"), ("o_totalprice", "double"),
        ("o_orderdate", "timestamp"), ("o_orderpriority", "string"),
    ],
    "lineitem": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_suppkey", "bigint"), ("l_linenumber", "int"),
        ("l_quantity", "double"), ("l_extendedprice", "double"), ("l_discount", "double"), ("l_tax", "double"),
        ("l_returnflag", "string"), ("l_linestatus", "string"), ("l_shipdate", "timestamp"),
    ],
    "lineitem_outlier": [
        ("l_orderkey", "bigint"), ("l_partkey", "bigint"), ("l_quantity", "double"), ("l_discount", "double"),
        ("l_returnflag", "string"), ("l_extendedprice", "double"),
    ],
    "lineitem_wide": [
        ("l_extendedprice", "double"), ("l_quantity", "double"), ("net_price", "double"), ("half_quantity", "double"),
        ("l_discount", "double"), ("l_tax", "double"), ("gross_price", "double"),
    ],
    "events": [
        ("event_id", "bigint"), ("ts", "timestamp"), ("user_id", "bigint"), ("event_type", "string"),
        ("value", "double"), ("props", "string"),
    ],
    "events_dup": [("user_id", "bigint"), ("event_type", "string"), ("value", "double"), ("props", "string")],
    "customer_text_num": [
        ("c_custkey", "bigint"), ("c_nationkey", "int"), ("c_acctbal", "string"), ("c_mktsegment", "string"),
        ("c_constant", "string"), ("c_near", "string"),
    ],
    "documents": [
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
    ],
    "labels": [("doc_id", "bigint"), ("quality", "int"), ("toxic", "int")],
    "labels_docs": [
        ("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint"),
        ("quality", "int"),
    ],
    "conversations": [("conv_id", "bigint"), ("turn", "bigint"), ("role", "string"), ("text", "string")],
}

BASE = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A base table, or a derived view over the base tables of `sf_dir`."""
    if name in BASE:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = DERIVED[name]
    needed = {table: spark.read.parquet(f"{sf_dir}/{table}.parquet") for table in BASE if f" {table} " in sql + " "}
    for table, df in needed.items():
        df.createOrReplaceTempView(table)
    return spark.sql(sql)


def view_sql(name: str) -> str:
    return f"SELECT * FROM {name}" if name in BASE else DERIVED[name]
