"""Query registry: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None, doubles: str = "", digits: int = 4):
    """Register a query; its double columns named in `doubles` are rounded on both sides."""
    listed = doubles.split()

    def wrap(fn):
        def run(spark, sf_dir: str) -> DataFrame:
            return rounded(fn(spark, sf_dir), listed, digits)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = rounded_sql(sql, listed, digits)
        return fn

    return wrap


def rounded(df: DataFrame, columns: list[str], digits: int) -> DataFrame:
    if not columns:
        return df
    return df.select(
        *[
            (F.round(F.col(f"`{c}`").cast("double"), digits) + F.lit(0.0)).alias(c) if c in columns else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def rounded_sql(sql: str, columns: list[str], digits: int) -> str:
    if not columns:
        return sql
    parts = ", ".join(f'(round(CAST("{c}" AS DOUBLE), {digits}) + 0.0) AS "{c}"' for c in columns)
    return f"SELECT * REPLACE ({parts}) FROM ({sql}) AS checked"
