"""Queries of this subpackage: name -> (Spark callable, SQL or None)."""

from __future__ import annotations

import os

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Register a query that takes (spark, sf_dir)."""

    def wrap(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


BATCH_BYTES = 8 << 20


def importable(spark) -> None:
    """Let Python workers of this machine import the library (on a cluster it is installed or sent along), and
    bound the Arrow batches they get: every task holds a batch on both sides, and texts and sets may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    held = spark.conf.get(name).rstrip("b")
    if not held.isdigit() or int(held) > BATCH_BYTES:
        spark.conf.set(name, str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = spark.sparkContext.environment
    parts = held.get("PYTHONPATH", "").split(os.pathsep)
    if root not in parts:
        held["PYTHONPATH"] = os.pathsep.join(p for p in [*parts, root] if p)


def table(spark, sf_dir: str, name: str):
    """A table of the test data."""
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
