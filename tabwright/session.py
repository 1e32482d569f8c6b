"""Session helpers: settings, scratch space, lineage cuts and small driver-side tables."""

from __future__ import annotations

import json
import math
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A driver-side table may be broadcast up to this many rows; anything larger takes
# the shuffle path (see operators/lookup.py).
BROADCAST_ROWS = 100_000


def build_session(app: str = "tabwright", master: str | None = None, shuffle: int | None = None) -> SparkSession:
    """A session with the settings the library expects. On a cluster leave `master` unset."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if master:
        builder = builder.master(master)
    if shuffle:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle))
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named by `spark.checkpoint.dir`; a temporary one in local mode only."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named
    current = context.getCheckpointDir()
    if current:
        return current
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="tabwright-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: later stages re-read files instead of recomputing the past."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """The table as compressed files below the shared folder, for results that are read more than once."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _plain(value):
    """JSON value of a cell: NaN is missing, infinities are spelt as Spark's reader expects them."""
    if isinstance(value, float) and not math.isfinite(value):
        return None if math.isnan(value) else "Infinity" if value > 0 else "-Infinity"
    return value


def local_table(spark: SparkSession, rows: list[dict], ddl: str) -> DataFrame:
    """A DataFrame over a few driver-side rows, held as one literal in the plan."""
    text = json.dumps([{k: _plain(v) for k, v in row.items()} for row in rows], default=str)
    one = spark.range(0, 1, 1, 1)
    return one.select(F.inline(F.from_json(F.lit(text), f"array<struct<{ddl}>>")))


def batches(items: list, size: int):
    """Consecutive slices, used to keep one aggregate from growing with the table's width."""
    for start in range(0, len(items), size):
        yield items[start : start + size]
