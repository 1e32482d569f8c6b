"""Saved runs: data, processed data and result tables under one folder, with versioned metadata."""

from __future__ import annotations

import os
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabwright.functions.columns import named
from tabwright.session import local_table

RUN_DDL = (
    "run_id string, name string, created_at string, updated_at string, n_rows bigint, n_columns bigint, "
    "target string, preprocessing_applied boolean, models_trained boolean, tags array<string>, description string"
)


def fingerprint(df: DataFrame) -> DataFrame:
    """(n_rows, fingerprint): a digest of the rows that does not depend on their order.

    Each row's md5 gives two 32-bit numbers; their exact sums name the dataset.
    """
    texts = [named(c).cast("string") for c in df.columns]
    # every cell says how long it is, so no text can pass for a separator or a null
    cells = [F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    digest = F.md5(F.concat_ws("|", *cells))
    words = [F.conv(F.substring(digest, start, 8), 16, 10).cast("decimal(20,0)") for start in (1, 9)]
    sums = [F.coalesce(F.sum(w), F.lit(0)).cast("decimal(38,0)").cast("string") for w in words]
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.concat_ws("-", *sums).alias("fingerprint"))


class RunStore:
    """Append-only store. `runs` holds one row per version of a run's metadata."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark = spark
        self.base = base

    def _path(self, *parts: str) -> str:
        return os.path.join(self.base, *parts)

    def save_run(
        self,
        df: DataFrame,
        name: str | None = None,
        processed: DataFrame | None = None,
        tables: dict[str, DataFrame] | None = None,
        target: str | None = None,
        models_trained: bool = False,
        tags: list[str] | None = None,
        description: str = "",
    ) -> str:
        mark = fingerprint(df).first()
        now = datetime.now(timezone.utc)
        short = f"{sum(int(x) for x in mark['fingerprint'].split('-')) % 16**8:08x}"
        run_id = f"{now:%Y%m%d_%H%M%S}_{short}"
        df.write.parquet(self._path("data", f"run_id={run_id}"))
        if processed is not None:
            processed.write.parquet(self._path("processed", f"run_id={run_id}"))
        for table, rows in (tables or {}).items():
            rows.coalesce(1).write.json(self._path("tables", run_id, table))
        self._append(
            {
                "run_id": run_id,
                "name": name or f"run {run_id[:8]}",
                "created_at": now.isoformat(),
                "updated_at": now.isoformat(),
                "n_rows": mark["n_rows"],
                "n_columns": len(df.columns),
                "target": target,
                "preprocessing_applied": processed is not None,
                "models_trained": models_trained,
                "tags": tags or [],
                "description": description,
            }
        )
        return run_id

    def _append(self, row: dict) -> None:
        local_table(self.spark, [row], RUN_DDL).write.mode("append").parquet(self._path("runs"))

    def list_runs(self) -> DataFrame:
        """Latest version of every run, newest first."""
        versions = self.spark.read.parquet(self._path("runs"))
        latest = F.row_number().over(Window.partitionBy("run_id").orderBy(F.desc("updated_at")))
        return versions.withColumn("_v", latest).where("_v = 1").drop("_v").orderBy(F.desc("updated_at"))

    def update_run(self, run_id: str, **changes) -> bool:
        """Rename, retag or redescribe: a new version of the metadata row."""
        unknown = set(changes) - {"name", "tags", "description"}
        if unknown:
            raise ValueError(f"cannot change {sorted(unknown)}")
        current = self.list_runs().where(F.col("run_id") == run_id).first()
        if current is None:
            return False
        now = datetime.now(timezone.utc).isoformat()
        self._append({**current.asDict(), **changes, "updated_at": now})
        return True

    def load_run(self, run_id: str, tables: tuple[str, ...] = ()) -> dict[str, DataFrame]:
        metadata = self.list_runs().where(F.col("run_id") == run_id)
        row = metadata.first()
        if row is None:
            raise FileNotFoundError(f"run {run_id} not found")
        found = {"metadata": metadata, "data": self.spark.read.parquet(self._path("data", f"run_id={run_id}"))}
        if row["preprocessing_applied"]:
            found["processed"] = self.spark.read.parquet(self._path("processed", f"run_id={run_id}"))
        for table in tables:
            found[table] = self.spark.read.json(self._path("tables", run_id, table))
        return found
