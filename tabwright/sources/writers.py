"""Sinks: CSV, JSON records, result tables and models."""

from __future__ import annotations

import os

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("header", True).csv(path)


def write_json_records(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object per line, nulls kept."""
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_result_tables(tables: dict[str, DataFrame], path: str, fmt: str = "json") -> list[str]:
    """Every table below `path/<name>`; returns the paths."""
    written = []
    for name, df in tables.items():
        target = os.path.join(path, name)
        df.coalesce(1).write.mode("overwrite").format(fmt).save(target)  # result tables are small
        written.append(target)
    return written


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
