"""Run a fitted plan, and optionally a fitted model, over a stream of files.

A plan without `codes` steps is a projection; a `codes` step is a stream-static join. Only dropping duplicates keeps
state: the rows of the last `delay` of the stream's time column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tabwright.plans.preprocess import PreprocessPlan
from tabwright.plans.training import Trainer


def stream_files(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def prepare_stream(
    stream: DataFrame,
    plan: PreprocessPlan,
    out: str,
    checkpoint: str,
    trainer: Trainer | None = None,
    time: str | None = None,
    delay: str = "10 minutes",
) -> StreamingQuery:
    """Append prepared (and, with a trainer, predicted) rows to a Parquet folder until the input is read.

    `time` and `delay` bound the state of a plan that drops duplicates.
    """
    prepared = plan.transform(stream, time, delay)
    if trainer is not None:
        prepared = trainer.predict(prepared)
    writer = prepared.writeStream.outputMode("append").format("parquet").option("path", out)
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
