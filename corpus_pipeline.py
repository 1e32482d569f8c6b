"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again.

Stage                  what goes
toxicity               documents that the toxicity model rejects
line_dedup             lines that repeat an earlier line, or nearly do (their documents stay)
near_duplicates        all documents of a near-duplicate class but the one with the smallest doc_id
decontamination        documents that hold a benchmark passage
packing                nothing: the texts become pieces of token sequences

All stages but the last return the columns of `documents`. Nulls, empty texts, ties, repeated rows and further
columns are treated as the operators say; an empty table passes through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabwright.llm.common import stored
from tabwright.llm.decontaminate import decontaminate
from tabwright.llm.lines import without_repeated_lines
from tabwright.llm.neardup import without_near_duplicates
from tabwright.llm.packing import best_fit
from tabwright.llm.registry import importable, table
from tabwright.llm.tokens import tokenizer_path
from tabwright.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return without_repeated_lines(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    importable(spark)
    return best_fit(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity),
    ("line_dedup", line_dedup),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("packing", packing),
]

# SQL cannot tokenise, fit the toxicity model or follow links; tests hold the operators behind the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
