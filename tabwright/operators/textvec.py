"""TF-IDF over 1- and 2-grams with a bounded vocabulary."""

from __future__ import annotations

import math

from pyspark.ml import PipelineModel
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabwright.functions.columns import named
from tabwright.functions.text import grams, tokens
from tabwright.session import local_table
from tabwright.sources.readers import spread

MAX_TERMS, MIN_DOCS = 100, 2
LEADING = 2_000  # terms that are counted exactly
TRACKED = 98_304  # terms that the sketch holds
SKETCH_ERROR = 3.5 * 0.75  # a sketch of m terms is wrong by at most this share / m of all occurrences


def _grams(df: DataFrame, column: str, out: str) -> DataFrame:
    return df.withColumn("_words", tokens(named(column))).withColumn(out, grams(F.col("_words"))).drop("_words")


def term_counts(df: DataFrame, column: str) -> DataFrame:
    """(term, corpus_count, doc_count) of every 1- and 2-gram.

    Each text is cut into words once and its grams are sorted, so that the first of equal ones counts the document:
    one shuffle, combined map-side.
    """
    listed = _grams(spread(df.select(named(column))), column, "_grams").select(F.sort_array("_grams").alias("_sorted"))
    first = lambda g, i: F.when((i == 0) | (F.get("_sorted", i - 1) != g), 1).otherwise(0)
    marks = F.transform("_sorted", lambda g, i: F.struct(g.alias("term"), first(g, i).alias("d")))
    counted = listed.select(F.inline(marks)).groupBy("term")
    return counted.agg(F.count(F.lit(1)).alias("corpus_count"), F.sum("d").alias("doc_count"))


def vocabulary(df: DataFrame, column: str, max_terms: int = MAX_TERMS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The most frequent terms that occur in enough documents; ties by term.

    One pass summarises all grams in a mergeable heavy-hitter sketch of fixed size, a second counts the leading ones
    exactly. The sketch bounds what any other term can reach; where that leaves a doubt, as in flat
    or small corpora, all terms are counted by one shuffle.
    """
    shape = "term string, corpus_count bigint, doc_count bigint"
    listed = _grams(spread(df.select(named(column))), column, "_grams").select("_grams")
    held = max(LEADING, 8 * max_terms)
    sketch = F.expr(f"approx_top_k(_gram, {held}, {max(TRACKED, 24 * held)})")
    top = listed.select(F.explode("_grams").alias("_gram")).agg(sketch.alias("top"), F.count("_gram").alias("n")).first()
    if not top["n"]:
        return local_table(df.sparkSession, [], shape)
    leading = [(r["item"], r["count"]) for r in top["top"] if r["item"] is not None]
    if leading:
        terms = [t for t, _ in leading]
        some = listed.select(F.filter("_grams", lambda g: g.isin(terms)).alias("_grams"))
        marks = F.concat(
            F.transform("_grams", lambda g: F.struct(g.alias("term"), F.lit(1).alias("n"), F.lit(0).alias("d"))),
            F.transform(F.array_distinct("_grams"), lambda g: F.struct(g.alias("term"), F.lit(0).alias("n"), F.lit(1).alias("d"))),
        )
        counted = some.select(F.inline(marks)).groupBy("term").agg(F.sum("n").alias("corpus_count"), F.sum("d").alias("doc_count"))
        rows = [r.asDict() for r in counted.where(F.col("doc_count") >= min_docs).collect()]  # at most `held`
        rows = sorted(rows, key=lambda r: (-r["corpus_count"], r["term"]))[:max_terms]
        # twice the sketch's error for terms it does not name, the last estimate for those cut off
        beyond = max(2 * SKETCH_ERROR / max(TRACKED, 24 * held) * top["n"], leading[-1][1] if len(leading) == held else 0)
        if len(rows) == max_terms and rows[-1]["corpus_count"] > beyond:
            return local_table(df.sparkSession, rows, shape)
    every = term_counts(df, column).where(F.col("doc_count") >= min_docs)
    rows = every.orderBy(F.desc("corpus_count"), "term").limit(max_terms).select("term", "corpus_count", "doc_count").collect()
    return local_table(df.sparkSession, [r.asDict() for r in rows], shape)


def fit_tfidf(df: DataFrame, column: str, n_docs: int) -> dict | None:
    """Step with the terms in alphabetical order and their smooth idf; None without any term."""
    rows = sorted((r["term"], r["doc_count"]) for r in vocabulary(df, column).collect())
    if not rows:
        return None
    idf = [math.log((1 + n_docs) / (1 + docs)) + 1 for _, docs in rows]
    return {"op": "tfidf", "column": column, "terms": [t for t, _ in rows], "idf": idf}


def tfidf_vector(df: DataFrame, step: dict, out: str) -> DataFrame:
    """Append the L2-normalised TF-IDF vector of one text column."""
    model = PipelineModel(
        [
            CountVectorizerModel.from_vocabulary(step["terms"], "_grams", "_counts"),
            ElementwiseProduct(scalingVec=Vectors.dense(step["idf"]), inputCol="_counts", outputCol="_weighted"),
            Normalizer(p=2.0, inputCol="_weighted", outputCol=out),
        ]
    )
    return model.transform(_grams(df if df.isStreaming else spread(df), step["column"], "_grams")).drop("_grams", "_counts", "_weighted")


def tfidf_columns(df: DataFrame, step: dict) -> DataFrame:
    """Append `{column}_tfidf_{i}` for every term."""
    column = step["column"]
    with_vector = tfidf_vector(df, step, "_vector").withColumn("_values", vector_to_array("_vector"))
    added = [F.col("_values")[i].alias(f"{column}_tfidf_{i}") for i in range(len(step["terms"]))]
    return with_vector.select(*[named(c) for c in df.columns], *added)
