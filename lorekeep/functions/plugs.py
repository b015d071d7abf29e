"""Where a caller's own models enter: embedder, extractor, reranker, utility, predicate.

Each is a Column-to-Column function (a pandas_udf of the caller, or a plain
expression), applied only to the rows that need it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Model = Callable[..., Column]


def embed(notes: DataFrame, model: Model, space: str) -> DataFrame:
    """Notes (text, vec, embed_space) with vectors of the given space; only missing or foreign ones are asked for."""
    stale = F.col("vec").isNull() | ~F.col("embed_space").eqNullSafe(F.lit(space))
    vec = F.when(stale, model(F.when(stale, F.col("text")))).otherwise(F.col("vec"))
    return notes.withColumns({"vec": vec, "embed_space": F.when(vec.isNotNull(), F.lit(space))})


def extract(sessions: DataFrame, model: Model) -> DataFrame:
    """Sessions (body) with the extractor's JSON as `reply`."""
    return sessions.withColumn("reply", model(F.col("body")))


def relevance(pool: DataFrame, model: Model) -> DataFrame:
    """(qid, stem, relevance) of a pool (qid, stem, query, text), for `retrieval.rerank`."""
    return pool.select("qid", "stem", model(F.col("query"), F.col("text")).cast("double").alias("relevance"))


def utility(notes: DataFrame, value: Column, tokens: Column) -> DataFrame:
    """Notes with the two columns that the coreset needs."""
    return notes.withColumns({"utility": value.cast("double"), "toks": tokens})
