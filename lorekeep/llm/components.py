"""Connected components by alternating large-star and small-star steps.

Every step is a grouped minimum (combined before the shuffle) and a join, so a
hub with millions of links is never gathered in one task. Each round is written
to the shared folder, which cuts the lineage, and takes the place of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import drop, new_path, stored


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], row[1]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u links to the smallest of u and its neighbours."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(edges: DataFrame) -> DataFrame:
    """u (the larger end) and its smaller neighbours link to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    # the edge to the smallest stays, so u keeps a link; the ends of the others are moved
    return edges.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node that it reaches.

    `edges` has two long columns u and v; loops and repeats are allowed. Nodes
    without an edge have no row. Raises when the rounds do not settle.
    """
    spark = edges.sparkSession
    at = new_path(spark, "edges")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges", at)
    mark = _mark(edges)
    for _ in range(max_rounds):
        if not mark[0]:
            break
        last, at = at, new_path(spark, "edges")
        edges = stored(_small_star(_large_star(edges)), "edges", at)
        before, mark = mark, _mark(edges)
        drop(spark, last)
        if mark == before:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root")).distinct()
