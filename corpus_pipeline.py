"""A training corpus from `documents` in five stages, each on all that its predecessor kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorekeep.llm import dac, decontam, minhash, mixing, nbsvm
from lorekeep.llm.shared import new_path, stored
from lorekeep.shared import cleared


def text_key() -> Column:
    return F.xxhash64(F.col("text").cast("string"))


def named(docs: DataFrame) -> list[Column]:
    """The columns of `docs`, whatever their names."""
    return [docs[f"`{c.replace('`', '``')}`"] for c in docs.columns]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject.

    Every row is judged by its own text, a null one as an empty one, so rows with null or repeated ids
    and equal rows stay or go each for itself; a score of just the threshold stays. Labels of null ids
    are ignored. An empty table stays empty; the columns of `docs` come back as they are.
    """
    model = nbsvm.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return nbsvm.filter_rows(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (links of Jaccard 0.8 or more over five-word shingles), that with the smallest id.

    SimHash proposes the closest pairs, minimum hashes those that it misses; each link is measured.
    A null id comes last; rows of one id are told apart by their texts, and of rows equal in both any
    one is kept. Null texts and texts without words are one group. An empty table stays empty; the
    columns of `docs` come back as they are.
    """
    path = new_path(spark, "groups")
    with cleared(spark):
        minhash.groups(docs, shingle=5, least=0.8).write.parquet(path)
    placed = spark.read.parquet(path)
    rows = placed.groupBy("id", "h", "root").agg(F.count("*").alias("ties"))
    first = rows.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "h", "ties")).alias("k"))
    keep = stored(first.select(F.col("k.id").alias("_keep_id"), F.col("k.h").alias("_keep_h"), F.col("k.ties").alias("_keep_ties")), "keep")
    same = docs["doc_id"].cast("long").eqNullSafe(keep["_keep_id"]) & (F.xxhash64(docs["text"].cast("string")) == keep["_keep_h"])
    kept = docs.join(keep, same)
    if keep.where("_keep_ties > 1").isEmpty():
        return kept.select(*named(docs))
    # rows equal in id and text: one of them, with whatever else it holds
    more = docs.join(keep.where("_keep_ties > 1"), same).groupBy("_keep_id", "_keep_h").agg(F.first(F.struct(*named(docs))).alias("_keep_row"))
    one = docs.join(keep.where("_keep_ties = 1"), same).select(*named(docs))
    return one.union(more.select(*[F.col("_keep_row")[c].alias(c) for c in docs.columns]))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is benchmark text; a row is judged by its text, whatever its id.

    Null texts have no words and stay; equal texts stay or go together. An empty benchmark rejects nothing,
    an empty table stays empty; the columns of `docs` come back as they are.
    """
    texts = docs.select(text_key().alias("_text_key"), "text")
    path = new_path(spark, "bad")
    with cleared(spark):
        found = decontam.decontaminate(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id_col="_text_key")
        found.where("contaminated").select(F.col("_text_key").alias("bad")).distinct().write.parquet(path)
    bad = spark.read.parquet(path)
    return docs.join(bad, text_key() == F.col("bad"), "left_anti").select(*named(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once, those of small sources again, up to half a pass more than the largest source; written in the mixture's order.

    A null source is a source of its own, sources without words are passed once, and rows equal in id and
    text are taken or left together. An empty table stays empty; the columns of `docs` come back as they are.
    """
    return mixing.in_order(mixing.mix(docs, repetition=1.5))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, in the order in which the rows of `docs` were written; one row per document in them.

    The place of a row is its file's name and its number in it; a table that was not read from files goes
    by doc_id. A null text is an empty one, null and repeated ids stay, and an empty table gives no row.
    """
    placed = dac.placed(docs)
    return dac.encode_table(docs) if placed is None else dac.encode_table(placed, order=[F.col(f"_at.{c}") for c in ("long", "name", "row")])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mix),
    ("token files", tokens),
]

#: A linear model and token ids are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        with cleared(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
