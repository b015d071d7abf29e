"""Supersession, validity, conflicts, merges of versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days up to which they are broadcast.
SMALL_ROWS = 100_000
STATUS_RANK = ["live", "current", "resolved", "superseded"]


def supersession_chain(notes: DataFrame) -> DataFrame:
    """Versions of a (project, ntype, slug) family by date: each closes the one before; an explicit superseded_by holds."""
    w = Window.partitionBy("project", "ntype", "slug").orderBy("date", "stem")
    return notes.select("project", "ntype", "slug", "stem", F.col("date").alias("valid_from"), F.lead("date").over(w).alias("valid_to"), F.coalesce("explicit", F.lead("stem").over(w)).alias("superseded_by"), F.lag("stem").over(w).alias("supersedes"), F.row_number().over(w).alias("version"))


def conflicts(notes: DataFrame) -> DataFrame:
    """Superseded notes with their successors; resolved when the successor exists and is not superseded itself."""
    old = notes.where("status = 'superseded'").select("project", "ntype", F.col("stem").alias("old_stem"), F.col("date").alias("old_date"), F.col("superseded_by").alias("new_stem"))
    new = notes.select(F.col("stem").alias("new_stem"), F.col("date").alias("new_date"), F.col("status").alias("s"))
    return old.join(new, "new_stem", "left").select("project", "ntype", "old_stem", "old_date", "new_stem", "new_date", (F.col("s").isNotNull() & (F.col("s") != "superseded")).alias("resolved"))


def valid_at(notes: DataFrame, days: DataFrame, start: str = "valid_from", stop: str = "valid_to") -> DataFrame:
    """(day, stem): notes whose half-open interval holds each day; the days are broadcast if they are few."""
    inside = (F.col("day") >= F.col(start)) & (F.col(stop).isNull() | (F.col("day") < F.col(stop)))
    return notes.join(F.broadcast(days) if days.count() <= SMALL_ROWS else days, inside).select("day", "stem")


def contradictions(notes: DataFrame) -> DataFrame:
    """Families with a superseded version: (project, ntype, slug, versions, newest)."""
    g = notes.groupBy("project", "ntype", "slug").agg(F.count("*").alias("versions"), F.max_by("stem", F.struct("date", "stem")).alias("newest"), F.bool_or(F.col("status") == "superseded").alias("revised"))
    return g.where("revised").drop("revised")


def contradicted_set(notes: DataFrame, targets: DataFrame) -> DataFrame:
    """(stem): superseded notes, those of low confidence marked refuted, and targets of contradictions (stem)."""
    refuted = notes.where("confidence < 0.5 AND resolved").select("stem")
    return notes.where("status = 'superseded'").select("stem").union(refuted).union(targets.select("stem")).distinct()


def f1(found: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: precision, recall, F1 of two sets of stems."""
    both = found.select("stem", F.lit(1).alias("f")).join(gold.select("stem", F.lit(1).alias("g")), "stem", "full")
    tp, f, g = F.count_if(F.col("f").isNotNull() & F.col("g").isNotNull()), F.count("f"), F.count("g")
    return both.agg(F.round(F.try_divide(tp, f), 6).alias("precision"), F.round(F.try_divide(tp, g), 6).alias("recall"), F.round(F.try_divide(2 * tp, f + g), 6).alias("f1"))


def falsification_frontier(notes: DataFrame, ledger: DataFrame, k: int) -> DataFrame:
    """The k beliefs nearest to being wrong: unsure, recurring, revised (ledger: old_stem, new_stem)."""
    revisions = ledger.select(F.col("old_stem").alias("stem")).union(ledger.where("new_stem <> ''").select("new_stem")).groupBy("stem").agg(F.count("*").alias("revisions"))
    both = notes.join(revisions, "stem", "left").withColumn("revisions", F.coalesce("revisions", F.lit(0)))
    risk = (1 - F.coalesce("confidence", F.lit(1.0))) * (1 + F.log(F.col("recurrence").cast("double"))) * (1 + F.col("revisions")) * F.when(F.col("resolved"), 0.4).otherwise(1.0)
    return both.withColumn("risk", F.bround(risk, 4)).where("risk > 0").select("stem", "project", "revisions", "risk").orderBy(F.desc("risk"), "stem").limit(k)


def three_way_merge(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row per stem of versions (stem, recurrence, status, tags, superseded_by, title, body): merged fields and conflict flag."""
    fields = ["recurrence", "status", "tags", "superseded_by", "title", "body"]
    named = lambda df, s: df.select("stem", *[F.col(c).alias(f"{c}_{s}") for c in fields])
    both = named(ours, "o").join(named(theirs, "t"), "stem", "full").join(base.select("stem").distinct().withColumn("in_base", F.lit(True)), "stem", "full")
    o, t = (lambda c: F.col(c + "_o")), (lambda c: F.col(c + "_t"))
    either = lambda c: F.coalesce(o(c), t(c))
    differ = lambda c: o(c).isNotNull() & t(c).isNotNull() & (o(c) != t(c))
    rank = lambda c: F.coalesce(F.array_position(F.array(*map(F.lit, STATUS_RANK)), c), F.lit(0))
    status = F.when(o("status").isNull() | t("status").isNull(), either("status")).when(rank(o("status")) >= rank(t("status")), o("status")).otherwise(t("status"))
    none = F.array().cast("array<string>")
    return both.select(
        "stem",
        F.greatest(o("recurrence"), t("recurrence")).alias("recurrence"),
        status.alias("status"),
        F.array_union(F.coalesce(o("tags"), none), F.coalesce(t("tags"), none)).alias("tags"),
        either("superseded_by").alias("superseded_by"),
        either("title").alias("title"),
        (differ("superseded_by") | differ("title") | differ("body")).alias("conflict"),
        F.coalesce("in_base", F.lit(False)).alias("in_base"),
    )


def age_archive(rows: DataFrame, as_of: str, days: int) -> DataFrame:
    """Status becomes archived for rows older than `days`."""
    return rows.withColumn("status", F.when(F.col("date") < F.date_sub(F.lit(as_of).cast("date"), days), "archived").otherwise(F.col("status")))
