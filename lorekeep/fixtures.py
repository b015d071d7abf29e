"""The note store's tables, derived from the supplied ones, for Spark and (as CTEs) for DuckDB.

A document is a note of its source's project; versions of one (project, type,
slug) family follow each other by date, and all but the newest are superseded.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The day on which every age is taken.
AS_OF = "2025-01-01"
#: Produced relation names, by document.
RELATIONS = ["causes", "caused-by", "fixes", "fixed-by", "depends-on", "requires", "part-of", "alternative-to", "related-to"]
ETYPES = ["method", "dataset", "paper"]
#: Consecutive documents whose notes of one project and type are versions of one another; families grow in number with the table.
FAMILY = 180

BASE_SQL = """
WITH n0 AS (
  SELECT d.doc_id, d.text, d.lang, d.n_chars, d.source AS project,
    CASE d.doc_id % 3 WHEN 0 THEN 'mistake' WHEN 1 THEN 'pattern' ELSE 'decision' END AS ntype,
    DATE '2024-01-01' + CAST((d.doc_id * 37) % 366 AS INT) AS date,
    't' || (d.doc_id // 180) AS slug, split_part(d.text, '.', 1) AS title, d.text AS descr,
    CASE WHEN d.doc_id % 3 = 0 THEN split_part(d.text, '.', 2) ELSE '' END AS prevention,
    1 + d.doc_id % 5 AS recurrence, CASE l.quality WHEN 1 THEN 0.9::DOUBLE WHEN 0 THEN 0.4::DOUBLE END AS confidence,
    d.doc_id % 3 = 0 AND d.doc_id % 4 = 0 AS resolved, CAST(e.embedding AS DOUBLE[]) AS vec
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = d.doc_id),
n1 AS (SELECT *, strftime(date, '%Y-%m-%d') || '-' || project || '-' || ntype || '-' || slug || '-' || doc_id AS stem FROM n0),
n AS (SELECT *, lead(stem) OVER f AS superseded_by, lag(stem) OVER f AS supersedes, date AS valid_from, lead(date) OVER f AS valid_to,
    CASE WHEN lead(stem) OVER f IS NULL THEN 'live' ELSE 'superseded' END AS status
  FROM n1 WINDOW f AS (PARTITION BY project, ntype, slug ORDER BY date, stem)),
live AS (SELECT * FROM n WHERE status = 'live'),
ne AS (SELECT doc_id, stem, project, ntype, date, title, recurrence, status, unnest(['lang-' || lang, project, 'topic-' || (doc_id % 23), 'size-' || (n_chars // 1000)]) AS entity FROM n),
nr AS (SELECT doc_id, stem, project, status, CASE doc_id % 9 WHEN 0 THEN 'causes' WHEN 1 THEN 'caused-by' WHEN 2 THEN 'fixes' WHEN 3 THEN 'fixed-by' WHEN 4 THEN 'depends-on' WHEN 5 THEN 'requires' WHEN 6 THEN 'part-of' WHEN 7 THEN 'alternative-to' ELSE 'related-to' END AS rel,
    'topic-' || ((doc_id * 5 + 1) % 31) AS target FROM n),
nt AS (SELECT doc_id, stem, project, date, status, 'topic-' || (doc_id % 23) AS entity, CASE (doc_id % 23 + doc_id) % 3 WHEN 0 THEN 'method' WHEN 1 THEN 'dataset' ELSE 'paper' END AS etype FROM n),
nl AS (SELECT doc_id, stem, project, status, CASE WHEN doc_id % 10 = 0 THEN 'missing-' || doc_id ELSE lead(stem) OVER (PARTITION BY project ORDER BY doc_id) END AS target FROM n),
q AS (SELECT item_id AS qid, text, CAST(e.embedding AS DOUBLE[]) AS qvec FROM benchmark b LEFT JOIN embeddings e ON e.vec_id = b.item_id),
qrels AS (SELECT b.item_id AS qid, d.doc_id FROM benchmark b JOIN documents d ON contains(d.text, substr(b.text, 1, 60))),
sr AS (SELECT conv_id AS session, turn, role, text, 'p' || (conv_id % 10) AS project,
    1704067200 + conv_id * 3600 + turn * 40 + CASE WHEN turn >= 5 THEN 300 ELSE 0 END AS ts FROM conversations),
g(guard_id, pattern, message, status, project, pack) AS (VALUES
  ('g-0', 'MIT License', 'check the licence', 'advisory', NULL, false), ('g-1', 'GNU General', 'copyleft', 'blocking', NULL, false),
  ('g-2', '[0-9]{4,}', 'long number', 'advisory', 'src1', false), ('g-3', '!!', 'shouting', 'advisory', 'src2', false),
  ('g-4', '\\|', 'table', 'retired', NULL, false), ('g-5', '@[a-z]+\\.', 'mail address', 'blocking', 'src3', false),
  ('g-6', 'CC BY-NC', 'non-commercial', 'advisory', NULL, false), ('g-7', '\\$\\$\\$', 'noise', 'advisory', 'src4', false),
  ('g-8', 'eval\\(', 'code', 'advisory', NULL, true), ('g-9', 'Apache', 'check the licence', 'advisory', 'src5', false),
  ('g-10', '%%%', 'noise', 'advisory', NULL, false), ('g-11', 'der die', 'german', 'advisory', 'src0', true)),
fb AS (SELECT event_id, 'g-' || (user_id % 20) AS guard_id, CAST(user_id AS VARCHAR) AS session,
    CASE event_type WHEN 'purchase' THEN 'helped' WHEN 'signup' THEN 'corroborated' ELSE 'false_positive' END AS outcome
  FROM events WHERE event_type IN ('purchase', 'signup', 'error')),
led AS (SELECT event_id, ts, CAST(ts AS DATE) AS day, CASE event_type WHEN 'view' THEN 'recall' WHEN 'error' THEN 'guard' WHEN 'click' THEN 'counterfactual' ELSE 'other' END AS kind,
    CAST(floor(value) AS BIGINT) AS saved, CAST(floor(value / 10) AS BIGINT) AS injected FROM events)
"""

GUARDS = [
    ("g-0", "MIT License", "check the licence", "advisory", None, False),
    ("g-1", "GNU General", "copyleft", "blocking", None, False),
    ("g-2", "[0-9]{4,}", "long number", "advisory", "src1", False),
    ("g-3", "!!", "shouting", "advisory", "src2", False),
    ("g-4", r"\|", "table", "retired", None, False),
    ("g-5", r"@[a-z]+\.", "mail address", "blocking", "src3", False),
    ("g-6", "CC BY-NC", "non-commercial", "advisory", None, False),
    ("g-7", r"\$\$\$", "noise", "advisory", "src4", False),
    ("g-8", r"eval\(", "code", "advisory", None, True),
    ("g-9", "Apache", "check the licence", "advisory", "src5", False),
    ("g-10", "%%%", "noise", "advisory", None, False),
    ("g-11", "der die", "german", "advisory", "src0", True),
]


def pick(values: list[str], at) -> F.Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def text_of(prefix: str, number) -> F.Column:
    return F.concat(F.lit(prefix), number.cast("string"))


class Tables:
    """Lazily built views over one data folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        return self.spread(df) if name == "documents" else df

    def spread(self, df: DataFrame) -> DataFrame:
        """Texts of fewer files than cores are dealt over all cores; larger inputs are read as they lie."""
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if len(df.inputFiles()) < cores else df

    @cached_property
    def plain_notes(self) -> DataFrame:
        """Notes without vectors and without their place in a family."""
        d = self.read("documents").join(self.read("labels").select("doc_id", "quality"), "doc_id", "left")
        key = F.col("doc_id")
        kind = pick(["mistake", "pattern", "decision"], key % 3)
        notes = d.select(
            "doc_id", "text", "lang", "n_chars", F.col("source").alias("project"), kind.alias("ntype"),
            F.date_add(F.lit("2024-01-01").cast("date"), (key * 37 % 366).cast("int")).alias("date"),
            text_of("t", F.floor(key / FAMILY)).alias("slug"), F.split_part("text", F.lit("."), F.lit(1)).alias("title"), F.col("text").alias("descr"),
            F.when(key % 3 == 0, F.split_part("text", F.lit("."), F.lit(2))).otherwise("").alias("prevention"),
            (1 + key % 5).alias("recurrence"), F.when(F.col("quality") == 1, 0.9).when(F.col("quality") == 0, 0.4).alias("confidence"),
            ((key % 3 == 0) & (key % 4 == 0)).alias("resolved"),
        )
        return notes.withColumn("stem", F.concat_ws("-", F.date_format("date", "yyyy-MM-dd"), "project", "ntype", "slug", F.col("doc_id").cast("string")))

    @cached_property
    def notes(self) -> DataFrame:
        """Notes with supersession: the next version in the family closes this one."""
        family = Window.partitionBy("project", "ntype", "slug").orderBy("date", "stem")
        after = F.lead("stem").over(family)
        chain = {"superseded_by": after, "supersedes": F.lag("stem").over(family), "valid_from": F.col("date"), "valid_to": F.lead("date").over(family), "status": F.when(after.isNull(), "live").otherwise("superseded")}
        return self.plain_notes.withColumns(chain)

    @cached_property
    def vectors(self) -> DataFrame:
        return self.read("embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").cast("array<double>").alias("vec"))

    @cached_property
    def live(self) -> DataFrame:
        return self.notes.where("status = 'live'")

    @cached_property
    def superseded(self) -> DataFrame:
        return self.notes.where("status = 'superseded'")

    @cached_property
    def entities(self) -> DataFrame:
        key = F.col("doc_id")
        names = F.array(F.concat(F.lit("lang-"), "lang"), F.col("project"), text_of("topic-", key % 23), text_of("size-", F.floor(F.col("n_chars") / 1000)))
        return self.notes.select("doc_id", "stem", "project", "ntype", "date", "title", "recurrence", "status", F.explode(names).alias("entity"))

    @cached_property
    def relations(self) -> DataFrame:
        key = F.col("doc_id")
        return self.notes.select("doc_id", "stem", "project", "status", pick(RELATIONS, key % 9).alias("rel"), text_of("topic-", (key * 5 + 1) % 31).alias("target"))

    @cached_property
    def types(self) -> DataFrame:
        key = F.col("doc_id")
        return self.notes.select("doc_id", "stem", "project", "date", "status", text_of("topic-", key % 23).alias("entity"), pick(ETYPES, (key % 23 + key) % 3).alias("etype"))

    @cached_property
    def links(self) -> DataFrame:
        key = F.col("doc_id")
        after = F.lead("stem").over(Window.partitionBy("project").orderBy("doc_id"))
        return self.notes.select("doc_id", "stem", "project", "status", F.when(key % 10 == 0, text_of("missing-", key)).otherwise(after).alias("target"))

    @cached_property
    def queries(self) -> DataFrame:
        return self.read("benchmark").select(F.col("item_id").alias("qid"), "text").join(self.vectors.select(F.col("doc_id").alias("qid"), F.col("vec").alias("qvec")), "qid", "left")

    @cached_property
    def qrels(self) -> DataFrame:
        items = self.read("benchmark").select(F.col("item_id").alias("qid"), F.substring("text", 1, 60).alias("part"))
        return self.read("documents").join(F.broadcast(items), F.col("text").contains(F.col("part"))).select("qid", "doc_id")

    @cached_property
    def sessions(self) -> DataFrame:
        ts = 1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 40 + F.when(F.col("turn") >= 5, 300).otherwise(0)
        return self.read("conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", text_of("p", F.col("conv_id") % 10).alias("project"), ts.alias("ts"))

    @cached_property
    def guards(self) -> DataFrame:
        return self.spark.createDataFrame(GUARDS, "guard_id string, pattern string, message string, status string, project string, pack boolean")

    @cached_property
    def feedback(self) -> DataFrame:
        kind = F.col("event_type")
        outcome = F.when(kind == "purchase", "helped").when(kind == "signup", "corroborated").otherwise("false_positive")
        return self.read("events").where(kind.isin("purchase", "signup", "error")).select("event_id", text_of("g-", F.col("user_id") % 20).alias("guard_id"), F.col("user_id").cast("string").alias("session"), outcome.alias("outcome"))

    @cached_property
    def ledger(self) -> DataFrame:
        kind = F.col("event_type")
        named = F.when(kind == "view", "recall").when(kind == "error", "guard").when(kind == "click", "counterfactual").otherwise("other")
        return self.read("events").select("event_id", "ts", F.to_date("ts").alias("day"), named.alias("kind"), F.floor("value").alias("saved"), F.floor(F.col("value") / 10).alias("injected"))
