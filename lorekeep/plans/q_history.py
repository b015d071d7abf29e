"""Queries over supersession, validity, windows and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.fixtures import AS_OF, Tables
from lorekeep.operators import graph, history, rollups
from lorekeep.plans.registry import query

DAYS = ["2024-03-01", "2024-07-15", "2024-12-31"]


def days(t: Tables):
    return t.spark.createDataFrame([(d,) for d in DAYS], "d string").select(F.col("d").cast("date").alias("day"))


DAYS_SQL = ", dy AS (SELECT unnest([" + ", ".join(f"DATE '{d}'" for d in DAYS) + "]) AS day)"


@query("SELECT project, ntype, slug, stem, date AS valid_from, lead(date) OVER f AS valid_to, coalesce(CASE WHEN doc_id % 50 = 0 THEN 'explicit' END, lead(stem) OVER f) AS superseded_by, lag(stem) OVER f AS supersedes, CAST(row_number() OVER f AS INT) AS version FROM n WINDOW f AS (PARTITION BY project, ntype, slug ORDER BY date, stem)")
def supersession_chain(t):
    return history.supersession_chain(t.plain_notes.withColumn("explicit", F.when(F.col("doc_id") % 50 == 0, "explicit")))


CONFLICTS = ", cf AS (SELECT o.project, o.ntype, o.stem AS old_stem, o.date AS old_date, o.superseded_by AS new_stem, s.date AS new_date, coalesce(s.status <> 'superseded', false) AS resolved FROM n o LEFT JOIN n s ON s.stem = o.superseded_by WHERE o.status = 'superseded')"


@query(CONFLICTS + " SELECT * FROM cf")
def conflicts_join(t):
    return history.conflicts(t.notes)


@query(DAYS_SQL + " SELECT day, stem FROM n JOIN dy ON valid_from <= day AND (valid_to IS NULL OR day < valid_to)")
def asof_validity(t):
    return history.valid_at(t.notes, days(t))


@query(DAYS_SQL + " SELECT day, stem FROM (SELECT *, date + 3 AS txn_from, valid_to + 3 AS txn_to FROM n) JOIN dy ON txn_from <= day AND (txn_to IS NULL OR day < txn_to)")
def belief_at(t):
    known = t.notes.withColumns({"txn_from": F.date_add("date", 3), "txn_to": F.date_add("valid_to", 3)})
    return history.valid_at(known, days(t), "txn_from", "txn_to")


@query(DAYS_SQL + """, tr AS (SELECT day, project, ntype, slug, max_by(stem, {'d': date, 's': stem}) AS truth FROM n JOIN dy ON date <= day GROUP BY ALL), iv AS (SELECT day, stem FROM n JOIN dy ON valid_from <= day AND (valid_to IS NULL OR day < valid_to)), nw AS (SELECT project, ntype, slug, max_by(stem, {'d': date, 's': stem}) AS newest, count(*) AS versions FROM n GROUP BY ALL)
SELECT day, count(*) AS questions, round(avg(CASE WHEN iv.stem IS NOT NULL THEN 1.0 ELSE 0 END), 6) AS interval_accuracy, round(avg(CASE WHEN newest = truth THEN 1.0 ELSE 0 END), 6) AS newest_accuracy, round(avg(versions), 6) AS versions FROM tr JOIN nw USING (project, ntype, slug) LEFT JOIN iv ON iv.day = tr.day AND iv.stem = truth GROUP BY day""".replace("SELECT day, count(*)", "SELECT tr.day AS day, count(*)").replace("GROUP BY day", "GROUP BY tr.day"))
def eval_point_in_time(t):
    """Interval lookup and newest version against the version that held on each day."""
    family = ["project", "ntype", "slug"]
    newest = F.struct("date", "stem")
    truth = t.notes.join(F.broadcast(days(t)), F.col("date") <= F.col("day")).groupBy("day", *family).agg(F.max_by("stem", newest).alias("truth"))
    last = t.notes.groupBy(*family).agg(F.max_by("stem", newest).alias("newest"), F.count("*").alias("versions"))
    held = history.valid_at(t.notes, days(t)).withColumn("hit", F.lit(1.0))
    both = truth.join(last, family).join(held.withColumnRenamed("stem", "truth"), ["day", "truth"], "left")
    share = lambda c, n: F.round(F.avg(c), 6).alias(n)
    return both.groupBy("day").agg(F.count("*").alias("questions"), share(F.coalesce("hit", F.lit(0.0)), "interval_accuracy"), share((F.col("newest") == F.col("truth")).cast("double"), "newest_accuracy"), share(F.col("versions"), "versions"))


@query("SELECT slug, stem, date, row_number() OVER (PARTITION BY project, ntype, slug ORDER BY date, stem) AS place FROM n WHERE project = 'src1'")
def timeline(t):
    return history.supersession_chain(t.plain_notes.where("project = 'src1'").withColumn("explicit", F.lit(None).cast("string"))).select("slug", "stem", F.col("valid_from").alias("date"), F.col("version").alias("place"))


@query("SELECT entity, stem, date, status, min(date) OVER w AS first_seen, max(date) OVER w AS last_seen, count(*) OVER w AS mentions FROM ne WINDOW w AS (PARTITION BY entity)")
def entity_timeline(t):
    e = t.entities.select("entity", "stem", "date", "status")
    return e.join(e.groupBy("entity").agg(F.min("date").alias("first_seen"), F.max("date").alias("last_seen"), F.count("*").alias("mentions")), "entity")


@query("SELECT project, ntype, slug, count(*) AS versions, max_by(stem, {'d': date, 's': stem}) AS newest FROM n GROUP BY ALL HAVING bool_or(status = 'superseded')")
def contradictions(t):
    return history.contradictions(t.notes)


SETS = ", cs AS (SELECT stem FROM n WHERE status = 'superseded' UNION SELECT stem FROM n WHERE confidence < 0.5 AND resolved UNION SELECT supersedes FROM n WHERE doc_id % 6 = 0 AND supersedes IS NOT NULL)"


def contradicted(t: Tables):
    return history.contradicted_set(t.notes, t.notes.where("doc_id % 6 = 0 AND supersedes IS NOT NULL").select(F.col("supersedes").alias("stem")))


@query(SETS + " SELECT stem FROM cs")
def contradicted_set(t):
    return contradicted(t)


@query(SETS + ", gd AS (SELECT stem FROM n WHERE status = 'superseded' AND doc_id % 4 <> 0) SELECT round(tp / f, 6) AS precision, round(tp / g, 6) AS recall, round(2 * tp / (f + g), 6) AS f1 FROM (SELECT (SELECT count(*) FROM cs JOIN gd USING (stem)) AS tp, (SELECT count(*) FROM cs) AS f, (SELECT count(*) FROM gd) AS g)")
def contradiction_f1(t):
    return history.f1(contradicted(t), t.notes.where("status = 'superseded' AND doc_id % 4 <> 0"))


@query(CONFLICTS + """, rv AS (SELECT stem, count(*) AS revisions FROM (SELECT old_stem AS stem FROM cf UNION ALL SELECT new_stem FROM cf) GROUP BY 1)
SELECT stem, project, coalesce(revisions, 0) AS revisions, round((1 - confidence) * (1 + ln(recurrence)) * (1 + coalesce(revisions, 0)) * CASE WHEN resolved THEN 0.4 ELSE 1 END, 4) AS risk FROM n LEFT JOIN rv USING (stem) WHERE confidence < 1 ORDER BY 4 DESC, stem LIMIT 20""")
def falsification_frontier(t):
    return history.falsification_frontier(t.notes, history.conflicts(t.notes), 20)


@query("""SELECT stem, CASE WHEN doc_id % 10 = 3 THEN recurrence WHEN doc_id % 10 = 7 THEN recurrence + doc_id % 3 ELSE recurrence + doc_id % 3 END AS recurrence,
CASE WHEN doc_id % 4 = 0 THEN 'superseded' ELSE status END AS status, CASE WHEN doc_id % 10 = 3 THEN [lang, 'a'] WHEN doc_id % 10 = 7 THEN [lang, 'b'] ELSE [lang, 'a', 'b'] END AS tags,
CASE WHEN doc_id % 4 = 0 THEN 'r-' || CASE WHEN doc_id % 8 = 0 OR doc_id % 10 = 7 THEN CASE WHEN doc_id % 10 = 7 THEN 'theirs' ELSE 'ours' END ELSE 'ours' END END AS superseded_by, title, doc_id % 10 NOT IN (3, 7) AND (doc_id % 8 = 0 OR doc_id % 15 = 0) AS conflict, doc_id % 2 = 0 AS in_base FROM n""".replace("CASE WHEN doc_id % 8 = 0 OR doc_id % 10 = 7 THEN CASE WHEN doc_id % 10 = 7 THEN 'theirs' ELSE 'ours' END ELSE 'ours' END", "'ours'").replace("CASE WHEN doc_id % 10 = 3 THEN recurrence WHEN doc_id % 10 = 7 THEN recurrence + doc_id % 3 ELSE recurrence + doc_id % 3 END", "recurrence + CASE WHEN doc_id % 10 = 3 THEN 0 ELSE doc_id % 3 END"))
def three_way_merge(t):
    """Two sides that edited the same notes: one bumps recurrence, both add tags, some retire a note differently."""
    key = F.col("doc_id")
    n = t.notes
    state = F.when(key % 4 == 0, "superseded").otherwise(F.col("status"))

    def side(rows, more, tag, by, body):
        return rows.select("stem", (F.col("recurrence") + more).alias("recurrence"), state.alias("status"), F.array("lang", F.lit(tag)).alias("tags"), F.when(key % 4 == 0, by).alias("superseded_by"), "title", body.alias("body"))

    ours = side(n.where("doc_id % 10 <> 7"), F.lit(0), "a", F.lit("r-ours"), F.col("slug"))
    theirs = side(n.where("doc_id % 10 <> 3"), key % 3, "b", F.when(key % 8 == 0, "r-theirs").otherwise("r-ours"), F.when(key % 15 == 0, "other").otherwise(F.col("slug")))
    return history.three_way_merge(n.where("doc_id % 2 = 0").select("stem"), ours, theirs)


@query(f"SELECT stem, CASE WHEN date < DATE '{AS_OF}' - 90 THEN 'archived' ELSE status END AS status FROM n")
def age_archive(t):
    return history.age_archive(t.notes, AS_OF, 90).select("stem", "status")


@query("SELECT stem, status FROM n WHERE status IN ('live', 'superseded')")
def live_union_superseded(t):
    return t.live.unionByName(t.superseded).select("stem", "status")


@query("SELECT text, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def dedup_first(t):
    return graph.ranked(t.read("documents").select("doc_id", "text"), ["text"], ["doc_id"], 1).select("text", "doc_id")


@query("SELECT stem, date FROM live WHERE date >= DATE '2024-12-01' ORDER BY date DESC, stem LIMIT 12")
def recent_n(t):
    return t.live.where("date >= DATE '2024-12-01'").select("stem", "date").orderBy(F.desc("date"), "stem").limit(12)


PACK = ", rw AS (SELECT project AS qid, CASE ntype WHEN 'mistake' THEN 0 WHEN 'pattern' THEN 1 ELSE 2 END AS section, row_number() OVER (PARTITION BY project, ntype ORDER BY date DESC, stem) AS rank, length(title) + 1 AS cost FROM n QUALIFY rank <= 6)"


def packing(t: Tables):
    section = F.when(F.col("ntype") == "mistake", 0).when(F.col("ntype") == "pattern", 1).otherwise(2)
    lines = t.plain_notes.select(F.col("project").alias("qid"), section.alias("section"), (F.length("title") + 1).alias("cost"), "date", "stem")
    return rollups.ranked(lines, ["qid", "section"], [F.desc("date"), "stem"], 6).select("qid", "section", "rank", "cost")


@query(None)
def budget_pack(t):
    return rollups.budget_pack(packing(t), 900)


@query(None)
def receipt(t):
    return rollups.receipt(rollups.budget_pack(packing(t), 900), 930)


@query(None)
def inventory_budget(t):
    files = t.plain_notes.select("project", F.col("stem").alias("path"), F.col("n_chars").alias("bytes"), (F.col("ntype") == "mistake").alias("is_code"))
    return rollups.inventory_budget(files, 20, 30_000)


@query("""SELECT project, stem, CASE WHEN k <= 3 OR (k <= 12 AND used <= 12000) THEN 'keep' ELSE 'fold' END AS state FROM (SELECT project, stem, row_number() OVER w AS k, sum(octet_length(encode(text)) + 2) OVER (PARTITION BY project ORDER BY date DESC, stem DESC ROWS UNBOUNDED PRECEDING) AS used FROM n WINDOW w AS (PARTITION BY project ORDER BY date DESC, stem DESC))""")
def context_compact(t):
    return rollups.compact(t.plain_notes)


def compaction_sql(cap: int, live: bool) -> str:
    room, limit = cap - (200 if live else 1800), cap * (4 if live else 1)
    kept = "fit" if live else "CASE WHEN greatest(least(3, al - 1), least(fit, least(12, al - 1))) > fit THEN greatest(1, fit) ELSE greatest(least(3, al - 1), least(fit, least(12, al - 1))) END"
    return f""", jr AS (SELECT project, date, stem, CASE WHEN doc_id % 3 = 0 THEN substr(text, 1, 300) ELSE title END || ' [[' || slug || ']] see [[t' || (doc_id % 7) || '|x]]' AS text FROM n),
en AS (SELECT *, octet_length(encode(text)) + 2 AS bytes, row_number() OVER w AS k, sum(octet_length(encode(text)) + 2) OVER (PARTITION BY project ORDER BY date DESC, stem DESC ROWS UNBOUNDED PRECEDING) AS used FROM jr WINDOW w AS (PARTITION BY project ORDER BY date DESC, stem DESC)),
pp AS (SELECT project, count(*) AS al, sum(bytes) AS total, count(*) FILTER (k = 1 OR used <= {room}) AS fit FROM en GROUP BY 1),
cs AS (SELECT project, date, stem, text, CASE WHEN al < 2 OR total <= {limit} OR k <= {kept} THEN 'keep' ELSE '{"spill" if live else "fold"}' END AS state FROM en JOIN pp USING (project))"""


def journal(t: Tables):
    k = F.col("doc_id")
    body = F.concat(F.when(k % 3 == 0, F.substring("text", 1, 300)).otherwise(F.col("title")), F.lit(" [["), "slug", F.lit("]] see [[t"), (k % 7).cast("string"), F.lit("|x]]"))
    return t.plain_notes.select("project", "date", "stem", body.alias("text"))


@query(compaction_sql(4000, False) + " SELECT project, stem, state FROM cs")
def context_fold(t):
    return rollups.compaction(journal(t), 4000).select("project", "stem", "state")


@query(compaction_sql(1500, True) + " SELECT project, stem, state FROM cs")
def context_spill(t):
    """Where no model is asked, journals over four times the cap give up their oldest entries as they are."""
    return rollups.compaction(journal(t), 1500, live=True).select("project", "stem", "state")


@query(compaction_sql(4000, False) + """, lk AS (SELECT project, date, stem, unnest(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1)) AS target, generate_subscripts(regexp_extract_all(text, '\\[\\[([^\\]|#]+)', 1), 1) AS pos FROM cs WHERE state = 'fold'),
fi AS (SELECT project, trim(target) AS target, min({'d': date, 's': stem, 'p': pos}) AS spot FROM lk GROUP BY ALL), la AS (SELECT * FROM fi QUALIFY row_number() OVER (PARTITION BY project ORDER BY spot DESC) <= 6)
SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY spot) AS INT) AS place, target FROM la""")
def context_links(t):
    entries = journal(t)
    return rollups.folded_links(entries, rollups.compaction(entries, 4000), 6)


@query("SELECT stem, recurrence, row_number() OVER (PARTITION BY project ORDER BY recurrence DESC, stem) AS rank FROM n WHERE ntype = 'mistake' AND recurrence >= 2 AND length(title) >= 6 AND length(descr) >= 15 AND lower(title) <> lower(prevention) QUALIFY rank <= 3")
def distill_candidates(t):
    ok = (F.col("recurrence") >= 2) & (F.length("title") >= 6) & (F.length("descr") >= 15) & (F.lower("title") != F.lower("prevention"))
    return rollups.ranked(t.plain_notes.where("ntype = 'mistake'").where(ok), ["project"], [F.desc("recurrence"), "stem"], 3).select("stem", "recurrence", "rank")
