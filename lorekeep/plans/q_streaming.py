"""Streaming queries: each reads a table as a file stream, runs to its end, and returns what the sink holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.fixtures import Tables, pick
from lorekeep.operators import active, graph
from lorekeep.plans.q_active import lessons
from lorekeep.plans.registry import query
from lorekeep.shared import new_path, stored
from lorekeep.sources.versions import Versions
from lorekeep.streaming import jobs


def stream(t: Tables, name: str) -> DataFrame:
    """A table (one file or a folder of files) as a file stream, its times with a zone."""
    schema = t.read(name).schema
    rows = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/{name}.parque[t]")  # a pattern may match a file
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.typeName() == "timestamp_ntz"})


def turns(t: Tables) -> DataFrame:
    ts = 1704067200 + F.col("conv_id") * 3600 + F.col("turn") * 40 + F.when(F.col("turn") >= 5, 300).otherwise(0)
    return stream(t, "conversations").select(F.col("conv_id").alias("session"), "turn", "role", "text", F.timestamp_seconds(ts).alias("at"))


def ledger(t: Tables) -> DataFrame:
    kind = F.when(F.col("event_type") == "view", "recall").otherwise("other")
    return stream(t, "events").select("event_id", "ts", kind.alias("kind"), F.floor("value").alias("saved"), F.floor(F.col("value") / 10).alias("injected"))


@query("SELECT session, count(*) AS turns, CAST(sum(length(text)) AS BIGINT) AS chars FROM sr GROUP BY 1 HAVING max(ts) <= (SELECT max(ts) FROM sr) - 120")
def st_ingest(t):
    """Settled sessions: every batch writes what it adds to a session, a batch that is run again overwrites its own output."""
    parts = jobs.run_once(turns(t), "ingest", batch=lambda df, _: df.groupBy("session").agg(F.count("*").alias("turns"), F.sum(F.length("text")).alias("chars"), F.max("at").alias("last")))
    return jobs.settled(parts)


SESSIONS = ", gp AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY session ORDER BY ts) < 120 THEN 0 ELSE 1 END AS fresh FROM sr), rn AS (SELECT *, sum(fresh) OVER (PARTITION BY session ORDER BY ts) AS run FROM gp)"


@query(SESSIONS + " SELECT session, CAST(to_timestamp(min(ts)) AT TIME ZONE 'UTC' AS TIMESTAMP) AS begin, CAST(to_timestamp(max(ts) + 120) AT TIME ZONE 'UTC' AS TIMESTAMP) AS finish, count(*) AS turns FROM rn GROUP BY session, run")
def st_sessionize(t):
    return jobs.run_once(jobs.sessionize(turns(t)), "sessions", "complete")


@query("SELECT DISTINCT user_id FROM events")
def st_dedup(t):
    rows = stream(t, "events").select("user_id", "ts")
    return jobs.run_once(jobs.dedup(rows, "user_id", "ts", "60 days").select("user_id"), "dedup")


@query("SELECT CAST(ts AS DATE) AS day, CAST(sum(floor(value)) AS BIGINT) AS saved, CAST(sum(floor(value / 10)) AS BIGINT) AS injected, count(*) AS events FROM events GROUP BY 1")
def st_daily_ledger(t):
    return jobs.latest(jobs.run_once(jobs.daily(ledger(t)), "daily", "update"), "day")


@query("SELECT first_day, CAST(sum(floor(value)) AS BIGINT) AS saved, count(*) AS events FROM (SELECT value, CAST(CAST(ts AS DATE) - unnest(range(14)) AS DATE) AS first_day FROM events) GROUP BY 1".replace("CAST(CAST(ts AS DATE) - unnest(range(14)) AS DATE)", "CAST(ts AS DATE) - CAST(unnest(range(14)) AS INT)"))
def st_activity_sliding(t):
    return jobs.latest(jobs.run_once(jobs.trailing(ledger(t)), "trailing", "update"), "first_day")


@query("SELECT doc_id AS action_id, guard_id, status, CAST(CASE status WHEN 'blocking' THEN 0 ELSE 1 END AS INT) AS place FROM documents JOIN g ON status <> 'retired' AND (project IS NULL OR project = source) AND regexp_matches(substr(text, 1, 20000), pattern)")
def st_guard_check(t):
    moving = stream(t, "documents").select(F.col("doc_id").alias("action_id"), F.col("source").alias("project"), "text")
    return jobs.run_once(active.guard_scan(moving, t.guards), "guards")


@query("SELECT user_id AS stem, count(*) FILTER (event_type = 'purchase') AS helped, count(*) FILTER (event_type = 'error') AS false_alarms FROM events GROUP BY 1")
def st_anticipate_state(t):
    outcome = F.when(F.col("event_type") == "purchase", "helped").when(F.col("event_type") == "error", "false_alarm")
    return jobs.latest(jobs.run_once(jobs.alarm_counts(stream(t, "events").select(F.col("user_id").alias("stem"), outcome.alias("outcome"))), "alarms", "update"), "stem")


@query(None)
def st_guard_lifecycle(t):
    """The last state of every guard; the batch form gives the same."""
    kind = F.col("event_type")
    outcome = F.when(kind == "purchase", "helped").when(kind == "signup", "corroborated").otherwise("false_positive")
    fb = stream(t, "events").where(kind.isin("purchase", "signup", "error")).select("event_id", F.concat(F.lit("g-"), (F.col("user_id") % 20).cast("string")).alias("guard_id"), F.col("user_id").cast("string").alias("session"), outcome.alias("outcome"))
    states = jobs.run_once(jobs.guard_lifecycle(fb, t.guards), "lifecycle", "update")
    return jobs.latest(states, "guard_id").drop("last_event")


@query(None)
def st_prompt_recall(t):
    """Turns of users as prompts; their hits are the project's notes that share the turn's rank by recurrence."""
    notes = t.live.select(F.regexp_replace("project", "src", "").cast("long").alias("k"), "stem", "recurrence")
    best = graph.ranked(notes, ["k"], [F.desc("recurrence"), "stem"], 8, "rank").select("k", "rank", "stem")
    prompts = turns(t).where("role = 'user'").select("session", F.col("turn").alias("prompt"), "at", (F.col("session") % 20).alias("k"))
    hits = prompts.join(best, "k").select("session", "prompt", "rank", "stem", "at")
    return jobs.run_once(jobs.prompt_recall(hits), "recall").select("session", "prompt", "stem")


@query(None)
def st_lesson_upsert(t):
    """The write path as a batch sink: every batch of lessons is folded into the notes of its projects, and a version of the table keeps all others."""
    none = "project string, ntype string, slug string, stem string, date date, recurrence long, session string, status string, superseded_by string, resolved_by string"
    store = Versions(t.spark, new_path(t.spark, "note-versions"), none, "project")
    key = F.col("doc_id")
    moving = stream(t, "documents").select(
        "doc_id", F.col("source").alias("project"), pick(["mistake", "pattern", "decision"], key % 3).alias("ntype"), F.date_add(F.lit("2024-01-01").cast("date"), (key * 37 % 366).cast("int")).alias("date"), F.lit(None).cast("double").alias("confidence"), "text"
    )

    def fold(df: DataFrame, number: int) -> DataFrame:
        # lessons tie notes of one project only, so the others stay as they are
        new = stored(lessons(df), "batch")
        touched = new.select("project").distinct()
        after = stored(active.upsert(store.read(number, touched), new), "after")
        return t.spark.createDataFrame([(store.write(number, after, touched),)], "version long")

    last = jobs.run_once(moving, "upsert", batch=fold).agg(F.max("version")).first()[0] or 0
    return store.read(last)
