"""Structured Streaming forms of the note store's jobs.

Watermarks are ours (files carry no event-time policy): late rows beyond the
stated delay are dropped. State lives in the state store of each query's
checkpoint; sinks are idempotent per batch, so a restart repeats no effect.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lorekeep.operators.active import PROMOTE, RETIRE
from lorekeep.shared import new_path

SETTLE, STATE_DAYS = "120 seconds", 3
PER_PROMPT, PROMPTS = 3, 6


def read_files(spark: SparkSession, path: str, schema: str, per_batch: int = 8) -> DataFrame:
    """A stream over the Parquet files of a folder, a few per batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def run_once(stream: DataFrame, name: str, mode: str = "append", batch: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Process all that is there, write every batch to its own folder, and return what the folders hold.

    A batch that is repeated after a failure overwrites its own folder. With
    complete mode only the last batch counts; with update mode rows have the
    number of their batch as `_batch`, and `latest` keeps the last of each key.
    """
    spark = stream.sparkSession
    out = new_path(spark, name)

    def write(df: DataFrame, number: int) -> None:
        df = batch(df, number) if batch else df
        df = df.withColumn("_batch", F.lit(number).cast("long")) if mode == "update" else df
        df.write.mode("overwrite").parquet(f"{out}/{'all' if mode == 'complete' else f'batch={number}'}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, name + "-state")).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()
    return spark.read.option("recursiveFileLookup", "true").parquet(out)


def latest(updates: DataFrame, *keys: str) -> DataFrame:
    """The last row of each key of an update-mode sink."""
    rest = [c for c in updates.columns if c not in (*keys, "_batch")]
    last = updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_batch").alias("last"))
    return last.select(*keys, "last.*")


def settled(parts: DataFrame, settle: int = 120) -> DataFrame:
    """(session, turns, chars) from the counts of every batch (with `last`): a session that goes on in a later batch is one, and sessions that were heard of less than `settle` seconds before the newest turn wait."""
    whole = parts.groupBy("session").agg(F.sum("turns").alias("turns"), F.sum("chars").alias("chars"), F.max("last").alias("last"))
    newest = parts.agg(F.max("last")).first()[0]
    return whole.where(F.unix_timestamp("last") <= F.unix_timestamp(F.lit(newest)) - settle).drop("last")


def sessionize(turns: DataFrame, gap: str = SETTLE, late: str = "10 minutes") -> DataFrame:
    """(session, begin, finish, turns): runs of turns (session, at) without a silence longer than the gap."""
    return turns.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "session").agg(F.count("*").alias("turns")).select("session", F.col("w.start").alias("begin"), F.col("w.end").alias("finish"), "turns")


def dedup(rows: DataFrame, key: str, at: str, late: str = "1 hour") -> DataFrame:
    """The first row of every key within the watermark."""
    return rows.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def daily(ledger: DataFrame, late: str = "2 days") -> DataFrame:
    """Counters per day of an activity stream (ts, kind, saved, injected)."""
    w = F.window("ts", "1 day")
    return ledger.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.sum("saved").alias("saved"), F.sum("injected").alias("injected"), F.count("*").alias("events")).select(F.to_date("w.start").alias("day"), "saved", "injected", "events")


def trailing(ledger: DataFrame, days: int = 14, late: str = "2 days") -> DataFrame:
    """Counters per trailing window of some days, one window a day."""
    w = F.window("ts", f"{days} days", "1 day")
    return ledger.withWatermark("ts", late).groupBy(w.alias("w")).agg(F.sum("saved").alias("saved"), F.count("*").alias("events")).select(F.to_date("w.start").alias("first_day"), "saved", "events")


def alarm_counts(events: DataFrame) -> DataFrame:
    """(stem, helped, false_alarms) of a stream (stem, outcome)."""
    return events.groupBy("stem").agg(F.count_if(F.col("outcome") == "helped").alias("helped"), F.count_if(F.col("outcome") == "false_alarm").alias("false_alarms"))


def prompt_recall(hits: DataFrame, per_prompt: int = PER_PROMPT, prompts: int = PROMPTS) -> DataFrame:
    """(session, prompt, stem) shown: for each prompt its best notes not shown in the session yet, a few per prompt, some prompts per session (1: once a session).

    Hits: session, prompt (ordered), rank, stem, at; reset rows have a null stem.
    State goes some days (of event time) after a session's last prompt.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        shown, count = state.get if state.exists else ([], 0)
        shown, out = list(shown), []
        hits = pd.concat(list(batches)).sort_values(["prompt", "rank"])
        last = int(hits["at"].max().timestamp() * 1000)
        for prompt, rows in hits.groupby("prompt", sort=True):
            if rows["stem"].isna().any():
                shown, count = [], 0
            if count >= prompts:
                continue
            new = [s for s in rows["stem"].dropna() if s not in shown][:per_prompt]
            if new:
                count += 1
                shown += new
                out += [(key[0], prompt, s) for s in new]
        state.update((shown, count))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + STATE_DAYS * 86_400_000)
        yield pd.DataFrame(out, columns=["session", "prompt", "stem"])

    kind = hits.schema["session"].dataType.simpleString()
    return hits.withWatermark("at", "10 minutes").groupBy("session").applyInPandasWithState(step, f"session {kind}, prompt long, stem string", "shown array<string>, count int", "append", GroupStateTimeout.EventTimeTimeout)


def guard_lifecycle(feedback: DataFrame, guards: DataFrame) -> DataFrame:
    """(guard_id, status, helped, corroborations, false_positives) after each batch of feedback (guard_id, event_id, outcome, session).

    Starting status and pack flag come from the static guards table.
    """
    joined = feedback.join(guards.select("guard_id", F.col("status").alias("start"), "pack"), "guard_id")

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("event_id")
        status, helped, corroborations, wrong, seen = state.get if state.exists else (rows["start"].iloc[0], 0, 0, 0, [])
        seen = list(seen)
        for outcome, session, pack in zip(rows["outcome"], rows["session"], rows["pack"], strict=True):
            if outcome in ("helped", "corroborated"):
                helped += outcome == "helped"
                if session is None or session not in seen:
                    corroborations += 1
                    seen += [] if session is None else [session]
                if status == "advisory" and corroborations >= PROMOTE and not pack:
                    status = "blocking"
            elif outcome == "false_positive":
                wrong += 1
                if wrong >= RETIRE:
                    status, wrong = {"blocking": "advisory"}.get(status, "retired"), 0
        state.update((status, int(helped), int(corroborations), int(wrong), seen))
        yield pd.DataFrame({"guard_id": [key[0]], "status": [status], "helped": [int(helped)], "corroborations": [int(corroborations)], "false_positives": [int(wrong)], "last_event": [int(rows["event_id"].max())]})

    return joined.groupBy("guard_id").applyInPandasWithState(step, "guard_id string, status string, helped int, corroborations int, false_positives int, last_event long", "status string, helped int, corroborations int, false_positives int, seen array<string>", "update", GroupStateTimeout.NoTimeout)
