"""Agent session logs to events, texts and sweeps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

LINE_CHARS = 2000
BLOCK = "struct<type:string,text:string,name:string,input:string>"
EVENT = "type string, cwd string, timestamp string, metadata struct<cwd:string,timestamp:string>, snapshot struct<cwd:string,timestamp:string>, message struct<role:string,content:string>"
SETTLE_SECONDS, RUN_CAP, MINED_BYTES = 120, 40, 10 * 1024 * 1024


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, seq, line) of JSONL files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"), F.monotonically_increasing_id().alias("seq"))
    return lines


def events(lines: DataFrame, key: str = "session") -> DataFrame:
    """One row per well-formed event line (columns: key, seq, line): type, cwd, ts, content. Blank and broken lines go."""
    parsed = lines.where(F.trim("line") != "").withColumn("e", F.from_json("line", EVENT, {"mode": "PERMISSIVE"})).where("e.type IS NOT NULL")
    cwd, ts = (F.coalesce(f"e.{n}", f"e.metadata.{n}", f"e.snapshot.{n}") for n in ("cwd", "timestamp"))
    return parsed.select(key, "seq", F.col("e.type").alias("type"), cwd.alias("cwd"), ts.alias("ts"), F.col("e.message.content").alias("content"))


def session_meta(events: DataFrame, key: str = "session") -> DataFrame:
    """First cwd and first timestamp of every session."""
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c)
    return events.groupBy(key).agg(first("cwd"), first("ts"))


def event_lines(kind: Column, content: Column) -> Column:
    """The lines of one event: its text, or one line per text and tool block, each cut to a limit."""
    label = F.when(kind == "user", "USER: ").otherwise("ASSISTANT: ")
    blocks = F.from_json(content, f"array<{BLOCK}>")
    tool = lambda b: F.concat(F.lit("TOOL["), F.coalesce(b["name"], F.lit("")), F.lit("]: "), F.coalesce(b["input"], F.lit("{}")))
    line = lambda b: F.when(b["type"] == "tool_use", tool(b)).when((b["type"] == "text") & (F.trim(b["text"]) != ""), F.concat(label, b["text"]))
    listed = F.array_compact(F.transform(blocks, line))
    plain = F.when(F.trim(content) != "", F.array(F.concat(label, content))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.when(content.startswith("[") & blocks.isNotNull(), listed).otherwise(plain), lambda s: F.substring(s, 1, LINE_CHARS))


def assemble(events: DataFrame, key: str = "session") -> DataFrame:
    """One text per session, its events' lines in order."""
    lines = events.where(F.col("type").isin("user", "assistant")).withColumn("lines", event_lines(F.col("type"), F.col("content")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "lines")))
    return lines.groupBy(key).agg(F.array_join(F.flatten(F.transform(ordered, lambda e: e["lines"])), "\n").alias("body"))


def flatten_agent_log(lines: DataFrame, key: str = "path") -> DataFrame:
    """One text per file of {"payload": {...}} lines; the raw text unless at least max(2, half) of the lines parse and something is kept."""
    payload = "struct<type:string,role:string,content:string,name:string,arguments:string,output:string>"
    p = F.from_json("line", f"payload {payload}")["payload"]
    kept = (
        F.when(p["role"].isNotNull() & (F.trim(F.coalesce(p["content"], F.lit(""))) != ""), F.concat(p["role"], F.lit(": "), p["content"]))
        .when(p["type"] == "function_call", F.concat(F.lit("tool["), p["name"], F.lit("]: "), F.substring(p["arguments"], 1, LINE_CHARS)))
        .when(p["type"] == "function_call_output", F.concat(F.lit("tool_output: "), F.substring(p["output"], 1, LINE_CHARS)))
    )
    rows = lines.where(F.trim("line") != "").select(key, "seq", "line", p.isNotNull().cast("int").alias("ok"), kept.alias("kept"))
    text = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("seq", c)))), lambda x: x[c]), "\n")
    whole = rows.groupBy(key).agg(F.sum("ok").alias("ok"), F.count("*").alias("n"), text("kept").alias("flat"), text("line").alias("raw"))
    use = (F.col("ok") >= F.greatest(F.lit(2.0), F.col("n") / 2)) & (F.col("flat") != "")
    return whole.select(key, F.when(use, F.col("flat")).otherwise(F.col("raw")).alias("body"), use.alias("flattened"))


def sweep(files: DataFrame, processed: DataFrame, now: int, settle: int = SETTLE_SECONDS, cap: int = RUN_CAP) -> DataFrame:
    """Settled files (path, mtime seconds, bytes) that are new or have grown, oldest first, `cap` at most."""
    todo = files.join(processed.select("path", F.col("bytes").alias("seen")), "path", "left")
    todo = todo.where((F.col("mtime") <= now - settle) & (F.col("seen").isNull() | (F.col("bytes") > F.col("seen"))))
    return todo.select("path", "mtime", "bytes").orderBy("mtime", "path").limit(cap)


def delta(files: DataFrame, watermarks: DataFrame, cap: int | None = MINED_BYTES, now: int | None = None, settle: int = SETTLE_SECONDS) -> DataFrame:
    """What to mine of each file (path, text and, with `now`, mtime), and its watermark afterwards: path, mode, mined, chars, hash8, bytes.

    skip: as many bytes as the watermark saw. same: the text is the old one. delta: the old text stands, its tail is
    mined. full: no watermark, or the old text changed. wait: a file still being written has no complete new line.
    over: more than `cap` bytes to mine (null: no cap); the watermark stays, so that nothing is lost when the cap is
    raised. A file changed within `settle` seconds gives complete lines only, and -1 bytes where a rest is left, so that
    the next look does not skip it.
    """
    w = watermarks.select("path", F.col("chars").alias("w_chars"), F.col("hash8").alias("w_hash"), F.col("bytes").alias("w_bytes"))
    f = files.join(w, "path", "left").withColumn("size", F.octet_length("text"))
    digest = lambda c: F.substring(F.sha1(c.cast("binary")), 1, 8)
    stands = digest(F.col("text").substr(F.lit(1), F.col("w_chars"))) == F.col("w_hash")
    kind = F.when(F.col("w_bytes") == F.col("size"), "skip").when(stands & (F.length("text") == F.col("w_chars")), "same").when(stands & (F.length("text") > F.col("w_chars")), "delta").otherwise("full")
    f = f.withColumn("kind", kind)
    tail = F.when(F.col("kind") == "delta", F.col("text").substr(F.col("w_chars") + 1, F.length("text"))).when(F.col("kind") == "full", F.col("text")).otherwise("")
    if now is not None:
        tail = F.when(F.col("mtime") > now - settle, F.regexp_extract(tail, r"(?s)\A.*\n", 0)).otherwise(tail)
    f = f.withColumn("tail", tail)
    mines = F.col("kind").isin("delta", "full")
    over = F.octet_length("tail") > cap if cap is not None else F.lit(False)
    mode = F.when(mines & (F.col("tail") == "") & (F.col("text") != ""), "wait").when(mines & over, "over").otherwise(F.col("kind"))
    f = f.withColumn("mode", mode)
    took = F.col("mode").isin("delta", "full", "same")
    chars = F.when(F.col("kind") == "delta", F.col("w_chars")).when(F.col("kind") == "same", F.col("w_chars")).otherwise(0) + F.length("tail")
    # a changed file whose watermark no longer holds, and that is not mined now, has none
    kept = lambda c: F.when((F.col("kind") != "full"), F.col(c))
    f = f.withColumn("new_chars", F.when(took, chars).otherwise(kept("w_chars")))
    whole = F.col("new_chars") == F.length("text")
    return f.select(
        "path", "mode", F.when(F.col("mode").isin("delta", "full"), F.col("tail")).otherwise("").alias("mined"), F.col("new_chars").alias("chars"),
        F.when(took, digest(F.col("text").substr(F.lit(1), F.col("new_chars")))).otherwise(kept("w_hash")).alias("hash8"),
        F.when(took, F.when(whole, F.col("size")).otherwise(-1)).otherwise(kept("w_bytes")).alias("bytes"),
    )


def prune(processed: DataFrame, as_of: str, days: int = 90) -> DataFrame:
    """Ledger rows (session, processed_at as text) younger than `days`, and those whose time does not parse."""
    at = F.try_to_timestamp("processed_at")
    return processed.where(at.isNull() | (at >= F.date_sub(F.lit(as_of).cast("date"), days).cast("timestamp")))


def backlog(files: DataFrame, processed: DataFrame, now: int, settle: int = SETTLE_SECONDS, tracked: DataFrame | None = None) -> DataFrame:
    """Settled files that nobody processed, and the newest processed time, in one row; with `tracked` (path, tracked) only those of tracked projects."""
    left = files.where(F.col("mtime") <= now - settle).join(processed, "path", "left_anti")
    if tracked is not None:
        left = left.join(tracked.where("tracked").select("path").distinct(), "path", "left_semi")
    return left.agg(F.count("*").alias("waiting")).crossJoin(processed.agg(F.max("processed_at").alias("newest")))


def context_entries(journals: DataFrame, key: str = "project") -> DataFrame:
    """Head (entry 0) and dated entries of a journal (key, text), cut before each "## YYYY-MM-DD" line."""
    parts = F.split("text", r"(?m)(?=^## \d{4}-\d{2}-\d{2})")
    # settled inside the generator's input, once a journal: beside it, every entry would ask the whole text again
    numbered = F.when(F.col("text").rlike(r"^## \d{4}-\d{2}-\d{2}"), F.concat(F.array(F.lit(None).cast("string")), parts)).otherwise(parts)
    cut = journals.select(key, F.posexplode(numbered).alias("entry_no", "entry")).where("entry IS NOT NULL")
    return cut.select(key, "entry_no", F.regexp_extract("entry", r"^## (\d{4}-\d{2}-\d{2})", 1).alias("day"), "entry")


def first_in_order(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of every key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
