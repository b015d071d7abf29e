"""Queries over sources and sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.fixtures import Tables
from lorekeep.operators import graph, lenses
from lorekeep.plans.registry import query
from lorekeep.shared import new_path
from lorekeep.sources import files as tree
from lorekeep.sources import notes as source
from lorekeep.sources import transcripts


def raw_lines(t: Tables) -> DataFrame:
    """Conversations as JSONL event lines, with a broken line in every tenth session."""
    message = F.struct(F.col("role"), F.col("text").alias("content"))
    event = F.to_json(F.struct(F.col("role").alias("type"), F.when(F.col("turn") == 1, F.concat(F.lit("/work/"), "project")).alias("cwd"), F.struct(F.col("ts").cast("string").alias("timestamp")).alias("metadata"), message.alias("message")))
    return t.sessions.select("session", F.col("turn").alias("seq"), F.when((F.col("session") % 10 == 3) & (F.col("turn") == 0), F.lit('{"type": "user", ')).otherwise(event).alias("line"))


RAW = ", ev AS (SELECT session, turn AS seq, role AS type, CASE WHEN turn = 1 THEN '/work/' || project END AS cwd, CAST(ts AS VARCHAR) AS ts, text AS content FROM sr WHERE NOT (session % 10 = 3 AND turn = 0))"


@query(RAW + " SELECT * FROM ev")
def src_transcripts(t):
    return transcripts.events(raw_lines(t))


@query(RAW + " SELECT session, min_by(cwd, seq) FILTER (cwd IS NOT NULL) AS cwd, min_by(ts, seq) AS ts FROM ev GROUP BY session")
def session_meta(t):
    return transcripts.session_meta(transcripts.events(raw_lines(t)))


ASSEMBLED = ", ln AS (SELECT session, seq, substr(CASE WHEN type = 'user' THEN 'USER: ' ELSE 'ASSISTANT: ' END || content, 1, 2000) AS line FROM ev WHERE type IN ('user', 'assistant') AND trim(content) <> ''), asm AS (SELECT session, string_agg(line, chr(10) ORDER BY seq) AS body FROM ln GROUP BY session)"


@query(RAW + ASSEMBLED + " SELECT * FROM asm")
def transcript_assemble(t):
    return transcripts.assemble(transcripts.events(raw_lines(t)))


FLAT = """SELECT session AS path, CASE WHEN session % 7 = 0 THEN string_agg('plain ' || turn, chr(10) ORDER BY turn) WHEN count(*) = 1 THEN any_value('{"payload":{"role":' || to_json(role) || ',"content":' || to_json(text) || '}}') ELSE string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (trim(text) <> '') END AS body, session % 7 <> 0 AND count(*) > 1 AS flattened
FROM sr GROUP BY session"""


@query(" " + FLAT)
def agent_log_flatten(t):
    line = F.when(F.col("session") % 7 == 0, F.concat(F.lit("plain "), "turn")).otherwise(F.to_json(F.struct(F.struct("role", F.col("text").alias("content")).alias("payload"))))
    return transcripts.flatten_agent_log(t.sessions.select(F.col("session").alias("path"), F.col("turn").alias("seq"), line.alias("line")))


def session_files(t: Tables) -> DataFrame:
    return t.sessions.groupBy(F.col("session").alias("path")).agg(F.max("ts").alias("mtime"), F.sum(F.octet_length("text")).alias("bytes"))


def processed(t: Tables) -> DataFrame:
    done = session_files(t).where("path % 3 = 0")
    return done.select("path", F.when(F.col("path") % 6 == 0, F.col("bytes")).otherwise(F.col("bytes") - 1).alias("bytes"), F.col("mtime").alias("processed_at"))


FILES = ", sf AS (SELECT session AS path, max(ts) AS mtime, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes FROM sr GROUP BY session), pr AS (SELECT path, CASE WHEN path % 6 = 0 THEN bytes ELSE bytes - 1 END AS bytes, mtime AS processed_at FROM sf WHERE path % 3 = 0)"
NOW = 1704067200 + 1_000_000_000


@query(FILES + f" SELECT sf.path, mtime, sf.bytes FROM sf LEFT JOIN pr USING (path) WHERE mtime <= {NOW} - 120 AND (pr.bytes IS NULL OR sf.bytes > pr.bytes) ORDER BY mtime, sf.path LIMIT 40")
def transcript_sweep(t):
    return transcripts.sweep(session_files(t), processed(t), NOW)


@query(RAW + ASSEMBLED + f""", f AS (SELECT session AS path, body AS text, length(body) // 2 AS c, CASE WHEN session % 5 = 0 THEN {NOW} ELSE 0 END AS mtime FROM asm),
k AS (SELECT *, CASE WHEN path % 4 = 0 THEN 'skip' WHEN path % 4 = 2 AND length(text) > c THEN 'delta' ELSE 'full' END AS kind FROM f),
m AS (SELECT *, CASE kind WHEN 'skip' THEN '' WHEN 'delta' THEN substr(text, c + 1) ELSE text END AS rest FROM k),
l AS (SELECT *, CASE WHEN mtime > {NOW} - 120 THEN regexp_extract(rest, '(?s)^.*\n') ELSE rest END AS tail FROM m),
o AS (SELECT *, CASE WHEN kind <> 'skip' AND tail = '' THEN 'wait' WHEN kind <> 'skip' AND octet_length(encode(tail)) > 4000 THEN 'over' ELSE kind END AS mode FROM l),
r AS (SELECT *, CASE WHEN mode IN ('delta', 'full') THEN CASE kind WHEN 'delta' THEN c ELSE 0 END + length(tail) WHEN kind <> 'full' THEN c END AS chars FROM o)
SELECT path, mode, CASE WHEN mode IN ('delta', 'full') THEN tail ELSE '' END AS mined, CAST(chars AS INT) AS chars, substr(sha1(substr(text, 1, chars)), 1, 8) AS hash8,
  CASE WHEN mode IN ('delta', 'full') THEN CASE WHEN chars = length(text) THEN octet_length(encode(text)) ELSE -1 END WHEN mode = 'skip' THEN octet_length(encode(text)) WHEN kind = 'delta' THEN 1 END AS bytes FROM r""")
def delta_ingest(t):
    """Unchanged, grown, changed and new files; every fifth is still being written, and some are over the cap."""
    files = transcripts.assemble(transcripts.events(raw_lines(t))).select(F.col("session").alias("path"), F.col("body").alias("text"), F.when(F.col("session") % 5 == 0, NOW).otherwise(0).alias("mtime"))
    half = F.floor(F.length("text") / 2)
    old = F.when(F.col("path") % 4 == 1, F.lit("changed")).otherwise(F.col("text").substr(F.lit(1), half.cast("int")))
    marks = files.where("path % 4 <> 3").select("path", half.cast("int").alias("chars"), F.substring(F.sha1(old.cast("binary")), 1, 8).alias("hash8"), F.when(F.col("path") % 4 == 0, F.octet_length("text")).otherwise(1).alias("bytes"))
    return transcripts.delta(files, marks, cap=4000, now=NOW)


@query(f"SELECT event_id, CASE WHEN event_id % 50 = 0 THEN 'not a time' ELSE strftime(ts, '%Y-%m-%d %H:%M:%S') END AS processed_at FROM led WHERE event_id % 50 = 0 OR date_trunc('second', ts) >= DATE '2024-04-15' - INTERVAL 90 DAY")
def processed_prune(t):
    at = F.when(F.col("event_id") % 50 == 0, "not a time").otherwise(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return transcripts.prune(t.ledger.select("event_id", at.alias("processed_at")), "2024-04-15")


@query(FILES + f" SELECT (SELECT count(*) FROM sf WHERE mtime <= {NOW} - 120 AND path NOT IN (SELECT path FROM pr) AND path % 10 <> 4) AS waiting, (SELECT max(processed_at) FROM pr) AS newest")
def backlog_report(t):
    """Of the projects below the tracked root, but for an excluded one."""
    cwd = t.sessions.select(F.col("session").alias("key"), F.concat(F.lit("/work/"), "project", F.lit("/src")).alias("path")).distinct()
    roots = t.spark.createDataFrame([("/work",)], "root string")
    own = lenses.tracked(cwd, roots, ["/p4/"], "key").select(F.col("key").alias("path"), "tracked")
    return transcripts.backlog(session_files(t), processed(t), NOW, tracked=own)


@query("""SELECT session, project, CAST(turn AS INT) AS pos, CASE WHEN turn % 2 = 0 THEN 'mistake' ELSE 'pattern' END AS ntype, trim(substr(text, 1, 40)) AS title, trim(text) AS descr, CASE WHEN turn % 3 = 0 THEN 1.0 WHEN turn % 3 = 1 THEN 0.5 END AS confidence
FROM (SELECT session, project, row_number() OVER (PARTITION BY session ORDER BY turn % 2, turn) - 1 AS turn_, turn, text FROM sr WHERE session % 5 <> 0) WHERE trim(substr(text, 1, 40)) <> ''""".replace("CAST(turn AS INT) AS pos", "CAST(turn_ AS INT) AS pos"))
def extraction_parse(t):
    conf = F.when(F.col("turn") % 3 == 0, "7").when(F.col("turn") % 3 == 1, "0.5").otherwise("high")
    item = F.struct(F.substring("text", 1, 40).alias("title"), F.col("text").alias("desc"), conf.alias("confidence"))
    kept = lambda odd: F.transform(F.array_sort(F.collect_list(F.when(F.col("turn") % 2 == odd, F.struct("turn", item.alias("x"))))), lambda e: e["x"])
    flag = F.when(F.col("session") % 5 == 0, " No ").when(F.col("session") % 5 == 1, "true")
    replies = t.sessions.groupBy("session", "project").agg(kept(0).alias("mistakes"), kept(1).alias("patterns"))
    return source.extraction_rows(replies.select("session", "project", F.to_json(F.struct(flag.alias("project_relevant"), "mistakes", "patterns")).alias("reply")))


JOURNAL = """, jr AS (SELECT project, CASE WHEN project = 'src0' THEN '' ELSE 'head of ' || project || chr(10) END || string_agg('## ' || strftime(date, '%Y-%m-%d') || chr(10) || title || chr(10), '' ORDER BY doc_id) AS text FROM n WHERE NOT contains(title, chr(10) || '## ') GROUP BY project)"""


def journals(t: Tables) -> DataFrame:
    """A journal per project: one dated entry per note, in id order."""
    entry = F.concat(F.lit("## "), F.date_format("date", "yyyy-MM-dd"), F.lit("\n"), "title", F.lit("\n"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("doc_id", entry.alias("e")))), lambda x: x["e"]), "")
    rows = t.plain_notes.groupBy("project").agg(text.alias("text"))
    return rows.select("project", F.when(F.col("project") == "src0", F.col("text")).otherwise(F.concat(F.lit("head of "), "project", F.lit("\n"), "text")).alias("text"))


@query("""SELECT project, CAST(row_number() OVER (PARTITION BY project ORDER BY doc_id) AS INT) AS entry_no, strftime(date, '%Y-%m-%d') AS day, '## ' || strftime(date, '%Y-%m-%d') || chr(10) || title || chr(10) AS entry FROM n
UNION ALL SELECT DISTINCT project, 0, '', 'head of ' || project || chr(10) FROM n WHERE project <> 'src0'""")
def context_entries(t):
    return transcripts.context_entries(journals(t))


@query("""SELECT stem AS path, 'Note ' || doc_id AS title, 'Body of ' || doc_id AS descr, 'Check ' || slug AS prevention, date, project, ntype, CASE WHEN doc_id % 8 = 0 THEN 'Resolved' ELSE 'live' END AS status,
CAST(CASE WHEN doc_id % 5 = 0 THEN 1 ELSE recurrence END AS INT) AS recurrence, [lang, slug] AS tags, doc_id % 8 = 0 OR doc_id % 9 = 0 AS resolved FROM n""")
def notes_from_markdown(t):
    text = F.concat(
        F.when(F.col("doc_id") % 2 == 0, "﻿").otherwise(""), F.lit('---\ndate: '), F.date_format("date", "yyyy-MM-dd"), F.lit('\nproject: "'), "project", F.lit('"\ntype: '), "ntype",
        F.lit("\ntags: "), F.to_json(F.array("lang", "slug")), F.lit("\nrecurrence: "), F.when(F.col("doc_id") % 5 == 0, "many").otherwise(F.col("recurrence").cast("string")),
        F.when(F.col("doc_id") % 8 == 0, "\nstatus: Resolved").otherwise(""), F.when(F.col("doc_id") % 9 == 0, "\nresolved_by: other").otherwise(""),
        F.lit("\n---\n\n# Note "), F.col("doc_id").cast("string"), F.lit("\n\nBody of "), F.col("doc_id").cast("string"), F.lit("\n\n**Prevention:** Check "), "slug", F.lit("\n"),
    )
    return source.from_markdown(t.plain_notes.select(F.col("stem").alias("path"), text.alias("text")))


@query("SELECT stem, status FROM n WHERE project = 'src1' UNION ALL SELECT stem, status FROM n WHERE project <> 'src1' AND status = 'superseded'")
def notes_iter(t):
    return t.notes.where("project = 'src1' OR status = 'superseded'").select("stem", "status")


BULLETS = "'intro' || chr(10) || '- ' || replace(title, chr(10), ' ') || chr(10) || '* short' || chr(10) || '  - lang ' || lang || ' size ' || n_chars"


def clip_sql(c: str, n: int) -> str:
    line = f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"
    return f"CASE WHEN length({line}) > {n} THEN rtrim(substr({line}, 1, {n - 1})) || '…' ELSE {line} END"


@query(f""", f AS (SELECT stem AS path, unnest(regexp_extract_all({BULLETS}, '(?m)^\\s*[-*]\\s+(.{{8,}})$', 1)) AS part, generate_subscripts(regexp_extract_all({BULLETS}, '(?m)^\\s*[-*]\\s+(.{{8,}})$', 1), 1) - 1 AS pos FROM n)
SELECT path, CAST(pos AS INT) AS pos, 'pattern' AS ntype, {clip_sql('part', 120)} AS title, {clip_sql('part', 1500)} AS body FROM f""")
def import_lessons(t):
    text = F.concat(F.lit("<!-- own:START -->\n- what the store wrote itself\n<!-- own:END -->\nintro\n- "), F.replace("title", F.lit("\n"), F.lit(" ")), F.lit("\n* short\n  - lang "), "lang", F.lit(" size "), F.col("n_chars").cast("string"))
    return source.lessons(t.plain_notes.select(F.col("stem").alias("path"), text.alias("text")), "bullets")


@query(f" SELECT 'facts/' || stem || '.md' AS path, CAST(0 AS INT) AS pos, CASE doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'mistake' ELSE 'pattern' END AS ntype, CASE WHEN doc_id % 3 = 0 THEN 'about ' || lang WHEN doc_id % 3 = 1 THEN project ELSE stem END AS title, {clip_sql('descr', 1500)} AS body FROM n WHERE trim(descr) <> ''")
def import_facts(t):
    """One fact per file, with a description, a name or nothing in its head; the index file is skipped."""
    k = F.col("doc_id")
    kind = F.when(k % 4 == 0, "project").when(k % 4 == 1, "Mistake").when(k % 4 == 2, "user").otherwise("")
    head = F.concat(F.lit("---\ntype: "), kind, F.when(k % 3 == 0, F.concat(F.lit('\ndescription: "about '), "lang", F.lit('"'))).when(k % 3 == 1, F.concat(F.lit("\nname: "), "project")).otherwise(""), F.lit("\n---\n"))
    files = t.plain_notes.where("trim(descr) <> ''").select(F.concat(F.lit("facts/"), "stem", F.lit(".md")).alias("path"), F.concat(head, "descr").alias("text"))
    index = files.select(F.lit("facts/MEMORY.md").alias("path"), "text")
    return source.lessons(files.union(index), "facts")


@query(f" SELECT 'rules/' || slug || '-' || doc_id || '.mdc' AS path, CAST(0 AS INT) AS pos, 'pattern' AS ntype, CASE WHEN doc_id % 2 = 0 THEN 'for ' || lang ELSE slug || ' ' || doc_id END AS title, {clip_sql('descr', 1500)} AS body FROM n UNION ALL SELECT 'rules/' || doc_id, unnest([0, 1]), 'pattern', unnest(['first rule of ' || project, 'second rule of ' || lang]), unnest(['first rule of ' || project, 'second rule of ' || lang]) FROM n")
def import_rules(t):
    """Rule files with a head, and plain ones by blocks."""
    k = F.col("doc_id")
    head = F.when(k % 2 == 0, F.concat(F.lit("---\ndescription: for "), "lang", F.lit("\n---\n"))).otherwise("---\nglobs: x\n---\n")
    new = t.plain_notes.select(F.concat(F.lit("rules/"), "slug", F.lit("-"), k.cast("string"), F.lit(".mdc")).alias("path"), F.concat(head, "descr").alias("text"))
    old = t.plain_notes.select(F.concat(F.lit("rules/"), k.cast("string")).alias("path"), F.concat(F.lit("first rule of "), "project", F.lit("\n\nshort\n \nsecond rule of "), "lang").alias("text"))
    return source.lessons(new.union(old), "rules")


@query(""", r AS (SELECT 'lang' AS source, ntype, title, descr AS body, doc_id AS ord, sha1('lang|' || ntype || '|' || title || '|' || substr(descr, 1, 400)) AS key FROM n),
o AS (SELECT * FROM r WHERE key NOT IN (SELECT key FROM r WHERE ord % 11 = 0) QUALIFY row_number() OVER (PARTITION BY key ORDER BY ord) = 1)
SELECT ord, ntype, CASE WHEN regexp_matches(title, '[A-Za-z0-9_]') THEN title ELSE title || ' ' || substr(key, 1, 8) END AS title, key FROM o""")
def import_dedup(t):
    rows = t.plain_notes.select(F.lit("lang").alias("source"), "ntype", "title", F.col("descr").alias("body"), F.col("doc_id").alias("ord"))
    seen = rows.where("ord % 11 = 0").select(source.import_key(*[F.col(c) for c in ("source", "ntype", "title", "body")]).alias("key")).distinct()
    return source.import_new(rows, seen).select("ord", "ntype", "title", "key")


def _html_sql() -> str:
    body = f"""array_to_string(list_filter(list_transform(string_split(regexp_replace(regexp_replace(coalesce(html, ''), '{source.HIDDEN}', '', 'g'), '{source.TAG}', chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')), lambda x: x <> ''), chr(10))"""
    char = "CASE WHEN lower(m) LIKE '&#x%' THEN chr(CAST('0x' || substr(m, 4, length(m) - 4) AS INT)) ELSE chr(CAST(substr(m, 3, length(m) - 3) AS INT)) END"
    pairs = f"list_zip(regexp_split_to_array(b, '{source.NUMERIC}'), list_append(list_transform(regexp_extract_all(b, '{source.NUMERIC}'), lambda m: {char}), ''))"
    shown, body = body, f"array_to_string(list_transform({pairs}, lambda p: p[1] || p[2]), '')"
    for name, sign in source.ENTITIES.items():
        body = "replace({}, '{}', '{}')".format(body, name, sign.replace("'", "''"))
    return f" SELECT page_id, {body} AS body FROM (SELECT page_id, {shown} AS b FROM pages)"


@query(_html_sql())
def html_text(t):
    return source.html_text(t.read("pages"))


FILE_TEXT = "'import os' || chr(10) || 'from a.b' || (doc_id % 5) || ' import c' || chr(10) || 'def f' || doc_id || '(x):' || chr(10) || repeat('    pass' || chr(10), CAST(doc_id % 7 AS INT))"


def files(t: Tables) -> DataFrame:
    key = F.col("doc_id")
    text = F.concat(F.lit("import os\nfrom a.b"), (key % 5).cast("string"), F.lit(" import c\ndef f"), key.cast("string"), F.lit("(x):\n"), F.repeat(F.lit("    pass\n"), (key % 7).cast("int")))
    return t.plain_notes.select(F.concat("project", F.lit("/m"), key.cast("string"), F.when(key % 3 == 0, ".py").otherwise(".md")).alias("path"), text.alias("text"))


@query(f", f AS (SELECT doc_id, project, {FILE_TEXT} AS text FROM n) SELECT project || '/m' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path, CASE WHEN doc_id % 3 = 0 THEN 'py' ELSE 'md' END AS ext, octet_length(encode(text)) AS bytes, CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT) AS lines, ['os', 'a.b' || (doc_id % 5)] AS imports, ['f' || doc_id] AS exports, CAST([] AS VARCHAR[]) AS headings FROM f")
def file_inventory(t):
    return source.inventory(files(t))


@query(f", f AS (SELECT project, doc_id % 3 = 0 AS code, octet_length(encode({FILE_TEXT})) AS bytes FROM n) SELECT project, count(*) AS files, round(sum(bytes) / 1024.0, 1) AS kb, CAST(coalesce(sum(bytes) FILTER (code), 0) AS BIGINT) AS code_bytes, (SELECT string_agg(e || ':' || k, ',' ORDER BY k DESC, e) FROM (SELECT CASE WHEN g.code THEN 'py' ELSE 'md' END AS e, count(*) AS k FROM f g WHERE g.project = f.project GROUP BY 1)) AS top FROM f GROUP BY project")
def file_totals(t):
    found = tree.listed(files(t)).select("path", F.octet_length("text").alias("bytes"), F.split_part("path", F.lit("/"), F.lit(1)).alias("project"))
    return tree.totals(found, ["project"])


@query("SELECT project || '/m' || doc_id || CASE WHEN doc_id % 3 = 0 THEN '.py' ELSE '.md' END AS path, unnest(['os', 'a.b' || (doc_id % 5)]) AS module FROM n")
def import_edges(t):
    return source.inventory(files(t)).select("path", F.explode("imports").alias("module"))


@query(r""", p AS (SELECT doc_id, regexp_replace(text, '\n\s*\n', chr(10), 'g') AS t FROM n0), c AS (SELECT doc_id, unnest(range(0, greatest(CAST(ceil(length(t) / 1500.0) AS INT), 1))) AS pos, t FROM p), s AS (SELECT doc_id, pos, substr(t, pos * 1500 + 1, 1500) AS chunk FROM c)
SELECT doc_id, CAST(pos AS INT) AS pos, chunk FROM s WHERE length(chunk) > 300""")
def chunk_text(t):
    return source.chunk(t.read("documents"))


@query(r""", p AS (SELECT doc_id, project, regexp_replace(text, '\n\s*\n', chr(10), 'g') AS t FROM n0), c AS (SELECT doc_id, project, unnest(range(0, greatest(CAST(ceil(length(t) / 1500.0) AS INT), 1))) AS pos, t FROM p), s AS (SELECT doc_id, project, pos, substr(t, pos * 1500 + 1, 1500) AS chunk FROM c)
SELECT doc_id, CAST(pos AS INT) AS pos, chunk FROM (SELECT * FROM s WHERE length(chunk) > 300 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY pos) <= 5) QUALIFY row_number() OVER (PARTITION BY project ORDER BY md5(chunk), doc_id, pos) <= 30""")
def chunk_text_capped(t):
    """At most five segments of a text and thirty of a project."""
    return source.chunk(t.read("documents").withColumnRenamed("source", "project"), cap=5, domain_col="project", domain_cap=30)


@query("SELECT stem, CASE WHEN doc_id % 4 = 0 THEN vec ELSE CASE WHEN vec IS NULL THEN [CAST(doc_id AS DOUBLE)] ELSE [CAST(doc_id AS DOUBLE)] END END AS vec, CASE WHEN doc_id % 4 <> 0 OR vec IS NOT NULL THEN 'new' END AS embed_space, NOT (doc_id % 4 = 0 AND vec IS NOT NULL) AS asked FROM n WHERE NOT (doc_id % 4 = 0 AND vec IS NULL) UNION ALL SELECT stem, [CAST(doc_id AS DOUBLE)], 'new', true FROM n WHERE doc_id % 4 = 0 AND vec IS NULL")
def embed_missing(t):
    notes = t.plain_notes.select("doc_id", "stem").join(t.vectors, "doc_id", "left")
    notes = notes.withColumn("embed_space", F.when(F.col("doc_id") % 4 == 0, "new").otherwise("old"))
    new = notes.select("stem", F.array(F.col("doc_id").cast("double")).alias("new_vec"))
    return source.embed_missing(notes.drop("doc_id"), new, "new")


@query("SELECT stem, CASE WHEN doc_id % 4 = 0 OR project = 'src1' THEN vec WHEN doc_id % 3 = 0 THEN NULL ELSE [CAST(doc_id AS DOUBLE)] END AS vec, CASE WHEN doc_id % 4 = 0 THEN 'new' WHEN project = 'src1' THEN 'old' WHEN doc_id % 3 <> 0 THEN 'new' END AS embed_space, doc_id % 4 <> 0 OR vec IS NULL AS asked FROM n WHERE NOT (doc_id % 4 = 0 AND vec IS NULL)")
def embed_abandoned(t):
    """A project whose embedder fails keeps what it had."""
    k = F.col("doc_id")
    notes = t.plain_notes.select("doc_id", "stem", "project").join(t.vectors, "doc_id", "left").where("NOT (doc_id % 4 = 0 AND vec IS NULL)")
    notes = notes.withColumn("embed_space", F.when(k % 4 == 0, "new").otherwise("old"))
    new = notes.where("project <> 'src1' AND doc_id % 3 <> 0").select("stem", F.array(k.cast("double")).alias("new_vec"))
    return source.embed_missing(notes.drop("doc_id"), new, "new", F.col("project"))


@query("SELECT project, status, count(*) AS notes, sum(recurrence) AS recurrence FROM n WHERE status = 'live' GROUP BY ALL")
def sink_notes(t):
    path = new_path(t.spark, "notes")
    source.write_notes(t.notes.select("stem", "recurrence", "status", "project"), path)
    return source.read_notes(t.spark, path, ["live"]).groupBy("project", "status").agg(F.count("*").alias("notes"), F.sum("recurrence").alias("recurrence"))


@query(""", c AS (SELECT entity, count(*) AS notes FROM ne WHERE status = 'live' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20), e AS (SELECT a.entity AS source, b.entity AS target, count(*) AS weight FROM ne a JOIN ne b ON a.stem = b.stem AND a.entity < b.entity WHERE a.status = 'live' AND a.entity IN (SELECT entity FROM c) AND b.entity IN (SELECT entity FROM c) GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT 'node' AS kind, entity AS source, '' AS target, notes AS weight FROM c UNION ALL SELECT 'edge', source, target, weight FROM e""")
def export_graph(t):
    return graph.export(t.entities.where("status = 'live'"), 20)




EXPORT = """, tg AS (SELECT DISTINCT stem, entity FROM ne WHERE status = 'live'), rl AS (SELECT stem, rel, target FROM nr WHERE status = 'live'),
nd AS (SELECT entity, max(notes) AS notes FROM (SELECT entity, count(*) AS notes FROM tg GROUP BY 1 UNION ALL SELECT DISTINCT target, 0 FROM rl) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12),
ed AS (SELECT entity AS source, rel, target, count(*) AS notes FROM tg JOIN rl USING (stem) WHERE entity <> target AND entity IN (SELECT entity FROM nd) AND target IN (SELECT entity FROM nd) GROUP BY ALL),
pa AS (SELECT a.entity AS source, b.entity AS target, count(*) AS notes FROM tg a JOIN tg b ON a.stem = b.stem AND a.entity < b.entity WHERE a.entity IN (SELECT entity FROM nd) AND b.entity IN (SELECT entity FROM nd) GROUP BY ALL HAVING count(*) >= 2)"""


def exported(t: Tables) -> DataFrame:
    return graph.export_rows(t.entities.where("status = 'live'"), t.relations.where("status = 'live'"), 12)


@query(EXPORT + " SELECT 'node' AS kind, entity AS source, '' AS rel, '' AS target, notes FROM nd UNION ALL SELECT 'edge', source, rel, target, notes FROM ed UNION ALL SELECT 'pair', source, '', target, notes FROM pa")
def export_rows(t):
    return exported(t)


@query(EXPORT + """ SELECT '{"nodes":[' || (SELECT string_agg('{"id":"' || entity || '","notes":' || notes || '}', ',' ORDER BY notes DESC, entity) FROM nd) || '],"edges":[' || coalesce((SELECT string_agg('{"source":"' || source || '","rel":"' || rel || '","target":"' || target || '","notes":' || notes || '}', ',' ORDER BY notes DESC, source, target, rel) FROM ed), '') || '],"cooccurrence":[' || coalesce((SELECT string_agg('{"a":"' || source || '","b":"' || target || '","notes":' || notes || '}', ',' ORDER BY notes DESC, source, target) FROM pa), '') || ']}' AS text""")
def export_json(t):
    return graph.export_text(exported(t), "json")


@query(EXPORT + """ SELECT 'digraph notes {' || chr(10) || '  rankdir=LR; node [shape=box];' || chr(10) || (SELECT string_agg('  "' || entity || '" [label="' || entity || '\\n(' || notes || ')"];' || chr(10), '' ORDER BY entity) FROM nd) || coalesce((SELECT string_agg('  "' || source || '" -> "' || target || '" [label="' || rel || '"];' || chr(10), '' ORDER BY notes DESC, source, target, rel) FROM ed), '') || coalesce((SELECT string_agg('  "' || source || '" -> "' || target || '" [dir=none, style=dashed];' || chr(10), '' ORDER BY notes DESC, source, target) FROM pa), '') || '}' AS text""")
def export_dot(t):
    return graph.export_text(exported(t), "dot")


@query(EXPORT + """, ii AS (SELECT entity, 'n' || (row_number() OVER (ORDER BY entity) - 1) AS id FROM nd) SELECT 'graph LR' || (SELECT string_agg(chr(10) || '  ' || id || '["' || entity || '"]', '' ORDER BY entity) FROM ii) || coalesce((SELECT string_agg(chr(10) || '  ' || a.id || ' -->|' || rel || '| ' || b.id, '' ORDER BY notes DESC, source, target, rel) FROM ed JOIN ii a ON a.entity = source JOIN ii b ON b.entity = target), '') || coalesce((SELECT string_agg(chr(10) || '  ' || a.id || ' -.- ' || b.id, '' ORDER BY notes DESC, source, target) FROM pa JOIN ii a ON a.entity = source JOIN ii b ON b.entity = target), '') AS text""")
def export_mermaid(t):
    return graph.export_text(exported(t), "mermaid")
