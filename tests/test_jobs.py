"""Clusters and their merges, studies, streams: against plain loops over small tables."""

import datetime as dt
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from lorekeep import shared
from lorekeep.fixtures import Tables
from lorekeep.operators import rollups, similarity
from lorekeep.plans import QUERIES, q_similarity
from lorekeep.streaming import jobs

SF = "/root/testdata/sf0.001"
NOTES = "stem string, date date, recurrence long, tags array<string>, ents array<string>, confidence double, descr string, prevention string, status string"


def rows():
    day = lambda n: dt.date(2024, 1, n)
    return [
        ("a", day(1), 2, ["x", "y"], ["e"], 0.4, "first line\nshared line", "do this", "live"),
        ("b", day(3), 1, ["y"], ["f", "e"], None, "Shared  line", "do that", "live"),
        ("c", day(2), 5, ["z"], [], 0.9, "third", "", "live"),
        ("d", day(9), 1, ["q"], [], None, "alone", "", "live"),
    ]


def test_clusters_merge_into_their_newest_note(spark):
    notes = spark.createDataFrame(rows(), NOTES)
    clusters = spark.createDataFrame([("a", "c"), ("b", "c"), ("c", "c")], "id string, seed string")
    m = similarity.merge_clusters(notes, clusters).first()
    assert (m.seed, m.keeper, m["size"], m.recurrence, m.tags, m.ents, m.confidence) == ("c", "b", 3, 5, ["y", "x", "z"], ["f", "e"], 0.9)
    # new to the keeper: a's text and prevention, c's text
    assert m.added == 3
    after, audit = similarity.consolidate(notes, clusters)
    got = {r.stem: (r.status, r.duplicate_of, r.recurrence, r.tags) for r in after.collect()}
    assert got == {"a": ("duplicate", "b", 2, ["x", "y"]), "b": ("live", None, 5, ["y", "x", "z"]), "c": ("duplicate", "b", 5, ["z"]), "d": ("live", None, 1, ["q"])}
    assert audit.count() == 1


def greedy(order, near):
    used, out = set(), {}
    for i in order:
        if i in used:
            continue
        free = {b for b in near[i] if b not in used}
        if free:
            out |= dict.fromkeys(free | {i}, i)
        used |= free | {i}
    return out


def test_cluster_queries_equal_sequential_passes(spark):
    notes = q_similarity.notes(Tables(spark, SF))
    all_ = {r.stem: r for r in notes.collect()}
    unit = {k: np.array(r.vec) / np.linalg.norm(r.vec) for k, r in all_.items()}
    near = defaultdict(set)
    for r in QUERIES["near_dup_pairs"](spark, SF).collect():
        near[r.stem_a].add(r.stem_b)
        near[r.stem_b].add(r.stem_a)
    want = greedy(sorted(all_, key=lambda k: (-all_[k].recurrence, k)), near)
    assert dict(QUERIES["dedup_clusters"](spark, SF).collect()) == want and want
    sizes = defaultdict(list)
    for member, seed in want.items():
        sizes[seed].append(all_[member].recurrence)
    got = {r.seed: (r["size"], r.recurrence) for r in QUERIES["cluster_recurrence"](spark, SF).collect()}
    assert got == {s: (len(v), max(len(v), *v)) for s, v in sizes.items()}
    newest = {s: max((k for k, v in want.items() if v == s), key=lambda k: (all_[k].date, k)) for s in sizes}
    assert {r.seed: r.keeper for r in QUERIES["cluster_merge_meta"](spark, SF).collect()} == newest
    assert {r.seed: r.keeper for r in QUERIES["cluster_merge_text"](spark, SF).collect()} == newest
    assert {r.seed: r.keeper for r in QUERIES["consolidate"](spark, SF).collect()} == newest
    names = sorted(unit)
    sim = np.array([unit[k] for k in names]) @ np.array([unit[k] for k in names]).T
    close = {k: {names[j] for j in np.flatnonzero(sim[i] >= 0.6) if j != i} for i, k in enumerate(names)}
    assert dict(QUERIES["communities"](spark, SF).collect()) == greedy(names, close)
    for row in QUERIES["eval_recurrence"](spark, SF).collect():
        own = {k: {names[j] for j in np.flatnonzero(sim[i] >= row.sim) if j != i and all_[names[j]].project == all_[k].project} for i, k in enumerate(names)}
        found = greedy(names, own)
        days = defaultdict(set)
        for k, s in found.items():
            days[s].add(all_[k].date)
        assert (row.clusters, row.cross_date, row.notes) == (len(days), sum(len(d) > 1 for d in days.values()), len(found) or None)


def test_receipt_takes_the_richest_line_that_fits(spark):
    packed = spark.createDataFrame([("q", True, 40), ("q", False, 9), ("r", True, 75), ("s", False, 1)], "qid string, shown boolean, cost int")
    got = {r.qid: (r.shown, r.held, r.chars, r.line) for r in rollups.receipt(packed, 80).collect()}
    assert got["q"][:3] == (1, 1, 40) and got["q"][3].startswith("1 shown, 1 held") and got["r"][3] == "" and got["s"][:3] == (0, 1, 0)


def test_twin_fit_separates_what_the_features_separate(spark):
    rng = np.random.default_rng(1)
    data = [(f"a{i}", f"b{i}", i % 2, *(float(x) for x in rng.normal(i % 2, 0.4, 5))) for i in range(200)]
    pairs = spark.createDataFrame(data, f"stem_a string, stem_b string, twin int, {', '.join(f + ' double' for f in similarity.FEATURES)}")
    row = similarity.auc(similarity.twin_fit(pairs), "p_fit", "twin").first()
    assert row.auc > 0.98
    assert QUERIES["twin_fit"](spark, SF).count() == 1


def test_guard_stream_ends_where_the_batch_does(spark):
    stream = {r.guard_id: (r.status, r.helped, r.corroborations, r.false_positives) for r in QUERIES["st_guard_lifecycle"](spark, SF).collect()}
    batch = {r.guard_id: (r.status, r.helped, r.corroborations, r.false_positives) for r in QUERIES["guard_feedback"](spark, SF).collect()}
    assert stream and all(batch[g] == s for g, s in stream.items())


def test_prompts_never_show_a_note_twice_in_a_session(spark):
    got = QUERIES["st_prompt_recall"](spark, SF).collect()
    assert got and len({(r.session, r.stem) for r in got}) == len(got)
    per = defaultdict(set)
    for r in got:
        per[r.session].add(r.prompt)
    counts = defaultdict(int)
    for r in got:
        counts[r.session, r.prompt] += 1
    assert max(counts.values()) <= jobs.PER_PROMPT and max(map(len, per.values())) <= jobs.PROMPTS


def test_sessions_over_batches_are_settled_once(spark):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    parts = spark.createDataFrame([(1, 2, 10, at(0)), (1, 1, 5, at(100)), (2, 1, 1, at(400)), (3, 4, 4, at(520))], "session long, turns long, chars long, last timestamp")
    assert {(r.session, r.turns, r.chars) for r in jobs.settled(parts).collect()} == {(1, 3, 15), (2, 1, 1)}
    updates = spark.createDataFrame([("a", 1, 0), ("a", 3, 2), ("b", 2, 1)], "key string, n int, _batch long")
    assert dict(jobs.latest(updates, "key").collect()) == {"a": 3, "b": 2}


def test_offline_bandit_uses_every_round(spark):
    got = QUERIES["bandit_offline"](spark, SF).collect()
    assert got and QUERIES["posterior_fit"](spark, SF).select(F.lit(1)).count() > 0


def test_kept_tables_go_when_their_job_ends(spark, tmp_path):
    here = lambda path: spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration()).exists(spark._jvm.org.apache.hadoop.fs.Path(path))
    before, out = shared.new_path(spark, "before"), str(tmp_path / "out")
    spark.range(3).write.parquet(before)
    with shared.cleared(spark):
        kept = shared.stored(spark.range(5), "kept")
        path = shared._made[-1]
        kept.write.parquet(out)
        assert here(path)
    assert not here(path) and here(before) and spark.read.parquet(out).count() == 5
