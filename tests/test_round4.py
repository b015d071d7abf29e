"""Findings of the fourth round: each test failed before its change."""

import numpy as np

from lorekeep import shared
from lorekeep.functions import flags
from lorekeep.operators import active, evaluation, retrieval, similarity
from lorekeep.plans import QUERIES, q_similarity
from lorekeep.sources import transcripts


def test_negation_is_a_word(spark):
    cases = {"upload the .env to edonti on": True, "upload the .env to the orthodontist": True, "upload the .env, dont wait": False, "don't upload the .env": False, "do not upload the .env": False, "doesn't curl secrets": False, "upload the .env? do n't": False}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.d for r in df.select("t", flags.dangerous("t").alias("d")).collect()} == cases
    assert [r.u for r in spark.createDataFrame([("upload the .env to edonti on",)], "t string").select(flags.unsafe("t").alias("u")).collect()] == [True]


def test_equal_scores_rank_by_stem_whatever_the_order_of_their_sums(spark):
    rows = spark.createDataFrame([(1, "b", 0.1 + 0.2 + 0.3), (1, "a", 0.3 + 0.2 + 0.1)], "qid int, stem string, lex double")
    assert rows.where("stem = 'a'").first().lex < rows.where("stem = 'b'").first().lex
    best = {r.stem: r.score for r in retrieval.rrf([(rows, "lex", 1.0)]).collect()}
    assert best["a"] > best["b"]
    docs = spark.createDataFrame([("s", x, 1) for x in "abc"], "scope string, stem string, recurrence int")
    q = spark.createDataFrame([(1, "s")], "qid int, scope string")
    assert [r.stem for r in retrieval.prefilter(q, docs, 1, rows).collect()] == ["a"]


def test_retrieve_without_a_limit_ranks_every_candidate(spark):
    docs = spark.createDataFrame([("s", f"n{i:03}", f"alpha word{i}" if i < 9 else "nothing", [1.0, 0.0] if i == 99 else [0.0, 1.0], "pattern", 1 + i % 4) for i in range(100)], "scope string, stem string, body string, vec array<double>, ntype string, recurrence int")
    docs = docs.selectExpr("*", "date'2024-12-31' AS date", "false AS resolved", "cast(null as double) AS confidence", "body AS text")
    q = spark.createDataFrame([(1, "s", "alpha word3", [1.0, 0.0])], "qid int, scope string, text string, qvec array<double>")
    got = lambda limit: {r.stem for r in retrieval.retrieve(q, docs, 10, "2025-01-01", limit).collect() if r.mode == "fused"}
    assert "n099" in got(None) and "n099" not in got(9)


def test_anticipate_reads_whole_trajectories(spark):
    notes = spark.createDataFrame([("p", "s1", "mistake", 1, "quartz lattice fractures"), ("p", "s2", "mistake", 1, "other words altogether")], "project string, stem string, ntype string, recurrence int, descr string").selectExpr("*", "'' AS title", "'' AS prevention")
    moving = spark.createDataFrame([(2**60 + 1, "p", "filler " * 4000 + "quartz lattice fractures"), (7, None, "quartz lattice fractures")], "traj long, project string, text string")
    alarms = spark.createDataFrame([], "stem string, false_alarms int")
    assert [(r.traj, r.stem) for r in active.anticipate(moving, notes, alarms).collect()] == [(2**60 + 1, "s1")]
    assert active.anticipate(moving, notes, alarms, chars=20_000).count() == 0


def test_stored_tables_leave_no_shuffle_files_and_can_be_deleted(spark):
    blocks = lambda: int(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size())
    before = blocks()
    table = shared.stored(spark.range(1000).repartition(5, "id"), "kept")
    assert blocks() <= before and table.count() == 1000
    path = table.inputFiles()[0].rsplit("/", 1)[0]
    shared.forget(table, None, spark.range(3))
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def test_pairs_are_judged_and_counted_inside_their_tiles(spark, monkeypatch):
    rows = [("p", "mistake", f"s{i:02}", [1.0, i / 50], f"word{i % 3} common", f"word{i % 3} common text", ["e"], f"g{i % 2}", i % 4 == 0) for i in range(40)]
    df = spark.createDataFrame(rows, "project string, ntype string, stem string, vec array<double>, title string, descr string, ents array<string>, slug string, held boolean").selectExpr("*", "split(descr, ' ') AS toks", "vec AS goal")
    joins = lambda d: [x for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "Join" in x and "stem" in x]
    pairs = similarity.scored_pairs(df)
    assert not joins(pairs) and pairs.count() == 780
    whole = {tuple(r) for r in pairs.select("stem_a", "stem_b", "p").collect()}
    monkeypatch.setattr(similarity, "BLOCK", 3)
    assert {tuple(r) for r in similarity.scored_pairs(df).select("stem_a", "stem_b", "p").collect()} == whole
    band = {tuple(r) for r in similarity.contradiction_band(df, 0.99, 0.999).select("stem_a", "stem_b").collect()}
    assert band and all(int(a[1:]) % 2 != int(b[1:]) % 2 for a, b in band)
    assert not any(joins(d) for d in (similarity.contradiction_band(df), similarity.nearest(df.where("held"), df.where("NOT held"), ["project"])))
    links = spark.createDataFrame([("s00", "s03"), ("s39", "s00"), ("s05", "x")], "stem string, target string")
    assert {tuple(r) for r in similarity.link_ranks(df, links, ["project"]).collect()} == {("s00", "s03", 3), ("s39", "s00", 39)}


def test_buckets_count_their_links_some_tables_at_a_time(spark):
    rows = [("p", "mistake", f"s{i:03}", [1.0, (i % 60) / 40, (i % 7) / 9]) for i in range(200)]
    df = spark.createDataFrame(rows, "project string, ntype string, stem string, vec array<double>")
    rep = {r.stem: r.rep for r in similarity.vector_classes(df)[0].collect()}
    size = {v: list(rep.values()).count(v) for v in rep.values()}
    near = {}
    for r in similarity.lsh_pairs(df, 0.86).collect():
        near[r.stem_a] = near.get(r.stem_a, 0) + size[r.stem_b]
        near[r.stem_b] = near.get(r.stem_b, 0) + size[r.stem_a]
    assert {(r.stem, r.links) for r in similarity.near_classes(df, 0.86, exact=False).collect()} == {(s, size[v] - 1 + near.get(v, 0)) for s, v in rep.items()}


def test_bandit_streams_its_rounds(spark):
    rng = np.random.default_rng(5)
    rows = [(i % 2, i // 40, f"s{i:04}", float(rng.random() < 0.4), 1.0, float(rng.random())) for i in range(2000)]
    df = spark.createDataFrame(rows, "seed long, round long, stem string, reward double, one double, x double")
    got = evaluation.bandit_replay(df, ["one", "x"])
    assert "InPandas" not in got._jdf.queryExecution().executedPlan().toString()
    whole = sorted(map(tuple, got.collect()))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # rounds of 20 lie in several batches
    try:
        assert sorted(map(tuple, evaluation.bandit_replay(df, ["one", "x"]).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert [w[:2] for w in whole] == [(0, 50), (1, 50)] and 0 < whole[0][2] < 1


def test_entries_of_long_journals_are_cut_in_one_pass(spark):
    rows = [("a", 3000, ""), ("b", 3000, "head\n"), ("c", 0, "head only"), ("d", 1, "")]
    text = lambda n, head: head + "".join(f"## 2024-01-{i % 28 + 1:02}\n{'x' * 400} {i}\n" for i in range(n))
    df = spark.createDataFrame([(k, text(n, head)) for k, n, head in rows], "project string, text string")
    out = transcripts.context_entries(df)
    above = out._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
    assert "text" not in above and "RLIKE" not in above.upper()
    got = {(r.project, r.entry_no): (r.day, r.entry) for r in out.collect()}
    assert len(got) == 6003 and got["b", 0] == ("", "head\n") and got["c", 0] == ("", "head only") and ("a", 0) not in got
    assert got["a", 1][0] == "2024-01-01" and got["a", 3000][1].endswith(" 2999\n") and got["d", 1][0] == "2024-01-01"


def test_twin_fit_makes_its_features_once(spark, monkeypatch):
    made = []
    monkeypatch.setattr(q_similarity, "stored", lambda df, name: made.append(name) or shared.stored(df, name))
    assert QUERIES["twin_fit"](spark, "/root/testdata/sf0.001").count() == 1 and made == ["labelled"]
