"""Queries of the evaluation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.fixtures import AS_OF, Tables
from lorekeep.functions import numbers
from lorekeep.operators import evaluation as ev
from lorekeep.operators import retrieval as r
from lorekeep.operators import similarity
from lorekeep.plans.q_retrieval import ALL, docs, mm, queries, rounded
from lorekeep.plans.registry import query
from lorekeep.shared import stored

RANKED = ALL + ", rk AS (SELECT qid, stem, doc_id, recurrence, lex, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, stem) AS rank FROM (SELECT qid, stem, round(lex, 6) AS lex FROM bm) JOIN cd USING (stem)), rl AS (SELECT qid, stem FROM qrels JOIN cd USING (doc_id))"


def ranked(t: Tables, k: int | None = None):
    scored = rounded(r.bm25(queries(t, "*"), docs(t, "*")), "lex")
    return r.top(scored, ["qid"], [F.desc("lex"), "stem"], k or 1 << 30)


def relevant(t: Tables):
    return t.qrels.join(t.plain_notes.select("doc_id", "stem"), "doc_id").select("qid", "stem")


@query(RANKED + " SELECT qid, round(coalesce(1 / log2(min(rank) + 1), 0), 6) AS ndcg FROM rl LEFT JOIN (SELECT * FROM rk WHERE rank <= 10) USING (qid, stem) GROUP BY qid")
def eval_ndcg(t):
    return ev.ndcg(ranked(t, 10), relevant(t))


@query(", sm AS (SELECT a.stem, b.stem AS other, list_cosine_similarity(a.vec, b.vec) AS sim FROM n a JOIN n b ON a.project = b.project AND a.stem <> b.stem WHERE a.vec IS NOT NULL AND b.vec IS NOT NULL), lk AS (SELECT stem, target AS other FROM nl), rk AS (SELECT stem, other, row_number() OVER (PARTITION BY stem ORDER BY round(sim, 9) DESC, other) AS rank FROM sm) SELECT count(*) AS questions, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5 FROM rk JOIN lk USING (stem, other)")
def eval_leave_one_out(t):
    v = stored(t.plain_notes.join(t.vectors, "doc_id").select("project", "stem", "vec"), "vectors")
    hit = similarity.link_ranks(v, t.links, ["project"])
    return hit.agg(F.count("*").alias("questions"), ev.share(F.when(F.col("rank") <= 5, 1.0).otherwise(0.0), "recall_5"))


@query(RANKED + ", fi AS (SELECT rank, 'recurrence' AS kind, CASE WHEN recurrence = 1 THEN '1' WHEN recurrence <= 3 THEN '2-3' WHEN recurrence <= 7 THEN '4-7' ELSE '8+' END AS bucket FROM rk JOIN rl USING (qid, stem) UNION ALL SELECT rank, 'time', year(date) || 'q' || quarter(date) FROM rk JOIN rl USING (qid, stem) JOIN (SELECT stem, date FROM n) USING (stem)) SELECT kind, bucket, count(*) AS questions, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0 END), 6) AS recall_1 FROM fi GROUP BY ALL")
def eval_stratified(t):
    return ev.stratified(ranked(t).join(relevant(t), ["qid", "stem"]).join(t.plain_notes.select("stem", "recurrence", "date"), "stem"))


@query(RANKED + f", sc AS (SELECT qid, stem, {mm('lex')} AS a, {mm('ln(recurrence)')} AS b FROM rk WHERE rank <= 50), gr AS (SELECT qid, stem, w, round((1 - w) * a + w * b, 9) AS s FROM sc, (SELECT unnest([0.0, 0.1, 0.3, 0.5]) AS w)), fr AS (SELECT w, qid, min(rank) AS r FROM (SELECT *, row_number() OVER (PARTITION BY w, qid ORDER BY s DESC, stem) AS rank FROM gr) JOIN rl USING (qid, stem) GROUP BY ALL) SELECT CAST(w AS DOUBLE) AS w, round(sum(CASE WHEN r = 1 THEN 1.0 ELSE 0 END) / (SELECT count(DISTINCT qid) FROM rl), 6) AS recall_1, round(sum(1.0 / r) / (SELECT count(DISTINCT qid) FROM rl), 6) AS mrr FROM fr GROUP BY 1")
def eval_weight_sweep(t):
    both = ranked(t, 50).join(t.plain_notes.select("stem", "recurrence"), "stem")
    scores = stored(both.select("qid", "stem", F.col("lex").alias("a"), F.log(F.col("recurrence").cast("double")).alias("b")), "sweep")
    return ev.weight_sweep(r.min_max(scores, "a", "b"), relevant(t), [0.0, 0.1, 0.3, 0.5])


@query(", p AS (SELECT (event_id * 37 % 1000) / 1000 AS p, CASE WHEN event_type IN ('purchase', 'view') THEN 1.0 ELSE 0 END AS y FROM events), b AS (SELECT CAST(least(floor(p * 10), 9) AS INT) AS bin, count(*) AS n, avg(p) AS predicted, avg(y) AS observed FROM p GROUP BY 1) SELECT bin, n, round(predicted, 6) AS predicted, round(observed, 6) AS observed, round((SELECT sum(n * abs(predicted - observed)) / sum(n) FROM b), 6) AS ece FROM b")
def eval_calibration(t):
    return ev.calibration(t.read("events").select((F.col("event_id") * 37 % 1000 / 1000).alias("p"), F.when(F.col("event_type").isin("purchase", "view"), 1.0).otherwise(0.0).alias("y")))


SIZES = RANKED + ", tk AS (SELECT stem, length(text) // 4 AS tokens FROM cd), sz AS (SELECT rk.qid, rk.stem, rank, tokens, CASE WHEN rl.stem IS NULL THEN 0 ELSE 1 END AS hit FROM rk JOIN tk USING (stem) LEFT JOIN rl ON rl.qid = rk.qid AND rl.stem = rk.stem WHERE rank <= 20), pk AS (SELECT qid, k, sum(tokens) AS t, max(hit) AS hit FROM sz, (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL), pl AS (SELECT qid, sum(tokens) AS pool FROM sz GROUP BY 1)"


@query(SIZES + " SELECT CAST(k AS INT) AS k, round(avg(hit), 6) AS recall, round(avg(t), 6) AS tokens, round(avg(hit * pool - t), 6) AS net_small, round(avg(hit * (SELECT sum(tokens) FROM tk) - t), 6) AS net_all FROM pk JOIN pl USING (qid) GROUP BY 1")
def retrieval_token_ab(t):
    sizes = t.plain_notes.select("stem", F.floor(F.length("text") / 4).alias("tokens"))
    return ev.token_account(ranked(t, 20), sizes, relevant(t), [1, 5, 10])


@query(RANKED + " SELECT CAST(k AS INT) AS k, round(avg(raw), 6) AS raw_tokens, round(avg(small), 6) AS distilled_tokens, round(sum(small) / sum(raw), 6) AS ratio FROM (SELECT qid, k, sum(length(text) // 4) AS raw, sum(length(split_part(text, '.', 1)) // 4) AS small FROM rk JOIN cd USING (stem), (SELECT unnest([1, 5, 10]) AS k) WHERE rank <= k GROUP BY ALL) GROUP BY 1")
def distillation_ab(t):
    sized = ranked(t, 10).join(t.plain_notes.select("stem", F.floor(F.length("text") / 4).alias("raw"), F.floor(F.length("title") / 4).alias("small")), "stem")
    per = sized.select("qid", "rank", "raw", "small", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))).alias("k")).where("rank <= k").groupBy("qid", "k").agg(F.sum("raw").alias("raw"), F.sum("small").alias("small"))
    return per.groupBy("k").agg(ev.share(F.col("raw"), "raw_tokens"), ev.share(F.col("small"), "distilled_tokens"), F.round(F.sum("small") / F.sum("raw"), 6).alias("ratio"))


@query("SELECT user_id % 12 AS task, round(b, 6) AS base, round(g, 6) AS guarded, round(b - g, 6) AS absolute, round((b - g) / b, 6) AS relative FROM (SELECT user_id % 12 AS user_id, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) FILTER (event_id % 2 = 0) AS b, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) FILTER (event_id % 2 = 1) AS g FROM events GROUP BY 1)")
def guard_efficacy(t):
    return ev.guard_efficacy(t.read("events").select((F.col("user_id") % 12).alias("task"), F.when(F.col("event_id") % 2 == 0, "none").otherwise("guard").alias("arm"), (F.col("event_type") == "error").alias("pitfall")))


@query("SELECT arm, round(e, 6) AS errors, round(t, 6) AS tokens, round((first_value(e) OVER (ORDER BY arm) - e) * 1000 / t, 6) AS prevented_per_1k FROM (SELECT 'arm-' || (user_id % 3) AS arm, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0 END) AS e, avg(value) AS t FROM events GROUP BY 1)")
def eval_token_efficiency(t):
    arm = F.concat(F.lit("arm-"), (F.col("user_id") % 3).cast("string"))
    return ev.token_efficiency(t.read("events").select(arm.alias("arm"), F.when(F.col("event_type") == "error", 1.0).otherwise(0.0).alias("errors"), F.col("value").alias("tokens")), "arm-0")


@query("SELECT CASE WHEN event_id % 2 = 0 THEN 'oracle' ELSE 'retrieved' END AS setting, event_type AS question_type, count(*) AS n, round(avg(CASE WHEN value > 50 THEN 1.0 ELSE 0 END), 6) AS accuracy FROM events WHERE user_id % 9 <> 0 GROUP BY ALL")
def qa_accuracy(t):
    return ev.qa_accuracy(t.read("events").select(F.when(F.col("event_id") % 2 == 0, "oracle").otherwise("retrieved").alias("setting"), F.col("event_type").alias("question_type"), F.when(F.col("user_id") % 9 != 0, F.col("value") > 50).alias("correct")))


def choices(t: Tables):
    """The 20 best candidates of every question with a relevant one among them, and their features."""
    top = ranked(t, 20).join(t.plain_notes.select("stem", "recurrence", "date", "resolved"), "stem")
    y = relevant(t).withColumn("y", F.lit(1.0))
    rows = top.join(y, ["qid", "stem"], "left").withColumn("y", F.coalesce("y", F.lit(0.0)))
    return rows.select("qid", "stem", "y", (F.col("lex") / 10).alias("lex"), F.log(F.col("recurrence").cast("double")).alias("often"), (numbers.age_days("date", AS_OF) / 365).alias("age"), F.col("resolved").cast("double").alias("resolved"))


FEATURES = ["lex", "often", "age", "resolved"]


def named(t: Tables, weights: list[float], names: list[str]):
    return t.spark.createDataFrame([(n, round(w, 6)) for n, w in zip(names, weights, strict=True)], "feature string, weight double")


@query(None)
def posterior_fit(t):
    return named(t, ev.posterior_fit(choices(t), FEATURES), FEATURES)


@query(None)
def posterior_ablation(t):
    """What each feature is worth: the loss without it less the loss with all."""
    rows = stored(choices(t), "choices")
    return t.spark.createDataFrame([(n, round(x, 6)) for n, x in ev.leave_one_out(rows, FEATURES)], "feature string, loss_change double")


def rewards(t: Tables):
    e = t.read("events")
    return e.select(F.lit(1.0).alias("one"), (F.col("user_id") / 150).alias("user"), (F.col("value") / 100).alias("value"), (F.col("event_type") == "view").cast("double").alias("view"), (F.col("event_type") == "purchase").cast("double").alias("reward"), (F.col("event_id") % 5).alias("seed"), F.floor(F.col("event_id") / 50).alias("round"), F.col("event_id").alias("stem"))


@query(None)
def bandit_offline(t):
    names = ["one", "user", "value", "view"]
    return named(t, ev.ridge(rewards(t), names, "reward"), names)


@query(None)
def bandit_replay(t):
    return ev.bandit_replay(rewards(t), ["one", "user", "value", "view"])
