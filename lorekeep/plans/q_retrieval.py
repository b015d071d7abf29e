"""Queries over batched retrieval and its evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.fixtures import AS_OF, Tables
from lorekeep.functions import numbers
from lorekeep.operators import graph
from lorekeep.operators import retrieval as r
from lorekeep.plans.q_graph import entities, relations
from lorekeep.plans.registry import query

TK = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{Nl}}\p{{No}}]{{3,}}|\p{{Nd}}{{3,}}')"


def scoped(scope: str, query_scope: str) -> str:
    """CTEs of candidates and queries with their scopes, and of every score over them."""
    return rf""", cd AS (SELECT {scope} AS scope, stem, doc_id, project, ntype, date, recurrence, resolved, confidence, vec, text, concat_ws(' ', title, descr, prevention, stem) AS body FROM n),
qs AS (SELECT qid, {query_scope} AS scope, text, qvec FROM q),
qt AS (SELECT qid, scope, unnest(list_distinct({TK.format('text')})) AS term FROM qs),
dw AS (SELECT scope, stem, {TK.format('body')} AS w FROM cd),
st AS (SELECT scope, count(*) AS n, avg(len(w)) AS avgdl FROM dw GROUP BY 1),
tf AS (SELECT scope, term, stem, dl, count(*) AS tf FROM (SELECT scope, stem, len(w) AS dl, unnest(w) AS term FROM dw) WHERE (scope, term) IN (SELECT scope, term FROM qt) GROUP BY ALL),
dq AS (SELECT scope, term, count(*) AS df FROM tf GROUP BY ALL),
bm AS (SELECT qid, stem, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) AS lex FROM qt JOIN tf USING (scope, term) JOIN dq USING (scope, term) JOIN st USING (scope) GROUP BY ALL),
ov AS (SELECT qid, stem, count(*) AS shared FROM qt JOIN (SELECT DISTINCT scope, term, stem FROM tf) USING (scope, term) GROUP BY ALL),
sm AS (SELECT qid, stem, list_cosine_similarity(qvec, vec) AS sim FROM qs JOIN cd USING (scope) WHERE qvec IS NOT NULL AND vec IS NOT NULL),
cf0 AS (SELECT qid, max(sim) AS s1, max(sim) FILTER (r = 2) AS s2, quantile_cont(sim, 0.5) AS mid, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY sim DESC) AS r FROM sm) GROUP BY 1),
cf AS (SELECT qid, CASE WHEN n < 2 THEN 1.0 ELSE least(1.0, 1 / (1 + 15 * (s1 - s2))) END AS ambiguity, s1 < 0.4 OR (n >= 4 AND s1 - mid < 0.15) AS low FROM cf0)"""


def z_sql(source: str, value: str, name: str) -> str:
    w = "OVER (PARTITION BY qid)"
    return f"SELECT qid, stem, CASE WHEN count(*) {w} = 1 THEN 1.0 ELSE ({value} - avg({value}) {w}) / CASE WHEN stddev_pop({value}) {w} = 0 THEN 1 ELSE stddev_pop({value}) {w} END END AS {name} FROM {source}"


def fuse_sql(sem: str, lex: str) -> str:
    return f"""zs AS ({z_sql(sem, 'sim', 'zs')}), zl AS ({z_sql(lex, 'lex', 'zl')}),
fu AS (SELECT qid, stem, 1 / (1 + exp(-greatest(-30, least(30, 0.5 * coalesce(zs, -3) + coalesce(zl, -3))))) AS score FROM zs FULL JOIN zl USING (qid, stem))"""


MULT = f"greatest(0.5, pow(0.5, greatest(0, date_diff('day', c.date, DATE '{AS_OF}')) / (1 + ln(c.recurrence)) / 365.0)) * CASE WHEN c.resolved THEN 0.6 ELSE 1 END * CASE WHEN c.confidence IS NULL THEN 1 ELSE 0.6 + 0.4 * c.confidence END"


def prior_sql(source: str) -> str:
    return f"SELECT f.qid, f.stem, (f.score + 0.02 * ln(c.recurrence) * coalesce(ambiguity, 1)) * {MULT} AS score FROM {source} f JOIN cd c USING (stem) LEFT JOIN cf ON cf.qid = f.qid"


OWN = scoped("project", "'src' || (qid % 20)")
ALL = scoped("'*'", "'*'")
FUSED = OWN + ", se AS (SELECT * FROM sm WHERE sim > 0.15), " + fuse_sql("se", "bm")


def docs(t: Tables, scope=None):
    body = F.concat_ws(" ", "title", "descr", "prevention", "stem")
    notes = t.plain_notes.join(t.vectors, "doc_id", "left")
    return notes.select((F.col("project") if scope is None else F.lit(scope)).alias("scope"), "stem", "doc_id", "project", "ntype", "date", "recurrence", "resolved", "confidence", "vec", "text", body.alias("body"))


def queries(t: Tables, scope=None):
    own = F.concat(F.lit("src"), (F.col("qid") % 20).cast("string"))
    return t.queries.select("qid", (own if scope is None else F.lit(scope)).alias("scope"), "text", "qvec")


def rounded(df, *names):
    return df.withColumns({n: F.round(n, 6) for n in names})


def sem(t: Tables):
    return r.similarities(queries(t), docs(t)).where(F.col("sim") > r.NEAR_FLOOR)


def fused(t: Tables):
    return r.fuse(sem(t), r.bm25(queries(t), docs(t)))


@query(OWN + " SELECT qid, stem, round(lex, 6) AS lex FROM bm")
def bm25(t):
    return rounded(r.bm25(queries(t), docs(t)), "lex")


@query(OWN + " SELECT qid, stem, lex, row_number() OVER (PARTITION BY qid ORDER BY lex DESC, stem) AS rank FROM (SELECT qid, stem, round(lex, 6) AS lex FROM bm) QUALIFY rank <= 10")
def join_fts(t):
    return r.top(bm25(t), ["qid"], [F.desc("lex"), "stem"], 10)


@query(OWN + f", nq AS (SELECT qid, len(list_distinct({TK.format('text')})) AS nq FROM qs) SELECT qid, stem, round(shared / sqrt(nq) + 0.03 * ln(recurrence), 6) AS score FROM ov JOIN nq USING (qid) JOIN cd USING (stem)")
def lex_overlap(t):
    return rounded(r.lex_overlap(queries(t), docs(t)), "score")


@query(OWN + ", nq AS (SELECT qid, len(list_distinct(" + TK.format("text") + ")) AS nq FROM qs) SELECT qid, stem, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, stem) AS rank, true AS low FROM (SELECT qid, stem, shared / sqrt(nq) + 0.03 * ln(recurrence) AS score FROM ov JOIN nq USING (qid) JOIN cd USING (stem)) QUALIFY rank <= 5")
def as_text_fallback(t):
    return r.top(lex_overlap(t), ["qid"], [F.desc("score"), "stem"], 5).withColumn("low", F.lit(True))


@query(OWN + " SELECT qid, stem, round(sim, 6) AS sim FROM sm WHERE sim > 0.15")
def sem_scores(t):
    return rounded(sem(t), "sim")


@query(OWN + " SELECT qid, stem, round(z, 6) AS z FROM (" + z_sql("bm", "lex", "z") + ")")
def zscore(t):
    return rounded(r.zscores(r.bm25(queries(t), docs(t)), "lex", "z"), "z")


@query(FUSED + " SELECT qid, stem, round(score, 6) AS score FROM fu")
def calibrated_fusion(t):
    return rounded(fused(t), "score")


@query(OWN + " SELECT qid, round(ambiguity, 6) AS ambiguity FROM cf")
def ambiguity(t):
    return rounded(r.confidence(r.similarities(queries(t), docs(t))).select("qid", "ambiguity"), "ambiguity")


@query(OWN + " SELECT qid, low FROM cf")
def confidence_gate(t):
    return r.confidence(r.similarities(queries(t), docs(t))).select("qid", "low")


@query(FUSED + " SELECT f.qid, f.stem, round(f.score + 0.02 * ln(recurrence) * coalesce(ambiguity, 1), 6) AS score FROM fu f JOIN cd USING (stem) LEFT JOIN cf ON cf.qid = f.qid")
def recurrence_prior(t):
    conf = r.confidence(r.similarities(queries(t), docs(t)))
    both = fused(t).join(docs(t).select("stem", "recurrence"), "stem").join(conf, "qid", "left")
    return both.select("qid", "stem", F.round(F.col("score") + r.RECUR_FUSION * F.log(F.col("recurrence").cast("double")) * F.coalesce("ambiguity", F.lit(1.0)), 6).alias("score"))


@query(f"SELECT stem, round({MULT}, 6) AS mult FROM n c")
def salience_mult(t):
    mult = numbers.salience_multiplier(numbers.age_days("date", AS_OF), "recurrence", "resolved", "confidence")
    return t.plain_notes.select("stem", F.round(mult, 6).alias("mult"))


RETRIEVE = OWN + ", se AS (SELECT sm.* FROM sm JOIN cf USING (qid) WHERE NOT low AND sim > 0.4), " + fuse_sql("se", "bm") + ", pr AS (" + prior_sql("fu") + """),
hi AS (SELECT qid, stem, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, stem) AS rank, 'fused' AS mode FROM pr QUALIFY rank <= 5),
rn AS (SELECT scope, stem, row_number() OVER (PARTITION BY scope ORDER BY kind, r) AS rank FROM (SELECT project AS scope, stem, CASE ntype WHEN 'mistake' THEN 0 WHEN 'pattern' THEN 1 ELSE 2 END AS kind, row_number() OVER (PARTITION BY project, ntype ORDER BY date DESC, stem DESC) AS r FROM n QUALIFY r <= 5) QUALIFY rank <= 5)"""


@query(RETRIEVE + " SELECT * FROM hi UNION ALL SELECT qid, stem, NULL, rank, 'recent' FROM qs JOIN rn USING (scope) WHERE qid NOT IN (SELECT qid FROM hi)")
def retrieve(t):
    return rounded(r.retrieve(queries(t), docs(t), 5, AS_OF, None), "score")


@query(None)
def retrieve_expanded(t):
    """The injection ranker over prefiltered candidates, with graph salience and the notes that hits link to or share a target with."""
    salience = graph.salience_index(entities(t), relations(t))
    return rounded(r.retrieve(queries(t), docs(t), 5, AS_OF, 30, salience, t.links.where("target IS NOT NULL"), relations(t)), "score")


@query(RETRIEVE + " SELECT * FROM rn")
def recency_fallback(t):
    return r.recency_fallback(docs(t), 5)


@query(f""", e AS (SELECT * FROM n WHERE vec IS NOT NULL)""" + OWN.replace("prevention, stem) AS body FROM n)", "prevention, stem) AS body FROM e)") + ", se AS (SELECT * FROM sm WHERE sim > 0.15), " + fuse_sql("se", "bm") + ", pr AS (" + prior_sql("fu") + rf"""),
x AS (SELECT project AS scope, stem, recurrence, list_distinct({TK.format("concat_ws(' ', title, descr, prevention, stem)")}) AS w FROM n WHERE vec IS NULL),
tx AS (SELECT qid, stem, count(*) / sqrt(any_value(nq)) + 0.03 * ln(any_value(recurrence)) AS score FROM (SELECT scope, stem, recurrence, unnest(w) AS term FROM x) JOIN qt USING (scope, term) JOIN (SELECT qid, count(*) AS nq FROM qt GROUP BY 1) USING (qid) GROUP BY ALL)
SELECT qid, stem, round(score, 6) AS score, low, row_number() OVER (PARTITION BY qid ORDER BY tier, score DESC, stem) AS rank FROM (SELECT pr.qid, stem, score, coalesce(low, true) AS low, 0 AS tier FROM pr LEFT JOIN cf USING (qid) UNION ALL SELECT qid, stem, score, true, 1 FROM tx) QUALIFY rank <= 10""")
def search(t):
    return rounded(r.search(queries(t), docs(t), 10, AS_OF), "score")


@query(ALL + """, c1 AS (SELECT sm.qid, sm.stem, sim FROM sm JOIN cd USING (stem) WHERE sim > 0.5 AND project <> 'src' || (qid % 20)), c2 AS (SELECT ov.qid, ov.stem, shared FROM ov JOIN cd USING (stem) WHERE shared >= 2 AND project <> 'src' || (qid % 20)),
f AS (SELECT qid, stem, sum(p) AS score FROM (SELECT qid, stem, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY sim DESC, stem)) AS p FROM c1 UNION ALL SELECT qid, stem, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY shared DESC, stem)) FROM c2) GROUP BY ALL)
SELECT qid, stem, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, stem) AS rank FROM f QUALIFY rank <= 2""")
def retrieve_cross(t):
    own = queries(t, "*").withColumn("project", F.concat(F.lit("src"), (F.col("qid") % 20).cast("string")))
    return rounded(r.cross_project(own, docs(t, "*")), "score")


RRF = FUSED + ", rf AS (SELECT qid, stem, sum(p) AS score FROM (SELECT qid, stem, 2.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY sim DESC, stem)) AS p FROM se UNION ALL SELECT qid, stem, 1.0 / (60 + row_number() OVER (PARTITION BY qid ORDER BY lex DESC, stem)) FROM bm) GROUP BY ALL)"


def rrf(t):
    return r.rrf([(sem(t), "sim", r.RRF_SEM_WEIGHT), (r.bm25(queries(t), docs(t)), "lex", 1.0)])


@query(RRF + " SELECT qid, stem, round(score, 6) AS score FROM rf")
def rrf_fuse(t):
    return rounded(rrf(t), "score")


@query(RRF + f" SELECT qid, f.stem, round(ln(f.score) + 0.3 * ln(c.recurrence) + ln(greatest(1e-12, {MULT})), 6) AS score FROM rf f JOIN cd c USING (stem)")
def posterior_rank(t):
    return rounded(r.posterior(rrf(t), docs(t), AS_OF), "score")


def mm(value: str) -> str:
    w = "OVER (PARTITION BY qid)"
    return f"CASE WHEN max({value}) {w} = min({value}) {w} THEN 0.5 ELSE ({value} - min({value}) {w}) / (max({value}) {w} - min({value}) {w}) END"


@query(FUSED + f" SELECT qid, stem, round(0.7 * {mm('score')} + 0.3 * {mm('ln(recurrence)')}, 6) AS score FROM fu JOIN cd USING (stem)")
def linear_blend(t):
    return rounded(r.linear_blend(fused(t), docs(t), 0.3), "score")


@query(None)
def mmr(t):
    return r.mmr(fused(t), docs(t), 5)


@query(FUSED + """, ce AS (SELECT label, list(x ORDER BY pos) AS cvec FROM (SELECT label, pos, avg(x) AS x FROM (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY ALL) GROUP BY 1),
nr2 AS (SELECT stem, label, list_cosine_similarity(vec, cvec) AS sim, row_number() OVER (PARTITION BY stem ORDER BY list_cosine_similarity(vec, cvec) DESC, label) AS r FROM cd, ce WHERE vec IS NOT NULL QUALIFY r <= 2),
br AS (SELECT stem, greatest(0, product(greatest(0, sim))) AS bridge FROM nr2 GROUP BY 1) SELECT qid, stem, round(0.25 * score + 0.75 * bridge, 6) AS score FROM fu JOIN br USING (stem)""")
def bridge_rank(t):
    e = t.read("embeddings").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("at", "x")).groupBy("label", "at").agg(F.avg("x").alias("x"))
    centroids = e.groupBy(F.col("label").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("cvec"))
    return rounded(r.bridge(fused(t), docs(t), centroids), "score")


@query(FUSED + f" SELECT qid, stem, round(sim + 0.35 * {mm('f')}, 6) AS score FROM (SELECT qid, stem, sim, (doc_id % 10 + 1) / (1 + ln(1 + recurrence)) AS f FROM se JOIN cd USING (stem))")
def rare_event_rank(t):
    return rounded(r.rare_event(sem(t).withColumnRenamed("sim", "score"), docs(t).withColumn("doc_id", F.col("doc_id")).select("stem", "doc_id", "recurrence"), F.col("doc_id") % 10 + 1), "score")


@query(OWN + """, k3 AS (SELECT qid, stem FROM sm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY sim DESC, stem) <= 3),
mn AS (SELECT qid, list(x ORDER BY pos) AS m FROM (SELECT qid, pos, avg(x) AS x FROM (SELECT qid, unnest(vec) AS x, generate_subscripts(vec, 1) AS pos FROM k3 JOIN cd USING (stem)) GROUP BY ALL) GROUP BY 1),
mv AS (SELECT qid, list_transform(list_zip(qvec, m), lambda p: 0.6 * p[1] + 0.4 * p[2] / sqrt(list_dot_product(m, m))) AS v FROM qs JOIN mn USING (qid))
SELECT qid, stem, round(list_cosine_similarity(v, vec), 6) AS sim FROM mv JOIN qs USING (qid) JOIN cd USING (scope) WHERE vec IS NOT NULL""")
def rocchio_prf(t):
    return rounded(r.rocchio(queries(t), docs(t)), "sim")


@query(OWN + " SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN recurrence >= 3 THEN recurrence END DESC NULLS LAST, was, stem) AS rank FROM (SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, stem) AS was FROM bm QUALIFY was <= 20) JOIN cd USING (stem) QUALIFY rank <= 5")
def rerank_by_score(t):
    pool = r.top(bm25(t), ["qid"], [F.desc("lex"), "stem"], 20).select("qid", "stem", "rank")
    scores = pool.join(docs(t).where("recurrence >= 3").select("stem", F.col("recurrence").alias("relevance")), "stem").select("qid", "stem", "relevance")
    return r.rerank(pool, scores, 5)


@query(OWN + f""", b5 AS (SELECT qid, stem FROM bm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, stem) <= 3),
li AS (SELECT qid, stem, a.text AS qtext, unnest(string_split(c.text, chr(10))) AS line, generate_subscripts(string_split(c.text, chr(10)), 1) AS pos FROM b5 JOIN qs a USING (qid) JOIN cd c USING (stem)),
sc AS (SELECT *, len(list_intersect(list_distinct({TK.format('qtext')}), {TK.format('line')})) AS shared, length(line) + 1 AS cost FROM li WHERE trim(line) <> ''),
ku AS (SELECT *, sum(cost) OVER (PARTITION BY qid, stem ORDER BY shared DESC, pos ROWS UNBOUNDED PRECEDING) AS used FROM sc)
SELECT qid, stem, string_agg(line, chr(10) ORDER BY pos) AS passage FROM ku WHERE used <= 800 GROUP BY ALL""")
def passage_select(t):
    best = r.top(bm25(t), ["qid"], [F.desc("lex"), "stem"], 3)
    pairs = best.join(docs(t).select("stem", "text"), "stem").join(queries(t).select("qid", F.col("text").alias("query")), "qid")
    return r.passages(pairs, 800)


@query(OWN + """, b3 AS (SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, stem) AS rank FROM bm QUALIFY rank <= 3)
SELECT qid, substr(string_agg(substr(text, 1, share), chr(10) || chr(10) ORDER BY rank), 1, 4000) AS context FROM (SELECT qid, rank, text, greatest(1200, 4000 // count(*) OVER (PARTITION BY qid)) AS share FROM b3 JOIN cd USING (stem)) GROUP BY 1""")
def context_slice(t):
    best = r.top(bm25(t), ["qid"], [F.desc("lex"), "stem"], 3)
    return r.context(best.join(docs(t).select("stem", "text"), "stem"), 4000)


@query(rf""", cd AS (SELECT project AS scope, stem, recurrence, list_distinct({TK.format('title')}) AS ents, list_distinct({TK.format("concat_ws(' ', title, descr)")}) AS w FROM n WHERE valid_from <= DATE '2024-10-01' AND (valid_to IS NULL OR valid_to > DATE '2024-10-01')),
qt AS (SELECT qid, 'src' || (qid % 20) AS scope, unnest(list_distinct({TK.format('text')})) AS term FROM q),
tg AS (SELECT qid, stem, count(*) AS tagged FROM qt JOIN (SELECT scope, stem, unnest(ents) AS term FROM cd) USING (scope, term) GROUP BY ALL), sh AS (SELECT qid, stem, count(*) AS shared FROM qt JOIN (SELECT scope, stem, unnest(w) AS term FROM cd) USING (scope, term) GROUP BY ALL)
SELECT qid, stem, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY round(score, 6) DESC, stem) AS rank FROM (SELECT qid, stem, 3 * tagged + coalesce(shared, 0) + 2 * ln(1 + recurrence) AS score FROM tg LEFT JOIN sh USING (qid, stem) JOIN cd USING (stem)) QUALIFY rank <= 5""")
def replication_rank(t):
    notes = t.notes.select(F.col("project").alias("scope"), "stem", "recurrence", "valid_from", "valid_to", r.tokens("title").alias("entities"), F.concat_ws(" ", "title", "descr").alias("body"))
    return rounded(r.replication(queries(t), notes, "2024-10-01"), "score")


def robust_sql(source: str, value: str, name: str) -> str:
    return f"SELECT qid, stem, ({value} - mid) / CASE WHEN mad = 0 THEN 1 ELSE mad END AS {name} FROM (SELECT *, 1.4826 * quantile_cont(abs({value} - mid), 0.5) OVER (PARTITION BY qid) AS mad FROM (SELECT *, quantile_cont({value}, 0.5) OVER (PARTITION BY qid) AS mid FROM {source}))"


@query(FUSED + f", rs AS ({robust_sql('se', 'sim', 'rs')}), rl AS ({robust_sql('bm', 'lex', 'rl')}), pk AS (SELECT qid, max(zs) AS peak FROM zs GROUP BY 1)" + """
SELECT qid, stem, round(0.5 * coalesce(rs, -3) + coalesce(rl, -3), 6) AS robust, round(0.5 * coalesce(zs, -3) + coalesce(zl, -3) + 0.25 * coalesce(zs * zl, 0), 6) AS agree, round(coalesce(zs, -3) / (1 + 0.25 * coalesce(peak, 0)) + coalesce(zl, -3), 6) AS adaptive
FROM (SELECT * FROM zs FULL JOIN zl USING (qid, stem)) JOIN (SELECT * FROM rs FULL JOIN rl USING (qid, stem)) USING (qid, stem) LEFT JOIN pk USING (qid)""")
def fusion_variants(t):
    return rounded(r.fusion_variants(sem(t), r.bm25(queries(t), docs(t))), "robust", "agree", "adaptive")


@query(OWN + """, hm AS (SELECT qid, stem, list_cosine_similarity(qvec, vec) AS sim, list_sum(list_transform(list_zip(qvec, vec), lambda p: CAST((p[1] >= 0) <> (p[2] >= 0) AS INT))) AS bits FROM qs JOIN cd USING (scope) WHERE qvec IS NOT NULL AND vec IS NOT NULL),
po AS (SELECT * FROM hm QUALIFY row_number() OVER (PARTITION BY qid ORDER BY bits, stem) <= 15) SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY sim DESC, stem) AS rank, round(sim, 6) AS sim FROM po QUALIFY rank <= 5""")
def quantize_binary(t):
    return rounded(r.quantized(queries(t), docs(t), 64, 5, 15), "sim")


@query(OWN + " SELECT qid, stem, round(list_cosine_similarity(qvec, list_transform(vec, lambda x: CASE WHEN x >= 0 THEN 1.0 ELSE -1.0 END)), 6) AS sim FROM qs JOIN cd USING (scope) WHERE qvec IS NOT NULL AND vec IS NOT NULL")
def quantize_asymmetric(t):
    return rounded(r.asymmetric(queries(t), docs(t)), "sim")


@query(OWN + """, sz AS (SELECT scope, count(*) AS n FROM cd GROUP BY 1), lx AS (SELECT qid, stem FROM bm JOIN qs USING (qid) JOIN sz USING (scope) WHERE n > 30 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY round(lex, 9) DESC, stem) <= 30)
SELECT qid, stem FROM qs JOIN sz USING (scope) JOIN cd USING (scope) WHERE n <= 30 UNION ALL SELECT * FROM lx UNION ALL SELECT qid, stem FROM (SELECT qid, scope FROM qs JOIN sz USING (scope) WHERE n > 30 AND qid NOT IN (SELECT qid FROM lx)) JOIN (SELECT scope, stem FROM cd QUALIFY row_number() OVER (PARTITION BY scope ORDER BY recurrence DESC, stem) <= 30) USING (scope)""")
def prefilter_topn(t):
    return r.prefilter(queries(t), docs(t), 30)


@query(OWN + " SELECT qid, stem, rank FROM (SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY round(sim, 6) DESC, stem) AS rank FROM sm) WHERE rank <= 10")
def topk_per_query(t):
    return r.top(rounded(r.similarities(queries(t), docs(t)), "sim"), ["qid"], [F.desc("sim"), "stem"], 10).select("qid", "stem", "rank")


@query(ALL + """, rk AS (SELECT qid, doc_id, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, stem) AS rank FROM bm JOIN cd USING (stem) QUALIFY rank <= 10),
fr AS (SELECT q.qid, min(rank) AS r FROM (SELECT DISTINCT qid FROM qrels) q LEFT JOIN (SELECT rk.* FROM rk JOIN qrels USING (qid, doc_id)) USING (qid) GROUP BY 1)
SELECT count(*) AS questions, round(avg(CASE WHEN r <= 1 THEN 1.0 ELSE 0 END), 6) AS recall_1, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0 END), 6) AS recall_3, round(avg(CASE WHEN r <= 5 THEN 1.0 ELSE 0 END), 6) AS recall_5, round(avg(CASE WHEN r <= 10 THEN 1.0 ELSE 0 END), 6) AS recall_10, round(avg(coalesce(1.0 / r, 0)), 6) AS mrr FROM fr""")
def eval_recall_mrr(t):
    ranked = r.top(rounded(r.bm25(queries(t, "*"), docs(t, "*")), "lex"), ["qid"], [F.desc("lex"), "stem"], 10)
    rel = t.qrels.join(t.plain_notes.select("doc_id", "stem"), "doc_id").select("qid", "stem")
    return r.eval_recall(ranked, rel)
