"""Batched hybrid retrieval: BM25 and cosine scores, gates, fusion, priors, rankers.

Queries are a table (qid, scope, text, qvec); candidates a table (scope, stem,
body, vec, recurrence, ...). A scope is the candidate set of a query: a project,
or one constant for the whole store. All statistics of BM25 are per scope.
Postings are kept for the queries' terms only, counted before they are shuffled, and
stored, so that a call reads and cuts every text once. Scores that several steps read
are stored too. Statistics of a query are sums and extremes, joined back; no window
holds all candidates of a query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions import numbers
from lorekeep.functions.text import token_list, tokens
from lorekeep.shared import stored

K1, B = 1.5, 0.75
SIM_FLOOR, NEAR_FLOOR, CROSS_FLOOR, MARGIN = 0.40, 0.15, 0.50, 0.15
AMBIGUITY_K, SEM_WEIGHT, RRF_SEM_WEIGHT, RRF_K0, MISSING = 15, 0.5, 2.0, 60, -3.0
RECUR_FUSION, RECUR_RRF, RECUR_COSINE = 0.02, 0.0003, 0.03
PREFILTER = 600
#: Digits to which scores are ranked: sums of equal parts in another order are ties, which the stem settles.
RANKED = 9
#: Query terms or queries up to which that side is broadcast.
SMALL_ROWS = 200_000


def small(df: DataFrame, bound: DataFrame | None = None) -> DataFrame:
    """`df` with a broadcast hint if it, or a table that has no fewer rows and is cheaper to count, is within the bound."""
    return F.broadcast(df) if (df if bound is None else bound).count() <= SMALL_ROWS else df


def top(df: DataFrame, by: list[str], order: list, k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)


def query_terms(queries: DataFrame) -> DataFrame:
    return queries.select("qid", "scope", F.explode(tokens("text")).alias("term"))


def postings(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(scope, stem, term, tf, dl): the queries' terms in each candidate, and a row without a term for every candidate."""
    asked = query_terms(queries).select("scope", "term").distinct()
    asked = asked.union(docs.select("scope").distinct().select("scope", F.lit(None).cast("string").alias("term")))
    asked = small(stored(asked.select(F.col("scope").alias("s"), F.col("term").alias("t")), "asked"))
    words = docs.select("scope", "stem", token_list("body").alias("w"))
    each = words.select("scope", "stem", F.size("w").alias("dl"), F.explode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("term"))
    held = each.join(asked, (F.col("scope") == F.col("s")) & F.col("term").eqNullSafe(F.col("t")))
    return stored(held.groupBy("scope", "stem", "term", "dl").agg(F.count("*").alias("tf")), "postings")


def bm25(queries: DataFrame, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(qid, stem, lex): positive BM25 scores; N, df and mean length are those of the query's scope."""
    index = postings(queries, docs) if index is None else index
    stats = index.where("term IS NULL").groupBy("scope").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    tf = index.where("term IS NOT NULL")
    df = small(stored(tf.groupBy("scope", "term").agg(F.count("*").alias("df")).join(stats, "scope"), "df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    scored = tf.join(df, ["scope", "term"]).select("scope", "term", "stem", weight.alias("s"))
    return query_terms(queries).join(scored, ["scope", "term"]).groupBy("qid", "stem").agg(F.sum("s").alias("lex"))


def overlap(queries: DataFrame, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(qid, stem, shared): number of distinct query terms in each candidate, when there is one."""
    index = postings(queries, docs) if index is None else index
    held = index.where("term IS NOT NULL").select("scope", "term", "stem")
    return query_terms(queries).join(held, ["scope", "term"]).groupBy("qid", "stem").agg(F.count("*").alias("shared"))


def lex_overlap(queries: DataFrame, docs: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """(qid, stem, score): shared terms over the root of the query's terms, plus the recurrence prior."""
    size = queries.select("qid", F.size(tokens("text")).alias("nq"))
    shared = overlap(queries, docs, index).join(small(size), "qid").join(docs.select("stem", "recurrence"), "stem")
    return shared.select("qid", "stem", (F.col("shared") / F.sqrt("nq") + RECUR_COSINE * F.log(F.col("recurrence").cast("double"))).alias("score"))


#: Query vectors up to which they go to the tasks as one matrix a scope.
MATRIX_ROWS = 20_000


def similarities(queries: DataFrame, docs: DataFrame, kept: DataFrame | None = None) -> DataFrame:
    """(qid, stem, sim): cosine of every query with every embedded candidate of its scope, or with those in `kept` (qid, stem) alone.

    Query vectors within a bound are multiplied as a matrix with each batch of candidates; more of them meet by a join.
    """
    q = queries.where("qvec IS NOT NULL").select("qid", "scope", F.col("qvec").cast("array<double>").alias("qvec"))
    d = docs.where("vec IS NOT NULL").select("scope", "stem", F.col("vec").cast("array<double>").alias("vec"))
    value = F.coalesce(F.try_divide(numbers.dot("qvec", "vec"), numbers.norm("qvec") * numbers.norm("vec")), F.lit(0.0))
    if kept is not None:
        return kept.select("qid", "stem").join(d.select("stem", "vec"), "stem").join(small(q.select("qid", "qvec"), queries), "qid").select("qid", "stem", value.alias("sim"))
    if q.count() > MATRIX_ROWS:
        return d.join(q, "scope").select("qid", "stem", value.alias("sim"))
    kind = queries.schema["qid"].dataType.simpleString()
    held: dict[tuple[str, int], list] = {}
    for r in q.collect():
        held.setdefault((r.scope, len(r.qvec)), []).append((r.qid, r.qvec))
    unit = lambda m: m / np.where((n := np.linalg.norm(m, axis=1)) > 0, n, 1.0)[:, None]
    shared = queries.sparkSession.sparkContext.broadcast({k: ([i for i, _ in v], unit(np.array([x for _, x in v], float))) for k, v in held.items()})

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            parts = []
            for (scope, size), own in pdf.groupby(["scope", pdf["vec"].map(len)]):
                asked = shared.value.get((scope, size))
                if asked:
                    sim = unit(np.array(own["vec"].tolist(), float)) @ asked[1].T
                    n, m = sim.shape
                    parts.append(pd.DataFrame({"qid": asked[0] * n, "stem": np.repeat(own["stem"].to_numpy(object), m), "sim": sim.ravel()}))
            if parts:
                yield pd.concat(parts)

    return d.mapInPandas(run, f"qid {kind}, stem string, sim double")


def confidence(sims: DataFrame) -> DataFrame:
    """(qid, ambiguity, low): how bunched the best similarities are, and whether none stands out of the background.

    The median is only held against a limit, for which counts on both sides of it and the values next to it suffice.
    """
    best = sims.groupBy("qid").agg(F.max("sim").alias("s1"), F.count("*").alias("n"))
    sim, limit = F.col("sim"), F.col("s1") - MARGIN
    both = sims.join(best, "qid").groupBy("qid", "s1", "n").agg(
        F.count_if(sim == F.col("s1")).alias("firsts"),
        F.max(F.when(sim < F.col("s1"), sim)).alias("next"),
        F.count_if(sim > limit).alias("over"),
        F.min(F.when(sim > limit, sim)).alias("above"),
        F.max(F.when(sim <= limit, sim)).alias("below"),
    )
    s2 = F.when(F.col("firsts") > 1, F.col("s1")).otherwise(F.col("next"))
    ambiguity = F.when(F.col("n") < 2, 1.0).otherwise(F.least(F.lit(1.0), 1 / (1 + AMBIGUITY_K * (F.col("s1") - s2))))
    between = (2 * F.col("over") == F.col("n")) & ((F.col("above") + F.col("below")) / 2 > limit)
    bunched = (2 * F.col("over") > F.col("n")) | F.coalesce(between, F.lit(False))
    low = (F.col("s1") < SIM_FLOOR) | ((F.col("n") >= 4) & bunched)
    return both.select("qid", ambiguity.alias("ambiguity"), low.alias("low"))


def zscores(scores: DataFrame, value: str, name: str) -> DataFrame:
    """Scores less their mean over the population deviation, per query; a lone score is 1."""
    stats = scores.groupBy("qid").agg(F.count("*").alias("_n"), F.avg(value).alias("_mean"), F.stddev_pop(value).alias("_sd"))
    z = F.when(F.col("_n") == 1, 1.0).otherwise((F.col(value) - F.col("_mean")) / F.when(F.col("_sd") == 0, 1.0).otherwise(F.col("_sd")))
    return scores.join(stats, "qid").select("qid", "stem", z.alias(name))


def fuse(sem: DataFrame, lex: DataFrame, weight: float = SEM_WEIGHT) -> DataFrame:
    """(qid, stem, score): logistic of the weighted z-scores; a missing signal counts as far below."""
    sem, lex = stored(sem.select("qid", "stem", "sim"), "sem"), stored(lex.select("qid", "stem", "lex"), "lex")
    both = zscores(sem, "sim", "zs").join(zscores(lex, "lex", "zl"), ["qid", "stem"], "full")
    z = weight * F.coalesce("zs", F.lit(MISSING)) + F.coalesce("zl", F.lit(MISSING))
    return both.select("qid", "stem", (1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))).alias("score"))


def rrf(signals: list[tuple[DataFrame, str, float]]) -> DataFrame:
    """(qid, stem, score): weighted reciprocal ranks of several (scores, column, weight)."""
    parts = []
    for scores, value, weight in signals:
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.round(value, RANKED).desc(), "stem"))
        parts.append(scores.select("qid", "stem", (weight / (RRF_K0 + rank)).alias("part")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.groupBy("qid", "stem").agg(F.sum("part").alias("score"))


def priors(scores: DataFrame, docs: DataFrame, conf: DataFrame, as_of: str, boost: float = RECUR_FUSION, queries: DataFrame | None = None) -> DataFrame:
    """Scores with the ambiguity-scaled recurrence prior and the age, resolution and confidence multiplier."""
    note = docs.select("stem", "date", "recurrence", "resolved", "confidence")
    both = scores.join(note, "stem").join(small(conf.select("qid", "ambiguity"), queries), "qid", "left")
    raised = F.col("score") + boost * F.log(F.col("recurrence").cast("double")) * F.coalesce("ambiguity", F.lit(1.0))
    return both.select("qid", "stem", (raised * numbers.salience_multiplier(numbers.age_days("date", as_of), "recurrence", "resolved", "confidence")).alias("score"))


def recency_fallback(docs: DataFrame, k: int) -> DataFrame:
    """(scope, stem, rank): newest notes per type, mistakes, then patterns, then decisions, k in all."""
    kind = F.when(F.col("ntype") == "mistake", 0).when(F.col("ntype") == "pattern", 1).otherwise(2)
    newest = top(docs.withColumn("kind", kind), ["scope", "kind"], [F.desc("date"), F.desc("stem")], k, "r")
    return top(newest, ["scope"], ["kind", "r"], k).select("scope", "stem", "rank")


def prefilter(queries: DataFrame, docs: DataFrame, limit: int = PREFILTER, lex: DataFrame | None = None) -> DataFrame:
    """(qid, stem): all candidates of a scope of at most `limit` notes, else the `limit` best by BM25, or by recurrence when nothing matches."""
    size = docs.groupBy("scope").agg(F.count("*").alias("n"))
    q = stored(queries.select("qid", "scope").join(size, "scope"), "sizes")
    whole = docs.select("scope", "stem").join(small(q.where(F.col("n") <= limit), queries), "scope").select("qid", "stem")
    large = q.where(F.col("n") > limit).select("qid", "scope")
    if large.isEmpty():
        return whole
    scores = bm25(queries.join(large.select("qid"), "qid", "left_semi"), docs) if lex is None else lex.join(large.select("qid"), "qid", "left_semi")
    lexical = stored(top(scores, ["qid"], [F.round("lex", RANKED).desc(), "stem"], limit).select("qid", "stem"), "lexical")
    none = large.join(lexical.select("qid").distinct(), "qid", "left_anti")
    often = top(docs, ["scope"], [F.desc("recurrence"), "stem"], limit).select("scope", "stem")
    return whole.union(lexical).union(often.join(small(none, queries), "scope").select("qid", "stem"))


def narrow(docs: DataFrame) -> DataFrame:
    """Candidates without their texts, stored: what every step but the postings reads."""
    return stored(docs.drop("body", "text"), "candidates")


def expand(hits: DataFrame, notes: DataFrame, links: DataFrame | None, relations: DataFrame | None, k: int) -> DataFrame:
    """Hits (qid, stem, score, rank, mode) and, behind them, up to `k` notes that they link to or that share a relation's target."""
    near = None
    if links is not None:
        near = hits.select("qid", "stem", "rank").join(links.select("stem", "target"), "stem").select("qid", F.col("target").alias("other"), "rank", F.lit("link").alias("mode"))
    if relations is not None:
        # the newest notes of a target, before the hits meet them
        newest = top(relations.select("stem", "target").distinct().join(notes.select("stem", "date"), "stem"), ["target"], [F.desc("date"), F.desc("stem")], k + 1, "r").select("target", F.col("stem").alias("other"))
        shared = hits.select("qid", "stem", "rank").join(relations.select("stem", "target").distinct(), "stem").join(newest, "target").where("stem <> other").select("qid", "other", "rank", F.lit("relation").alias("mode"))
        near = shared if near is None else near.unionByName(shared)
    if near is None:
        return hits
    known = notes.select(F.col("stem").alias("other")).distinct()
    fresh = near.join(known, "other", "left_semi").join(hits.select("qid", F.col("stem").alias("other")), ["qid", "other"], "left_anti")
    first = fresh.groupBy("qid", "other").agg(F.min(F.struct("rank", "mode")).alias("m"))
    behind = top(first.select("qid", F.col("other").alias("stem"), "m.rank", "m.mode"), ["qid"], ["rank", "stem"], k, "at")
    last = hits.groupBy("qid").agg(F.max("rank").alias("last"))
    return hits.unionByName(behind.join(last, "qid").select("qid", "stem", F.lit(None).cast("double").alias("score"), (F.col("last") + F.col("at")).alias("rank"), "mode"))


def retrieve(queries: DataFrame, docs: DataFrame, k: int, as_of: str, limit: int | None = PREFILTER, salience: DataFrame | None = None, links: DataFrame | None = None, relations: DataFrame | None = None, more: int = 2) -> DataFrame:
    """(qid, stem, score, rank, mode): the injection ranker; newest notes when a query has no signal.

    In a scope of over `limit` notes a query's candidates are its `limit` best by BM25 (null: all of them). `salience` (stem,
    salience) raises scores by the notes' place in the graph; `links` (stem, target) and `relations` (stem,
    target) add up to `more` notes behind each query's hits.
    """
    queries, note, index = stored(queries, "queries"), narrow(docs), postings(queries, docs)
    lex = stored(bm25(queries, note, index), "lex")
    if limit is None:
        sims = similarities(queries, note)
    else:
        kept = prefilter(queries, note, limit, lex)
        # in scopes within the limit every candidate is kept, and a matrix is quicker than pairs
        size = stored(note.groupBy("scope").agg((F.count("*") <= limit).alias("whole")), "scopes")
        of = queries.join(small(size), "scope")
        sims = similarities(of.where("whole"), note)
        if not of.where("NOT whole").isEmpty():
            sims = sims.unionByName(similarities(of.where("NOT whole"), note, kept.join(small(of.where("NOT whole").select("qid"), queries), "qid", "left_semi")))
        lex = lex.join(kept, ["qid", "stem"], "left_semi")
    sims = stored(sims, "sims")
    conf = stored(confidence(sims), "confidence")
    sem = sims.join(small(conf.where("NOT low").select("qid"), queries), "qid").where(F.col("sim") > SIM_FLOOR)
    scored = priors(fuse(sem, lex), note, conf, as_of, queries=queries)
    if salience is not None:
        scored = scored.join(salience.select("stem", "salience"), "stem", "left").select("qid", "stem", (F.col("score") * (1 + F.coalesce("salience", F.lit(0.0)))).alias("score"))
    hits = stored(top(scored, ["qid"], [F.round("score", RANKED).desc(), "stem"], k).select("qid", "stem", "score", "rank", F.lit("fused").alias("mode")), "hits")
    silent = queries.select("qid", "scope").join(hits.select("qid").distinct(), "qid", "left_anti")
    recent = recency_fallback(note, k).join(small(silent, queries), "scope").select("qid", "stem", F.lit(None).cast("double").alias("score"), "rank", F.lit("recent").alias("mode"))
    return expand(hits, note, links, relations, more).unionByName(recent)


def search(queries: DataFrame, docs: DataFrame, k: int, as_of: str, limit: int | None = None) -> DataFrame:
    """(qid, stem, score, low, rank): the search ranker over embedded notes, then text-only notes by overlap.

    With `limit` the embedded candidates of a query in a larger scope are its `limit` best by BM25, before any cosine.
    """
    queries, note, index = stored(queries, "queries"), narrow(docs), postings(queries, docs)
    embedded, plain = note.where("vec IS NOT NULL"), note.where("vec IS NULL")
    part = lambda rows: index.join(rows.select("stem"), "stem", "left_semi")
    lex, kept = bm25(queries, embedded, part(embedded)), None
    if limit is not None:
        lex = stored(lex, "lex")
        kept = stored(prefilter(queries, embedded, limit, lex), "kept")
        lex = lex.join(kept, ["qid", "stem"], "left_semi")
    sims = stored(similarities(queries, embedded, kept), "sims")
    conf = stored(confidence(sims), "confidence")
    fused = priors(fuse(sims.where(F.col("sim") > NEAR_FLOOR), lex), embedded, conf, as_of, queries=queries)
    first = fused.join(small(conf.select("qid", "low"), queries), "qid", "left").select("qid", "stem", "score", F.coalesce("low", F.lit(True)).alias("low"), F.lit(0).alias("tier"))
    second = lex_overlap(queries, plain, part(plain)).select("qid", "stem", "score", F.lit(True).alias("low"), F.lit(1).alias("tier"))
    return top(first.unionByName(second), ["qid"], ["tier", F.desc("score"), "stem"], k).select("qid", "stem", "score", "low", "rank")


def cross_project(queries: DataFrame, docs: DataFrame, k: int = 2) -> DataFrame:
    """(qid, stem, score, rank) from other projects than the query's (column project): strict cosine and overlap lists, fused by rank."""
    own = queries.select("qid", F.col("project").alias("own"))
    other = lambda df: df.join(docs.select("stem", "project"), "stem").join(small(own), "qid").where("project <> '' AND project <> own").drop("project", "own")
    sem = other(similarities(queries, docs).where(F.col("sim") > CROSS_FLOOR))
    lex = other(overlap(queries, docs).where("shared >= 2"))
    return top(rrf([(sem, "sim", 1.0), (lex, "shared", 1.0)]), ["qid"], [F.desc("score"), "stem"], k).select("qid", "stem", "score", "rank")


def posterior(scores: DataFrame, docs: DataFrame, as_of: str) -> DataFrame:
    """Log-linear posterior of relevance, recurrence and salience."""
    note = docs.select("stem", "date", "recurrence", "resolved", "confidence")
    mult = numbers.salience_multiplier(numbers.age_days("date", as_of), "recurrence", "resolved", "confidence")
    value = F.log("score") + 0.3 * F.log(F.col("recurrence").cast("double")) + F.log(F.greatest(F.lit(1e-12), mult))
    return scores.join(note, "stem").select("qid", "stem", value.alias("score"))


def min_max(scores: DataFrame, *values: str) -> DataFrame:
    """`scores` with `values` scaled to [0, 1] in each query by its extremes; one half when all are equal."""
    ends = scores.groupBy("qid").agg(*[f(v).alias(f"_{n}_{v}") for v in values for n, f in (("low", F.min), ("high", F.max))])
    both = scores.join(ends, "qid")
    scaled = {v: F.when(F.col(f"_high_{v}") == F.col(f"_low_{v}"), 0.5).otherwise((F.col(v) - F.col(f"_low_{v}")) / (F.col(f"_high_{v}") - F.col(f"_low_{v}"))) for v in values}
    return both.withColumns(scaled).select(*scores.columns)


def linear_blend(scores: DataFrame, docs: DataFrame, weight: float, log: bool = True) -> DataFrame:
    often = F.log(F.col("recurrence").cast("double")) if log else (F.col("recurrence") - 1).cast("double")
    both = stored(scores.join(docs.select("stem", often.alias("often")), "stem").select("qid", "stem", "score", "often"), "blend")
    return min_max(both, "score", "often").select("qid", "stem", ((1 - weight) * F.col("score") + weight * F.col("often")).alias("score"))


def mmr(scores: DataFrame, docs: DataFrame, k: int, divergence: float = 0.3) -> DataFrame:
    """(qid, stem, rank): greedy relevance less similarity to what is chosen, over the best 4k of each query."""
    window = top(scores, ["qid"], [F.desc("score"), "stem"], 4 * k, "at").join(docs.select("stem", "vec"), "stem")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        rel = pdf["score"].to_numpy()
        spread = rel.max() - rel.min()
        rel = (rel - rel.min()) / spread if spread else np.full(len(rel), 0.5)
        dim = max((len(v) for v in pdf["vec"] if v is not None), default=1)
        unit = np.array([np.zeros(dim) if v is None else np.asarray(v) / (np.linalg.norm(v) or 1) for v in pdf["vec"]])
        near, left, order = np.full(len(rel), -np.inf), list(range(len(rel))), []
        while left:
            value = (1 - divergence) * rel[left] - divergence * near[left] if order else rel[left]
            best = left[int(np.argmax(value))]
            order.append(best)
            left.remove(best)
            near = np.maximum(near, unit @ unit[best])
        return pd.DataFrame({"qid": pdf["qid"].iloc[0], "stem": pdf["stem"].to_numpy()[order[:k]], "rank": np.arange(1, min(k, len(order)) + 1)})

    kind = scores.schema["qid"].dataType.simpleString()
    return window.groupBy("qid").applyInPandas(choose, f"qid {kind}, stem string, rank int")


def bridge(scores: DataFrame, docs: DataFrame, centroids: DataFrame, divergence: float = 0.75) -> DataFrame:
    """(qid, stem, score): relevance blended with how close a note is to two topics at once (centroids: topic, cvec)."""
    near = docs.where("vec IS NOT NULL").select("stem", "vec").crossJoin(small(centroids)).select("stem", "topic", numbers.cosine("vec", "cvec").alias("sim"))
    two = top(near, ["stem"], [F.desc("sim"), "topic"], 2, "r").groupBy("stem").agg(F.greatest(F.lit(0.0), F.product(F.greatest(F.lit(0.0), F.col("sim")))).alias("bridge"))
    return scores.join(two, "stem").select("qid", "stem", ((1 - divergence) * F.col("score") + divergence * F.col("bridge")).alias("score"))


def rare_event(scores: DataFrame, docs: DataFrame, consequence: Column, gated: bool = False, weight: float = 0.35) -> DataFrame:
    """Scores raised for notes whose consequence is large for how rarely they recur."""
    both = stored(scores.join(docs.select("stem", (consequence / (1 + F.log1p(F.col("recurrence").cast("double")))).alias("f")), "stem").select("qid", "stem", "score", "f"), "rare")
    value = F.col("score") * (1 + weight * F.col("f")) if gated else F.col("score") + weight * F.col("f")
    return min_max(both, "f").select("qid", "stem", value.alias("score"))


def rocchio(queries: DataFrame, docs: DataFrame, k0: int = 3, beta: float = 0.4) -> DataFrame:
    """(qid, stem, sim): candidates re-scored by the query moved towards the mean of its nearest notes."""
    first = top(similarities(queries, docs), ["qid"], [F.desc("sim"), "stem"], k0).join(docs.select("stem", "vec"), "stem")
    mean = first.select("qid", F.posexplode("vec").alias("at", "x")).groupBy("qid", "at").agg(F.avg("x").alias("x"))
    mean = mean.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda e: e["x"]).alias("mean"))
    unit = F.transform("mean", lambda x: x / numbers.norm("mean"))
    moved = queries.join(mean, "qid").withColumn("qvec", F.zip_with("qvec", unit, lambda a, b: (1 - beta) * a + beta * b)).drop("mean")
    return similarities(moved, docs)


def rerank(pool: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(qid, stem, rank): a pool (qid, stem, rank) in the order of external scores (qid, stem, relevance); unscored rows keep their order behind."""
    both = pool.withColumnRenamed("rank", "was").join(relevance, ["qid", "stem"], "left")
    return top(both, ["qid"], [F.desc_nulls_last("relevance"), "was", "stem"], k).select("qid", "stem", "rank")


def fusion_variants(sem: DataFrame, lex: DataFrame, agreement: float = 0.25) -> DataFrame:
    """(qid, stem, robust, agree, adaptive): median-based z-scores, an agreement term, and a peak-dependent semantic weight."""

    def robust(scores: DataFrame, value: str, name: str) -> DataFrame:
        mid = scores.groupBy("qid").agg(F.percentile(value, F.lit(0.5)).alias("mid"))
        away = scores.join(mid, "qid").withColumn("away", F.abs(F.col(value) - F.col("mid")))
        mad = away.groupBy("qid").agg((1.4826 * F.percentile("away", F.lit(0.5))).alias("mad"))
        scale = F.when(F.col("mad") == 0, 1.0).otherwise(F.col("mad"))
        return away.join(mad, "qid").select("qid", "stem", ((F.col(value) - F.col("mid")) / scale).alias(name))

    at = lambda c: F.coalesce(c, F.lit(MISSING))
    z = zscores(sem, "sim", "zs").join(zscores(lex, "lex", "zl"), ["qid", "stem"], "full")
    r = robust(sem, "sim", "rs").join(robust(lex, "lex", "rl"), ["qid", "stem"], "full")
    z = stored(z, "z")
    peak = z.groupBy("qid").agg(F.coalesce(F.max("zs"), F.lit(0.0)).alias("peak"))
    both = z.join(peak, "qid").join(r, ["qid", "stem"])
    agree = SEM_WEIGHT * at("zs") + at("zl") + agreement * F.coalesce(F.col("zs") * F.col("zl"), F.lit(0.0))
    adaptive = at("zs") / (1 + 0.25 * F.col("peak")) + at("zl")
    return both.select("qid", "stem", (SEM_WEIGHT * at("rs") + at("rl")).alias("robust"), agree.alias("agree"), adaptive.alias("adaptive"))


def quantized(queries: DataFrame, docs: DataFrame, dim: int, k: int = 10, exact: int = 50) -> DataFrame:
    """(qid, stem, rank, sim): best by sign-code Hamming distance, the first `exact` of them re-scored by cosine."""
    q = queries.where("qvec IS NOT NULL").select("qid", "scope", "qvec", numbers.sign_words("qvec", dim).alias("qc"))
    d = docs.where("vec IS NOT NULL").select("scope", "stem", "vec", numbers.sign_words("vec", dim).alias("dc"))
    near = d.join(small(q), "scope").select("qid", "stem", "qvec", "vec", numbers.hamming("qc", "dc").alias("bits"))
    pool = top(near, ["qid"], ["bits", "stem"], exact, "r").withColumn("sim", numbers.cosine("qvec", "vec"))
    return top(pool, ["qid"], [F.desc("sim"), "stem"], k).select("qid", "stem", "rank", "sim")


def asymmetric(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, stem, sim): cosine of the float query with the note's signs."""
    signs = F.transform("vec", lambda x: F.when(x >= 0, 1.0).otherwise(-1.0))
    return similarities(queries, docs.where("vec IS NOT NULL").withColumn("vec", signs))


def passages(pairs: DataFrame, budget: int) -> DataFrame:
    """Pairs (qid, stem, text, query) to (qid, stem, passage): the lines nearest the query within a budget of characters, in their order."""
    lines = pairs.select("qid", "stem", tokens("query").alias("qt"), F.posexplode(F.split("text", "\n")).alias("at", "line")).where("trim(line) <> ''")
    scored = lines.withColumn("shared", F.size(F.array_intersect("qt", tokens("line")))).withColumn("cost", F.length("line") + 1)
    running = F.sum("cost").over(Window.partitionBy("qid", "stem").orderBy(F.desc("shared"), "at").rowsBetween(Window.unboundedPreceding, 0))
    kept = scored.withColumn("used", running).where(F.col("used") <= budget)
    return kept.groupBy("qid", "stem").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda e: e["line"]), "\n").alias("passage"))


def context(chosen: DataFrame, budget: int, least: int = 1200) -> DataFrame:
    """Chosen (qid, rank, text) to (qid, context): an equal share of characters of each, joined, cut at the budget."""
    share = F.greatest(F.lit(least), F.floor(F.lit(budget) / F.count("*").over(Window.partitionBy("qid")))).cast("int")
    cut = chosen.withColumn("share", share).withColumn("part", F.col("text").substr(F.lit(1), F.col("share")))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda e: e["part"])
    return cut.groupBy("qid").agg(F.substring(F.array_join(ordered, "\n\n"), 1, budget).alias("context"))


def replication(queries: DataFrame, docs: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """(qid, stem, score, rank): entity-gated relevance plus replication, among notes valid at a day (docs: entities, text terms as body)."""
    valid = docs.where((F.col("valid_from") <= F.lit(as_of).cast("date")) & (F.col("valid_to").isNull() | (F.col("valid_to") > F.lit(as_of).cast("date"))))
    terms = query_terms(queries)
    shared = overlap(queries, valid)
    tagged = terms.join(valid.select("scope", "stem", F.explode("entities").alias("term")), ["scope", "term"]).groupBy("qid", "stem").agg(F.count("*").alias("tagged"))
    both = tagged.join(shared, ["qid", "stem"], "left").join(valid.select("stem", "recurrence"), "stem")
    score = 3 * F.col("tagged") + F.coalesce("shared", F.lit(0)) + 2 * F.log1p(F.col("recurrence").cast("double"))
    return top(both.withColumn("score", score), ["qid"], [F.desc("score"), "stem"], k).select("qid", "stem", "score", "rank")


def eval_recall(ranked: DataFrame, qrels: DataFrame) -> DataFrame:
    """One row: questions with a relevant document, recall at 1, 3, 5 and 10, and MRR of rankings (qid, stem, rank) against (qid, stem)."""
    first = qrels.select("qid").distinct().join(ranked.join(qrels, ["qid", "stem"]).groupBy("qid").agg(F.min("rank").alias("r")), "qid", "left")
    at = [F.bround(F.avg(F.when(F.col("r") <= k, 1.0).otherwise(0.0)), 6).alias(f"recall_{k}") for k in (1, 3, 5, 10)]
    return first.agg(F.count("*").alias("questions"), *at, F.bround(F.avg(F.coalesce(1 / F.col("r"), F.lit(0.0))), 6).alias("mrr"))


