"""Queries that exercise the plug points with small models, and columns under their own names."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from lorekeep.functions import plugs
from lorekeep.functions import text as tx
from lorekeep.operators import retrieval as r
from lorekeep.plans import q_active, q_hygiene, q_rollups, q_sources
from lorekeep.plans.q_retrieval import OWN, bm25, docs, queries
from lorekeep.plans.registry import query
from lorekeep.sources.notes import extraction_rows


@F.pandas_udf(ArrayType(DoubleType()))
def _sizes(text: pd.Series) -> pd.Series:
    """A model stand-in: characters and spaces of a text."""
    return text.map(lambda t: None if t is None else [float(len(t)), float(t.count(" "))])


@F.pandas_udf(StringType())
def _lesson(body: pd.Series) -> pd.Series:
    """A model stand-in: one pattern titled by the first 30 characters."""
    return body.map(lambda t: json.dumps({"patterns": [{"title": t[:30], "desc": str(len(t))}]}))


@F.pandas_udf(DoubleType())
def _shared(query: pd.Series, text: pd.Series) -> pd.Series:
    """A model stand-in: how many characters of the query's head occur in the text."""
    return pd.Series([float(sum(c in t for c in set(q[:20]))) for q, t in zip(query, text, strict=True)])


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN [1.0, 2.0] ELSE [CAST(length(text) AS DOUBLE), CAST(length(text) - length(replace(text, ' ', '')) AS DOUBLE)] END AS vec, 'new' AS embed_space FROM documents")
def udf_embedder(t):
    key = F.col("doc_id")
    known = F.when(key % 3 != 1, F.array(F.lit(1.0), F.lit(2.0)))
    notes = t.read("documents").select("doc_id", "text", known.alias("vec"), F.when(key % 3 == 0, "new").otherwise("old").alias("embed_space"))
    return plugs.embed(notes, _sizes, "new").select("doc_id", "vec", "embed_space")


@query("SELECT doc_id AS session, trim(substr(text, 1, 30)) AS title, CAST(length(text) AS VARCHAR) AS descr FROM documents WHERE trim(substr(text, 1, 30)) <> ''")
def udf_extractor(t):
    sessions = t.read("documents").select(F.col("doc_id").alias("session"), F.col("source").alias("project"), F.col("text").alias("body"))
    return extraction_rows(plugs.extract(sessions, _lesson)).select("session", "title", "descr")


@query(OWN + ", po AS (SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY round(lex, 6) DESC, stem) AS was FROM bm QUALIFY was <= 8), sc AS (SELECT po.*, len(list_filter(list_distinct(string_split(substr(a.text, 1, 20), '')), lambda x: contains(c.text, x))) AS s FROM po JOIN qs a USING (qid) JOIN cd c USING (stem)) SELECT qid, stem, row_number() OVER (PARTITION BY qid ORDER BY s DESC, was, stem) AS rank FROM sc QUALIFY rank <= 3")
def udf_reranker(t):
    pool = r.top(bm25(t), ["qid"], [F.desc("lex"), "stem"], 8).select("qid", "stem", "rank")
    texts = pool.join(docs(t).select("stem", "text"), "stem").join(queries(t).select("qid", F.col("text").alias("query")), "qid")
    return r.rerank(pool, plugs.relevance(texts, _shared), 3)


@query("SELECT stem, CAST(recurrence * 2 AS DOUBLE) AS utility FROM n")
def udf_utility(t):
    return plugs.utility(t.plain_notes, F.col("recurrence") * 2, tx.tokens("title")).select("stem", "utility")


@query("SELECT stem FROM n WHERE length(title) > 40 AND recurrence % 2 = 1")
def udf_predicate(t):
    return t.plain_notes.where((F.length("title") > 40) & (F.col("recurrence") % 2 == 1)).select("stem")


@query("SELECT stem, 'SCHuka-' || slug || '-Ezh' AS latin FROM n")
def translit(t):
    return t.plain_notes.select("stem", tx.translit(F.concat(F.lit("Щука-"), "slug", F.lit("-Ёж"))).alias("latin"))


@query("SELECT stem, 'my_' || slug || '/x-y' AS tag FROM n")
def slug_tag(t):
    return t.plain_notes.select("stem", tx.slug_tag(F.concat(F.lit(" My "), "slug", F.lit("/X-Y! "))).alias("tag"))


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 4 THEN 0.0 END AS confidence FROM n")
def coerce_confidence(t):
    return q_hygiene.coerce_numbers(t).select("doc_id", "confidence")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 7 ELSE 1 END AS recurrence FROM n")
def coerce_recurrence(t):
    return q_hygiene.coerce_numbers(t).select("doc_id", "recurrence")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 ELSE 0.0 END AS salience FROM n")
def coerce_salience(t):
    return q_hygiene.coerce_numbers(t).select("doc_id", "salience")


@query("SELECT CASE WHEN n_chars > 950000 THEN rtrim(rtrim(printf('%.1f', n_chars / 1000000.0), '0'), '.') || 'M' WHEN n_chars > 950 THEN rtrim(rtrim(printf('%.1f', n_chars / 1000.0), '0'), '.') || 'k' ELSE CAST(n_chars AS VARCHAR) END AS size, count(*) AS documents FROM documents GROUP BY 1")
def human(t):
    return t.read("documents").groupBy(tx.human("n_chars").alias("size")).agg(F.count("*").alias("documents"))


@query(None)
def udaf_fold(t):
    """An ordered fold as an aggregate: guard states from their feedback."""
    return q_active.guard_feedback(t)


@query(" SELECT path, unnest(string_split(body, chr(10))) AS turn FROM (" + q_sources.FLAT + ")")
def udtf_flatten(t):
    """One log to many turns, by explode."""
    return q_sources.agent_log_flatten(t).select("path", F.explode(F.split("body", "\n")).alias("turn"))


@query("SELECT project, tag, count(*) AS notes FROM (SELECT project, unnest([lang, slug]) AS tag FROM live) GROUP BY ALL")
def top_tags(t):
    tags = F.explode(F.array("lang", "slug")).alias("tag")
    return q_rollups.tagged(t).select("project", tags).groupBy("project", "tag").agg(F.count("*").alias("notes"))
