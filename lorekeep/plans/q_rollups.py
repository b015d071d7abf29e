"""Queries over digests, cards, vocabularies and accounts."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.fixtures import Tables
from lorekeep.operators import rollups as r
from lorekeep.plans.registry import query

SINCE = "2024-11-01"
TAGS = "[lang, slug, CASE WHEN n_chars > 2000 THEN 'long' ELSE 'short' END, ntype]"


def tagged(t: Tables, rows=None):
    size = F.when(F.col("n_chars") > 2000, "long").otherwise("short")
    return (t.live if rows is None else rows).withColumn("tags", F.array("lang", "slug", size, "ntype"))


@query(f"SELECT count(*) FILTER (status = 'live') AS live, count(*) FILTER (status <> 'live') AS superseded, count(DISTINCT project) FILTER (status = 'live') AS projects, count(*) FILTER (status = 'live' AND date >= DATE '{SINCE}') AS added, count(*) FILTER (status = 'superseded' AND coalesce(valid_to, date) >= DATE '{SINCE}') AS revised FROM n")
def digest_totals(t):
    return r.digest_totals(t.notes, SINCE)


@query(f"SELECT project, count(*) FILTER (status = 'live') AS total, count(*) FILTER (status = 'live' AND date >= DATE '{SINCE}') AS added, count(*) FILTER (status <> 'live' AND coalesce(valid_to, date) >= DATE '{SINCE}') AS superseded, count(*) FILTER (status = 'live' AND ntype = 'mistake') AS mistakes, count(*) FILTER (status = 'live' AND ntype = 'pattern') AS patterns, count(*) FILTER (status = 'live' AND ntype = 'decision') AS decisions FROM n GROUP BY 1")
def digest_by_project(t):
    return r.digest_by_project(t.notes, SINCE)


@query("SELECT project, ntype, count(*) AS notes FROM n GROUP BY ROLLUP (project, ntype)")
def digest_subtotals(t):
    return r.subtotals(t.plain_notes)


CARD = f""", tg AS (SELECT *, {TAGS} AS tags FROM live),
op AS (SELECT project, stem, row_number() OVER (PARTITION BY project ORDER BY recurrence DESC, date DESC, coalesce(confidence, 1) DESC, stem DESC) AS rank FROM live WHERE ntype = 'mistake' AND NOT resolved QUALIFY rank <= 5),
cd AS (SELECT project, 'status' AS section, 1 AS rank, max_by(title, {{'d': date, 's': stem}}) AS item FROM live GROUP BY 1
  UNION ALL SELECT project, 'topic', row_number() OVER (PARTITION BY project ORDER BY c DESC, tag), tag FROM (SELECT project, tag, count(*) AS c FROM (SELECT project, unnest(tags) AS tag FROM tg) WHERE tag NOT IN ('mistake', 'pattern', 'decision', 'session', 'index', 'general') GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY project ORDER BY c DESC, tag) <= 8
  UNION ALL SELECT project, 'open', rank, stem FROM op
  UNION ALL SELECT project, 'decision', row_number() OVER d, stem FROM live WHERE ntype = 'decision' WINDOW d AS (PARTITION BY project ORDER BY date DESC, recurrence DESC, coalesce(confidence, 1) DESC, stem DESC) QUALIFY row_number() OVER d <= 5
  UNION ALL SELECT project, 'recurring', row_number() OVER o, stem FROM live WHERE recurrence >= 2 AND stem NOT IN (SELECT stem FROM op) WINDOW o AS (PARTITION BY project ORDER BY recurrence DESC, date DESC, stem DESC) QUALIFY row_number() OVER o <= 3)"""


@query(CARD + " SELECT project, section, rank, item FROM cd")
def project_card(t):
    return r.project_card(tagged(t))


BEST = "row_number() OVER (PARTITION BY entity ORDER BY n DESC, item)"


@query(f""", le AS (SELECT * FROM ne WHERE status = 'live'),
c AS (SELECT entity, 'mentions' AS section, 1 AS rank, CAST(min(date) AS VARCHAR) || ' ' || CAST(max(date) AS VARCHAR) AS item, count(*) AS n FROM ne GROUP BY 1
  UNION ALL SELECT entity, 'evolution', 1, 'superseded', count(*) FROM ne WHERE status = 'superseded' GROUP BY 1
  UNION ALL SELECT entity, 'project', {BEST}, item, n FROM (SELECT entity, project AS item, count(*) AS n FROM ne GROUP BY ALL)
  UNION ALL SELECT * FROM (SELECT entity, 'neighbour', {BEST} AS rank, item, n FROM (SELECT a.entity, b.entity AS item, count(*) AS n FROM le a JOIN le b USING (stem) WHERE a.entity <> b.entity GROUP BY ALL)) WHERE rank <= 8
  UNION ALL SELECT * FROM (SELECT entity, 'edge', {BEST} AS rank, item, n FROM (SELECT entity, rel || ' ' || target AS item, count(*) AS n FROM le JOIN nr USING (stem) WHERE nr.status = 'live' GROUP BY ALL)) WHERE rank <= 8
  UNION ALL SELECT * FROM (SELECT entity, ntype, row_number() OVER (PARTITION BY entity, ntype ORDER BY date DESC, stem DESC) AS rank, stem, recurrence FROM le) WHERE rank <= 5)
SELECT entity, section, CAST(rank AS INT) AS rank, item, CAST(n AS BIGINT) AS n FROM c""")
def entity_card(t):
    return r.entity_card(t.entities, t.relations)


@query(f"SELECT tag, count(*) AS notes FROM (SELECT unnest({TAGS}) AS tag FROM n) WHERE tag NOT IN ('mistake', 'pattern', 'decision', 'session', 'index', 'general') GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, 1 LIMIT 30")
def tag_vocab(t):
    return r.tag_vocabulary(tagged(t, t.plain_notes))


@query("SELECT project, ntype, string_agg(slug, ',' ORDER BY stem DESC) AS slugs FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY project, ntype ORDER BY stem DESC) <= 40) GROUP BY ALL")
def title_vocab(t):
    return r.title_vocabulary(t.plain_notes)


@query(r""", w AS (SELECT stem, project, ntype, unnest(list_filter(list_distinct(regexp_extract_all(lower(concat_ws(' ', slug, descr)), '[\p{L}\p{Nl}\p{No}]{3,}|\p{Nd}{3,}')), lambda x: length(x) >= 4 AND NOT regexp_matches(x, '[0-9]'))) AS tok FROM n),
ra AS (SELECT tok FROM w GROUP BY 1 HAVING count(*) <= (SELECT greatest(3, floor(0.22 * count(*))) FROM n)), pe AS (SELECT w.* FROM w JOIN ra USING (tok))
(SELECT 'gotcha' AS kind, tok AS item, count(DISTINCT project) AS n FROM pe WHERE ntype = 'mistake' GROUP BY tok HAVING n >= 2 ORDER BY n DESC, tok DESC LIMIT 8) UNION ALL (SELECT 'style', tok, count(*) AS n FROM pe WHERE ntype = 'pattern' GROUP BY tok HAVING n >= 3 ORDER BY n DESC, tok LIMIT 10)""")
def user_profile(t):
    return r.user_profile(t.plain_notes)


@query("SELECT project, CAST(sum((length(title) + length(descr) + length(prevention) + 2) // 4) AS BIGINT) AS tokens FROM n GROUP BY 1")
def store_tokens(t):
    size = F.length("title") + F.length("descr") + F.length("prevention") + 2
    return t.plain_notes.groupBy("project").agg(F.sum(F.floor(size / 4)).alias("tokens"))


DAILY = ", dl AS (SELECT day, CAST(sum(saved) AS BIGINT) AS saved, CAST(sum(injected) AS BIGINT) AS injected, count(*) FILTER (kind = 'recall') AS recalls, count(*) FILTER (kind = 'guard') AS guards, count(*) FILTER (kind = 'counterfactual') AS counterfactuals FROM led GROUP BY 1)"


@query(DAILY + " SELECT * FROM dl ORDER BY day DESC LIMIT 400")
def daily_ledger(t):
    return r.daily_ledger(t.ledger)


@query(DAILY + " SELECT d AS day, coalesce(saved, 0) AS saved, coalesce(injected, 0) AS injected, coalesce(recalls, 0) AS recalls, coalesce(guards, 0) AS guards, coalesce(counterfactuals, 0) AS counterfactuals FROM (SELECT CAST(unnest(range(DATE '2024-01-20', DATE '2024-02-03', INTERVAL 1 DAY)) AS DATE) AS d) LEFT JOIN dl ON day = d")
def last_days(t):
    return r.last_days(r.daily_ledger(t.ledger), "2024-02-02")


@query("SELECT CAST(SUM(saved) AS BIGINT) AS saved, CAST(sum(injected) AS BIGINT) AS injected, count(*) AS events FROM led")
def ledger_totals(t):
    return t.ledger.agg(F.sum("saved").alias("saved"), F.sum("injected").alias("injected"), F.count("*").alias("events"))


@query("SELECT user_id % 50 AS lesson, count(DISTINCT CASE WHEN event_id % 7 <> 0 THEN user_id END) + count(*) FILTER (event_id % 7 = 0) AS recurrence FROM events GROUP BY 1")
def recurrence_count(t):
    session = F.when(F.col("event_id") % 7 != 0, F.col("user_id"))
    return r.recurrence_count(t.read("events").select((F.col("user_id") % 50).alias("lesson"), session.alias("session")), ["lesson"])


ECON = ", ec AS (SELECT project, length(text) // 4 AS tk, row_number() OVER (PARTITION BY project ORDER BY date DESC, stem DESC) AS k FROM n)"


@query(ECON + " SELECT project, CAST(sum(tk) FILTER (k = 1) AS BIGINT) AS snapshot, CAST(sum(tk) FILTER (k <= 5) AS BIGINT) AS newest, CAST(sum(tk) AS BIGINT) AS journal FROM ec GROUP BY 1")
def token_economy(t):
    return r.token_economy(t.plain_notes)


@query("SELECT project, round(avg(n_chars), 6) AS mean, round(1.96 * stddev_samp(n_chars) / sqrt(count(*)), 6) AS half, count(*) AS n FROM n GROUP BY 1")
def mean_ci(t):
    return r.mean_ci(t.plain_notes, ["project"], "n_chars")


@query(CARD + ECON + ", cc AS (SELECT project, CAST(sum(length(item) // 4) AS BIGINT) AS card FROM cd GROUP BY 1), jj AS (SELECT project, CAST(sum(tk) AS BIGINT) AS journal FROM ec GROUP BY 1) SELECT project, card, journal, round(card / journal, 6) AS ratio FROM cc JOIN jj USING (project) ORDER BY journal DESC, project LIMIT 12")
def card_vs_journal(t):
    card = r.project_card(tagged(t)).groupBy("project").agg(F.sum(F.floor(F.length("item") / 4)).alias("card"))
    journal = r.token_economy(t.plain_notes).select("project", "journal")
    return card.join(journal, "project").select("project", "card", "journal", F.round(F.col("card") / F.col("journal"), 6).alias("ratio")).orderBy(F.desc("journal"), "project").limit(12)
