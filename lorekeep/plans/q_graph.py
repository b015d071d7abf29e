"""Queries over the entity and relation graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from lorekeep.fixtures import RELATIONS, Tables
from lorekeep.operators import graph
from lorekeep.plans.registry import query

CONSUMED = [*graph.FORWARD, *graph.REVERSE]
PLAIN = ", le AS (SELECT * FROM ne WHERE status = 'live'), lr AS (SELECT * FROM nr WHERE status = 'live')"
RELATED = PLAIN + ", rb AS (SELECT entity, rel, target, count(*) AS notes FROM le JOIN lr USING (stem) WHERE entity <> target GROUP BY ALL), rg AS (SELECT * FROM rb QUALIFY row_number() OVER (PARTITION BY entity ORDER BY notes DESC, rel, target) <= 8)"
IMPACT = RELATED + f""", im AS (SELECT * FROM (SELECT CASE WHEN rel IN {tuple(graph.FORWARD)} THEN entity WHEN rel IN {tuple(graph.REVERSE)} THEN target END AS cause,
  CASE WHEN rel IN {tuple(graph.FORWARD)} THEN target WHEN rel IN {tuple(graph.REVERSE)} THEN entity END AS effect, rel AS via, notes FROM rg) WHERE cause IS NOT NULL AND cause <> effect)"""


def entities(t: Tables):
    return t.entities.where("status = 'live'")


def relations(t: Tables):
    return t.relations.where("status = 'live'")


def related(t: Tables):
    return graph.related_by(entities(t), relations(t))


def impact(t: Tables):
    return graph.impact_graph(graph.relation_graph(related(t)))


def seeds(t: Tables):
    return t.types.select(F.col("entity").alias("seed")).distinct()


@query(PLAIN + " SELECT entity, count(*) AS notes, min(stem) AS first_stem, max(stem) AS last_stem FROM le GROUP BY 1")
def entity_index(t):
    return graph.entity_index(entities(t))


TYPES = ", ty AS (SELECT entity, max_by(etype, {'d': date, 's': stem}) AS etype FROM nt WHERE status = 'live' GROUP BY 1)"


@query(TYPES + " SELECT * FROM ty")
def entity_types(t):
    return graph.newest_types(t.types.where("status = 'live'"))


@query(TYPES + " SELECT entity FROM ty WHERE etype = 'method'")
def entities_by_type(t):
    return graph.newest_types(t.types.where("status = 'live'")).where("etype = 'method'").select("entity").orderBy("entity")


@query(PLAIN + " SELECT a.entity, b.entity AS other, count(*) AS notes FROM le a JOIN le b ON a.stem = b.stem AND a.entity <> b.entity WHERE a.entity IN ('topic-1', 'lang-en') GROUP BY a.entity, b.entity QUALIFY row_number() OVER (PARTITION BY a.entity ORDER BY count(*) DESC, b.entity) <= 10")
def co_occurring(t):
    return graph.co_occurring(entities(t), ["topic-1", "lang-en"], 10)


@query(PLAIN + " SELECT a.entity AS a, b.entity AS b, count(*) AS notes FROM le a JOIN le b ON a.stem = b.stem AND a.entity < b.entity GROUP BY ALL")
def co_occurrence_all(t):
    return graph.co_occurrence_all(entities(t))


@query(RELATED + " SELECT * FROM rb")
def related_by(t):
    return related(t)


@query(RELATED + " SELECT rg.* FROM rg JOIN (SELECT entity FROM rg GROUP BY 1 ORDER BY sum(notes) DESC, 1 LIMIT 25) USING (entity)")
def relation_graph(t):
    return graph.relation_graph(related(t), 25)


@query(PLAIN + ", h AS (SELECT entity, count(*) AS notes FROM le GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 30) SELECT h.entity, h.notes, b.entity AS other, count(*) AS shared FROM h JOIN le a ON a.entity = h.entity JOIN le b ON a.stem = b.stem AND a.entity <> b.entity GROUP BY h.entity, h.notes, b.entity QUALIFY row_number() OVER (PARTITION BY h.entity ORDER BY count(*) DESC, b.entity) <= 5")
def entity_graph(t):
    return graph.entity_graph(entities(t))


SALIENCE = PLAIN + """, dg AS (SELECT entity, count(*) - 1 AS degree FROM le GROUP BY 1), ib AS (SELECT target AS entity, count(*) AS inbound FROM lr GROUP BY 1),
sm AS (SELECT stem, ln(1 + sum(coalesce(inbound, 0))) + 0.5 * ln(1 + sum(degree)) AS raw FROM le JOIN dg USING (entity) LEFT JOIN ib USING (entity) GROUP BY stem),
sal AS (SELECT stem, round(raw / (SELECT max(raw) FROM sm), 4) AS salience FROM sm)"""


@query(SALIENCE + " SELECT * FROM sal")
def salience_index(t):
    return graph.salience_index(entities(t), relations(t))


@query("SELECT entity, stem, date FROM ne WHERE status = 'live' AND entity = 'topic-3' ORDER BY date DESC, stem DESC LIMIT 20")
def notes_for_entity(t):
    return entities(t).where("entity = 'topic-3'").select("entity", "stem", "date").orderBy(F.desc("date"), F.desc("stem")).limit(20)


HITS = ", hit AS (SELECT doc_id % 20 AS qid, row_number() OVER (PARTITION BY doc_id % 20 ORDER BY date DESC, stem) AS rank, stem FROM live QUALIFY rank <= 3)"


def hits(t):
    live = t.live.select((F.col("doc_id") % 20).alias("qid"), "stem", "date")
    return graph.ranked(live, ["qid"], [F.desc("date"), "stem"], 3, "rank").select("qid", "rank", "stem")


@query(PLAIN + HITS + """, ed AS (SELECT qid, rank, rel, target FROM hit JOIN lr USING (stem)),
nr1 AS (SELECT qid, rank, rel, target, le.stem AS found, row_number() OVER (PARTITION BY qid, rank, rel, target ORDER BY date DESC, le.stem DESC) AS near FROM ed JOIN le ON le.entity = ed.target WHERE NOT EXISTS (SELECT 1 FROM hit h WHERE h.qid = ed.qid AND h.stem = le.stem) QUALIFY near <= 2),
o AS (SELECT * FROM nr1 QUALIFY row_number() OVER (PARTITION BY qid, found ORDER BY rank, rel, target) = 1)
SELECT qid, found AS stem, rel || ' -> ' || target AS via, row_number() OVER (PARTITION BY qid ORDER BY rank, rel, target, near, found) AS place FROM o QUALIFY place <= 10""")
def relation_expand(t):
    return graph.relation_expand(hits(t), relations(t), entities(t))


@query(HITS + """, li AS (SELECT h.qid, min(h.rank) AS rank, nl.target AS stem FROM hit h JOIN nl ON nl.stem = h.stem WHERE nl.target IN (SELECT stem FROM n) AND NOT EXISTS (SELECT 1 FROM hit x WHERE x.qid = h.qid AND x.stem = nl.target) GROUP BY h.qid, nl.target)
SELECT qid, stem, rank FROM li JOIN (SELECT qid, 10 - count(*) AS room FROM hit GROUP BY 1) USING (qid) QUALIFY row_number() OVER (PARTITION BY qid ORDER BY rank, stem) <= room""")
def link_expand(t):
    return graph.link_expand(hits(t), t.links, t.notes)


@query(IMPACT + " SELECT * FROM im")
def impact_graph(t):
    return impact(t)


def breaks_sql(impact_table: str, top: int = 8) -> str:
    return f"""sd AS (SELECT DISTINCT entity AS seed FROM nt),
h1 AS (SELECT seed, effect, via, 1 AS hops, notes FROM sd JOIN {impact_table} ON cause = seed WHERE effect <> seed),
h2 AS (SELECT h.seed, i.effect, i.via, 2 AS hops, i.notes FROM (SELECT DISTINCT seed, effect FROM h1) h JOIN {impact_table} i ON i.cause = h.effect WHERE i.effect <> h.seed),
bs AS (SELECT * FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2) QUALIFY row_number() OVER (PARTITION BY seed, effect ORDER BY notes / hops DESC, hops, via) = 1),
wb AS (SELECT seed, effect, via, hops, notes, row_number() OVER (PARTITION BY seed ORDER BY notes / hops DESC, effect) AS rank FROM bs QUALIFY rank <= {top})"""


@query(IMPACT + ", " + breaks_sql("im") + " SELECT * FROM wb")
def what_breaks(t):
    return graph.what_breaks(impact(t), seeds(t))


@query(IMPACT + ", ri AS (SELECT effect AS cause, cause AS effect, via, notes FROM im), " + breaks_sql("ri") + " SELECT * FROM wb")
def why(t):
    return graph.what_breaks(graph.reversed_impact(impact(t)), seeds(t))


@query(IMPACT + ", " + breaks_sql("im", 12) + ", sh AS (SELECT seed, effect AS node FROM wb UNION ALL SELECT seed, seed FROM sd) SELECT a.seed, cause AS source, via, effect AS target FROM sh a JOIN im ON im.cause = a.node JOIN sh b ON b.seed = a.seed AND b.node = im.effect")
def causal_closure(t):
    return graph.causal_closure(impact(t), seeds(t))


MODES = ", fm AS (SELECT entity, stem, recurrence, row_number() OVER (PARTITION BY entity ORDER BY recurrence DESC, date DESC, stem DESC) AS rank FROM (SELECT * FROM ne WHERE status = 'live' QUALIFY row_number() OVER (PARTITION BY entity ORDER BY date DESC, stem DESC) <= 18) WHERE ntype = 'mistake' QUALIFY rank <= 6)"


@query(MODES + " SELECT * FROM fm")
def failure_modes(t):
    return graph.failure_modes(entities(t), t.live)


@query(IMPACT + ", " + breaks_sql("im") + MODES + """, ef AS (SELECT seed, string_agg('  → ' || effect || '  (via ' || via || CASE WHEN hops = 1 THEN ')' ELSE ', ' || hops || ' hops)' END, chr(10) ORDER BY rank) AS effects FROM wb GROUP BY 1),
ff AS (SELECT entity AS seed, string_agg('  • ' || stem, chr(10) ORDER BY rank) AS fails FROM fm GROUP BY 1)
SELECT seed, 'Changing `' || seed || '` may impact:' || chr(10) || coalesce(effects, '  → (no downstream dependents recorded)') || coalesce(chr(10) || 'Known failure modes when touching `' || seed || '`:' || chr(10) || fails, '') AS answer
FROM sd LEFT JOIN ef USING (seed) LEFT JOIN ff USING (seed) WHERE effects IS NOT NULL OR fails IS NOT NULL""")
def counterfactual(t):
    return graph.counterfactual(impact(t), seeds(t), graph.failure_modes(entities(t), t.live))


@query(PLAIN + " SELECT stem, rel, target FROM lr WHERE target NOT IN (SELECT entity FROM ne)")
def dangling_targets(t):
    return graph.dangling_targets(relations(t), t.entities)


CONV = ", ce AS (SELECT DISTINCT ne.entity AS source, rel, target FROM ne JOIN nr USING (stem))"


def entity_edges(t):
    return t.entities.select("stem", F.col("entity").alias("source")).join(t.relations.select("stem", "rel", "target"), "stem")


@query(CONV + " SELECT a.source, a.target, a.rel, b.rel AS converse FROM ce a JOIN ce b ON a.source = b.source AND a.target = b.target WHERE (a.rel, b.rel) IN (('causes', 'caused-by'), ('fixes', 'fixed-by'))")
def check_converse(t):
    return graph.check_converse(entity_edges(t))


@query("SELECT stem, rel, target FROM nr WHERE rel NOT IN ('causes', 'fixes', 'fixed-by', 'caused-by', 'requires', 'related-to')")
def check_vocab(t):
    return graph.check_vocabulary(t.relations, ["causes", "fixes", "fixed-by", "caused-by", "requires", "related-to"])


@query(f"""SELECT coalesce(u.rel, c.rel) AS rel, coalesce(notes, 0) AS notes, CASE WHEN u.rel IS NULL THEN 'unproduced' WHEN c.rel IS NULL THEN 'inert' ELSE 'used' END AS state
FROM (SELECT rel, count(*) AS notes FROM nr GROUP BY 1) u FULL JOIN (SELECT unnest({CONSUMED}) AS rel) c ON u.rel = c.rel""")
def vocabulary_report(t):
    return graph.vocabulary_report(t.relations, CONSUMED)


@query(f"SELECT rel FROM (SELECT unnest({CONSUMED}) AS rel EXCEPT SELECT rel FROM nr) UNION SELECT rel || ' (known)' FROM (SELECT DISTINCT rel FROM nr UNION SELECT unnest({CONSUMED}))")
def vocab_sets(t):
    consumed = t.spark.createDataFrame([(c,) for c in CONSUMED], "rel string")
    known = t.relations.select("rel").union(consumed).distinct()
    return consumed.join(t.relations.select("rel").distinct(), "rel", "left_anti").union(known.select(F.concat("rel", F.lit(" (known)"))))


FINDINGS = ", fi AS (SELECT stem, 'referential' AS law FROM nr WHERE target NOT IN (SELECT entity FROM ne) UNION ALL SELECT stem, 'vocabulary' FROM nr WHERE rel = 'alternative-to')"


def findings(t):
    dangling = graph.dangling_targets(t.relations, t.entities).select("stem", F.lit("referential").alias("law"))
    unknown = graph.check_vocabulary(t.relations, [r for r in RELATIONS if r != "alternative-to"])
    return dangling.union(unknown.select("stem", F.lit("vocabulary")))


@query(FINDINGS + " SELECT *, round(dangling / edges, 3) AS dangling_rate FROM (SELECT (SELECT count(DISTINCT stem) FROM ne) AS notes, (SELECT count(DISTINCT entity) FROM ne) AS entities, (SELECT count(*) FROM nr) AS edges, (SELECT count(*) FROM fi) AS findings, (SELECT count(*) FROM fi WHERE law = 'referential') AS dangling)")
def integrity_stats(t):
    return graph.integrity_stats(t.entities, t.relations, findings(t))


@query(FINDINGS + " SELECT law, stem, count(*) OVER (PARTITION BY law) AS found FROM fi QUALIFY row_number() OVER (PARTITION BY law ORDER BY stem) <= 50")
def integrity_findings(t):
    by_law = findings(t).groupBy("law").agg(F.count("*").alias("found"))
    return graph.ranked(findings(t), ["law"], ["stem"], 50).drop("_rank").join(F.broadcast(by_law), "law")


@query(IMPACT + """, nd AS (SELECT DISTINCT cause AS a, effect AS b FROM im), c2 AS (SELECT * FROM nd), """ + ", ".join(f"c{2 * k} AS (SELECT a, b FROM c{k} UNION SELECT x.a, y.b FROM c{k} x JOIN c{k} y ON x.b = y.a)" for k in (2, 4, 8, 16, 32)) + """,
mu AS (SELECT x.a AS node, least(x.a, min(x.b)) AS component FROM c64 x JOIN c64 y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a),
mx AS (SELECT p.component, bool_or(via IN ('fixes', 'fixed-by')) AND bool_or(via IN ('causes', 'caused-by')) AS mixed FROM im JOIN mu p ON p.node = im.cause JOIN mu r ON r.node = im.effect AND r.component = p.component GROUP BY 1)
SELECT component, size, CASE WHEN mixed THEN 'warn' ELSE 'error' END AS level FROM (SELECT component, count(*) AS size FROM mu GROUP BY 1) JOIN mx USING (component)""")
def check_cycles(t):
    return graph.check_cycles(impact(t))
