"""Entity and relation graph: indexes, neighbours, impact traversal, consistency laws.

Inputs are the edge tables: entities (stem, entity, ...), relations (stem, rel,
target, ...), types (stem, entity, etype, date). Joins are equi-joins on stem,
entity or term, so a hot entity is split by the adaptive skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.shared import stored

# Direction of the relations.
FORWARD = ["causes", "enables", "prevents", "implements", "improves", "enforces", "standardizes", "exposes", "fixes"]
REVERSE = ["caused-by", "depends-on", "requires", "uses", "part-of", "fixed-by"]
CONVERSE = [("causes", "caused-by"), ("fixes", "fixed-by")]
EDGES_KEPT = 8


def ranked(df: DataFrame, by: list, order: list, n: int, name: str = "_rank") -> DataFrame:
    """The first `n` rows of every group."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(name) <= n)


def entity_index(entities: DataFrame) -> DataFrame:
    return entities.groupBy("entity").agg(F.count("*").alias("notes"), F.min("stem").alias("first_stem"), F.max("stem").alias("last_stem"))


def newest_types(types: DataFrame) -> DataFrame:
    """Entity and its type in the newest note that types it (ties: larger stem)."""
    return types.groupBy("entity").agg(F.max_by("etype", F.struct("date", "stem")).alias("etype"))


def co_occurring(entities: DataFrame, names: list[str] | None = None, k: int | None = None) -> DataFrame:
    """(entity, other, notes) of entities in the same note; the k commonest of each when k is given."""
    left = entities if names is None else entities.where(F.col("entity").isin(names))
    pairs = left.select("stem", "entity").join(entities.select("stem", F.col("entity").alias("other")), "stem").where("entity <> other")
    counts = pairs.groupBy("entity", "other").agg(F.count("*").alias("notes"))
    return counts if k is None else ranked(counts, ["entity"], [F.desc("notes"), "other"], k).drop("_rank")


def co_occurrence_all(entities: DataFrame) -> DataFrame:
    """(a, b, notes), a < b, of every two entities that share a note."""
    pairs = entities.select("stem", F.col("entity").alias("a")).join(entities.select("stem", F.col("entity").alias("b")), "stem").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("notes"))


def related_by(entities: DataFrame, relations: DataFrame, rel: str | None = None) -> DataFrame:
    """(entity, rel, target, notes): typed edges of the notes that tag an entity, without loops."""
    edges = relations if rel is None else relations.where(F.col("rel") == rel)
    both = entities.select("stem", "entity").join(edges.select("stem", "rel", "target"), "stem").where("entity <> target")
    return both.groupBy("entity", "rel", "target").agg(F.count("*").alias("notes"))


def relation_graph(edges: DataFrame, top: int | None = None) -> DataFrame:
    """The EDGES_KEPT commonest edges of each entity; with `top`, of the entities with the largest total."""
    kept = ranked(edges, ["entity"], [F.desc("notes"), "rel", "target"], EDGES_KEPT).drop("_rank")
    if top is None:
        return kept
    names = kept.groupBy("entity").agg(F.sum("notes").alias("total")).orderBy(F.desc("total"), "entity").limit(top)
    return kept.join(names.select("entity"), "entity", "left_semi")


def entity_graph(entities: DataFrame, top: int = 30, near: int = 5) -> DataFrame:
    """(entity, notes, other, shared): the commonest entities with their closest neighbours."""
    head = entities.groupBy("entity").agg(F.count("*").alias("notes")).orderBy(F.desc("notes"), "entity").limit(top)
    left = entities.select("stem", "entity").join(head, "entity")
    both = left.join(entities.select("stem", F.col("entity").alias("other")), "stem").where("entity <> other")
    counts = both.groupBy("entity", "notes", "other").agg(F.count("*").alias("shared"))
    return ranked(counts, ["entity"], [F.desc("shared"), "other"], near).drop("_rank")


def salience_index(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(stem, salience): ln(1 + edges that target its entities) + half ln(1 + notes that share an entity), over the maximum."""
    degree = entities.groupBy("entity").agg((F.count("*") - 1).alias("degree"))
    inbound = relations.groupBy(F.col("target").alias("entity")).agg(F.count("*").alias("inbound"))
    sums = entities.select("stem", "entity").join(degree, "entity").join(inbound, "entity", "left").groupBy("stem").agg(F.sum("degree").alias("degree"), F.sum(F.coalesce("inbound", F.lit(0))).alias("inbound"))
    raw = F.log1p("inbound") + 0.5 * F.log1p("degree")
    most = sums.agg(F.max(raw).alias("most"))
    return sums.crossJoin(F.broadcast(most)).select("stem", F.when(F.col("most") > 0, F.bround(raw / F.col("most"), 4)).otherwise(0.0).alias("salience"))


def relation_expand(hits: DataFrame, relations: DataFrame, entities: DataFrame, per_hit: int = 2, total: int = 10) -> DataFrame:
    """Hits (qid, rank, stem) to (qid, stem, via): newest notes that tag a target of a hit's edges, not hits themselves, in hit order."""
    edges = hits.join(relations.select("stem", "rel", "target"), "stem").select("qid", "rank", "rel", "target")
    near = edges.join(entities.select(F.col("entity").alias("target"), F.col("stem").alias("found"), "date"), "target")
    near = near.join(hits.select("qid", F.col("stem").alias("found")), ["qid", "found"], "left_anti")
    near = ranked(near, ["qid", "rank", "rel", "target"], [F.desc("date"), F.desc("found")], per_hit, "_near")
    once = ranked(near, ["qid", "found"], ["rank", "rel", "target"], 1, "_once")
    kept = ranked(once, ["qid"], ["rank", "rel", "target", "_near", "found"], total)
    return kept.select("qid", F.col("found").alias("stem"), F.concat_ws(" -> ", "rel", "target").alias("via"), F.col("_rank").alias("place"))


def link_expand(hits: DataFrame, links: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """Notes that the hits (qid, rank, stem) link to, among the candidates (stem), not hits, so that at most 2k are left."""
    out = hits.join(links.select("stem", "target"), "stem").where("target IS NOT NULL").select("qid", "rank", F.col("target").alias("stem"))
    out = out.join(candidates.select("stem").distinct(), "stem", "left_semi").join(hits.select("qid", "stem"), ["qid", "stem"], "left_anti")
    once = out.groupBy("qid", "stem").agg(F.min("rank").alias("rank"))
    room = hits.groupBy("qid").agg((2 * k - F.count("*")).alias("room"))
    kept = once.withColumn("_n", F.row_number().over(Window.partitionBy("qid").orderBy("rank", "stem"))).join(room, "qid").where("_n <= room")
    return kept.select("qid", "stem", "rank")


def impact_graph(edges: DataFrame) -> DataFrame:
    """(cause, effect, via, notes) of relation-graph edges, oriented; symmetric relations go."""
    forward, reverse = F.col("rel").isin(FORWARD), F.col("rel").isin(REVERSE)
    cause = F.when(forward, F.col("entity")).when(reverse, F.col("target"))
    effect = F.when(forward, F.col("target")).when(reverse, F.col("entity"))
    return edges.select(cause.alias("cause"), effect.alias("effect"), F.col("rel").alias("via"), "notes").where("cause IS NOT NULL AND cause <> effect")


def reversed_impact(impact: DataFrame) -> DataFrame:
    return impact.select(F.col("effect").alias("cause"), F.col("cause").alias("effect"), "via", "notes")


def what_breaks(impact: DataFrame, seeds: DataFrame, depth: int = 2, top: int = 8) -> DataFrame:
    """Seeds (seed) to (seed, effect, via, hops, notes, rank): everything within `depth`, best notes / hops first.

    A node expands once, at the depth it is first reached; an effect keeps its best score.
    """
    frontier = seeds.select("seed", F.col("seed").alias("node"))
    seen, found = frontier, None
    for hop in range(1, depth + 1):
        step = frontier.join(impact, F.col("node") == F.col("cause")).where("effect <> seed").select("seed", "effect", "via", F.lit(hop).alias("hops"), "notes")
        found = step if found is None else found.unionByName(step)
        if hop < depth:
            frontier = step.select("seed", F.col("effect").alias("node")).distinct().join(seen, ["seed", "node"], "left_anti")
            seen = seen.unionByName(frontier)
    best = ranked(found.withColumn("score", F.col("notes") / F.col("hops")), ["seed", "effect"], [F.desc("score"), "hops", "via"], 1, "_one")
    return ranked(best, ["seed"], [F.desc("score"), "effect"], top, "rank").select("seed", "effect", "via", "hops", "notes", "rank")


def causal_closure(impact: DataFrame, seeds: DataFrame, depth: int = 2, top: int = 12) -> DataFrame:
    """(seed, source, via, target): the impact edges among a seed and the effects it reaches."""
    shown = what_breaks(impact, seeds, depth, top).select("seed", F.col("effect").alias("node")).union(seeds.select("seed", F.col("seed").alias("node")))
    out = shown.join(impact, F.col("node") == F.col("cause")).select("seed", F.col("cause").alias("source"), "via", F.col("effect").alias("target"))
    return out.join(shown.select("seed", F.col("node").alias("target")), ["seed", "target"], "left_semi").select("seed", "source", "via", "target")


def failure_modes(entities: DataFrame, notes: DataFrame, k: int = 6) -> DataFrame:
    """(entity, stem, recurrence, rank): the most recurrent mistakes among an entity's newest 3k notes."""
    newest = ranked(entities.select("entity", "stem", "date", "ntype", "recurrence"), ["entity"], [F.desc("date"), F.desc("stem")], 3 * k, "_new").where("ntype = 'mistake'")
    return ranked(newest, ["entity"], [F.desc("recurrence"), F.desc("date"), F.desc("stem")], k, "rank").select("entity", "stem", "recurrence", "rank")


def counterfactual(impact: DataFrame, seeds: DataFrame, modes: DataFrame) -> DataFrame:
    """(seed, answer): one text per seed that has effects or failure modes (entity, stem, rank)."""
    hop = F.when(F.col("hops") == 1, F.lit(")")).otherwise(F.concat(F.lit(", "), F.col("hops").cast("string"), F.lit(" hops)")))
    line = F.concat(F.lit("  → "), "effect", F.lit("  (via "), "via", hop)
    listed = lambda order, value: F.transform(F.array_sort(F.collect_list(F.struct(order, value.alias("x")))), lambda e: e["x"])
    effects = what_breaks(impact, seeds).groupBy("seed").agg(F.array_join(listed("rank", line), "\n").alias("effects"))
    fails = modes.groupBy(F.col("entity").alias("seed")).agg(F.array_join(listed("rank", F.concat(F.lit("  • "), "stem")), "\n").alias("fails"))
    both = seeds.join(effects, "seed", "left").join(fails, "seed", "left").where("effects IS NOT NULL OR fails IS NOT NULL")
    head = F.concat(F.lit("Changing `"), "seed", F.lit("` may impact:"))
    none = F.lit("  → (no downstream dependents recorded)")
    tail = F.when(F.col("fails").isNotNull(), F.concat(F.lit("\nKnown failure modes when touching `"), "seed", F.lit("`:\n"), "fails")).otherwise("")
    return both.select("seed", F.concat(head, F.lit("\n"), F.coalesce("effects", none), tail).alias("answer"))


def dangling_targets(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Edges whose target no note is tagged with."""
    return relations.join(entities.select(F.col("entity").alias("target")).distinct(), "target", "left_anti").select("stem", "rel", "target")


def check_converse(edges: DataFrame) -> DataFrame:
    """(source, target, rel, converse): the same ordered pair asserted both ways. `edges` has source, rel, target."""
    pairs = edges.sparkSession.createDataFrame(CONVERSE, "rel string, converse string")
    once = edges.select("source", "target", "rel").distinct()
    other = once.select("source", "target", F.col("rel").alias("converse"))
    return once.join(F.broadcast(pairs), "rel").join(other, ["source", "target", "converse"]).select("source", "target", "rel", "converse")


def check_vocabulary(relations: DataFrame, known: list[str]) -> DataFrame:
    return relations.where(~F.col("rel").isin(known)).select("stem", "rel", "target")


def vocabulary_report(relations: DataFrame, consumed: list[str]) -> DataFrame:
    """(rel, notes, state): used relations, those nothing consumes, and consumed ones nobody used."""
    used = relations.groupBy("rel").agg(F.count("*").alias("notes"))
    eaten = relations.sparkSession.createDataFrame([(c,) for c in consumed], "rel string").withColumn("eaten", F.lit(True))
    both = used.join(F.broadcast(eaten), "rel", "full")
    state = F.when(F.col("notes").isNull(), "unproduced").when(F.col("eaten").isNull(), "inert").otherwise("used")
    return both.select("rel", F.coalesce("notes", F.lit(0)).alias("notes"), state.alias("state"))


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component): strongly connected components with more than one node, named by their smallest node.

    First what has no way in or no way out is trimmed, and nodes with one edge in and one out are bridged, in rounds that
    leave a fraction of every chain, so a path or a cycle takes rounds in the logarithm of its length. In what is left the
    smallest node from which a node can be reached, and the smallest one that it reaches, are propagated: where they agree
    is a component, and nodes of different labels part. Bridged nodes then join the component of both their neighbours.
    """
    edges = stored(edges.select("source", "target").where("source <> target").distinct(), "scc-edges")
    bridged: list[DataFrame] = []
    while not edges.isEmpty():
        before = edges.count()
        kept = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        kept = stored(kept.select("source", "target"), "scc-edges")
        one_in = kept.groupBy(F.col("target").alias("node")).agg(F.count("*").alias("n"), F.first("source").alias("before")).where("n = 1").select("node", "before")
        one_out = kept.groupBy(F.col("source").alias("node")).agg(F.count("*").alias("n"), F.first("target").alias("after")).where("n = 1").select("node", "after")
        luck = F.xxhash64(F.lit(len(bridged)), "node")
        chain = stored(one_in.join(one_out, "node").withColumn("luck", luck), "scc-chain")
        near = lambda side: chain.select(F.col("node").alias(side), F.col("luck").alias(f"{side}_luck"))
        lucky = (F.col("luck") < F.coalesce("before_luck", F.lit((1 << 63) - 1))) & (F.col("luck") < F.coalesce("after_luck", F.lit((1 << 63) - 1)))
        picked = stored(chain.join(near("before"), "before", "left").join(near("after"), "after", "left").where(lucky).select("node", "before", "after"), "scc-bridged")
        left = kept.count()
        if 20 * picked.count() < left or picked.isEmpty():  # too few to be worth a round
            edges = kept
            if left == before or picked.count():
                break
            continue
        gone = picked.select("node")
        rest = kept.join(gone.withColumnRenamed("node", "source"), "source", "left_anti").join(gone.withColumnRenamed("node", "target"), "target", "left_anti").select("source", "target")
        edges = stored(rest.union(picked.select("before", "after")).where("source <> target").distinct(), "scc-edges")
        bridged.append(picked)
    done = _by_labels(edges)
    for picked in reversed(bridged):
        of = lambda side: done.select(F.col("node").alias(side), F.col("component").alias(f"{side}_c"))
        both = picked.join(of("before"), "before", "left").join(of("after"), "after", "left").withColumns({"b": F.coalesce("before_c", "before"), "a": F.coalesce("after_c", "after")}).where("a = b")
        done = stored(done.union(both.select("node", "b")).union(both.select("before", "b")).distinct(), "scc")
    named = done.groupBy("component").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1")
    return done.join(named, "component").select("node", F.col("least").alias("component"))


def _by_labels(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes of a graph, by forward and backward smallest labels."""
    done = edges.select(F.col("source").alias("node"), F.col("source").alias("component")).limit(0)
    while not edges.isEmpty():
        forward, backward = _smallest(edges), _smallest(edges.select(F.col("target").alias("source"), F.col("source").alias("target")))
        labels = stored(forward.join(backward.withColumnRenamed("label", "back"), "node"), "scc-labels")
        done = done.unionByName(labels.where("label = back").select("node", F.col("label").alias("component")))
        # nodes in different (forward, backward) classes are in different components
        sides = labels.where("label <> back").select("node", "label", "back")
        edges = edges.join(sides.select(F.col("node").alias("source"), "label", "back"), "source").join(sides.select(F.col("node").alias("target"), "label", "back"), ["target", "label", "back"])
        edges = stored(edges.select("source", "target"), "scc-edges")
    return stored(done, "scc")


def _smallest(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node from which a node can be reached (itself included)."""
    labels = stored(edges.select(F.col("source").alias("node")).union(edges.select("target")).distinct().withColumn("label", F.col("node")), "labels")
    while True:
        offered = edges.join(labels, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("label").alias("offer"))
        moved = stored(labels.join(offered, "node", "left").select("node", F.least("label", F.coalesce("offer", "label")).alias("label"), (F.coalesce("offer", "label") < F.col("label")).alias("moved")), "labels")
        labels = moved.select("node", "label")
        if moved.where("moved").isEmpty():
            return labels


def check_cycles(impact: DataFrame) -> DataFrame:
    """(component, size, level): one finding per component; a warning when fixing and causing edges mix."""
    parts = strong_components(impact.select(F.col("cause").alias("source"), F.col("effect").alias("target")))
    inner = impact.join(parts.select(F.col("node").alias("cause"), F.col("component").alias("c")), "cause").join(parts.select(F.col("node").alias("effect"), F.col("component").alias("c")), ["effect", "c"])
    fix, cause = F.col("via").isin("fixes", "fixed-by"), F.col("via").isin("causes", "caused-by")
    mixed = inner.groupBy(F.col("c").alias("component")).agg((F.bool_or(fix) & F.bool_or(cause)).alias("mixed"))
    return parts.groupBy("component").agg(F.count("*").alias("size")).join(mixed, "component").select("component", "size", F.when(F.col("mixed"), "warn").otherwise("error").alias("level"))


def integrity_stats(entities: DataFrame, relations: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: notes, entities, edges, findings (stem, law), errors, dangling rate."""
    counts = entities.agg(F.count_distinct("stem").alias("notes"), F.count_distinct("entity").alias("entities"))
    edges = relations.agg(F.count("*").alias("edges"))
    found = findings.agg(F.count("*").alias("findings"), F.count_if(F.col("law") == "referential").alias("dangling"))
    return counts.crossJoin(edges).crossJoin(found).select("notes", "entities", "edges", "findings", "dangling", F.bround(F.try_divide(F.col("dangling"), F.col("edges")), 3).alias("dangling_rate"))


def export_rows(entities: DataFrame, relations: DataFrame, top: int = 40, shared: int = 2) -> DataFrame:
    """(kind, source, rel, target, notes): the commonest entities (relations' targets are entities too), the typed edges among them, and pairs of `shared` notes or more."""
    tagged = entities.select("stem", "entity").distinct()
    named = tagged.groupBy("entity").agg(F.count("*").alias("notes")).unionByName(relations.select(F.col("target").alias("entity"), F.lit(0).cast("long").alias("notes")).distinct())
    nodes = stored(named.groupBy("entity").agg(F.max("notes").alias("notes")).orderBy(F.desc("notes"), "entity").limit(top), "nodes")
    kept = F.broadcast(nodes.select("entity"))  # `top` rows
    ours = stored(tagged.join(kept, "entity"), "tagged")
    edges = relations.select("stem", "rel", "target").join(kept.withColumnRenamed("entity", "target"), "target").join(ours.withColumnRenamed("entity", "source"), "stem").where("source <> target")
    typed = edges.groupBy("source", "rel", "target").agg(F.count("*").alias("notes"))
    pairs = ours.select("stem", F.col("entity").alias("source")).join(ours.select("stem", F.col("entity").alias("target")), "stem").where("source < target").groupBy("source", "target").agg(F.count("*").alias("notes")).where(F.col("notes") >= shared)
    void = F.lit("")
    return nodes.select(F.lit("node").alias("kind"), F.col("entity").alias("source"), void.alias("rel"), void.alias("target"), "notes").union(typed.select(F.lit("edge"), "source", "rel", "target", "notes")).union(pairs.select(F.lit("pair"), "source", void, "target", "notes"))


def export_text(rows: DataFrame, form: str) -> DataFrame:
    """One row with the text of exported rows: json, dot or mermaid. Nodes are few (`top` of export_rows)."""

    def listed(kind: str, order: list[Column], line: Column, between: str) -> Column:
        held = F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct(*[o.alias(f"o{i}") for i, o in enumerate(order)], line.alias("line")))))
        return F.array_join(F.transform(held, lambda x: x["line"]), between)

    c = F.col
    quoted = lambda x: F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('\\"')), F.lit('"'))
    weight = [-c("notes"), c("source"), c("target"), c("rel")]
    if form == "json":
        nodes = listed("node", [-c("notes"), c("source")], F.to_json(F.struct(c("source").alias("id"), "notes")), ",")
        edges = listed("edge", weight, F.to_json(F.struct("source", "rel", "target", "notes")), ",")
        pairs = listed("pair", weight, F.to_json(F.struct(c("source").alias("a"), c("target").alias("b"), "notes")), ",")
        text = F.concat(F.lit('{"nodes":['), nodes, F.lit('],"edges":['), edges, F.lit('],"cooccurrence":['), pairs, F.lit("]}"))
    elif form == "dot":
        nodes = listed("node", [c("source")], F.concat(F.lit("  "), quoted(c("source")), F.lit(" [label="), quoted(F.concat("source", F.lit("\\n("), c("notes").cast("string"), F.lit(")"))), F.lit("];\n")), "")
        edges = listed("edge", weight, F.concat(F.lit("  "), quoted(c("source")), F.lit(" -> "), quoted(c("target")), F.lit(" [label="), quoted(c("rel")), F.lit("];\n")), "")
        pairs = listed("pair", weight, F.concat(F.lit("  "), quoted(c("source")), F.lit(" -> "), quoted(c("target")), F.lit(" [dir=none, style=dashed];\n")), "")
        text = F.concat(F.lit("digraph notes {\n  rankdir=LR; node [shape=box];\n"), nodes, edges, pairs, F.lit("}"))
    elif form == "mermaid":
        ids = F.transform(F.array_sort(F.collect_list(F.when(c("kind") == "node", c("source")))), lambda x: x)
        named = rows.crossJoin(F.broadcast(rows.agg(ids.alias("ids"))))
        at = lambda x: F.concat(F.lit("n"), (F.array_position("ids", x) - 1).cast("string"))
        rows = named.withColumns({"s": at(c("source")), "t": at(c("target"))})
        nodes = listed("node", [c("source")], F.concat(F.lit("\n  "), "s", F.lit("["), quoted(c("source")), F.lit("]")), "")
        edges = listed("edge", weight, F.concat(F.lit("\n  "), "s", F.lit(" -->|"), "rel", F.lit("| "), "t"), "")
        pairs = listed("pair", weight, F.concat(F.lit("\n  "), "s", F.lit(" -.- "), "t"), "")
        text = F.concat(F.lit("graph LR"), nodes, edges, pairs)
    else:
        raise ValueError(f"no export form {form!r}")
    return rows.agg(text.alias("text"))


def export(entities: DataFrame, top: int = 40) -> DataFrame:
    """(kind, source, target, weight): the commonest entities, and edges of two shared notes or more among them."""
    nodes = entities.groupBy("entity").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "entity").limit(top)
    nodes = stored(nodes, "nodes")
    kept = entities.select("stem", "entity").join(F.broadcast(nodes.select("entity")), "entity")
    edges = co_occurrence_all(kept).where("notes >= 2")
    return nodes.select(F.lit("node").alias("kind"), F.col("entity").alias("source"), F.lit("").alias("target"), "weight").union(edges.select(F.lit("edge"), "a", "b", "notes"))


def mermaid(graph: DataFrame) -> DataFrame:
    """One row with a Mermaid text of an exported graph."""
    line = F.concat(F.lit("  "), F.col("source"), F.lit(" --- "), F.col("target"))
    return graph.where("kind = 'edge'").agg(F.concat(F.lit("graph LR\n"), F.array_join(F.sort_array(F.collect_list(line)), "\n")).alias("text"))
