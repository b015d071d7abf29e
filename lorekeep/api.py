"""Public functions of the note store: tables in, tables out.

Each takes DataFrames (see README for their columns) and returns one; a batch of
questions is a table, so nothing is called row by row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.operators import active, graph, history, retrieval, rollups, similarity
from lorekeep.sources import transcripts
from lorekeep.streaming import jobs


def recall(queries: DataFrame, notes: DataFrame, as_of: str, k: int = 5) -> DataFrame:
    """Ranked notes for each query, from embedded and text-only notes."""
    return retrieval.search(queries, notes, k, as_of)


def remember(notes: DataFrame, lessons: DataFrame) -> DataFrame:
    """The notes after taking in lessons in order."""
    return active.upsert(notes, lessons)


def remember_lessons(notes: DataFrame, lessons: DataFrame, quarantine: bool = True) -> DataFrame:
    """As `remember`, with lessons tied to their near-duplicates first and doubtful ones set apart.

    Notes and lessons also have title, descr, ents, vec (and lessons a stem); see `write_near_dup`.
    """
    key = F.concat_ws("|", "project", "ntype", "slug", "session", F.col("pos").cast("string"))
    new = lessons.withColumns({"stem": key, "toks": F.array().cast("array<string>")})
    live = notes.where("status = 'live'").withColumn("toks", F.array().cast("array<string>"))
    twins = similarity.write_near_dup(new, live).groupBy(F.col("stem_a").alias("stem")).agg(F.sort_array(F.collect_list("stem_b")).alias("twins"))
    return active.upsert(notes, new.drop("twins").join(twins, "stem", "left"), quarantine)


def capture_session(lines: DataFrame) -> DataFrame:
    """One text per session of event lines."""
    return transcripts.assemble(transcripts.events(lines))


def notes_for_entity(entities: DataFrame, names: list[str], k: int = 20) -> DataFrame:
    return graph.ranked(entities.where(F.col("entity").isin(names)), ["entity"], [F.desc("date"), F.desc("stem")], k)


def co_occurring(entities: DataFrame, names: list[str], k: int = 10) -> DataFrame:
    return graph.co_occurring(entities, names, k)


def entity_graph(entities: DataFrame, top: int = 30) -> DataFrame:
    return graph.entity_graph(entities, top)


def related_by(entities: DataFrame, relations: DataFrame, rel: str | None = None) -> DataFrame:
    return graph.related_by(entities, relations, rel)


def relation_graph(entities: DataFrame, relations: DataFrame, top: int | None = None) -> DataFrame:
    return graph.relation_graph(graph.related_by(entities, relations), top)


def graph_export(entities: DataFrame, top: int = 40) -> DataFrame:
    return graph.export(entities, top)


def entity_card(entities: DataFrame, relations: DataFrame | None = None) -> DataFrame:
    return rollups.entity_card(entities, relations)


def entities_by_type(types: DataFrame, kind: str) -> DataFrame:
    return graph.newest_types(types).where(F.col("etype") == kind).select("entity")


def entity_timeline(entities: DataFrame, names: list[str]) -> DataFrame:
    return entities.where(F.col("entity").isin(names)).select("entity", "date", "stem", "status").orderBy("entity", "date", "stem")


def conflicts(notes: DataFrame) -> DataFrame:
    return history.conflicts(notes)


def as_of(notes: DataFrame, days: DataFrame) -> DataFrame:
    return history.valid_at(notes, days)


def integrity(entities: DataFrame, relations: DataFrame, known: list[str]) -> DataFrame:
    """(subject, law): notes with dangling targets or unknown relations, entities in a cycle of causes."""
    dangling = graph.dangling_targets(relations, entities).select(F.col("stem").alias("subject"), F.lit("referential").alias("law"))
    words = graph.check_vocabulary(relations, known).select("stem", F.lit("vocabulary"))
    own = impact(entities, relations)
    cycles = graph.strong_components(own.select(F.col("cause").alias("source"), F.col("effect").alias("target"))).select("node", F.lit("cycle"))
    return dangling.union(words).union(cycles)


def frontier(notes: DataFrame, k: int = 20) -> DataFrame:
    return history.falsification_frontier(notes, history.conflicts(notes), k)


def digest(notes: DataFrame, since: str) -> DataFrame:
    return rollups.digest_by_project(notes, since)


def impact(entities: DataFrame, relations: DataFrame) -> DataFrame:
    return graph.impact_graph(relation_graph(entities, relations))


def what_breaks(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return graph.what_breaks(impact(entities, relations), seeds, depth)


def why(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return graph.what_breaks(graph.reversed_impact(impact(entities, relations)), seeds, depth)


def lens_causal(entities: DataFrame, relations: DataFrame, seeds: DataFrame, depth: int = 2) -> DataFrame:
    return graph.causal_closure(impact(entities, relations), seeds, depth)


def counterfactual(entities: DataFrame, relations: DataFrame, notes: DataFrame, seeds: DataFrame) -> DataFrame:
    return graph.counterfactual(impact(entities, relations), seeds, graph.failure_modes(entities, notes))


def guards_check(actions: DataFrame, guards: DataFrame) -> DataFrame:
    return active.guard_scan(actions, guards)


def guard_feedback(guards: DataFrame, feedback: DataFrame) -> DataFrame:
    return active.guard_lifecycle(guards, feedback)


def guards_generate(notes: DataFrame, guards: DataFrame) -> DataFrame:
    return active.guard_generate(notes, guards)


def anticipate_feedback(events: DataFrame) -> DataFrame:
    """(stem, helped, false_alarms) of outcomes (stem, outcome): what `anticipate` takes as alarms."""
    return jobs.alarm_counts(events)


def anticipate(trajectories: DataFrame, notes: DataFrame, alarms: DataFrame, k: int = 1) -> DataFrame:
    return active.anticipate(trajectories, notes, alarms, k)
