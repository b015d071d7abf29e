"""Roll-ups: digests, cards, vocabularies, ledgers, token accounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.functions.text import tokens

STOP_TAGS = ["mistake", "pattern", "decision", "session", "index", "general"]


def chars_to_tokens(c: Column) -> Column:
    return F.floor(c / 4)


def digest_totals(notes: DataFrame, since: str) -> DataFrame:
    """One row: live, superseded, projects, added and revised since a day."""
    live, new = F.col("status") == "live", F.col("date") >= F.lit(since).cast("date")
    revised = (F.col("status") == "superseded") & (F.coalesce("valid_to", "date") >= F.lit(since).cast("date"))
    return notes.agg(F.count_if(live).alias("live"), F.count_if(~live).alias("superseded"), F.count_distinct(F.when(live, F.col("project"))).alias("projects"), F.count_if(live & new).alias("added"), F.count_if(revised).alias("revised"))


def digest_by_project(notes: DataFrame, since: str) -> DataFrame:
    live, day = F.col("status") == "live", F.lit(since).cast("date")
    kinds = [F.count_if(live & (F.col("ntype") == k)).alias(k + "s") for k in ("mistake", "pattern", "decision")]
    return notes.groupBy("project").agg(F.count_if(live).alias("total"), F.count_if(live & (F.col("date") >= day)).alias("added"), F.count_if(~live & (F.coalesce("valid_to", "date") >= day)).alias("superseded"), *kinds)


def subtotals(notes: DataFrame) -> DataFrame:
    """(project, ntype, notes) with subtotals; null stands for all."""
    return notes.rollup("project", "ntype").agg(F.count("*").alias("notes"))


def ranked(df: DataFrame, by: list, order: list, k: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def project_card(notes: DataFrame, k: int = 5) -> DataFrame:
    """(project, section, rank, item): newest title, topics, open mistakes, decisions, and other recurring notes."""
    sure = F.coalesce("confidence", F.lit(1.0))
    status = ranked(notes, ["project"], [F.desc("date"), F.desc("stem")], 1).select("project", F.lit("status").alias("section"), "rank", F.col("title").alias("item"))
    tags = notes.select("project", F.explode("tags").alias("tag")).where(~F.col("tag").isin(STOP_TAGS)).groupBy("project", "tag").count()
    topics = ranked(tags, ["project"], [F.desc("count"), "tag"], 8).select("project", F.lit("topic").alias("section"), "rank", F.col("tag").alias("item"))
    open_ = ranked(notes.where("ntype = 'mistake' AND NOT resolved"), ["project"], [F.desc("recurrence"), F.desc("date"), F.desc(sure), F.desc("stem")], k)
    decided = ranked(notes.where("ntype = 'decision'"), ["project"], [F.desc("date"), F.desc("recurrence"), F.desc(sure), F.desc("stem")], k)
    often = notes.where("recurrence >= 2").join(open_.select("stem"), "stem", "left_anti")
    often = ranked(often, ["project"], [F.desc("recurrence"), F.desc("date"), F.desc("stem")], 3)
    named = lambda df, s: df.select("project", F.lit(s).alias("section"), "rank", F.col("stem").alias("item"))
    return status.union(topics).union(named(open_, "open")).union(named(decided, "decision")).union(named(often, "recurring"))


def entity_card(entities: DataFrame, relations: DataFrame | None = None, edges: int = 8, mates: int = 8, notes: int = 5) -> DataFrame:
    """(entity, section, rank, item, n): what the store knows of each entity.

    Sections: `mentions` (n of live and superseded notes; item: first and last day), `project` (n of notes),
    `edge` (relation and target, by notes of the entity), `neighbour` (entities of the same notes), `mistake`,
    `pattern` and `decision` (newest live notes), and `evolution` (n of superseded notes).
    """
    count = entities.groupBy("entity").agg(F.count("*").alias("n"), F.concat_ws(" ", F.min("date").cast("string"), F.max("date").cast("string")).alias("item"), F.count_if(F.col("status") == "superseded").alias("old"))
    part = lambda df, name: df.select("entity", F.lit(name).alias("section"), F.col("rank").cast("int").alias("rank"), "item", F.col("n").cast("long").alias("n"))
    out = part(count.withColumn("rank", F.lit(1)), "mentions")
    out = out.union(part(count.where("old > 0").select("entity", F.lit(1).alias("rank"), F.lit("superseded").alias("item"), F.col("old").alias("n")), "evolution"))
    projects = entities.groupBy("entity", F.col("project").alias("item")).agg(F.count("*").alias("n"))
    out = out.union(part(_best(projects, ["entity"], None), "project"))
    live = entities.where("status = 'live'")
    pair = live.select("entity", "stem").join(live.select("stem", F.col("entity").alias("item")), "stem").where("entity <> item")
    out = out.union(part(_best(pair.groupBy("entity", "item").agg(F.count("*").alias("n")), ["entity"], mates), "neighbour"))
    if relations is not None:
        edge = live.select("entity", "stem").join(relations.where("status = 'live'").select("stem", F.concat_ws(" ", "rel", "target").alias("item")), "stem")
        out = out.union(part(_best(edge.groupBy("entity", "item").agg(F.count("*").alias("n")), ["entity"], edges), "edge"))
    newest = ranked(live.select("entity", "ntype", "date", "stem", "recurrence"), ["entity", "ntype"], [F.desc("date"), F.desc("stem")], notes)
    return out.union(newest.select("entity", F.col("ntype").alias("section"), F.col("rank").cast("int"), F.col("stem").alias("item"), F.col("recurrence").cast("long").alias("n")))


def _best(counts: DataFrame, by: list[str], k: int | None) -> DataFrame:
    """Items by falling count; all of them where `k` is None."""
    return ranked(counts, by, [F.desc("n"), "item"], k if k is not None else 2**31 - 1)


def tag_vocabulary(notes: DataFrame, least: int = 2, k: int = 30) -> DataFrame:
    tags = notes.select(F.explode("tags").alias("tag")).where(~F.col("tag").isin(STOP_TAGS))
    return tags.groupBy("tag").agg(F.count("*").alias("notes")).where(F.col("notes") >= least).orderBy(F.desc("notes"), "tag").limit(k)


def title_vocabulary(notes: DataFrame, k: int = 40) -> DataFrame:
    last = ranked(notes, ["project", "ntype"], [F.desc("stem")], k)
    return last.groupBy("project", "ntype").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "slug"))), lambda e: e["slug"]), ",").alias("slugs"))


def user_profile(notes: DataFrame, share: float = 0.22) -> DataFrame:
    """(kind, item, n): recurring mistake words across projects and pattern words, rare enough in the store to mean something."""
    words = notes.select("stem", "project", "ntype", F.explode(F.filter(tokens(F.concat_ws(" ", "slug", "descr")), lambda t: (F.length(t) >= 4) & ~t.rlike(r"\p{Nd}"))).alias("tok"))
    size = notes.agg(F.greatest(F.lit(3), F.floor(F.lit(share) * F.count("*"))).alias("ceiling"))
    rare = words.groupBy("tok").agg(F.count("*").alias("df")).crossJoin(F.broadcast(size)).where("df <= ceiling").select("tok")
    per = words.join(rare, "tok")
    cross = per.where("ntype = 'mistake'").groupBy("tok").agg(F.count_distinct("project").alias("n")).where("n >= 2").orderBy(F.desc("n"), F.desc("tok")).limit(8)
    style = per.where("ntype = 'pattern'").groupBy("tok").agg(F.count("*").alias("n")).where("n >= 3").orderBy(F.desc("n"), "tok").limit(10)
    return cross.select(F.lit("gotcha").alias("kind"), F.col("tok").alias("item"), "n").union(style.select(F.lit("style"), "tok", "n"))


def daily_ledger(ledger: DataFrame, days: int = 400) -> DataFrame:
    """Counters per day, the newest `days` days."""
    daily = ledger.groupBy("day").agg(F.sum("saved").alias("saved"), F.sum("injected").alias("injected"), *[F.count_if(F.col("kind") == k).alias(k + "s") for k in ("recall", "guard", "counterfactual")])
    return daily.orderBy(F.desc("day")).limit(days)


def last_days(daily: DataFrame, as_of: str, n: int = 14) -> DataFrame:
    """The last n days of a daily ledger, empty days as zeros."""
    day = F.explode(F.sequence(F.date_sub(F.lit(as_of).cast("date"), n - 1), F.lit(as_of).cast("date"))).alias("day")
    days = daily.sparkSession.range(1).select(day)
    return days.join(daily, "day", "left").na.fill(0)


def mean_ci(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Mean and half width of its 95 % interval per group."""
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return df.groupBy(*by).agg(F.round(F.avg(value), 6).alias("mean"), F.round(half, 6).alias("half"), F.count(value).alias("n"))


def recurrence_count(sightings: DataFrame, by: list[str]) -> DataFrame:
    """Distinct sessions per group; sightings without a session count one each."""
    return sightings.groupBy(*by).agg((F.count_distinct("session") + F.count_if(F.col("session").isNull())).alias("recurrence"))


def token_economy(entries: DataFrame, k: int = 5) -> DataFrame:
    """(project, snapshot, newest, journal): tokens of the newest entry, of the newest k, and of all."""
    size = chars_to_tokens(F.length("text"))
    r = entries.withColumns({"_n": F.row_number().over(Window.partitionBy("project").orderBy(F.desc("date"), F.desc("stem"))), "_t": size})
    return r.groupBy("project").agg(F.sum(F.when(F.col("_n") == 1, F.col("_t"))).alias("snapshot"), F.sum(F.when(F.col("_n") <= k, F.col("_t"))).alias("newest"), F.sum("_t").alias("journal"))


def budget_pack(rows: DataFrame, budget: int) -> DataFrame:
    """Rows (qid, section, rank, cost) with `shown`: a section's lines are shown while they fit; it stops at the first that does not."""
    # a line is refused when it and all shown before it pass the budget; a section ends there
    w = Window.partitionBy("qid").orderBy("section", "rank")
    run = rows.withColumn("line", F.row_number().over(w))
    fold = F.aggregate(
        F.array_sort(F.collect_list(F.struct("line", "section", "rank", "cost"))),
        F.struct(F.lit(0).cast("long").alias("used"), F.lit(-1).cast("long").alias("closed"), F.array().cast("array<struct<line:int,used:bigint>>").alias("kept")),
        lambda s, x: F.when(
            (x["section"].cast("long") != s["closed"]) & (s["used"] + x["cost"] <= budget),
            F.struct((s["used"] + x["cost"]).alias("used"), s["closed"].alias("closed"), F.array_append(s["kept"], F.struct(x["line"].alias("line"), (s["used"] + x["cost"]).alias("used"))).alias("kept")),
        ).otherwise(F.struct(s["used"].alias("used"), x["section"].cast("long").alias("closed"), s["kept"].alias("kept"))),
    )
    kept = run.groupBy("qid").agg(fold.alias("f")).select("qid", F.explode("f.kept").alias("k")).select("qid", "k.line", "k.used")
    return run.join(kept, ["qid", "line"], "left").select("qid", "section", "rank", "cost", F.col("used").isNotNull().alias("shown"))


def receipt(packed: DataFrame, budget: int) -> DataFrame:
    """(qid, shown, held, chars, tokens, line): the richest of three lines that the leftover room holds."""
    g = packed.groupBy("qid").agg(F.count_if("shown").alias("shown"), F.count_if(~F.col("shown")).alias("held"), F.coalesce(F.sum(F.when(F.col("shown"), F.col("cost"))), F.lit(0)).alias("chars"))
    g = g.withColumn("tokens", chars_to_tokens(F.col("chars")))
    full = F.concat(F.col("shown").cast("string"), F.lit(" shown, "), F.col("held").cast("string"), F.lit(" held, ~"), F.col("tokens").cast("string"), F.lit(" tokens"))
    short = F.concat(F.col("shown").cast("string"), F.lit(" shown"))
    room = budget - F.col("chars")
    return g.withColumn("line", F.when(F.length(full) <= room, full).when(F.length(short) <= room, short).otherwise(""))


def inventory_budget(files: DataFrame, max_files: int, max_bytes: int) -> DataFrame:
    """Files (project, path, bytes, is_code) kept: code first, then small; the first always, later ones skipped when they would pass a cap."""
    ordered = F.array_sort(F.collect_list(F.struct((~F.col("is_code")).alias("a"), F.col("bytes").alias("b"), F.col("path").alias("p"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).cast("long").alias("sum"), F.array().cast("array<string>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] == 0) | ((s["n"] < max_files) & (s["sum"] + x["b"] <= max_bytes))
        return F.when(fits, F.struct((s["n"] + 1).alias("n"), (s["sum"] + x["b"]).alias("sum"), F.array_append(s["kept"], x["p"]).alias("kept"))).otherwise(s)

    return files.groupBy("project").agg(F.aggregate(ordered, start, step).alias("f")).select("project", F.posexplode("f.kept").alias("place", "path"))


def compact(entries: DataFrame, cap: int = 12_000, floor: int = 3, ceiling: int = 12) -> DataFrame:
    """Entries (project, date, stem, text) with `state` keep or fold: the newest under a byte cap, between floor and ceiling of them."""
    w = Window.partitionBy("project").orderBy(F.desc("date"), F.desc("stem"))
    r = entries.withColumns({"n": F.row_number().over(w), "used": F.sum(F.octet_length("text") + 2).over(w.rowsBetween(Window.unboundedPreceding, 0))})
    keep = (F.col("n") <= floor) | ((F.col("n") <= ceiling) & (F.col("used") <= cap))
    return r.select("project", "stem", F.when(keep, "keep").otherwise("fold").alias("state"))


#: Bytes that a fold reserves for the new state, and a spill for its note; link targets that a fold carries on.
FOLD_RESERVE, SPILL_RESERVE, LINKS = 1800, 200, 60


def compaction(entries: DataFrame, cap: int = 12_000, floor: int = 3, ceiling: int = 12, live: bool = False) -> DataFrame:
    """Entries (project, date, stem, text) with what becomes of them: keep, fold (into a summary that a model writes) or spill (moved verbatim).

    A journal within `cap` bytes is left alone. Maintenance keeps the newest entries that fit beside the summary, between `floor` and
    `ceiling` of them and never more than fit. On the `live` path, where no model is asked, journals are left alone up to four
    times the cap; beyond it all but the newest entries that fit are spilled.
    """
    w = Window.partitionBy("project").orderBy(F.desc("date"), F.desc("stem"))
    # the journal's entries without their texts
    size = entries.select("project", "date", "stem", (F.octet_length("text") + 2).alias("bytes"))
    r = size.withColumns({"n": F.row_number().over(w), "used": F.sum("bytes").over(w.rowsBetween(Window.unboundedPreceding, 0))})
    reserve = SPILL_RESERVE if live else FOLD_RESERVE
    per = r.groupBy("project").agg(F.count("*").alias("all"), F.sum("bytes").alias("total"), F.count_if((F.col("n") == 1) | (F.col("used") <= max(0, cap - reserve))).alias("fit"))
    low, high = F.least(F.lit(floor), F.col("all") - 1), F.least(F.lit(ceiling), F.col("all") - 1)
    kept = F.greatest(low, F.least("fit", high))
    kept = F.when(kept > F.col("fit"), F.greatest(F.lit(1), F.col("fit"))).otherwise(kept)
    touched = (F.col("all") >= 2) & (F.col("total") > (4 * cap if live else cap))
    state = F.when(~touched | (F.col("n") <= (F.col("fit") if live else kept)), "keep").otherwise("spill" if live else "fold")
    return r.join(per, "project").select("project", "date", "stem", state.alias("state"))


def folded_links(entries: DataFrame, states: DataFrame, most: int = LINKS) -> DataFrame:
    """(project, place, target): the last `most` distinct link targets of folded entries, in the order in which they first appear, so that no note loses its place in the graph."""
    old = entries.join(states.where("state = 'fold'").select("project", "stem"), ["project", "stem"], "left_semi")
    each = old.select("project", "date", "stem", F.posexplode(F.regexp_extract_all("text", F.lit(r"\[\[([^\]|#]+)"), F.lit(1))).alias("pos", "target")).withColumn("target", F.trim("target")).where("target <> ''")
    first = each.groupBy("project", "target").agg(F.min(F.struct("date", "stem", "pos")).alias("at"))
    back = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("at")))
    last = first.withColumn("back", back).where(F.col("back") <= most)
    return last.select("project", F.row_number().over(Window.partitionBy("project").orderBy("at")).alias("place"), "target")
