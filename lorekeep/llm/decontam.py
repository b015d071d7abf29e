"""Benchmark decontamination with a distributed positional inverted index.

A window is 13 consecutive words of a benchmark item; an item of fewer words is
one window. The index holds a posting (row, term, position) of every occurrence,
in the training texts, of a term that the benchmark has, made in one pass over the
texts. The terms of a window are ordered by their number of postings. The list of
the rarest is adjusted by its offset and intersected with that of the second; what
both agree on is intersected with the lists of all others, so only postings of
rows that are still possible are read for the frequent terms. Windows that share
their two rarest terms at one distance share the first intersection. Postings carry
no text. Only DataFrame functions run, and texts are never shuffled.

Proximity matches ask for all terms of a window, as often as it has them and in
any order, within a stretch of the window's length and `slop` more.

Defined cases: null texts have no words; items without words or with a null id
are skipped; repeated item ids are one item; rows that repeat a document id are
judged each by its own text; a null document id is kept; an empty benchmark
finds nothing; other columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 13
#: Rows and bytes of strings up to which a table is broadcast; a larger one is shuffled.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 16 << 20


def words(text: Column) -> Column:
    """A-Z lower-cased, words in order."""
    plain = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(plain, BREAKS), "")


def _small(df: DataFrame) -> DataFrame:
    """`df` (already stored) with a broadcast hint if it is within the bounds."""
    strings = sum((F.octet_length(c) for c, kind in df.dtypes if kind == "string"), F.lit(0))
    rows, size = df.agg(F.count("*"), F.sum(strings)).first()
    return F.broadcast(df) if rows <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else df


def windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", size: int = WINDOW) -> DataFrame:
    """(phrase, terms, item): the windows of every item; a phrase is its terms joined by a space."""
    w = items.select(F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")).where("size(w) > 0 AND item IS NOT NULL")
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (size - 1), F.lit(1)))
    w = w.select("item", F.explode(F.transform(starts, lambda i: F.slice("w", i, size))).alias("terms"))
    return w.select(F.array_join("terms", " ").alias("phrase"), "terms", "item").distinct()


def numbered_terms(grams: DataFrame) -> DataFrame:
    """(term, tid): the distinct terms of windows, numbered."""
    return stored(grams.select(F.explode("terms").alias("term")).distinct().withColumn("tid", F.monotonically_increasing_id()), "terms")


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The index (row, tid, pos, id): a posting of every occurrence of a term, and per row of `docs` one without a tid that has its id and, as pos, its number of words."""
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words(F.col(text_col)).alias("w"))
    at = rows.select("row", "id", F.posexplode(F.concat("w", F.array(F.lit(None).cast("string")))).alias("pos", "term"))
    asked = terms.select(F.col("term").alias("asked"), "tid").union(terms.sparkSession.range(1).select(F.lit(None).cast("string"), F.lit(None).cast("long")))
    asked = _small(stored(asked, "asked"))
    found = at.join(asked, F.col("term").eqNullSafe(F.col("asked")))
    return stored(found.select("row", "tid", "pos", F.when(F.col("tid").isNull(), F.col("id")).alias("id")), "postings")


def ordered_windows(grams: DataFrame, terms: DataFrame, index: DataFrame) -> DataFrame:
    """(pid, phrase, size, lists): every phrase that can occur; lists are its (n, off, tid), those with the fewest postings first."""
    counts = index.where("tid IS NOT NULL").groupBy("tid").agg(F.count("*").alias("n"))
    sizes = _small(stored(terms.join(counts, "tid", "left").select("term", "tid", F.coalesce("n", F.lit(0).cast("long")).alias("n")), "counts"))
    each = grams.select("phrase", "terms").distinct().select("phrase", F.posexplode("terms").alias("off", "term")).join(sizes, "term")
    lists = each.groupBy("phrase").agg(F.sort_array(F.collect_list(F.struct("n", "off", "tid"))).alias("lists")).where("lists[0].n > 0")
    return stored(lists.select(F.monotonically_increasing_id().alias("pid"), "phrase", F.size("lists").alias("size"), "lists"), "lists")


def phrase_matches(index: DataFrame, lists: DataFrame) -> DataFrame:
    """(row, start, stop, pid): every place where all terms of a window stand in its order."""
    at = lists.select("pid", "size", F.col("lists")[0]["tid"].alias("t0"), F.col("lists")[0]["off"].alias("off0"), F.get("lists", F.lit(1))["tid"].alias("t1"), (F.get("lists", F.lit(1))["off"] - F.col("lists")[0]["off"]).alias("apart"))
    at = _small(stored(at, "firsts"))
    found = index.where("tid IS NOT NULL").select("row", "pos", "tid")
    one = found.join(at.where("size = 1"), F.col("tid") == F.col("t0")).select("row", "pid", F.col("pos").alias("start"), "size")
    # the two rarest lists, shifted to the place of the second
    pairs = _small(stored(at.where("size > 1").select("t0", "t1", "apart").distinct(), "pairs"))
    first = found.join(pairs, F.col("tid") == F.col("t0")).select("row", "t0", "t1", "apart", F.col("pos").alias("p0"), (F.col("pos") + F.col("apart")).alias("pos"))
    seconds = _small(stored(pairs.select(F.col("t1").alias("tid")).distinct(), "seconds"))
    second = found.join(seconds, "tid", "left_semi").select("row", "pos", F.col("tid").alias("t1"))
    both = first.join(second, ["row", "pos", "t1"]).select("row", "t0", "t1", "apart", "p0")
    starts = both.join(at, ["t0", "t1", "apart"]).select("row", "pid", (F.col("p0") - F.col("off0")).alias("start"), "size").where("start >= 0")
    starts = stored(one.union(starts), "starts")
    # all other lists, in the rows that are left
    rows = _small(stored(starts.where("size > 2").select("row").distinct(), "rows"))
    rest = lists.where("size > 2").select("pid", F.explode(F.slice("lists", 3, F.greatest(F.col("size") - 2, F.lit(0)))).alias("t"))
    rest = _small(stored(rest.select("pid", "t.off", "t.tid"), "rest"))
    asked = starts.join(rest, "pid").select("row", "pid", "start", "size", (F.col("start") + F.col("off")).alias("pos"), "tid")
    agreed = asked.join(found.join(rows, "row", "left_semi"), ["row", "pos", "tid"]).groupBy("row", "pid", "start", "size").agg(F.count("*").alias("n")).where("n = size - 2").drop("n")
    return starts.where("size <= 2").union(agreed).select("row", "start", (F.col("start") + F.col("size")).alias("stop"), "pid")


def proximity_matches(index: DataFrame, lists: DataFrame, slop: int = 5) -> DataFrame:
    """(row, pos, pid): postings of a window's rarest term in some stretch of its length and `slop` that has all its terms, as often as it has them, in any order."""
    at = lists.select("pid", (F.col("size") + slop).alias("reach"), F.col("lists")[0]["tid"].alias("tid"))
    needs = lists.select("pid", F.explode("lists").alias("t")).groupBy("pid", "t.tid").agg(F.count("*").alias("k"))
    at, needs = _small(stored(at, "firsts")), stored(needs, "needs")
    found = index.where("tid IS NOT NULL").select("row", "pos", "tid")
    cell = lists.agg(F.max("size")).first()[0]
    if cell is None:
        return found.select("row", "pos", F.col("tid").alias("pid")).limit(0)
    cell += slop
    rarest = found.join(at, "tid").select("row", "pid", "reach", F.col("pos").alias("p"))
    asked = rarest.join(_small(needs), "pid").select("row", "pid", "reach", "p", "tid", "k", F.explode(F.array(*[F.floor(F.col("p") / cell) + i for i in (-1, 0, 1)])).alias("cell"))
    near = asked.join(found.withColumn("cell", F.floor(F.col("pos") / cell)), ["row", "tid", "cell"]).where(F.abs(F.col("pos") - F.col("p")) < F.col("reach"))
    # a term's places around p: at most two stretches of them
    per_term = near.groupBy("row", "pid", "reach", "p", "tid", "k").agg(F.collect_list("pos").alias("places"))
    per_match = per_term.groupBy("row", "pid", "reach", "p").agg(F.collect_list(F.struct("k", "places")).alias("terms"), F.sum("k").alias("n"))
    whole = per_match.join(lists.select("pid", F.col("size").alias("asked")), "pid").where("n = asked")
    inside = lambda t, a: F.size(F.filter(t["places"], lambda x: (x >= a) & (x < a + F.col("reach")))) >= t["k"]
    stretch = F.exists(F.sequence(F.col("p") - F.col("reach") + 1, F.col("p")), lambda a: F.forall("terms", lambda t: inside(t, a)))
    return whole.where(stretch).select("row", F.col("p").alias("pos"), "pid")


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, share: int = 20) -> DataFrame:
    """One row per row of `docs`: id, n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words)."""
    grams = stored(windows(benchmark, item_col, item_text_col, size), "windows")
    terms = numbered_terms(grams)
    index = postings(docs, terms, id_col, text_col)
    lists = ordered_windows(grams, terms, index)
    found = stored(phrase_matches(index, lists), "matches")
    # words inside any occurrence: lengths of the union of its intervals
    spans = found.select("row", "start", "stop").distinct()
    reached = F.max("stop").over(Window.partitionBy("row").orderBy("start", "stop").rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(reached, F.lit(0)))))
    hits = spans.groupBy("row").agg(F.sum("new").cast("long").alias("n_hit"))
    of = _small(stored(lists.select("pid", "phrase").join(grams.select("phrase", "item"), "phrase").select("pid", "item"), "items"))
    items = found.select("row", "pid").distinct().join(of, "pid").groupBy("row").agg(F.sort_array(F.collect_set("item")).alias("items"))
    rows = index.where("tid IS NULL").select("row", F.col("id"), F.col("pos").cast("long").alias("n_words"))
    out = rows.join(hits.join(items, "row"), "row", "left")
    n_hit, items = F.coalesce("n_hit", F.lit(0).cast("long")), F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        ((n_hit > 0) & (share * n_hit >= F.col("n_words"))).alias("contaminated"),
    )
