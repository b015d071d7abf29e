"""Relational primitives over any DataFrame: filter, project, order, head, and hygiene of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.shared import stored

HEAD_SHARE, MARKER = 0.4, "\n\n[...middle of the transcript trimmed...]\n\n"


def where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(condition)


def select(df: DataFrame, *names: str) -> DataFrame:
    """The named columns in order; a missing one is null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def order_keys(name: str, descending: bool = True) -> list[tuple[Column, bool]]:
    """What rows are sorted by, and whether downwards: numbers before texts (after them when descending), missing and empty values last either way."""
    text = F.col(name).cast("string")
    number = text.try_cast("double")
    return [(text.isNull() | (text == ""), False), (number.isNull(), descending), (number, descending), (text, descending)]


def order_by(df: DataFrame, name: str, descending: bool = True) -> DataFrame:
    return df.orderBy(*[k.desc() if down else k.asc() for k, down in order_keys(name, descending)])


def top(df: DataFrame, n: int) -> DataFrame:
    return df.limit(max(0, n))


def strip_boilerplate(texts: DataFrame, key: str, text_col: str, least: int = 200, repeats: int = 3) -> DataFrame:
    """(key, text): injected reminder blocks removed; a long paragraph that occurs `repeats` times or more stays once."""
    plain = F.regexp_replace(text_col, r"(?s)<system-reminder>.*?</system-reminder>", " ")
    parts = texts.select(key, F.posexplode(F.split(plain, "\n\n")).alias("at", "part"))
    w = Window.partitionBy(key, "part")
    marked = parts.withColumns({"n": F.count("*").over(w), "nth": F.row_number().over(w.orderBy("at"))})
    kept = marked.where((F.length("part") < least) | (F.col("n") < repeats) | (F.col("nth") == 1))
    return kept.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "part"))), lambda e: e["part"]), "\n\n").alias("text"))


def head_tail(text: Column, limit: int = 12_000) -> Column:
    """Head and tail of a long text with a marker between."""
    head = min(int(limit * HEAD_SHARE), limit - len(MARKER) - 100)
    if head <= 0:
        return F.substring(text, 1, limit)
    tail = limit - head - len(MARKER)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, head), F.lit(MARKER), F.right(text, F.lit(tail))))


def stale(notes: DataFrame, files: DataFrame, text_col: str = "text") -> DataFrame:
    """(stem, cited, found, stale): notes that cite paths, none of which is in files (path)."""
    quoted = F.filter(F.regexp_extract_all(text_col, F.lit(r"`([^`\n]+?\.[A-Za-z0-9]{1,8})`"), F.lit(1)), lambda p: p.contains("/") | p.contains("\\"))
    bare = F.regexp_extract_all(text_col, F.lit(r"(?:^|[^\w/\\.])([A-Za-z0-9_.\-]+(?:[/\\][A-Za-z0-9_.\-]+)+\.[A-Za-z0-9]{1,8})"), F.lit(1))
    cited = F.array_distinct(F.transform(F.concat(quoted, bare), lambda p: F.replace(F.trim(p), F.lit("\\"), F.lit("/"))))
    rows = notes.select("stem", F.explode(F.filter(cited, lambda p: ~p.contains("://") & ~p.rlike("^(http|www[.])"))).alias("path"))
    known = files.select("path").distinct().withColumn("known", F.lit(1))
    per = rows.join(known, "path", "left").groupBy("stem").agg(F.count("*").alias("cited"), F.count("known").alias("found"))
    return per.withColumn("stale", F.col("found") == 0)


def numbered(df: DataFrame, order: list[tuple[Column, bool]], name: str = "place") -> DataFrame:
    """`df` with the place of each row in a total order, from 1: rows are sorted by range in many tasks, and a task adds the number of rows before its own."""
    ranged = df.select("*", *[c.alias(f"_o{i}") for i, (c, _) in enumerate(order)])
    keys = [F.col(f"_o{i}").desc() if down else F.col(f"_o{i}").asc() for i, (_, down) in enumerate(order)]
    dealt = stored(ranged.repartitionByRange(*keys).withColumn("_task", F.spark_partition_id()), "ranged")
    before, offsets = 0, []
    for r in dealt.groupBy("_task").count().orderBy("_task").collect():  # one row a task
        offsets.append((r["_task"], before))
        before += r["count"]
    start = df.sparkSession.createDataFrame(offsets, "_task int, _before long")
    own = F.row_number().over(Window.partitionBy("_task").orderBy(*keys))
    return dealt.join(F.broadcast(start), "_task").withColumn(name, own + F.col("_before")).select(*df.columns, name)


def above(path: Column) -> Column:
    """Every folder above a path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def project_of_path(rows: DataFrame, roots: DataFrame, key: str = "id") -> DataFrame:
    """(key, project): the segment under the longest matching root (column root), else the last segment of the path."""
    hit = rows.select(key, "path", F.explode(above(F.col("path"))).alias("root")).join(roots.select("root").distinct(), "root", "left_semi")
    longest = hit.groupBy(key, "path").agg(F.max(F.length("root")).alias("n"))
    both = rows.select(key, "path").join(longest, [key, "path"], "left")
    under = F.substring_index(F.expr("substring(path, n + 2)"), "/", 1)
    return both.select(key, F.when(F.col("n").isNotNull(), under).otherwise(F.substring_index("path", "/", -1)).alias("project"))


def tracked(rows: DataFrame, roots: DataFrame, excludes: list[str], key: str = "id") -> DataFrame:
    """(key, tracked): paths below a root, not in an excluded place."""
    hit = rows.select(key, F.explode(above(F.col("path"))).alias("root")).join(roots.select("root").distinct(), "root", "left_semi").select(key, F.lit(True).alias("inside"))
    out = F.lit(False)
    for e in excludes:
        out = out | F.col("path").contains(e)
    return rows.join(hit.distinct(), key, "left").select(key, (F.coalesce("inside", F.lit(False)) & ~out).alias("tracked"))
