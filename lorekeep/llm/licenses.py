"""Licence scan by sentence rules.

A text is cut into sentences (and the lines inside them), each is normalised (the
lead of a notice, as "this work is licensed under the", to one word) and looked up
in a table of known licence sentences. The identifiers found, in order, are matched
against ordered rules: a rule holds when its identifiers occur in its order, and no rule
holds that asks for all of them and more. Reserved rights count where no licence holds. The
tables (`license_table`) are fixed and small, so they are in-plan literals; texts
are never shuffled.

Defined cases: a null or empty text has no licence; a sentence that is one line
counts once, repeated sentences count each time; decoration and white space between
words have no effect at any length; rows are judged one by one, so repeated ids give
repeated rows; a null id is kept; other columns of any name are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.license_table import ELSE, LEAD, RULES, SENTENCES

#: Words one of which is in every known sentence as it is written; a text without any is not cut.
ANCHORS = ["licens", "licenc", "copyright", "permission", "software", "permitted", "rights", "program", "source code", "public domain", "warranty", "under "]
ENDS = r"[.!?;:]+[\x20\x09-\x0D]+|[\x20\x09\x0B\x0C]*\n[\x20\x09\x0B\x0C\x0D]*\n\s*"
LINES = r"[\r\n]+"


def _plain(s: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(s), "[^a-z0-9]+", " "))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order.

    A sentence may hold a mark that cuts it ("Identifier: MIT", "v. 2.0"), so up
    to three consecutive pieces are also looked up as one, the first of them whole
    or by its last line, the last of them whole or by its first line.
    """
    # by length first: the few sentences of one length are compared
    by: dict[int, list] = {}
    for s, name in sentences.items():
        by.setdefault(len(s), []).extend([F.lit(s), F.lit(name)])
    table = F.create_map(*[x for size, own in by.items() for x in (F.lit(size), F.create_map(*own))])
    known = lambda s: F.element_at(F.element_at(table, F.length(s)), s)
    # no known sentence is longer with its lead
    longest = max(map(len, sentences)) + 80
    lines = lambda s: F.filter(F.transform(F.split(s, LINES), _plain), lambda x: x != "")
    several = lambda s: F.when(s.contains("\n") | s.contains("\r"), lines(s)).otherwise(F.array().cast("array<string>"))
    parts = F.filter(F.transform(F.split(text, ENDS), lambda s: F.struct(_plain(s).alias("whole"), several(s).alias("lines"))), lambda x: x["whole"] != "")

    def names(p: Column, x: Column, i: Column) -> Column:
        y, z = F.get(p, i + 1), F.get(p, i + 2)
        # a piece of one line is that line
        own = F.when(F.size(x["lines"]) > 1, x["lines"]).otherwise(F.array().cast("array<string>"))
        heads = [x["whole"], F.get(own, F.size(own) - 1)]
        ends = lambda last: [last["whole"], F.when(F.size(last["lines"]) > 1, F.get(last["lines"], F.lit(0)))]
        short = lambda s: F.when(F.length(s) <= longest, s)
        middle = short(y["whole"])
        tails = [short(t) for t in ends(y)] + [F.concat(middle, F.lit(" "), short(t)) for t in ends(z)]
        joined = F.array(*[F.concat(short(h), F.lit(" "), t) for h in heads for t in tails])
        found = F.filter(F.concat(F.array(x["whole"]), own, joined), lambda s: F.length(s) <= longest)
        return F.transform(found, lambda s: known(F.regexp_replace(s, LEAD, "under ")))

    # the pieces are bound to a variable, so that they are made once a text
    found = F.transform(F.array(parts), lambda p: F.flatten(F.transform(p, lambda x, i: names(p, x, i))))
    return F.filter(F.get(found, F.lit(0)), lambda x: x.isNotNull())


def wider_rules(names: list[str], rules: list[tuple[str, list[str]]]) -> list[list[str]]:
    """The rules that ask for all of `names` and more."""
    return [own for _, own in rules if set(names) < set(own)]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES, anchors: list[str] = ANCHORS) -> DataFrame:
    """One row per row of `df`: id, licenses (sorted, comma-joined), n_sentences, sentence_ids (comma-joined, in order)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    near = F.lower(text).rlike("|".join(anchors))
    ids = F.when(near, sentence_ids(text, sentences)).otherwise(F.array().cast("array<string>"))
    rows = df.select(F.col(id_col), ids.alias("_ids"))
    line = F.concat(F.lit(","), F.array_join("_ids", ","), F.lit(","))
    holds = lambda names: line.rlike(f",{',(.*,)?'.join(names)},")
    held = []
    for name, names in rules:
        rule = holds(names)
        for wider in wider_rules(names, rules):
            rule = rule & ~holds(wider)
        held.append(F.when(rule, F.lit(name)))
    found = F.array_sort(F.array_distinct(F.array_compact(F.array(*held))))
    found = F.when(F.size(found) > 1, F.array_remove(found, ELSE)).otherwise(found)
    return rows.select(id_col, F.array_join(found, ",").alias("licenses"), F.size("_ids").cast("long").alias("n_sentences"), F.array_join("_ids", ",").alias("sentence_ids"))
