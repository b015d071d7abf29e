"""Column functions over text: tokens, slugs, tags, entities, clipping, markers.

All are built-in expressions, so they stay inside whole-stage code.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{Nl}\p{No}]{3,}|\p{Nd}{3,}"
TWIN_WORD = "[a-zа-я0-9]{3,}"
# Cyrillic letters and their Latin spelling.
CYRILLIC = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ё": "e", "ж": "zh", "з": "z", "и": "i", "й": "y",
    "к": "k", "л": "l", "м": "m", "н": "n", "о": "o", "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f",
    "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sch", "ъ": "", "ы": "y", "ь": "", "э": "e", "ю": "yu", "я": "ya",
}
#: Device names that cannot name a project.
RESERVED = ["con", "prn", "aux", "nul", *(f"com{i}" for i in range(1, 10)), *(f"lpt{i}" for i in range(1, 10))]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def joined(*parts: Column | str) -> Column:
    """Parts joined by a space, null as empty."""
    return F.concat_ws(" ", *[F.coalesce(col(p), F.lit("")) for p in parts])


def token_list(text: Column | str) -> Column:
    """Lower-cased runs of three letters or more, or three digits or more, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TOKEN), F.lit(0))


def tokens(text: Column | str) -> Column:
    return F.array_distinct(token_list(text))


def content_tokens(text: Column | str) -> Column:
    """Distinct tokens of four characters or more."""
    return F.filter(tokens(text), lambda t: F.length(t) >= 4)


def twin_words(text: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(col(text), F.lit(""))), F.lit(TWIN_WORD), F.lit(0)))


def translit(text: Column | str) -> Column:
    """Cyrillic to Latin; capitals keep their case."""
    out = F.coalesce(col(text), F.lit(""))
    single = {k: v for k, v in CYRILLIC.items() if len(v) == 1}
    out = F.translate(out, "".join(single) + "".join(single).upper(), "".join(single.values()) + "".join(single.values()).upper())
    for letter, latin in CYRILLIC.items():
        if len(latin) != 1:
            out = F.replace(F.replace(out, F.lit(letter), F.lit(latin)), F.lit(letter.upper()), F.lit(latin.upper()))
    return out


def _dashes(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, "-+", "-"), F.lit("-"))


def slugify(text: Column | str, cut: int = 55) -> Column:
    """Portable lower-case name of at most `cut` characters; "untitled" when nothing is left."""
    s = F.regexp_replace(translit(text), r"[^\p{L}\p{N}_\s-]", " ")
    s = _dashes(F.regexp_replace(F.trim(s), r"\s+", "-"))
    s = _dashes(F.regexp_replace(s, r"[^\x00-\x7F]", ""))
    s = F.lower(F.substring(s, 1, cut))
    return F.when(s == "", "untitled").otherwise(s)


def slug_tag(tag: Column | str) -> Column:
    return F.regexp_replace(F.replace(F.lower(F.trim(F.coalesce(col(tag), F.lit("")))), F.lit(" "), F.lit("_")), r"[^\p{L}\p{N}_\-/]", "")


def slug_project(name: Column | str) -> Column:
    """Project name without dashes; reserved device names get a prefix, nothing becomes "general"."""
    s = slugify(name, 40)
    plain = F.trim(F.replace(s, F.lit("-"), F.lit("_")), F.lit("._"))
    plain = F.when(plain.isin(RESERVED), F.concat(F.lit("project_"), plain)).otherwise(plain)
    return F.when((s == "untitled") | (plain == ""), "general").otherwise(plain)


def norm_tags(tags: Column | str) -> Column:
    """Canonical tags in first-seen order: dashes become underscores, empty ones go."""
    one = F.transform(F.coalesce(col(tags), F.array().cast("array<string>")), lambda t: F.trim(F.replace(slug_tag(t), F.lit("-"), F.lit("_")), F.lit("_")))
    return F.array_distinct(F.filter(one, lambda t: t != ""))


def norm_entity(name: Column | str) -> Column:
    """Lower-case kebab name of 2 to 40 characters, else null."""
    s = F.lower(F.trim(F.regexp_replace(col(name), r"[^\p{L}\p{N}_\s-]", " ")))
    s = F.trim(F.regexp_replace(s, r"[\s_]+", "-"), F.lit("-"))
    return F.when(F.length(s).between(2, 40), s)


def norm_entities(names: Column | str, cap: int = 8) -> Column:
    return F.slice(F.array_distinct(F.array_compact(F.transform(F.coalesce(col(names), F.array().cast("array<string>")), norm_entity))), 1, cap)


def norm_relations(edges: Column | str, cap: int = 8) -> Column:
    """Array of (rel, target) with both ends normalised; incomplete and repeated edges go."""
    both = F.transform(col(edges), lambda e: F.struct(norm_entity(e["rel"]).alias("rel"), norm_entity(e["target"]).alias("target")))
    return F.slice(F.array_distinct(F.filter(both, lambda e: e["rel"].isNotNull() & e["target"].isNotNull())), 1, cap)


def norm_entity_types(types: Column | str, allowed: list[str] | None = None, cap: int = 8) -> Column:
    """Entries (entity, type) of a map in key order, first one of an entity wins; types outside `allowed` go."""
    kind = lambda t: F.regexp_replace(F.lower(F.trim(t)), "[^a-z0-9-]", "")
    entries = F.transform(F.map_entries(col(types)), lambda e: F.struct(norm_entity(e["key"]).alias("key"), kind(e["value"]).alias("value")))
    fits = lambda e: e["key"].isNotNull() & F.length(e["value"]).between(2, 24) & (e["value"].isin(allowed) if allowed else F.lit(True))
    entries = F.filter(entries, fits)
    first = F.filter(entries, lambda e, i: F.array_position(F.transform(entries, lambda x: x["key"]), e["key"]) == i + 1)
    return F.slice(first, 1, cap)


def one_line(text: Column | str, limit: int = 120) -> Column:
    """Spaces collapsed; a long text ends at its last sentence end past 40 % of the limit, else at a word with an ellipsis."""
    s = F.trim(F.regexp_replace(F.coalesce(col(text), F.lit("")), r"\s+", " "))
    head = F.substring(s, 1, limit)
    sentence = F.regexp_extract(head, r"^(.*[.!?])(?:\s|$)", 1)
    word = F.regexp_replace(head, r"\s+\S*$", "")
    cut = F.when(F.length(sentence) > int(limit * 0.4), sentence).otherwise(F.concat(word, F.lit("…")))
    return F.when(F.length(s) <= limit, s).otherwise(cut)


def clip_utf8(text: Column | str, limit: int) -> Column:
    """The longest head of at most `limit` UTF-8 bytes that splits no character."""
    raw = F.encode(F.coalesce(col(text), F.lit("")), "UTF-8")
    code = lambda at: F.conv(F.hex(F.substring(raw, F.lit(at), F.lit(1))), 16, 10).cast("int")
    inside = lambda at: code(at).between(0x80, 0xBF)
    # the byte after the cut must not be a continuation
    keep = F.lit(limit)
    for back in range(1, 4):
        keep = F.when((keep == limit - back + 1) & inside(limit - back + 2), limit - back).otherwise(keep)
    short = F.octet_length(raw) <= limit
    return F.when(short, col(text)).otherwise(F.decode(F.substring(raw, F.lit(1), keep), "UTF-8"))


def est_tokens(text: Column | str) -> Column:
    return F.floor(F.length(F.coalesce(col(text), F.lit(""))) / 4).cast("long")


def _tenths(n: Column, unit: int) -> Column:
    """n / unit as a binary fraction, rounded to whole tenths as a float is printed: what lies exactly between goes to the even one."""
    q, rest, half = F.floor(n / (unit // 10)), n % (unit // 10), unit // 20
    value = n.cast("double") / unit
    # the fraction times this power of two is a whole number, so its error can be seen
    scale = F.when(value < 1024, F.lit(1 << 52)).otherwise(F.lit(1 << 40))
    error = (value * scale).cast("long").cast("decimal(38,0)") * unit - n.cast("decimal(19,0)") * scale.cast("decimal(18,0)")
    up = (rest > half) | ((rest == half) & ((error > 0) | ((error == 0) & (q % 2 == 1))))
    return q + up.cast("long")


def human(n: Column | str) -> Column:
    """11200 as 11.2k, 12000 as 12k, 999999 as 1M, 950 as it is."""
    n = col(n).cast("long")
    size = F.abs(n)

    def short(unit: int, name: str) -> Column:
        t = _tenths(size, unit)
        tail = F.when(t % 10 == 0, "").otherwise(F.concat(F.lit("."), (t % 10).cast("string")))
        return F.concat(F.when(n < 0, "-").otherwise(""), F.floor(t / 10).cast("string"), tail, F.lit(name))

    return F.when(size > 950_000, short(1_000_000, "M")).when(size > 950, short(1000, "k")).otherwise(n.cast("string"))


def links(text: Column | str) -> Column:
    """Distinct targets of [[target]], [[target|label]] and [[target#part]]."""
    found = F.regexp_extract_all(F.coalesce(col(text), F.lit("")), F.lit(r"\[\[([^\]|#]+)"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda t: F.trim(t)), lambda t: t != ""))
