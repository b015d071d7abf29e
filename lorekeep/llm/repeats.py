"""Repeated byte strings by enhanced suffix arrays, and their removal.

Every string of `least` bytes has an anchor, the last of its GRAM-byte grams with the least
hash, which depends on the string alone: equal strings have equal anchors at equal offsets. So a
text becomes one row per anchor, with the range of offsets of the strings that share it, the
anchor's digest, and a digest of the piece that those strings make up (at most
2 * least - GRAM bytes). Strings of different anchor digests never match.

Pieces that are equal as a whole are repeats without a look at their bytes; one of them stands
for all. The distinct pieces of one anchor digest are a block of suffixes: sorted by what follows
the anchor, with the lengths of common prefixes between neighbours, they are an enhanced suffix
array, and a scan with a stack gives its common-prefix intervals. What precedes the anchors is
sorted and scanned in the same way inside each interval; an interval of left contexts that spreads
over several children of the right one and is extended by different bytes on the left is a maximal
repeat, with all its occurrences. Work goes with suffixes and intervals, never with pairs.

A block of over TILE pieces is cut by offset ranges of 32, 8 and then 1: the strings of a range
share all but that many bytes, whose digest splits the block further, and equal pieces are folded
again. A range of one offset holds one string a piece, so nothing is left to compare.

A repeat longer than a piece comes as several groups that overlap; together they cover just the
bytes of strings of `least` bytes that start more than once. Occurrences are those of distinct
pieces (`copies` counts those that each stands for).

Defined cases: null texts are empty; texts shorter than `least` hold nothing; rows are told apart
by their texts alone, so null and repeated ids are kept and equal texts share their result; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored

LEAST, GRAM, STEP = 400, 128, 1 << 16
#: Pieces of a block that one task scans as a whole; offset ranges that larger blocks are cut into.
TILE, WIDTHS = 4096, (32, 8, 1)
#: Texts up to whose number their keys are broadcast to leave the others out of a shuffle.
BROADCAST_IDS = 1_000_000
BYTES = np.random.default_rng(20240512).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
BASE = 0x9E3779B97F4A7C15
LOW = np.uint64((1 << 24) - 1)


def grams(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` bytes (a power of two) from each place on."""
    h, width, power = BYTES[data], 1, BASE
    while width < size:
        h = h[:-width] * np.uint64(power) + h[width:]
        width, power = 2 * width, power * power % (1 << 64)
    h ^= h >> np.uint64(32)
    return h * np.uint64(0xD6E8FEB86659FD93)


def anchors(data: np.ndarray, least: int, gram: int) -> Iterator[tuple[int, int, int, int]]:
    """(anchor, first string, last string, digest) of each run of strings that share an anchor."""
    width, held = least - gram + 1, None
    for at in range(0, len(data) - least + 1, STEP):
        part = data[at : at + STEP + least - 1]
        h = grams(part, gram)
        # the least hash, and the last place that has it
        least_of, size = (h & ~LOW) | (LOW - np.arange(len(h), dtype=np.uint64)), 1
        while size < width:
            step = min(size, width - size)
            least_of = np.minimum(least_of[:-step], least_of[step:])
            size += step
        place = (LOW - (least_of & LOW)).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(place[1:] != place[:-1]) + 1))
        last = np.concatenate((first[1:] - 1, [len(place) - 1]))
        x = place[first]
        for row in zip((x + at).tolist(), (first + at).tolist(), (last + at).tolist(), h[x].view(np.int64).tolist(), strict=True):
            if held and held[0] == row[0]:
                held = (held[0], held[1], row[2], held[3])
                continue
            if held:
                yield held
            held = row
    if held:
        yield held


def _halves(digest: int) -> tuple[int, int]:
    return (digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)


ANCHOR = "t1 long, t2 long, x int, lo int, hi int, digest long, s1 long, s2 long, n long"


def _rows(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _scan(least: int, gram: int):
    """Anchors of each text; equal pieces of one text are one row with their number, and rows without a digest that cover them all."""
    names = [c.split()[0] for c in ANCHOR.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in ANCHOR.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest = xxhash.xxh3_128_intdigest
        for batch in batches:
            out: list[tuple] = []
            for t1, t2, text in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("raw"), strict=True):
                raw = text.as_py() or b""
                if len(raw) < least:
                    continue
                own: dict[int, list[int]] = {}
                twice: list[tuple[int, int]] = []
                for x, first, last, h in anchors(np.frombuffer(raw, np.uint8), least, gram):
                    key = digest(raw[first : last + least], h & 0xFFFFFFFF)
                    if key in own:
                        own[key][-1] += 1
                        twice.append((first, last + least))
                    else:
                        own[key] = [x, x - last, x - first, h, 1]
                out += [(t1, t2, x, lo, hi, h, *_halves(key), n) for key, (x, lo, hi, h, n) in own.items()]
                twice += [(x - hi, x - lo + least) for x, lo, hi, _, n in own.values() if n > 1]
                out += [(t1, t2, a, b, None, None, None, None, None) for a, b in merged(twice)]
                if len(out) >= 50_000:
                    yield _rows(out, names, kinds)
                    out = []
            if out:
                yield _rows(out, names, kinds)

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Union of half-open spans, ascending; spans that touch are one."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


def intervals(lcp: list[int], low: int = 0) -> Iterator[tuple[int, int, int]]:
    """(first, last, length) of the common-prefix intervals of sorted suffixes with lengths over `low`, children before parents; lcp[i] is between i and i + 1."""
    stack: list[tuple[int, int]] = []
    for i, here in enumerate([*lcp, low]):
        first = i
        while stack and stack[-1][1] > here:
            first, length = stack.pop()
            yield first, i, length
        if here > low and (not stack or stack[-1][1] < here):
            stack.append((first, here))


def repeats(left: list[bytes], right: list[bytes], least: int) -> Iterator[tuple[int, int, list[int]]]:
    """Maximal repeats of `least` bytes or more across an anchor: (bytes before it, bytes from it on, positions that have it).

    `left` holds what precedes each anchor, backwards, `right` what follows. No two positions are equal in both.
    """
    if len(left) == 2:
        before, after = _common(*left), _common(*right)
        if before + after >= least:
            yield before, after, [0, 1]
        return
    order = sorted(range(len(right)), key=right.__getitem__)
    lcp = [_common(right[a], right[b]) for a, b in zip(order, order[1:], strict=False)]
    by_left = sorted(range(len(left)), key=left.__getitem__)
    left_lcp = np.array([_common(left[a], left[b]) for a, b in zip(by_left, by_left[1:], strict=False)])
    rank = np.empty(len(left), np.int64)
    rank[by_left] = np.arange(len(left))
    ranks, at = rank[order], np.empty(len(left), np.int64)
    at[order] = np.arange(len(order))
    lcp_of = np.array(lcp)
    for first, last, after in intervals(lcp, least - int(left_lcp.max(initial=0)) - 1):
        own = np.sort(ranks[first : last + 1])
        near = np.minimum.reduceat(left_lcp[: own[-1]], own[:-1])
        if near.max() < least - after:
            continue
        for a, b, before in intervals(near.tolist(), least - after - 1):
            held = [by_left[r] for r in own[a : b + 1]]
            places = at[held]
            # right-maximal if it meets more than one child of the interval; a child reports what lies in it alone
            if lcp_of[places.min() : places.max()].min() == after:
                yield before, after, held


PIECE = "g long, t1 long, t2 long, x int, lo int, hi int, n long, before binary, after binary"
GROUP = "g long, no int, length int, t1 long, t2 long, start int, copies long"


COVERED = "t1 long, t2 long, start int, stop int"


def _scanned(least: int, schema: str, rows):
    """Pieces sorted by block to what `rows(block, repeats)` gives of each block of more than one piece."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]

    def scan(block: list[dict]) -> Iterator[tuple]:
        if len(block) > 1:
            yield from rows(block, repeats([p["before"][::-1] for p in block], [p["after"] for p in block], least))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[dict] = []
        out: list[tuple] = []
        for batch in (part for whole in batches for part in (whole.slice(a, 2000) for a in range(0, whole.num_rows, 2000))):
            for p in batch.to_pylist():
                if block and block[0]["g"] != p["g"]:
                    out += scan(block)
                    block = []
                block.append(p)
            if len(out) >= 20_000:
                yield _rows(out, names, kinds)
                out = []
        out += scan(block)
        if out:
            yield _rows(out, names, kinds)

    return run


def _occurrences(block: list[dict], found: Iterator[tuple[int, int, list[int]]]) -> Iterator[tuple]:
    """Every maximal repeat with all its occurrences."""
    for no, (before, after, held) in enumerate(found):
        for p in (block[i] for i in held):
            yield p["g"], no, before + after, p["t1"], p["t2"], p["x"] - before, p["n"]


def _covered(block: list[dict], found: Iterator[tuple[int, int, list[int]]]) -> Iterator[tuple]:
    """What the maximal repeats cover of each piece; a piece with copies is covered whole as it is."""
    spans: dict[int, set[tuple[int, int]]] = {}
    for before, after, held in found:
        for i in held:
            if block[i]["n"] == 1:
                spans.setdefault(i, set()).add((block[i]["x"] - before, block[i]["x"] + after))
    for i, own in spans.items():
        for a, b in merged(list(own)):
            yield block[i]["t1"], block[i]["t2"], a, b


def _cut(least: int):
    """Bytes around the anchors that are asked for in a text."""
    names = [c.split()[0] for c in PIECE.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for t1, t2, text, asked in zip(batch.column("t1").to_pylist(), batch.column("t2").to_pylist(), batch.column("raw"), batch.column("asked").to_pylist(), strict=True):
                raw = text.as_py()
                for p in asked:
                    x, lo, hi = p["x"], p["lo"], p["hi"]
                    out.append((p["g"], t1, t2, x, lo, hi, p["n"], raw[x - hi : x], raw[x : x + least - lo]))
                    if len(out) >= 5000:
                        yield _rows(out, names, kinds)
                        out = []
            if out:
                yield _rows(out, names, kinds)

    return run


SPLIT = PIECE + ", s1 long, s2 long"


def _split(least: int, width: int):
    """Pieces of a crowded block to ranges of `width` offsets; a block is what shares the bytes that all strings of a range have."""
    names = [c.split()[0] for c in SPLIT.split(", ")]
    kinds = [{"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[c.split()[1]] for c in SPLIT.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in (whole.slice(a, 1000) for a in range(0, whole.num_rows, 1000))):
            out = []
            for p in batch.to_pylist():
                raw, at = p["before"] + p["after"], len(p["before"])
                for b in range(p["lo"] // width, p["hi"] // width + 1):
                    lo, hi = max(p["lo"], b * width), min(p["hi"], b * width + width - 1)
                    core = raw[at - b * width : max(at - b * width, at + least - (b * width + width - 1))]
                    g = xxhash.xxh3_64_intdigest(core, (p["g"] + b) % (1 << 64)) - (1 << 63)
                    own = raw[at - hi : at + least - lo]
                    out.append((g, p["t1"], p["t2"], p["x"], lo, hi, p["n"], own[:hi], own[hi:], *_halves(xxhash.xxh3_128_intdigest(own, lo))))
            if out:
                yield _rows(out, names, kinds)

    return run


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


def _texts(df: DataFrame, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(*_text_keys(text), text.cast("binary").alias("raw"))


def _one_each(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(t1, t2, raw): each text that `keys` names, once."""
    if keys.count() <= BROADCAST_IDS:
        keys = F.broadcast(keys)
    return texts.join(keys, ["t1", "t2"], "left_semi").groupBy("t1", "t2").agg(F.first("raw").alias("raw"))


SPAN = ["t1", "t2", "start", "stop"]


def _folded(rows: DataFrame, block: str, least: int) -> tuple[DataFrame, DataFrame]:
    """Distinct pieces of each block with their number, and the spans of those that are several."""
    key = [block, "s1", "s2"]
    carried = [c for c in rows.columns if c not in (*key, "n")]
    kinds = stored(rows.groupBy(*key).agg(F.sum("n").alias("n"), F.min(F.struct(*carried)).alias("f")).select(*key, "n", "f.*"), "kinds")
    several = rows.drop("n").join(kinds.where("n > 1").select(*key), key, "left_semi")
    return kinds, several.select("t1", "t2", (F.col("x") - F.col("hi")).alias("start"), (F.col("x") - F.col("lo") + least).alias("stop"))


def _blocks(texts: DataFrame, least: int, gram: int, tile: int) -> tuple[list[DataFrame], DataFrame]:
    """Pieces (PIECE) in blocks that a task can scan as a whole, and the spans (SPAN) of pieces that are repeated whole."""
    found = stored(texts.mapInArrow(_scan(least, gram), ANCHOR), "anchors")
    spans = found.where("digest IS NULL").select("t1", "t2", F.col("x").alias("start"), F.col("lo").alias("stop"))
    rows = found.where("digest IS NOT NULL")
    often = rows.groupBy("digest").agg(F.sum("n").alias("c"), (F.min("s1") != F.max("s1")).alias("differ")).where("c > 1").select("digest", "differ")
    live = stored(rows.join(often, "digest"), "live")
    kinds, whole = _folded(live, "digest", least)
    spans = spans.union(whole)
    asked = stored(kinds.where("differ").select("t1", "t2", F.struct(F.col("digest").alias("g"), "x", "lo", "hi", "n").alias("p")), "asked")
    lists = asked.groupBy("t1", "t2").agg(F.collect_list("p").alias("asked"))  # places of one text
    pieces = stored(_one_each(texts, asked.select("t1", "t2").distinct()).join(lists, ["t1", "t2"]).mapInArrow(_cut(least), PIECE), "pieces")
    blocks = []
    for width in WIDTHS:
        crowded = stored(pieces.groupBy("g").count().where(F.col("count") > tile).select("g"), "crowded")
        if crowded.isEmpty():
            return [*blocks, pieces], spans
        blocks.append(pieces.join(crowded, "g", "left_anti"))
        parts = stored(pieces.join(crowded, "g").select(*pieces.columns).mapInArrow(_split(least, width), SPLIT), "parts")
        kinds, whole = _folded(parts, "g", least)
        spans = spans.union(whole)
        pieces = kinds.select(*[c.split()[0] for c in PIECE.split(", ")])
    return blocks, spans  # in ranges of one offset equal strings are folded, and no others are equal


def _each(blocks: list[DataFrame], least: int, schema: str, rows) -> DataFrame:
    scanned = [b.repartition("g").sortWithinPartitions("g").mapInArrow(_scanned(least, schema, rows), schema) for b in blocks]
    return reduce(DataFrame.union, scanned)


def repeat_groups(df: DataFrame, text_col: str = "text", least: int = LEAST, gram: int = GRAM, tile: int = TILE) -> tuple[DataFrame, DataFrame]:
    """Maximal repeats (GROUP: block, number, length, text key, start, copies) of the distinct pieces, and the spans (text key, start, stop) of pieces that are repeated whole.

    Both name a text by its two 64-bit keys (`_text_keys`). Repeats inside repeats are groups of their own, so an occurrence
    may be in several.
    """
    blocks, spans = _blocks(_texts(df, text_col), least, gram, tile)
    return _each(blocks, least, GROUP, _occurrences), spans


CLEAN = "t1 long, t2 long, n_removed long, n_spans long, starts array<int>, stops array<int>"


def _union(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [merged([(s["start"], s["stop"]) for s in x]) for x in batch.column("spans").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("t1"), batch.column("t2"), pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()), pa.array([len(x) for x in spans], pa.int64()), pa.array([[a for a, _ in x] for x in spans], pa.list_(pa.int32())), pa.array([[b for _, b in x] for x in spans], pa.list_(pa.int32()))],
            names=["t1", "t2", "n_removed", "n_spans", "starts", "stops"],
        )


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, starts, stops in zip(batch.column("raw"), batch.column("starts").to_pylist(), batch.column("stops").to_pylist(), strict=True):
            raw, sha = memoryview(text.as_py()), hashlib.sha256()
            for a, b in zip([0, *stops], [*starts, len(raw)], strict=True):
                sha.update(raw[a:b])
            out.append(sha.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("t1"), batch.column("t2"), pa.array(out)], names=["t1", "t2", "kept"])


def removals(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, tile: int = TILE) -> DataFrame:
    """Per row: n_bytes, n_removed, n_spans and the SHA-256 of what is left when each byte of a repeated string is taken out."""
    blocks, spans = _blocks(_texts(df, text_col), least, gram, tile)
    lists = spans.union(_each(blocks, least, COVERED, _covered)).groupBy("t1", "t2").agg(F.collect_set(F.struct("start", "stop")).alias("spans"))  # places of one text
    clean = stored(lists.mapInArrow(_union, CLEAN), "clean")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("doc_id"), *_text_keys(text), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text.cast("binary"), 256).alias("whole"))
    kept = _one_each(_texts(df, text_col), clean.select("t1", "t2")).join(clean, ["t1", "t2"]).mapInArrow(_kept, "t1 long, t2 long, kept string")
    done = stored(kept.join(clean.select("t1", "t2", "n_removed", "n_spans"), ["t1", "t2"]), "kept")
    zero = F.lit(0).cast("long")
    return rows.join(done, ["t1", "t2"], "left").select(F.col("doc_id").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("kept", "whole").alias("kept_sha256"))
