"""Substring dedup by content-defined chunks.

A gear rolling hash over the last 16 bytes of a text cuts it where it exceeds the
hashes of the 32 bytes before and after, so borders depend on the bytes around
them alone and move with them: an insertion changes the chunks around it and no
others, and chunks of 33 bytes or more come without a minimum that would carry a
difference on from cut to cut. Text that repeats itself within that reach is cut at
equal hashes, in step with the text.

A chunk whose 64-bit digest occurs in a document with a smaller id is a repeat.
Adjacent repeats form a run. A passage cannot hold two whole chunks next to its run
that are no repeats, so runs that are too short with two neighbours on either side
are done with. In the others, adjacent chunks that first occur in one document at one
distance form a chain; the texts on both sides of a chain are compared with those
around its first occurrence, byte by byte up to AROUND, which gives the passage its
true ends in that one document. Passages of `min_words` words or more are reported.
Inside a chain equality rests on the digests of its chunks in a row.

`within` also finds passages that an earlier part of the same document holds.
Defined cases: null and empty texts have no chunks; rows with a null id are not
reported and no passage refers to them; rows that repeat an id are one document;
an empty table gives an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import new_path, stored
from lorekeep.shared import cleared

#: Bytes on either side that a cut's hash exceeds; longest chunk; bytes in one numpy step.
WIDE, MOST, STEP = 32, 128, 1 << 20
#: Bytes compared at most on either side of a chain; more than two chunks.
AROUND = 320
MIN_WORDS = 50
#: Places, and documents that have some, up to which their list is broadcast; with a longer one texts are shuffled, all of them beyond the second bound.
BROADCAST_ROWS, BROADCAST_IDS = 100_000, 2_000_000
GEAR = np.frombuffer(np.random.default_rng(20240101).bytes(1024), "<u4")
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def gear(data: np.ndarray) -> np.ndarray:
    """At each byte the sum of the last 16 gear values, each shifted by its distance."""
    h = GEAR[data]
    for k in (1, 2, 4, 8):
        h[k:] += h[:-k] << np.uint32(k)
    return h


def peaks(h: np.ndarray, own: slice) -> tuple[np.ndarray, np.ndarray]:
    """Places in `own` whose value exceeds the WIDE values on either side, and places where none of them exceeds it."""
    padded = np.concatenate((np.zeros(WIDE, h.dtype), h, np.zeros(WIDE, h.dtype)))
    top, size = padded.copy(), 1
    while size < WIDE:  # greatest of the last `size` values, up to WIDE
        step = min(size, WIDE - size)
        top[step:] = np.maximum(top[step:], top[:-step])
        size += step
    at = np.arange(own.start, own.stop)
    around = np.maximum(top[at + WIDE - 1], top[at + 2 * WIDE])
    here = padded[at + WIDE]
    return at[here > around], at[here >= around]


def cuts(data: np.ndarray) -> list[int]:
    """Chunk ends of a whole text, the last one included.

    Between two peaks the first equal place more than WIDE bytes on is a cut, again and again:
    text that repeats itself is cut in whole periods. No chunk is over MOST bytes.
    """
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for at in range(0, len(data), STEP):
        low, stop = max(0, at - WIDE - 15), min(len(data), at + STEP)
        strict, equal = peaks(gear(data[low : stop + WIDE]), slice(at - low, stop - low))
        found.append((strict + low + 1, equal + low + 1))
    if not found:
        return []
    marks, equal = (np.concatenate(x) for x in zip(*found, strict=True))
    ties = np.setdiff1d(equal, marks, assume_unique=True)
    out, last = [], 0
    for end in [*marks.tolist(), len(data)]:
        if end - last > WIDE and len(ties):
            k = np.searchsorted(ties, last + WIDE, "right")
            while k < len(ties) and ties[k] < end:
                while ties[k] - last > MOST:
                    last += MOST
                    out.append(last)
                last = int(ties[k])
                out.append(last)
                k = np.searchsorted(ties, last + WIDE, "right")
        while end - last > MOST:
            last += MOST
            out.append(last)
        if end > last:
            out.append(end)
            last = end
    return out


def word_starts(data: np.ndarray) -> np.ndarray:
    space = SPACE[data]
    return ~space & np.concatenate(([True], space[:-1]))


#: `info` packs what is known of a chunk: its size, its words, those of the two chunks before it and of the two after it.
CHUNK = "digest long, doc_id long, start int, info int"
SIZE, WORDS, BEFORE, AFTER = ((0, 255), (8, 127), (15, 255), (23, 255))


def _info(part: tuple[int, int], info: str = "info") -> Column:
    return F.shiftright(info, part[0]).bitwiseAND(part[1])


def _chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    digest = xxhash.xxh3_64_intdigest
    for batch in batches:
        held: list[tuple] = []
        rows = 0

        def flush() -> pa.RecordBatch:
            columns = [np.concatenate([h[i] for h in held]) for i in range(4)]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["digest", "doc_id", "start", "info"])

        for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
            if not raw:
                continue
            data = np.frombuffer(raw, np.uint8)
            ends = cuts(data)
            stop = np.array(ends, np.int64)
            start = np.concatenate(([0], stop[:-1]))
            hashes = np.fromiter([digest(raw[a:b]) for a, b in zip([0, *ends], ends, strict=False)], np.uint64, len(ends)).view(np.int64)
            words = np.add.reduceat(word_starts(data), start, dtype=np.int32)
            edge = np.concatenate((np.zeros(2, np.int32), words, np.zeros(2, np.int32)))
            before, after = edge[:-4] + edge[1:-3], edge[3:-1] + edge[4:]
            info = (stop - start).astype(np.int32) | words << WORDS[0] | before << BEFORE[0] | after << AFTER[0]
            held.append((hashes, np.full(len(ends), key, np.int64), start.astype(np.int32), info))
            rows += len(ends)
            if rows >= 50_000:
                yield flush()
                rows = 0
        if held:
            yield flush()


def chunks(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(digest, doc_id, start, info) of every chunk of every text with an id."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_chunk, CHUNK)


def chains(table: DataFrame, min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """Chains (doc_id, chain, start, stop, words, f_doc, f_start) in the runs of repeats that may hold a passage, with their first occurrence."""
    place = F.min(F.struct("doc_id", "start")).alias("f")
    first = table.groupBy("digest").agg(place, F.max("doc_id").alias("last"), F.count("*").alias("n")).where("n > 1" if within else "f.doc_id < last")
    first = first.select("digest", F.col("f.doc_id").alias("f_doc"), F.col("f.start").alias("f_start"))
    repeats = table.join(first, "digest").where("doc_id > f_doc OR doc_id = f_doc AND start > f_start" if within else "doc_id > f_doc")
    repeats = repeats.select("doc_id", "start", (F.col("start") + _info(SIZE)).alias("stop"), "info", "f_doc", "f_start")
    w = Window.partitionBy("doc_id").orderBy("start")
    far = F.col("f_start") - F.col("start")
    near = F.lag("stop").over(w) == F.col("start")
    same = near & (F.lag("f_doc").over(w) == F.col("f_doc")) & (F.lag(far).over(w) == far)
    repeats = repeats.withColumns({"run": F.sum(F.when(near, 0).otherwise(1)).over(w), "chain": F.sum(F.when(same, 0).otherwise(1)).over(w)})
    grouped = repeats.groupBy("doc_id", "run", "chain").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.sum(_info(WORDS)).alias("words"), F.min("f_doc").alias("f_doc"), F.min("f_start").alias("f_start"), F.min_by(_info(BEFORE), "start").alias("before"), F.max_by(_info(AFTER), "start").alias("after"))
    r = Window.partitionBy("doc_id", "run")
    most = F.sum("words").over(r) + F.min_by("before", "start").over(r) + F.max_by("after", "start").over(r)
    return grouped.withColumn("most", most).where(F.col("most") >= min_words).select("doc_id", "chain", "start", "stop", "words", "f_doc", "f_start")


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes and word starts that two sides share, counted from the chain outwards."""
    for batch in batches:
        sizes, words = [], []
        for left, own, other in zip(batch.column("left").to_pylist(), batch.column("own"), batch.column("other"), strict=True):
            a, b = (np.frombuffer(x.as_py() or b"", np.uint8) for x in (own, other))
            n = min(len(a), len(b))
            differ = a[::-1][:n] != b[::-1][:n] if left else a[:n] != b[:n]
            n = int(np.argmax(differ)) if differ.any() else n
            # the left side's first byte starts a word only if a space or the text's start is before it
            starts = word_starts(a)
            inner = starts[len(a) - n :] if left else word_starts(np.concatenate((np.frombuffer(b"x", np.uint8), a[:n])))[1:]
            sizes.append(n)
            words.append(int(inner.sum()))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("chain"), batch.column("left"), pa.array(sizes, pa.int32()), pa.array(words, pa.int32())], names=["doc_id", "chain", "left", "more", "more_words"])


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, within: bool = False) -> DataFrame:
    """(doc_id, start, stop, n_words, first_doc_id): byte spans that stand whole in one document with a smaller id (`within`: or earlier in the same)."""
    spark = df.sparkSession
    path = new_path(spark, "chains")
    with cleared(spark):  # the chunks are the largest table kept, and done with here
        chains(stored(chunks(df, id_col, text_col), "chunks"), min_words, within).write.parquet(path)
    found = spark.read.parquet(path)
    end = lambda left, at, o_at: F.struct(F.lit(left).alias("left"), at.alias("at"), o_at.alias("o_at"))
    ends = F.array(end(True, F.col("start"), F.col("f_start")), end(False, F.col("stop"), F.col("f_start") + F.col("stop") - F.col("start")))
    sides = found.select("doc_id", "chain", F.col("f_doc").alias("o_doc"), F.explode(ends).alias("s")).select("doc_id", "chain", "o_doc", "s.*")
    # a chain's own side brings its chain along; the other side of many chains is one row
    own = sides.select("doc_id", "at", "left", "chain", "o_doc", "o_at")
    void = [F.lit(None).cast("long").alias("chain"), F.lit(None).cast("long").alias("o_doc"), F.lit(None).cast("int").alias("o_at")]
    asked = stored(own.union(sides.select("o_doc", "o_at", "left").distinct().select(F.col("o_doc").alias("doc_id"), F.col("o_at").alias("at"), "left", *void)), "places")
    raw = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("raw"))
    ids = stored(asked.select("doc_id").distinct(), "ids")
    if ids.count() <= BROADCAST_IDS:
        raw = raw.join(F.broadcast(ids), "doc_id", "left_semi")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    low = F.greatest(F.col("at") - AROUND, F.lit(0))
    snip = F.when(F.col("left"), F.substring("raw", low + 1, F.col("at") - low)).otherwise(F.substring("raw", F.col("at") + 1, F.lit(AROUND)))
    snips = stored(raw.join(asked, "doc_id").select("doc_id", "at", "left", "chain", "o_doc", "o_at", snip.alias("own")), "snips")
    other = snips.where("chain IS NULL").select(F.col("doc_id").alias("o_doc"), F.col("at").alias("o_at"), "left", F.col("own").alias("other"))
    pairs = snips.where("chain IS NOT NULL").join(other, ["o_doc", "o_at", "left"])
    more = pairs.select("doc_id", "chain", "left", "own", "other").mapInArrow(_common, "doc_id long, chain long, left boolean, more int, more_words int")
    # rows that repeat an id have several texts at a place: the longest agreement holds
    more = more.groupBy("doc_id", "chain", "left").agg(F.max(F.struct("more", "more_words")).alias("m"))
    side = lambda left: F.sum(F.when(F.col("left") == left, F.col("m.more")).otherwise(0))
    more = more.groupBy("doc_id", "chain").agg(side(True).alias("before"), side(False).alias("after"), F.sum("m.more_words").alias("more_words"))
    whole = found.join(more, ["doc_id", "chain"]).withColumn("n_words", F.col("words") + F.col("more_words"))
    span = whole.where(F.col("n_words") >= min_words).select("doc_id", (F.col("start") - F.col("before")).alias("start"), (F.col("stop") + F.col("after")).alias("stop"), "n_words", "f_doc")
    # chains of one passage reach the same ends; rows that repeat an id repeat theirs
    return span.groupBy("doc_id", "start", "stop").agg(F.max("n_words").alias("n_words"), F.min("f_doc").alias("first_doc_id")).select(F.col("doc_id").alias(id_col), "start", "stop", "n_words", "first_doc_id")
