"""SimHash near-duplicates by pigeonhole blocks.

Fingerprints are folded to distinct values first (exact copies never meet in a
pair). Two values within `radius` bits agree on at least `blocks - radius` of
`blocks` blocks, so every choice of that many blocks is a key, and values that
share a key are compared. Inside a key the Hamming distances are measured with
numpy, breadth first over the values not yet reached: a key yields at most one
link per value (a spanning forest of the true links), never all its pairs. Keys
with more than TILE values are cut into tiles, and every two tiles are compared
in a task of their own, so no link is lost and no task grows without bound.

Defined cases: a null text has no words; texts without words have fingerprint
zero and are linked like any other; rows that repeat an id get the component of
the smallest id of all their texts' components only through links between
texts; a null id gets a component like any other row but is never named as one
unless no other id is reachable; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.components import components
from lorekeep.llm.shared import stored

TILE = 8192
SEED = 42
#: Fingerprints in one numpy step, and values up to which a key is compared by shifts.
STEP, SHORT = 100_000, 24


def fingerprint(text: str | None, shingle: int, seed: int = SEED) -> int:
    """64-bit majority of the XXH64 hashes of all word shingles, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    hash64 = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return hash64(joined, seed)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes)
    starts = (ends - sizes)[: len(words) - shingle + 1].tolist()
    ends = (ends[shingle - 1 :] - 1).tolist()
    hashes = (hash64(joined[s:e], seed) for s, e in zip(starts, ends, strict=True))
    return majority(np.fromiter(hashes, np.uint64, len(starts)))


def majority(hashes: np.ndarray) -> int:
    """The number whose bits are those set in over half the hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), STEP):
        counts += np.unpackbits(hashes[at : at + STEP].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * counts > len(hashes), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5) -> DataFrame:
    """(id, fp): the fingerprint of every row as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["id", "fp"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, fp long")


def _keys(blocks: int, radius: int) -> list[tuple[int, int]]:
    """(number, mask) of every choice of blocks - radius blocks."""
    cuts = [64 * i // blocks for i in range(blocks + 1)]
    masks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [(i, sum(c)) for i, c in enumerate(combinations(masks, blocks - radius))]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask


def _forest(values: np.ndarray, radius: int) -> Iterator[tuple[int, np.ndarray]]:
    """Breadth first over values within `radius` bits: (position, positions it reaches first)."""
    left = np.arange(len(values))
    while len(left):
        todo, left = [left[0]], left[1:]
        while todo and len(left):
            at = todo.pop()
            near = np.bitwise_count(values[left] ^ values[at]) <= radius
            if near.any():
                found = left[near]
                yield at, found
                todo.extend(found.tolist())
                left = left[~near]


def _links(key: np.ndarray, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked values among rows that are sorted by key."""
    edge = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1], [True])))
    size = np.diff(edge)
    short = np.repeat(size <= SHORT, size)
    for shift in range(1, int(size[size <= SHORT].max(initial=1))):
        a = np.flatnonzero(short[shift:] & (key[shift:] == key[:-shift]))
        a = a[np.bitwise_count(fp[a] ^ fp[a + shift]) <= radius]
        if len(a):
            yield a, a + shift
    for begin, n in zip(edge[:-1][size > SHORT], size[size > SHORT], strict=True):
        for at, found in _forest(fp[begin : begin + n], radius):
            yield np.full(len(found), begin + at), begin + found


def _join(radius: int):
    """Rows sorted by (key, part) to linked nodes; the rows of a key that a batch cuts are carried on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None

        def emit(columns: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            kind, value, tile, node, fp = columns
            group = np.zeros(len(fp), np.int64)
            group[1:] = np.cumsum((kind[1:] != kind[:-1]) | (value[1:] != value[:-1]) | (tile[1:] != tile[:-1]))
            for a, b in _links(group, fp.view(np.uint64), radius):
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["u", "v"])

        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if rest is not None:
                columns = [np.concatenate(x) for x in zip(rest, columns, strict=True)]
            same = (columns[0] == columns[0][-1]) & (columns[1] == columns[1][-1]) & (columns[2] == columns[2][-1])
            cut = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            rest = [c[cut:] for c in columns]
            if cut:
                yield from emit([c[:cut] for c in columns])
        if rest is not None:
            yield from emit(rest)

    return run


def tiled(rows: DataFrame, key: list[str], spread: str, tile: int) -> DataFrame:
    """`rows` with a column `tile`, so that any two rows of a key meet in some tile and none has over about 2 * `tile` rows.

    A key of up to `tile` rows is one tile; rows of a larger one are dealt by a hash of `spread`, and every two parts are a tile.
    """
    crowded = rows.groupBy(*key).count().where(F.col("count") > tile).select(*key, F.ceil(F.col("count") / tile).cast("int").alias("parts"))
    crowded = stored(crowded, "crowded")
    if crowded.isEmpty():
        return rows.withColumn("tile", F.lit(0))
    own = F.pmod(F.xxhash64(spread), F.col("parts")).cast("int")
    other = F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = rows.join(crowded, key, "left").withColumn("other", other).withColumn("own", F.when(F.col("parts").isNull(), F.lit(0)).otherwise(own))
    return tiles.select(*rows.columns, (F.least("own", "other") * F.coalesce("parts", F.lit(1)) + F.greatest("own", "other")).alias("tile"))


def links(nodes: DataFrame, radius: int = 3, blocks: int | None = None, tile: int = TILE) -> DataFrame:
    """(u, v): a spanning forest, per key, of all pairs of (node, fp) rows within `radius` bits.

    Transitively it links exactly what the full set of pairs links. `blocks`
    (default radius + 2) sets the keys; more blocks give more and rarer keys.
    """
    blocks = blocks or radius + 2
    masks = F.array(*[F.struct(F.lit(i).alias("kind"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("value")) for i, m in _keys(blocks, radius)])
    rows = nodes.select("node", "fp", F.explode(masks).alias("k")).select("k.kind", "k.value", "node", "fp")
    dealt = tiled(rows, ["kind", "value"], "fp", tile)
    ordered = dealt.select("kind", "value", "tile", "node", "fp").repartition("kind", "value", "tile").sortWithinPartitions("kind", "value", "tile")
    return ordered.mapInArrow(_join(radius), "u long, v long")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """One row per row of `df`: id, fingerprint (hex), component_id (smallest id reachable)."""
    prints = stored(fingerprints(df, id_col, text_col, shingle), "fingerprints")
    values = stored(prints.groupBy("fp").agg(F.min("id").alias("least")), "values")
    # nodes are the values themselves: ids may be null or repeated
    linked = components(links(values.select(F.col("fp").alias("node"), "fp"), radius, blocks))
    of = values.join(linked, values.fp == linked.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    named = of.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = of.join(named, "root").select("fp", "component_id")
    return prints.join(classes, "fp").select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
