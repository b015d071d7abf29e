"""Near-duplicates by the exact Jaccard similarity of word shingles, for the pipeline's SimHash stage.

Texts with equal sets of shingles are one node. The first candidates are the pairs
that SimHash (`simhash.links`, pigeonhole blocks) finds within RADIUS bits. Of
pairs at a similarity of 0.8 it finds few (ten bits differ in the mean), and keys
for ten bits would be too many, so minimum hashes complete it: BANDS keys of ROWS
of them each name the buckets of a node; a pair of similarity 0.8 shares a bucket
with probability 0.9998. Inside a bucket the minimum hashes themselves (a sketch of 16
or 8 bits each) are compared with numpy: first every node with one centre of its bucket, then
along a spanning forest of the closest sketches, then all nodes that are still in different
components, crowded buckets in tiles. Every such step links the components of those before, not
their nodes anew, and its tables go once its links are found. Only pairs whose sketches agree in `least` less
SLACK (three deviations: 0.999 of the pairs at the limit) leave a task, and a link is
such a pair whose sets have a Jaccard similarity of `least` or more, measured on the
sets themselves (as 64-bit hashes) in a join. So all pairs of a bucket are either
compared or already connected, and a large group of copies gives a few rows a node.

Defined cases: a text of fewer words than a shingle is one shingle; null texts
and texts without words are one node, linked to no other; ids may be null or
repeated, as nodes come from texts alone; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm import simhash
from lorekeep.llm.components import components
from lorekeep.llm.shared import cleared, forget, new_path, small_batches, stored

BANDS, ROWS, SEED = 16, 4, 42
#: Differing bits of the SimHash candidates, and the blocks that fingerprints are cut into.
RADIUS, BLOCKS = 4, 7
#: What a sketch may lack of a similarity; nodes of a bucket in a tile.
SLACK, TILE = 0.075, 4096
#: Minimum hashes of a sketch; the first BANDS * ROWS of them make the keys and are kept with 16 bits, the others with 8.
SKETCH, KEYED = 256, 64
#: Candidate texts up to which their list is broadcast; a longer one is shuffled.
BROADCAST_ROWS = 400_000
#: Shingles in one numpy step, and in one batch of sets.
STEP, FLUSH = 2048, 200_000
_MIX = np.random.default_rng(20240101).integers(0, 1 << 64, (2, SKETCH), np.uint64)
ADD, FACTOR = _MIX[0][:, None], _MIX[1][:, None] | np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Distinct XXH64 hashes of the word shingles, sorted."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: max(1, len(words) - size + 1)].tolist()
    ends = (ends[min(size, len(words)) - 1 :] - 1).tolist()
    hash64 = xxhash.xxh64_intdigest
    return np.unique(np.fromiter([hash64(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64, len(starts)))


def node_of(held: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(held.tobytes())


def bands(held: np.ndarray) -> tuple[list[int], bytes]:
    """The key of each band and the sketch; no shingles, no keys."""
    if not len(held):
        return [], b""
    least = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(held), STEP):
        least = np.minimum(least, ((held[at : at + STEP] ^ ADD) * FACTOR).min(axis=1))
    keys = [xxhash.xxh3_64_intdigest(row.tobytes(), i) for i, row in enumerate(least[:KEYED].reshape(BANDS, ROWS))]
    short = least >> np.uint64(24)
    return keys, short[:KEYED].astype(np.uint16).tobytes() + short[KEYED:].astype(np.uint8).tobytes()


def sketches(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The keyed values and the others, a row for each sketch."""
    held = np.frombuffer(b"".join(raw), np.uint8).reshape(len(raw), -1)
    return np.ascontiguousarray(held[:, : 2 * KEYED]).view(np.uint16), np.ascontiguousarray(held[:, 2 * KEYED :])


def _prints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes, sizes = np.zeros(batch.num_rows, np.uint64), np.zeros(batch.num_rows, np.int32)
            keys = np.zeros((batch.num_rows, BANDS), np.uint64)
            prints = np.zeros(batch.num_rows, np.uint64)
            sketches = [b""] * batch.num_rows
            for i, text in enumerate(batch.column(2)):
                held = shingles(text.as_py(), size)
                nodes[i], sizes[i], prints[i] = node_of(held), len(held), simhash.majority(held)
                if len(held):
                    keys[i], sketches[i] = bands(held)
            edge = np.concatenate(([0], np.cumsum(np.where(sizes > 0, BANDS, 0)))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(keys[sizes > 0].ravel().view(np.int64)))
            columns = [batch.column(0), batch.column(1), pa.array(nodes.view(np.int64)), pa.array(sizes), pa.array(prints.view(np.int64)), lists, pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "h", "node", "n", "fp", "keys", "sketch"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            nodes: list[int] = []
            sets: list[np.ndarray] = []
            total = 0
            for i, text in enumerate(batch.column(0)):
                held = shingles(text.as_py(), size)
                nodes.append(node_of(held))
                sets.append(held.view(np.int64))
                total += len(held)
                if total >= FLUSH or i == batch.num_rows - 1:
                    edge = np.concatenate(([0], np.cumsum([len(x) for x in sets]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(edge), pa.array(np.concatenate(sets)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(nodes, np.uint64).view(np.int64)), lists], names=["node", "held"])
                    nodes, sets, total = [], [], 0

    return run


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """(a, b), the components of u and v, of the pairs (u, v, a, b) whose sets are similar enough."""
    pairs = stored(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("u").alias("node")).distinct().union(pairs.select("v").distinct()).distinct()
    sets = sets.join(F.broadcast(asked) if pairs.count() <= BROADCAST_ROWS else asked, "node", "left_semi")
    both = pairs.join(sets.select(F.col("node").alias("v"), F.col("held").alias("held_v")), "v").join(sets.select(F.col("node").alias("u"), F.col("held").alias("held_u")), "u")
    shared = F.size(F.array_intersect("held_u", "held_v"))
    # shared / union >= least; the margin is for the rounding of `least` alone
    return both.where(shared >= least * (F.size("held_u") + F.size("held_v") - shared) - 1e-9).select("a", "b")


#: Steps within the buckets: with one node, along a spanning forest, all pairs.
STAR, FOREST, ALL = range(3)


def _forest(keyed: np.ndarray, others: np.ndarray, n: np.ndarray, least: float, agree: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the sketches that agree, the closest ones first to last."""
    left = np.arange(1, len(n))
    best, parent, at = np.full(len(n), -1), np.zeros(len(n), np.int64), 0
    while len(left):
        same = (keyed[left] == keyed[at]).sum(axis=1) + (others[left] == others[at]).sum(axis=1)
        same[np.minimum(n[left], n[at]) < least * np.maximum(n[left], n[at]) - 1e-9] = -1
        nearer = same > best[left]
        best[left[nearer]], parent[left[nearer]] = same[nearer], at
        at = int(left[np.argmax(best[left])])
        if best[at] >= agree:
            yield at, int(parent[at])
        left = left[left != at]


def _compare(step: int, least: float):
    """Rows (key, tile, node, n, root, sketch, band) sorted by (key, tile) to candidates (u, v, a, b) of different roots a and b: with one node of the group (STAR), along a spanning forest (FOREST), or ALL."""

    def pairs(node: np.ndarray, root: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
        i, j = np.where(node[i] > node[j], i, j), np.where(node[i] > node[j], j, i)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (node[i], node[j], root[i], root[j])], names=["u", "v", "a", "b"])

    def group(columns: list) -> Iterator[pa.RecordBatch]:
        node, n, root = (c.to_numpy() for c in columns[2:5])
        if len(node) < 2 or (root == root[0]).all():
            return
        band = columns[6][0].as_py()
        keyed, others = sketches(columns[5].to_pylist())
        agree = int(np.ceil((least - SLACK) * SKETCH))
        order = range(len(node) - 1)
        if step == FOREST:
            edges = np.array([e for e in _forest(keyed, others, n, least, agree) if root[e[0]] != root[e[1]]], np.int64).reshape(-1, 2)
            if len(edges):
                yield pairs(node, root, edges[:, 0], edges[:, 1])
            return
        if step == STAR:
            order = [int(np.argmin((node.view(np.uint64) ^ ADD[0]) * FACTOR[0]))]
        for i in order:
            at = np.flatnonzero(root != root[i])
            at = at if step == STAR else at[at > i]
            low, high = np.minimum(n[at], n[i]), np.maximum(n[at], n[i])
            at = at[low >= least * high - 1e-9]
            same = keyed[at] == keyed[i]
            close = same.sum(axis=1) + (others[at] == others[i]).sum(axis=1) >= agree
            if step == ALL:
                # a pair leaves the first of the buckets that it shares, and no other
                shared = same.reshape(len(at), BANDS, ROWS).all(axis=2)
                close &= shared.argmax(axis=1) == band
            at = at[close]
            if len(at):
                yield pairs(node, root, at, np.full(len(at), i))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([rest, rows]).combine_chunks() if rest is not None else rows
            key, tile = (rows.column(c).to_numpy() for c in (0, 1))
            edge = np.flatnonzero((key[1:] != key[:-1]) | (tile[1:] != tile[:-1])) + 1
            for a, b in zip([0, *edge[:-1]], edge, strict=True) if len(edge) else ():
                yield from group([c.combine_chunks() for c in rows.slice(a, b - a).columns])
            rest = rows.slice(edge[-1]) if len(edge) else rows
        if rest is not None:
            yield from group([c.combine_chunks() for c in rest.columns])

    return run


def _joined(root: DataFrame | None, pairs: DataFrame, sets: DataFrame, least: float, path: str | None = None) -> DataFrame | None:
    """`root` (node, root) once the components that the pairs link are one; written to `path`, or as it was when they link none."""
    new = stored(_verified(pairs, sets, least), "links")
    if new.isEmpty():
        return root
    moved = components(new.toDF("u", "v"))
    if root is not None:
        moved = stored(moved, "moved").select(F.col("node").alias("root"), F.col("root").alias("to"))
        # a root that was alone before has no row of its own yet
        moved = root.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root")).union(moved.select(F.col("root").alias("node"), F.col("to").alias("root"))).distinct()
    return stored(moved, "roots", path)


def links(rows: DataFrame, sets: DataFrame, least: float, near: DataFrame) -> DataFrame:
    """(node, root) of every linked node, from bucket rows (key, band, node, n, sketch), the sets (node, held) of their nodes, and the candidates (u, v)."""
    spark = rows.sparkSession
    root = _joined(None, near.select("u", "v", F.col("u").alias("a"), F.col("v").alias("b")), sets, least)
    for step in (STAR, FOREST, ALL):
        at = new_path(spark, "roots")
        with cleared(spark):
            placed = rows.withColumn("root", F.col("node")) if root is None else rows.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
            mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
            placed = stored(placed.join(mixed, "key", "left_semi").select("key", "band", "node", "n", "root", "sketch"), "placed")
            dealt = simhash.tiled(placed, ["key"], "node", TILE).select("key", "tile", "node", "n", "root", "sketch", "band")
            pairs = dealt.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(_compare(step, least), "u long, v long, a long, b long")
            root = _joined(root, pairs, sets, least, at)
    return rows.select("node", F.col("node").alias("root")).limit(0) if root is None else root


def groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """(id, h, root) of every row: its id, the XXH64 of its text, its component."""
    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("h"), text.alias("text"))
    with small_batches(df.sparkSession):
        prints = stored(rows.mapInArrow(_prints(shingle), "id long, h long, node long, n int, fp long, keys array<long>, sketch binary"), "prints")
    nodes = stored(prints.groupBy("node").agg(F.min("h").alias("h"), F.min("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"), F.first("sketch").alias("sketch")), "nodes")
    buckets = nodes.select("node", "h", "n", "sketch", F.posexplode("keys").alias("band", "key"))
    shared = buckets.groupBy("key").agg(F.count("*").alias("size")).where("size > 1").select("key")
    buckets = stored(buckets.join(shared, "key"), "buckets")
    full = nodes.where("n > 0").select("node", "fp")
    near = stored(simhash.links(full, RADIUS, BLOCKS).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "near")
    ends = near.select(F.explode(F.array("u", "v")).alias("node")).distinct().join(nodes.select("node", "h"), "node").select("h")
    asked = stored(buckets.select("h").union(ends).distinct(), "asked")
    if asked.count() <= BROADCAST_ROWS:
        asked = F.broadcast(asked)
    texts = rows.join(asked, "h", "left_semi").select("text")
    with small_batches(df.sparkSession):
        sets = stored(texts.mapInArrow(_sets(shingle), "node long, held array<long>").dropDuplicates(["node"]), "sets")
    root = links(buckets.select("key", "band", "node", "n", "sketch"), sets, least, near)
    return prints.join(root, "node", "left").select("id", "h", F.coalesce("root", "node").alias("root"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8) -> DataFrame:
    """One row per row of `df`: id, component_id (smallest id of its component)."""
    placed = stored(groups(df, id_col, text_col, shingle, least), "groups")
    named = placed.groupBy("root").agg(F.min("id").alias("component_id"))
    return placed.join(named, "root").select(F.col("id").alias(id_col), "component_id")
