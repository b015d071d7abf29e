"""Ranked lexical search over per-term blocks of similar documents.

One scan cuts every text and keeps, a row per document, the terms that the queries have
(impacts are stored, texts are not). A query's first threshold is the k-th exact score among
the documents of its rarest terms. Terms whose greatest impacts together stay below it cannot
bring a document in, so only the posting lists of the others are opened.

Documents are sorted by range of a similarity code (signs of a random projection of their
weighted terms) and indexed in shards. Each posting list of a shard is clustered: its documents
go to the nearest of a few leaders from the list, by the projected vectors, and a cluster is a
block. A block stores its documents, the smallest of their ids and, for each term that a query
which has the block's term may ask for, the greatest impact of any of its documents. The sum of
a query's weights times these maxima bounds the score of every document in the block, in exact
integers; a block is skipped only if that bound is below the threshold, or equal to it while all
of the block's ids come after the one at the threshold. Documents of the blocks that are left
are scored exactly, and a task passes on its k best of a query.

Queries are taken in blocks (QUERY_ROWS, QUERY_ITEMS), whose terms and weights tasks get as a
broadcast; documents are never collected.

Defined cases: null texts have no terms; rows with a null item id are ignored, those that share
an item id are one item; every document row is a document of its own, so a repeated id may appear
twice; null document ids come last among equal scores; no documents or no queries give an empty
result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored

TERM = re.compile(rb"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Terms of items, and items, that one pass over the documents serves.
QUERY_ROWS, QUERY_ITEMS = 20_000, 500
#: Documents of a block; cells (documents x terms) of a shard; dimensions of the projection.
BLOCK, CELLS, DIMS = 96, 16_000_000, 32
#: Documents of the rarest terms that give the first threshold, as a multiple of k.
SEEDS = 4
BROADCAST_ROWS = 400_000
LAST = np.iinfo(np.int64).max


def terms(text: str | None) -> list[bytes]:
    return TERM.findall((text or "").encode("utf-8", "surrogatepass").translate(LOWER))


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        words = [[w.decode("utf-8", "surrogatepass") for w in terms(t)] for t in batch.column("text").to_pylist()]
        offsets = np.concatenate(([0], np.cumsum([len(w) for w in words]))).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column("item_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array([x for w in words for x in w], pa.string()))], names=["item_id", "terms"])


def _lists(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(values, kind))


def _flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values of a list column in a row, and where each list begins (and the last one ends)."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _gather(offsets: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of some lists, and where each of them begins."""
    sizes = offsets[rows + 1] - offsets[rows]
    starts = np.concatenate(([0], np.cumsum(sizes)))
    return np.repeat(offsets[rows] - starts[:-1], sizes) + np.arange(starts[-1]), starts


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[starts[1:]] - total[starts[:-1]]


FORWARD = "row long, doc_id long, n long, terms array<int>, tfs array<int>"


def _scan(vocabulary):
    """Number of terms of each text, and those of the vocabulary with their occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, row = vocabulary.value.get, TaskContext.get().partitionId() << 36
        for batch in batches:
            sizes, ids, counts, ends = [], [], [], [0]
            for text in batch.column("text"):
                words = terms(text.as_py())
                found = np.fromiter(map(number, words, repeat(-1)), np.int32, len(words))
                own, n = np.unique(found[found >= 0], return_counts=True)
                sizes.append(len(words))
                ids.append(own)
                counts.append(n)
                ends.append(ends[-1] + len(own))
            n = np.array(sizes, np.int64)
            ends = np.array(ends)
            ids, counts = (np.concatenate([np.zeros(0, np.int32), *x]).astype(np.int32) for x in (ids, counts))
            rows = pa.array(np.arange(row, row + len(n)))
            row += len(n)
            out = pa.RecordBatch.from_arrays([rows, batch.column("doc_id"), pa.array(n), _lists(ends, ids, pa.int32()), _lists(ends, counts, pa.int32())], names=["row", "doc_id", "n", "terms", "tfs"])
            yield out.filter(pa.array(n > 0))

    return run


def _projection(n_terms: int) -> np.ndarray:
    return (np.random.default_rng(13).integers(0, 2, (n_terms, DIMS)) * 2 - 1).astype(np.float32)


def _vectors(term: np.ndarray, impact: np.ndarray, offsets: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Projected documents, of length one."""
    out, step = [], 2000
    table = _projection(len(weight)) * weight.astype(np.float32)[:, None]
    for at in range(0, len(offsets) - 1, step):
        cut = offsets[at : at + step + 1]
        part = slice(cut[0], cut[-1])
        out.append(_sums((table[term[part]] * impact[part, None]).astype(np.float64), cut - cut[0]))
    v = np.concatenate(out) if out else np.zeros((0, DIMS))
    return (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9)).astype(np.float32)


CODED = "row long, doc_id long, code long, terms array<int>, impacts array<int>"


def _code(weight, n_docs: int, n_terms: int):
    """Occurrences to impacts; the similarity code of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            term, offsets = _flat(batch.column("terms"))
            tf = _flat(batch.column("tfs"))[0].astype(np.int64)
            size = 75 + 25 * batch.column("n").to_numpy() * n_docs // n_terms
            impact = 1_000_000_000 * tf // (1000 * tf + 12 * np.repeat(size, np.diff(offsets)))
            vectors = _vectors(term, impact.astype(np.float32), offsets, weight.value)
            code = ((vectors[:, :30] > 0) << np.arange(30)).sum(axis=1).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("doc_id"), pa.array(code), _lists(offsets, term, pa.int32()), _lists(offsets, impact.astype(np.int32), pa.int32())], names=["row", "doc_id", "code", "terms", "impacts"])

    return run


class Best:
    """The k best (score, doc_id, row) of each item seen so far."""

    def __init__(self, k: int) -> None:
        self.k, self.held = k, {}

    def add(self, item: int, score: np.ndarray, doc_id: np.ndarray, row: np.ndarray) -> None:
        x = np.stack([-score, doc_id, row])[:, score > 0]
        x = np.concatenate((self.held.get(item, x[:, :0]), x), axis=1)
        self.held[item] = x[:, np.lexsort((x[2], x[1], x[0]))[: self.k]]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for item, x in self.held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(x.shape[1], item, np.int32)), pa.array(x[2]), pa.array(x[1], mask=x[1] == LAST), pa.array(-x[0])], names=["item", "row", "doc_id", "score"])


SCORED = "item int, row long, doc_id long, score long"


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy()


def _best(k: int, weights, asked):
    """Exact scores of the items that `asked(batch, term, offsets)` names: pairs (row in the batch, item), sorted by item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, w = Best(k), weights.value
        for batch in batches:
            term, offsets = _flat(batch.column("terms"))
            impact = _flat(batch.column("impacts"))[0].astype(np.int64)
            doc_id, row = _ids(batch.column("doc_id")), batch.column("row").to_numpy()
            at, item = asked(batch, term, offsets)
            edges = np.flatnonzero(np.diff(item)) + 1
            for rows in np.split(np.arange(len(item)), edges) if len(item) else []:
                i, rows = int(item[rows[0]]), at[rows]
                places, starts = _gather(offsets, rows)
                best.add(i, _sums(w[i][term[places]] * impact[places], starts), doc_id[rows], row[rows])
        yield from best.batches()

    return run


def _seeded(items_of):
    """Documents that hold a seed term of an item."""

    def asked(batch: pa.RecordBatch, term: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, items = items_of.value
        n = starts[term + 1] - starts[term]
        places, _ = _gather(starts, term[n > 0])
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        pairs = np.unique(np.stack([items[places].astype(np.int64), np.repeat(row[n > 0], n[n > 0])]), axis=1)
        return pairs[1], pairs[0]

    return asked


def _listed(batch: pa.RecordBatch, term: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The items in the batch's own column."""
    items, starts = _flat(batch.column("items"))
    row = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    order = np.argsort(items, kind="stable")
    return row[order], items[order]


BLOCKS = "term int, docs array<long>, low long, coords array<int>, maxima array<int>"


def _cluster(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions by their nearest leader; leaders are spread over the list, a large cluster is cut."""
    n = len(vectors)
    if n <= size:
        return [np.arange(n)]
    leaders = np.linspace(0, n - 1, -(-n // size)).astype(np.int64)
    near = np.argmax(vectors @ vectors[leaders].T, axis=1)
    order = np.argsort(near, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(near[order])) + 1)
    return [g[at : at + 2 * size] for g in groups for at in range(0, len(g), 2 * size)]


def _index(weight, coords, block: int, cells: int):
    """Documents in the order of their codes to blocks of the posting lists that are asked for, shard by shard."""

    def shard(held: list[tuple]) -> pa.RecordBatch:
        row, doc_id = (np.concatenate([h[i] for h in held]) for i in (0, 1))
        term, impact, sizes = (np.concatenate([h[i] for h in held]) for i in (2, 3, 4))
        offsets = np.concatenate(([0], np.cumsum(sizes)))
        of = np.repeat(np.arange(len(row)), sizes)
        dense = np.zeros((len(row), len(weight.value)), np.int32)
        dense[of, term] = impact
        vectors = _vectors(term, impact.astype(np.float32), offsets, weight.value)
        order = np.argsort(term, kind="stable")
        edges = np.flatnonzero(np.diff(term[order])) + 1
        out = [[], [], [], [], []]
        for posting in np.split(order, edges) if len(order) else []:
            t = int(term[posting[0]])
            asked = coords.value.get(t)
            if asked is None:
                continue
            docs = of[posting]
            for part in _cluster(vectors[docs], block):
                part = docs[part]
                most = dense[np.ix_(part, asked)].max(axis=0)
                kept = np.flatnonzero(most)
                for column, value in zip(out, (t, row[part], int(doc_id[part].min()), asked[kept], most[kept]), strict=True):
                    column.append(value)
        ends = lambda c: np.concatenate(([0], np.cumsum([len(x) for x in c])))
        flat = lambda c, kind: np.concatenate([np.zeros(0, kind), *c]).astype(kind)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), _lists(ends(out[1]), flat(out[1], np.int64), pa.int64()), pa.array(out[2], pa.int64()), _lists(ends(out[3]), flat(out[3], np.int32), pa.int32()), _lists(ends(out[4]), flat(out[4], np.int32), pa.int32())], names=["term", "docs", "low", "coords", "maxima"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = max(64, cells // max(1, len(weight.value)))
        for batch in (part for whole in batches for part in (whole.slice(at, most) for at in range(0, whole.num_rows, most))):
            term, offsets = _flat(batch.column("terms"))
            yield shard([(batch.column("row").to_numpy(), _ids(batch.column("doc_id")), term, _flat(batch.column("impacts"))[0], np.diff(offsets))])

    return run


def _bounds(weights, lists, least):
    """Blocks that may hold one of an item's k best, as pairs (row, item)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, of, (score, doc_id) = weights.value, lists.value, least.value
        for batch in batches:
            docs, d = _flat(batch.column("docs"))
            coord, c = _flat(batch.column("coords"))
            most = _flat(batch.column("maxima"))[0].astype(np.int64)
            rows, items = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
            for b, (term, low) in enumerate(zip(batch.column("term").to_pylist(), batch.column("low").to_pylist(), strict=True)):
                asked = of[term]
                part = slice(c[b], c[b + 1])
                bound = w[np.ix_(asked, coord[part])] @ most[part]
                opened = asked[(bound > score[asked]) | (bound == score[asked]) & (low <= doc_id[asked])]
                own = docs[d[b] : d[b + 1]]
                rows.append(np.tile(own, len(opened)))
                items.append(np.repeat(opened, len(own)))
            pairs = np.unique(np.stack([np.concatenate(rows), np.concatenate(items).astype(np.int64)]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1].astype(np.int32))], names=["row", "item"])

    return run


def _csr(pairs: list[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    pairs = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.concatenate(([0], np.cumsum(np.bincount(pairs[:, 0], minlength=n)))), pairs[:, 1].astype(np.int32)


def _ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each item; a task has passed on k of an item at most."""
    w = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "row")
    return scored.dropDuplicates(["item", "row"]).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _search(docs: DataFrame, asked: list, k: int, block: int, cells: int) -> tuple[DataFrame, list] | None:
    """(item, row, doc_id, score, rank) for one block of queries, item a position in the list of ids that is returned too."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    ids = list(dict.fromkeys(r.item_id for r in asked))
    place = {v: i for i, v in enumerate(ids)}
    words = sorted({r.term for r in asked})
    number = {w.encode("utf-8", "surrogatepass"): i for i, w in enumerate(words)}
    forward = stored(docs.mapInArrow(_scan(sc.broadcast(number)), FORWARD), "forward")
    n_docs, n_terms = forward.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(words), np.int64)
    for t, n in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # the queries' terms
        df[t] = n
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) if n else 0 for n in df.tolist()], np.int64)
    weights = np.zeros((len(ids), len(words)), np.int64)
    for r in asked:
        weights[place[r.item_id], number[r.term.encode("utf-8", "surrogatepass")]] = r.n
    weights *= weight
    all_weights, term_weight = sc.broadcast(weights), sc.broadcast(weight)
    coded = stored(forward.where(F.size("terms") > 0).mapInArrow(_code(term_weight, n_docs, n_terms), CODED), "coded")
    most = np.zeros(len(words), np.int64)
    for t, m in coded.select(F.explode(F.arrays_zip("terms", "impacts")).alias("p")).groupBy("p.terms").agg(F.max("p.impacts")).collect():
        most[t] = m
    # first thresholds: exact scores of the documents that hold an item's rarest terms
    seeds = []
    for i, row in enumerate(weights):
        own = np.flatnonzero(row)
        own = own[np.argsort(df[own], kind="stable")]
        before = np.cumsum(df[own]) - df[own]
        seeds += [(int(t), i) for t in own[before < SEEDS * k]]
    seeded = stored(coded.mapInArrow(_best(k, all_weights, _seeded(sc.broadcast(_csr(seeds, len(words))))), SCORED), "seeded")
    score, doc_id = np.zeros(len(ids), np.int64), np.full(len(ids), LAST)
    for r in _ranked(seeded, k).where(F.col("rank") == k).collect():  # one row an item
        score[r["item"]], doc_id[r["item"]] = r.score, LAST if r.doc_id is None else r.doc_id
    # the posting lists of each item without which a document cannot come up to its threshold
    lists: dict[int, list[int]] = {}
    for i, row in enumerate(weights):
        own = np.flatnonzero(row)
        own = own[np.argsort(row[own] * most[own], kind="stable")]
        for t in own[np.cumsum(row[own] * most[own]) >= max(1, score[i])]:
            lists.setdefault(int(t), []).append(i)
    coords = {t: np.flatnonzero(weights[items].any(axis=0)).astype(np.int32) for t, items in lists.items()}
    order = ["code", "row"]
    ranged = coded.where(F.arrays_overlap("terms", F.lit(sorted(lists)).cast("array<int>"))).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(ranged.mapInArrow(_index(term_weight, sc.broadcast(coords), block, cells), BLOCKS), "blocks")
    opened = blocks.mapInArrow(_bounds(all_weights, sc.broadcast({t: np.array(v, np.int64) for t, v in lists.items()}), sc.broadcast((score, doc_id))), "row long, item int")
    pairs = stored(opened.groupBy("row").agg(F.collect_set("item").alias("items")), "pairs")  # QUERY_ITEMS at most
    pairs = F.broadcast(pairs) if pairs.count() <= BROADCAST_ROWS else pairs
    scored = coded.join(pairs, "row").mapInArrow(_best(k, all_weights, _listed), SCORED)
    return _ranked(scored.union(seeded), k), ids


def search(docs: DataFrame, queries: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block: int = BLOCK, cells: int = CELLS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents with the highest scores above 0 for each item, all if fewer."""
    spark = docs.sparkSession
    kind = queries.schema[item_col].dataType.simpleString()
    texts = queries.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    cut = texts.mapInArrow(_query_terms, f"item_id {kind}, terms array<string>").select("item_id", F.explode("terms").alias("term"))
    held = stored(cut.groupBy("item_id", "term").agg(F.count("*").alias("n")), "query-terms")
    rows, items = held.agg(F.count("*"), F.countDistinct("item_id")).first()
    n_blocks = max(-(-rows // query_rows), -(-items // QUERY_ITEMS))
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    for b in range(n_blocks):
        asked = held.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b).collect()  # about query_rows
        found = _search(raw, asked, k, block, cells) if asked else None
        if found:
            best, ids = found
            names = spark.createDataFrame(list(enumerate(ids)), f"item int, item_id {kind}")
            out = out.union(best.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int"), "doc_id", "score"))
    return out
