"""Exact dedup with a cuckoo-filter index.

Texts are equal when identical after every ASCII white-space run is replaced by
one space. Each text becomes the SHA-256 digest of that form. A `CuckooIndex`
decides whether a digest is live: a miss in the filter proves it new, a hit is
verified against the entries stored in the digest's bucket, and an insertion
that finds no free slot rebuilds filter and buckets at twice the size from the
stored keys. Deletion removes the fingerprint with the last live copy; where the
copy that was kept goes and others live on, the index is told which of them is
kept now from the live rows of that digest.

The index is distributed by digest. Each task first folds its own rows through
an index (so a text that makes up a third of the corpus leaves each task as one
row), the partial entries are shuffled by digest and folded again.

Defined cases: a null text counts as empty; a null id sorts after every other;
of rows that repeat the same id and text exactly one is kept; an empty table
gives an empty result; only the two named columns are read, so other columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import partitions, stored

SLOTS, KICKS, FLUSH, PER_TASK = 4, 200, 400_000, 400_000
#: Repeated texts up to which their entries are broadcast; more are shuffled.
BROADCAST_ROWS = 400_000
WHITE = r"[\x20\x09-\x0D]+"
#: An entry whose kept copy was deleted has a null `no_id`.
ENTRY = "digest binary, no_id boolean, keep_id long, keep_row long, live long"


class CuckooIndex:
    """Live digests with their best (no_id, id, row) and number of copies."""

    def __init__(self, capacity: int = 1024) -> None:
        self.resizes = 0
        self._clear(capacity)

    def _clear(self, capacity: int) -> None:
        self.mask = (1 << max(3, (capacity // SLOTS).bit_length())) - 1
        self.table = [0] * ((self.mask + 1) * SLOTS)
        self.content: list[list | None] = [None] * (self.mask + 1)
        self.size = 0

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        key = int.from_bytes(digest[:8], "little")
        fingerprint = (key >> 48) or 1
        first = key & self.mask
        return fingerprint, first, self._other(first, fingerprint)

    def _other(self, bucket: int, fingerprint: int) -> int:
        return bucket ^ ((fingerprint * 0x5BD1E995) >> 7 & self.mask)

    def _slot(self, bucket: int, fingerprint: int) -> int:
        for i in range(bucket * SLOTS, bucket * SLOTS + SLOTS):
            if self.table[i] == fingerprint:
                return i
        return -1

    def _put(self, fingerprint: int, first: int, other: int) -> bool:
        for bucket in (first, other):
            if (free := self._slot(bucket, 0)) >= 0:
                self.table[free] = fingerprint
                return True
        bucket = other
        for kick in range(KICKS):
            victim = bucket * SLOTS + kick % SLOTS
            fingerprint, self.table[victim] = self.table[victim], fingerprint
            bucket = self._other(bucket, fingerprint)
            if (free := self._slot(bucket, 0)) >= 0:
                self.table[free] = fingerprint
                return True
        return False

    def _grow(self) -> None:
        """Rebuild at twice the size from the stored keys."""
        entries = list(self.entries())
        capacity = (self.mask + 1) * SLOTS
        while True:
            capacity *= 2
            self.resizes += 1
            self._clear(capacity)
            if all(self._insert_new(e) for e in entries):
                return

    def _insert_new(self, entry: list) -> bool:
        fingerprint, first, other = self._places(entry[0])
        if self.content[first] is None:
            self.content[first] = []
        self.content[first].append(entry)
        self.size += 1
        return self._put(fingerprint, first, other)

    def find(self, digest: bytes) -> list | None:
        """The entry [digest, rank, live], verified in the bucket's content; None when not live."""
        fingerprint, first, other = self._places(digest)
        if self._slot(first, fingerprint) < 0 and self._slot(other, fingerprint) < 0:
            return None
        return next((e for e in self.content[first] or () if e[0] == digest), None)

    def insert(self, digest: bytes, rank: tuple, copies: int = 1) -> bool:
        """Add copies of a digest; True when it was not live before. The smallest rank is kept."""
        if (entry := self.find(digest)) is not None:
            entry[1] = entry[1] and min(entry[1], rank)
            entry[2] += copies
            return False
        if not self._insert_new([digest, rank, copies]):
            self._grow()
        return True

    def delete(self, digest: bytes, copies: int = 1, rank: tuple | None = None) -> bool:
        """Remove copies of a live digest; False when it is not live. If `rank` is the one kept, none is from then on."""
        if (entry := self.find(digest)) is None:
            return False
        entry[2] -= copies
        if rank == entry[1]:
            entry[1] = None
        if entry[2] <= 0:
            fingerprint, first, other = self._places(digest)
            self.content[first].remove(entry)
            slot = self._slot(first, fingerprint)
            self.table[slot if slot >= 0 else self._slot(other, fingerprint)] = 0
            self.size -= 1
        return True

    def entries(self) -> Iterator[list]:
        for bucket in self.content:
            yield from bucket or ()


def _rank(no_id: bool, key: int | None, row: int) -> tuple:
    return (no_id, 0 if key is None else key, row)


def _batches(entries: Iterable[list], size: int = 20_000) -> Iterator[pa.RecordBatch]:
    rows = list(entries)
    for i in range(0, len(rows), size):
        part = rows[i : i + size]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([e[0] for e in part], pa.binary()),
                pa.array([e[1] and e[1][0] for e in part], pa.bool_()),
                pa.array([None if not e[1] or e[1][0] else e[1][1] for e in part], pa.int64()),
                pa.array([e[1] and e[1][2] for e in part], pa.int64()),
                pa.array([e[2] for e in part], pa.int64()),
            ],
            names=["digest", "no_id", "keep_id", "keep_row", "live"],
        )


def _fold(flush: int | None):
    """Batches of entries through one index; a partial fold empties it when it is full."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = CuckooIndex()
        for batch in batches:
            for digest, no_id, key, row, live in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if live > 0:
                    index.insert(digest, _rank(no_id, key, row), live)
                else:
                    index.delete(digest, -live, _rank(no_id, key, row))
            if flush and index.size >= flush:
                yield from _batches(index.entries())
                index = CuckooIndex()
        yield from _batches(index.entries())

    return run


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: its digest, id and a row number, in the form of an index entry."""
    text = F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), WHITE, " ")
    key = F.col(id_col).cast("long")
    return df.select(F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), key.isNull().alias("no_id"), key.alias("keep_id"), F.monotonically_increasing_id().alias("keep_row"), F.lit(1).cast("long").alias("live"))


def build_index(entries: DataFrame, rows: int) -> DataFrame:
    """The live digests of `entries`: folded in each task, dealt by digest, folded again."""
    n = partitions(entries.sparkSession, rows, PER_TASK)
    return entries.mapInArrow(_fold(FLUSH), ENTRY).repartition(n, "digest").mapInArrow(_fold(None), ENTRY)


def change_index(index: DataFrame, insert: DataFrame, delete: DataFrame, live: DataFrame, rows: int) -> DataFrame:
    """`index` after insertions and then deletions (both in the form of `digests`); a digest goes with its last live copy.

    `live` are the rows that live on, insertions included; they are read for digests whose kept row was
    deleted. Row numbers tell rows apart, so those of `index`, `insert` and `live` must come from one
    numbering. A deletion of a digest that is not live has no effect.
    """
    n = partitions(index.sparkSession, rows, PER_TASK)
    added = index.unionByName(insert).withColumn("_late", F.lit(False))
    both = added.unionByName(delete.withColumn("live", -F.col("live")).withColumn("_late", F.lit(True)))
    changed = stored(both.repartition(n, "digest").sortWithinPartitions("_late").drop("_late").mapInArrow(_fold(None), ENTRY), "index")
    lost = changed.where("no_id IS NULL").select("digest", F.col("live").alias("n"))
    least = live.join(lost, "digest").groupBy("digest", "n").agg(F.min(F.struct("no_id", "keep_id", "keep_row")).alias("k"))
    return changed.where("no_id IS NOT NULL").union(least.select("digest", "k.no_id", "k.keep_id", "k.keep_row", F.col("n").alias("live")))


def verdicts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `df`: id, keep_id, group_size, kept, text_sha256."""
    keys = stored(digests(df, id_col, text_col), "digests")
    # only repeated texts have anything to look up
    repeats = stored(build_index(keys, keys.count()).where("live > 1").select("digest", F.col("keep_id").alias("_keep"), F.col("keep_row").alias("_row"), F.col("live").alias("_live")), "repeats")
    repeats = F.broadcast(repeats) if repeats.count() <= BROADCAST_ROWS else repeats
    return keys.join(repeats, "digest", "left").select(
        F.col("keep_id").alias(id_col),
        F.when(F.col("_row").isNull(), F.col("keep_id")).otherwise(F.col("_keep")).alias("keep_id"),
        F.coalesce("_live", F.lit(1).cast("long")).alias("group_size"),
        (F.coalesce("_row", "keep_row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )
