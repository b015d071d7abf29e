"""Trie of conversation prefixes in minimal-perfect-hash node tables.

A turn becomes a 128-bit digest in the scan; texts are never shuffled. Turns are sorted by
range over the whole table, so one long conversation may lie in many tasks: a task folds its
stretch into polynomial prefix digests, and the digest and length that a stretch brings along
come from the few conversations that a task border cuts. Prefix digests can be shifted, so a
conversation whose beginning is taken from another one (`splice`) needs no second pass.

Distinct prefixes are the nodes. A node with one member has no branches below it and is done
at once. The others, with the first node behind them of each member, go to shards of whole
subtrees of up to `shard` turns: a shard enumerates its digests by a minimal perfect hash
(slots are compared with the full digests, and a wrong hit is no hit), scatters counts into
flat arrays by slot, and adds them up through an array of parent slots, depth by depth.
Nodes above the subtrees are few, at most turns / `shard` on a level; sums over them go
up by pointer doubling, in rounds that grow with the logarithm of the depth.
The ids that end in a node are sorted by range, joined in pieces by many tasks and hashed as a
stream of those pieces, so that no task holds them.

Defined cases: null roles and texts are empty; a null turn comes first; equal turns of a
conversation go by digest, repeated rows are turns of their own; rows with a null conversation
id are ignored; an empty table has no node, not even a root; other columns are ignored.
Two prefixes of one digest and length whose last turns differ raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorekeep.llm.shared import stored

PRIMES = np.array([2147483647, 2147483629, 2147483587, 2147483579], np.uint64)
BASES = np.array([1103515249, 1664525171, 1299709963, 2038074751], np.uint64)
INVERSE = np.array([pow(int(b), -1, int(p)) for b, p in zip(BASES, PRIMES, strict=True)], np.uint64)
LOW = np.uint64(0x7FFFFFFF)
#: Turns below a node from which on it stands above the shards; at least the square root of all turns.
SHARD = 200_000
#: Nodes above the shards up to which their table is broadcast.
BROADCAST_ROWS = 400_000
#: Bytes of joined ids in one piece.
PIECE = 1 << 20


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Slots:
    """Minimal perfect hash of distinct keys (rows of an integer matrix).

    Level by level keys that are alone at their place of a bit array get it, the others go on;
    a key's slot is the number of taken places before its own.
    """

    def __init__(self, keys: np.ndarray, spread: float = 2.0) -> None:
        self.levels: list[tuple[np.ndarray, int]] = []
        self.keys = np.empty_like(keys)
        rest, base = np.arange(len(keys)), 0
        while len(rest):
            if len(self.levels) > 200:
                raise RuntimeError("keys repeat")
            places = max(8, int(spread * len(rest)))
            at = self._place(keys[rest], len(self.levels), places)
            taken = np.bincount(at, minlength=places) == 1
            rank = np.where(taken, base + np.cumsum(taken) - 1, -1)
            alone = taken[at]
            self.keys[rank[at[alone]]] = keys[rest[alone]]
            self.levels.append((rank, places))
            base += int(taken.sum())
            rest = rest[~alone]

    @staticmethod
    def _place(keys: np.ndarray, level: int, places: int) -> np.ndarray:
        h = np.full(len(keys), 0x9E3779B97F4A7C15 * (level + 1) % (1 << 64), np.uint64)
        for column in keys.T:
            h = _mix(h ^ column.astype(np.int64).view(np.uint64))
        return (h % np.uint64(places)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of keys; -1 where the slot's own key is another one."""
        out, rest = np.full(len(keys), -1), np.arange(len(keys))
        for level, (rank, places) in enumerate(self.levels):
            if not len(rest):
                break
            got = rank[self._place(keys[rest], level, places)]
            out[rest[got >= 0]] = got[got >= 0]
            rest = rest[got < 0]
        hit = out >= 0
        hit[hit] = (self.keys[out[hit]] == keys[hit]).all(axis=1)
        return np.where(hit, out, -1)


def _powers(base: np.ndarray, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent of each row, modulo the four primes."""
    left, square = exponents.astype(np.uint64), base.copy()
    out = np.ones((len(left), 4), np.uint64)
    while left.any():
        odd = (left & np.uint64(1)).astype(bool)
        out[odd] = out[odd] * square % PRIMES
        square = square * square % PRIMES
        left = left >> np.uint64(1)
    return out


def _terms(d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    a, b = d1.view(np.uint64), d2.view(np.uint64)
    return np.stack([a & LOW, a >> np.uint64(32) & LOW, b & LOW, b >> np.uint64(32) & LOW], axis=1) % PRIMES


def _pack(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (v[:, 0] | v[:, 1] << np.uint64(32)).view(np.int64), (v[:, 2] | v[:, 3] << np.uint64(32)).view(np.int64)


def _unpack(q1: np.ndarray, q2: np.ndarray) -> np.ndarray:
    a, b = q1.view(np.uint64), q2.view(np.uint64)
    return np.stack([a & LOW, a >> np.uint64(32), b & LOW, b >> np.uint64(32)], axis=1)


def _batch(**columns: np.ndarray | pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns.values()], names=list(columns))


def _columns(batch: pa.RecordBatch) -> dict[str, np.ndarray]:
    return {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes = [], []
        for role, text in zip(batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
            head, body = (role or "").encode("utf-8", "surrogatepass"), (text or "").encode("utf-8", "surrogatepass")
            digests.append(hashlib.blake2b(len(head).to_bytes(4, "little") + head + body, digest_size=16).digest())
            sizes.append(len(text or ""))
        d = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("turn"), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array(sizes, pa.int64())], names=["conv_id", "turn", "d1", "d2", "n_chars"])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Place and prefix digest of each turn in this task's stretch of its conversation."""
    seg = TaskContext.get().partitionId()
    conv, count, held = None, 0, np.zeros(4, np.uint64)
    for batch in batches:
        x = _columns(batch)
        c, n = x["conv_id"], batch.num_rows
        if not n:
            continue
        starts = np.concatenate(([0], np.flatnonzero(c[1:] != c[:-1]) + 1))
        run = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [n]))))
        place = np.arange(n) - starts[run]
        goes_on = run == 0 if c[0] == conv else np.zeros(n, bool)
        place[goes_on] += count
        term = _terms(x["d1"], x["d2"]) * _powers(BASES, place) % PRIMES
        sums = np.cumsum(term, axis=0)
        prefix = sums - (sums[starts] - term[starts])[run]
        prefix[goes_on] += held
        prefix %= PRIMES
        conv, count, held = c[-1], int(place[-1]) + 1, prefix[-1]
        q1, q2 = _pack(prefix)
        yield _batch(conv_id=c, seg=np.full(n, seg, np.int32), i=place, q1=q1, q2=q2, d1=x["d1"], d2=x["d2"], n_chars=x["n_chars"])


def _carried(carry: dict[tuple[int, int], tuple[int, list[int]]]):
    """Stretches of cut conversations moved behind those before them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _columns(batch)
            q, place = _unpack(x["q1"], x["q2"]), x["i"].copy()
            for (conv, seg), (count, held) in carry.items():
                at = np.flatnonzero((x["seg"] == seg) & (x["conv_id"] == conv))
                if len(at):
                    q[at] = (np.array(held, np.uint64) + q[at] * _powers(BASES, np.array([count]))) % PRIMES
                    place[at] += count
            q1, q2 = _pack(q)
            yield _batch(conv_id=x["conv_id"], i=place, q1=q1, q2=q2, d1=x["d1"], d2=x["d2"], n_chars=x["n_chars"])

    return run


TURN = "conv_id long, i long, q1 long, q2 long, d1 long, d2 long, n_chars long"


def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, i, q1, q2, d1, d2, n_chars): every turn with its place, the digest of the prefix that it ends, and its own."""
    kind = df.schema[turn_col].dataType.simpleString()
    rows = df.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    digested = stored(rows.mapInArrow(_digest, f"conv_id long, turn {kind}, d1 long, d2 long, n_chars long").withColumn("at", F.monotonically_increasing_id()), "turns")
    order = ["conv_id", "turn", "d1", "d2", "at"]
    ranged = digested.repartitionByRange(*order).sortWithinPartitions(*order)
    scanned = stored(ranged.drop("turn", "at").mapInArrow(_scan, "conv_id long, seg int, i long, q1 long, q2 long, d1 long, d2 long, n_chars long"), "stretches")
    # a task border cuts one conversation at most: these are fewer than tasks
    cut = scanned.groupBy("conv_id").agg(F.min("seg").alias("a"), F.max("seg").alias("b")).where("a < b").select("conv_id")
    pieces = scanned.join(F.broadcast(cut), "conv_id").groupBy("conv_id", "seg").agg(F.count("*").alias("n"), F.max_by(F.struct("q1", "q2"), "i").alias("q"))
    carry: dict[tuple[int, int], tuple[int, list[int]]] = {}
    conv, count, held = None, 0, np.zeros((1, 4), np.uint64)
    for piece in sorted(pieces.collect(), key=lambda p: (p.conv_id, p.seg)):
        if piece.conv_id != conv:
            conv, count, held = piece.conv_id, 0, np.zeros((1, 4), np.uint64)
        else:
            carry[piece.conv_id, piece.seg] = (count, held[0].tolist())
        own = _unpack(np.array([piece.q.q1]), np.array([piece.q.q2]))
        held = (held + own * _powers(BASES, np.array([count]))) % PRIMES
        count += piece.n
    return scanned.drop("seg") if not carry else stored(scanned.mapInArrow(_carried(carry), TURN), "turns")


MEMBER = "conv_id long, total long, depth long, k1 long, k2 long, p1 long, p2 long, d1 long, d2 long, n_chars long"


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A conversation's own turns behind the first `m` turns of its base, in place of its own first `h`."""
    for batch in batches:
        x = _columns(batch)
        depth = x["m"] + x["i"] - x["h"] + 1
        back = _powers(INVERSE, x["h"] - x["m"])
        own = (_unpack(x["q1"], x["q2"]) + PRIMES - _unpack(x["o1"], x["o2"])) % PRIMES
        key = (_unpack(x["b1"], x["b2"]) + own * back) % PRIMES
        parent = (key + PRIMES - _terms(x["d1"], x["d2"]) * _powers(BASES, depth - 1) % PRIMES) % PRIMES
        k1, k2 = _pack(key)
        p1, p2 = _pack(parent)
        yield _batch(conv_id=x["conv_id"], total=x["total"], depth=depth, k1=k1, k2=k2, p1=p1, p2=p2, d1=x["d1"], d2=x["d2"], n_chars=x["n_chars"])


def members(own: DataFrame, base: Column | None = None, h: Column | None = None, most: int = 0) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, total) and a row of every non-empty prefix of every rebuilt conversation.

    The first `h` turns (an expression on conv_id, up to `most`) are those of conversation `base`
    (all if it has fewer, none if it is absent); the conversation's own turns after its first `h` follow.
    """
    h = F.coalesce(h, F.lit(0)).cast("long") if h is not None else F.lit(0).cast("long")
    base = base.cast("long") if base is not None else F.col("conv_id")
    convs = own.groupBy("conv_id").agg(F.count("*").alias("n")).withColumns({"h": h, "base": base})
    turn = F.struct("i", "q1", "q2", "d1", "d2", "n_chars")
    first = stored(own.where(F.col("i") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("first")), "first")  # `most` turns each
    mine = first.select("conv_id", F.col("first").alias("mine"))
    theirs = first.select(F.col("conv_id").alias("base"), F.col("first").alias("theirs"))
    m = F.least("h", F.coalesce(F.size("theirs"), F.lit(0))).cast("long")
    info = convs.join(mine, "conv_id", "left").join(theirs, "base", "left").withColumn("m", F.when(F.col("theirs").isNull(), 0).otherwise(m).cast("long"))
    at = lambda a, i, q: F.coalesce(F.get(a, (i - 1).cast("int"))[q], F.lit(0)).cast("long")
    info = info.withColumns({"total": F.col("m") + F.greatest(F.col("n") - F.col("h"), F.lit(0)), **{f"b{k}": at("theirs", F.col("m"), f"q{k}") for k in (1, 2)}, **{f"o{k}": at("mine", F.col("h"), f"q{k}") for k in (1, 2)}})
    info = stored(info.select("conv_id", "h", "m", "total", "b1", "b2", "o1", "o2", "theirs"), "conversations")
    taken = info.where("m > 0").select("conv_id", "total", "theirs", F.posexplode(F.slice("theirs", 1, F.col("m").cast("int"))).alias("pos", "t"))
    before = lambda q: F.coalesce(F.get("theirs", F.col("pos") - 1)[q], F.lit(0)).cast("long")
    taken = taken.select("conv_id", "total", (F.col("pos") + 1).cast("long").alias("depth"), F.col("t.q1").alias("k1"), F.col("t.q2").alias("k2"), before("q1").alias("p1"), before("q2").alias("p2"), "t.d1", "t.d2", "t.n_chars")
    kept = own.join(info.drop("theirs"), "conv_id").where("i >= h").mapInArrow(_rebuilt, MEMBER)
    return info.select("conv_id", "total"), stored(taken.union(kept), "members")


NODE = "depth long, k1 long, k2 long, p1 long, p2 long, conv_id long, parent_conv_id long, n_convs long, n_ends long, n_children long, n_leaves long, saved_tokens long"


def _table(x: dict[str, np.ndarray]) -> pa.RecordBatch:
    """Counts of whole subtrees."""
    depth = x["depth"]
    slots = Slots(np.stack([depth, x["k1"], x["k2"]], axis=1))
    row = slots.find(np.stack([depth, x["k1"], x["k2"]], axis=1))
    if len(np.unique(row)) != len(row) or row.min() < 0:
        raise RuntimeError("a node has no slot of its own")
    by = np.argsort(row)  # rows in the order of their slots
    x = {k: v[by] for k, v in x.items()}
    parent = slots.find(np.stack([x["depth"] - 1, x["p1"], x["p2"]], axis=1))
    has = parent >= 0
    alone = x["n_convs"] == 1
    children = np.where(alone, 1 - x["n_ends"], 0)  # what follows a node of one member is not in the table
    np.add.at(children, parent[has], 1)
    leaves = np.where(alone | (children == 0), 1, 0)
    saved = (x["n_convs"] - 1) * x["n_chars"]
    order = np.argsort(-x["depth"], kind="stable")
    levels = np.flatnonzero(np.diff(x["depth"][order])) + 1
    for level in np.split(order, levels):
        level = level[has[level]]
        np.add.at(leaves, parent[level], leaves[level])
        np.add.at(saved, parent[level], saved[level])
    above = pa.array(x["conv_id"][parent], mask=~has)
    return _batch(depth=x["depth"], k1=x["k1"], k2=x["k2"], p1=x["p1"], p2=x["p2"], conv_id=x["conv_id"], parent_conv_id=above, n_convs=x["n_convs"], n_ends=x["n_ends"], n_children=children, n_leaves=leaves, saved_tokens=saved)


def _shards(rows: int):
    """Rows sorted by the top of their subtree to node tables of whole subtrees, of `rows` rows or one subtree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, np.ndarray]] = []
        for batch in batches:
            x = _columns(batch)
            if not batch.num_rows:
                continue
            held.append(x)
            if sum(len(h["depth"]) for h in held) < rows:
                continue
            x = {k: np.concatenate([h[k] for h in held]) for k in x}
            last = (x["r1"] == x["r1"][-1]) & (x["r2"] == x["r2"][-1])
            cut = len(last) - int(np.argmin(last[::-1])) if not last.all() else 0
            held = [{k: v[cut:] for k, v in x.items()}]
            if cut:
                yield _table({k: v[:cut] for k, v in x.items()})
        if held:
            yield _table({k: np.concatenate([h[k] for h in held]) for k in held[0]})

    return run


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ids sorted by node to comma-joined pieces, a piece never longer than PIECE and a few digits."""
    seg, no = TaskContext.get().partitionId(), 0
    for batch in batches:
        x = _columns(batch)
        if not batch.num_rows:
            continue
        same = np.ones(batch.num_rows - 1, bool)
        for k in ("depth", "k1", "k2"):
            same &= x[k][1:] == x[k][:-1]
        edges = np.concatenate(([0], np.flatnonzero(~same) + 1, [batch.num_rows]))
        cuts = [(a, min(a + PIECE // 20, e)) for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True) for a in range(s, e, PIECE // 20)]
        first = [a for a, _ in cuts]
        yield _batch(depth=x["depth"][first], k1=x["k1"][first], k2=x["k2"][first], seg=np.full(len(cuts), seg, np.int32), no=np.arange(no, no + len(cuts)), piece=pa.array([",".join(map(str, x["conv_id"][a:b].tolist())) for a, b in cuts]))
        no += len(cuts)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces in order to one hash a node."""
    node, sha = None, None
    for batch in batches:
        done = []
        for d, a, b, piece in zip(*(batch.column(c).to_pylist() for c in ("depth", "k1", "k2", "piece")), strict=True):
            if node != (d, a, b):
                if node is not None:
                    done.append((*node, sha.hexdigest()))
                node, sha = (d, a, b), hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        if done:
            yield _batch(**{k: pa.array(v) for k, v in zip(("depth", "k1", "k2", "ends_sha256"), zip(*done, strict=True), strict=True)})
    if node is not None:
        yield _batch(depth=pa.array([node[0]]), k1=pa.array([node[1]]), k2=pa.array([node[2]]), ends_sha256=pa.array([sha.hexdigest()]))


KEY = ["depth", "k1", "k2"]


def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256): SHA-256 of the comma-joined ascending ids of each node in `ends`."""
    ends = stored(ends.select(*KEY, "conv_id"), "ends")
    order = [*KEY, "conv_id"]
    pieces = ends.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_joined, "depth long, k1 long, k2 long, seg int, no long, piece string")
    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "seg", "no").mapInArrow(_hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def _known_small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def _summed(top: DataFrame) -> DataFrame:
    """Sums of n_leaves and saved_tokens over subtrees, by pointer doubling: after k rounds a node has what is less than 2**k levels below."""
    up = [F.col(c).alias(f"a_{c}") for c in KEY]
    state = stored(top.select(*KEY, (F.col("depth") - 1).alias("a_depth"), F.col("p1").alias("a_k1"), F.col("p2").alias("a_k2"), "n_leaves", "saved_tokens").withColumn("a_depth", F.when(F.col("a_depth") >= 0, F.col("a_depth"))), "sums")
    while not state.where("a_depth IS NOT NULL").isEmpty():
        climbing = state.where("a_depth IS NOT NULL")
        more = climbing.groupBy("a_depth", "a_k1", "a_k2").agg(F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
        more = more.select(*[F.col(f"a_{c}").alias(c) for c in KEY], "l", "s")
        far = state.select(*up, *[F.col(f"a_{c}").alias(f"b_{c}") for c in KEY])
        moved = state.join(more, KEY, "left").join(far, [f"a_{c}" for c in KEY], "left")
        zero = F.lit(0)
        state = stored(moved.select(*KEY, *[F.col(f"b_{c}").alias(f"a_{c}") for c in KEY], (F.col("n_leaves") + F.coalesce("l", zero)).alias("n_leaves"), (F.col("saved_tokens") + F.coalesce("s", zero)).alias("saved_tokens")), "sums")
    return state.select(*KEY, "n_leaves", "saved_tokens")


def nodes(df: DataFrame, base: Column | None = None, h: Column | None = None, most: int = 0, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", shard: int = SHARD, rows: int = 250_000) -> DataFrame:
    """One row per distinct prefix of the (rebuilt) conversations, the empty one included.

    (conv_id, depth) name a node: its smallest member and its length. n_convs are its members,
    n_leaves the childless nodes of its subtree, saved_tokens the code points that its subtree
    repeats, ends_sha256 the hash of the members that end in it.
    """
    own = turns(df, conv_col, turn_col, role_col, text_col)
    convs, rows_of = members(own, base, h, most)
    size = rows_of.count()
    shard = max(shard, isqrt(size))
    checked = F.when((F.min("d1") == F.max("d1")) & (F.min("d2") == F.max("d2")) & (F.min("p1") == F.max("p1")) & (F.min("p2") == F.max("p2")), F.min("n_chars")).otherwise(F.raise_error(F.lit("two prefixes share a digest")).cast("long"))
    found = rows_of.groupBy(*KEY).agg(F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("depth") == F.col("total")).cast("long")).alias("n_ends"), checked.alias("n_chars"), F.sum("total").alias("weight"))
    found = stored(found, "nodes")
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum((F.col("total") == 0).cast("long")).alias("n_ends")).where("n_convs > 0")
    root = root.select(*[zero.alias(c) for c in (*KEY, "p1", "p2")], "conv_id", "n_convs", "n_ends", zero.alias("n_chars"))
    high = (F.col("n_convs") > 1) & (F.col("weight") > shard)
    top = stored(found.where(high).drop("weight").unionByName(root), "top")
    # subtrees below the top: each member's first node that is not in it
    if top.where("depth > 0").isEmpty():
        roots = rows_of.where("depth = 1").select("conv_id", F.col("k1").alias("r1"), F.col("k2").alias("r2"))
    else:
        marked = rows_of.select("conv_id", *KEY).join(_known_small(top.select(*KEY, F.lit(True).alias("high"))), KEY, "left")
        roots = marked.where("high IS NULL").groupBy("conv_id").agg(F.min_by(F.struct("k1", "k2"), "depth").alias("r")).select("conv_id", F.col("r.k1").alias("r1"), F.col("r.k2").alias("r2"))
    tails = found.where("n_convs = 1").groupBy("conv_id").agg(F.min("depth").alias("tail"))
    low = stored(found.where(~high).drop("weight").join(roots, "conv_id").join(tails, "conv_id", "left").withColumn("deep", (F.col("n_convs") == 1) & (F.col("depth") > F.col("tail"))), "low")
    sharded = low.where("NOT deep").drop("tail", "deep").repartition("r1", "r2").sortWithinPartitions("r1", "r2")
    done = stored(sharded.mapInArrow(_shards(rows), NODE), "shards")
    deep = low.where("deep").select("conv_id", "depth", F.col("conv_id").alias("parent_conv_id"), "n_convs", (1 - F.col("n_ends")).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"), "n_ends")
    # the top: what its subtrees bring, its own edges, sums upwards
    over = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    hung = done.where("parent_conv_id IS NULL").groupBy(*over).agg(F.count("*").alias("c"), F.sum("n_leaves").alias("l"), F.sum("saved_tokens").alias("s"))
    inner = top.where("depth > 0").groupBy(*over).agg(F.count("*").alias("c2"))
    none = lambda c: F.coalesce(c, zero)
    counted = top.join(hung, KEY, "left").join(inner, KEY, "left").withColumn("n_children", none("c") + none("c2"))
    counted = stored(counted.withColumns({"n_leaves": none("l") + (F.col("n_children") == 0).cast("long"), "saved_tokens": none("s") + (F.col("n_convs") - 1) * F.col("n_chars")}).drop("c", "c2", "l", "s"), "counted")
    names = top.select(F.col("depth").alias("o_depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("above"))
    known = _known_small(names)
    out = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "n_ends"]
    up = lambda rows: rows.withColumn("o_depth", F.col("depth") - 1).join(known, ["o_depth", "p1", "p2"], "left")
    heights = up(counted.drop("n_leaves", "saved_tokens").join(_summed(counted), KEY)).withColumnRenamed("above", "parent_conv_id").select(*KEY[1:], *out)
    inside = done.where("parent_conv_id IS NOT NULL").select(*KEY[1:], *out).union(up(done.where("parent_conv_id IS NULL").drop("parent_conv_id")).withColumnRenamed("above", "parent_conv_id").select(*KEY[1:], *out))
    ends = end_hashes(rows_of.where("depth = total").select(*KEY, "conv_id").union(convs.where("total = 0").select(*[zero.alias(c) for c in KEY], "conv_id")))
    many = heights.union(inside).join(ends, KEY, "left")
    empty = F.sha2(F.lit(""), 256)
    rest = deep.withColumn("ends_sha256", F.when(F.col("n_ends") == 1, F.sha2(F.col("conv_id").cast("string"), 256)))
    return many.select(*out, "ends_sha256").union(rest.select(*out, "ends_sha256")).withColumn("ends_sha256", F.coalesce("ends_sha256", empty)).drop("n_ends")


def shared_starts(df: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Nodes of conversations that take their first crc32(id) % `most` turns from the one whose id ends a hundred (`every`)."""
    c = F.col("conv_id")
    return nodes(df, base=c - c % every, h=F.crc32(c.cast("string").cast("binary")) % most, most=most - 1)
