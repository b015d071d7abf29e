import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np

from lorekeep.llm import trie


def brute(rows, every=100, most=6):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % most if most else 0
        built[c] = tuple(own.get(c - c % every, [])[:h]) + tuple(v[h:])
    at = defaultdict(list)
    for c, v in built.items():
        for d in range(len(v) + 1):
            at[v[:d]].append(c)
    kids = defaultdict(list)
    for p in at:
        if p:
            kids[p[:-1]].append(p)
    leaves, saved = {}, {}
    for p in sorted(at, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids[p]) or 1
        saved[p] = sum(saved[k] for k in kids[p]) + ((len(at[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, convs in at.items():
        ends = ",".join(str(c) for c in sorted(convs) if built[c] == p)
        out.append((min(convs), len(p), min(at[p[:-1]]) if p else None, len(convs), len(kids[p]), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str)


def made(seed, convs=260, words=3):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(1000), convs):
        n = rng.choice([1, 2, 3, 5, 8])
        for t in range(n):
            rows.append((c, t, rng.choice(["user", "assistant"][t % 2 : t % 2 + 1] or ["user"]), "ab"[rng.randrange(2)] * (1 + rng.randrange(words)) + "é"))
    rng.shuffle(rows)
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


def test_nodes_match_brute_force(spark):
    rows = made(1) + [(5000, None, None, None), (5000, 2, "user", ""), (None, 1, "user", "x"), (5001, 0, None, ""), (5100, 1, "user", "t"), (5101, 1, "user", "t")]
    df = spark.createDataFrame([(*r, 9, "k") for r in rows], SCHEMA + ", depth int, k1 string")
    want = brute(rows)
    assert rows_of(trie.shared_starts(df)) == want
    # a top of many levels, and shards of a few rows
    c = trie.F.col("conv_id")
    h = trie.F.crc32(c.cast("string").cast("binary")) % 6
    assert rows_of(trie.nodes(df, base=c - c % 100, h=h, most=5, shard=12, rows=5)) == want
    assert rows_of(trie.nodes(df)) == brute(rows, most=0)
    assert trie.shared_starts(df.limit(0)).count() == 0


def test_one_long_conversation_lies_in_many_tasks(spark):
    rng = random.Random(4)
    texts = [rng.choice("abc") * rng.randrange(1, 4) for _ in range(3000)]
    rows = [(7, t, "user", x) for t, x in enumerate(texts)] + [(8, t, "user", x) for t, x in enumerate(texts[:2500])] + [(107, t, "user", x) for t, x in enumerate(texts[:2900] + ["z"])]
    rows += [(c, t, "user", "same") for c in range(200, 900) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert rows_of(trie.nodes(df, shard=40)) == brute(rows, most=0)


def test_equal_turns_and_repeats_are_turns_of_their_own(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "b"), (2, 0, "user", "a")], SCHEMA)
    got = trie.nodes(df).collect()
    assert len(got) == 4 and {(r.depth, r.n_convs) for r in got} == {(d, 2) for d in range(4)}


def test_slots_are_minimal_and_verified():
    rng = np.random.default_rng(2)
    keys = rng.integers(0, 1 << 62, (5000, 3))
    slots = trie.Slots(keys)
    assert sorted(slots.find(keys).tolist()) == list(range(5000))
    assert (slots.find(keys + 1) == -1).all() and not len(trie.Slots(keys[:0]).levels)


def test_pieces_of_ids_hash_as_a_whole(spark, monkeypatch):
    ids = list(range(0, 900_000, 7))
    df = spark.createDataFrame([(2, 1, 1, c) for c in ids] + [(2, 1, 2, 5)], "depth long, k1 long, k2 long, conv_id long")
    got = {r.k2: r.ends_sha256 for r in trie.end_hashes(df).collect()}
    assert got == {1: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), 2: hashlib.sha256(b"5").hexdigest()}
