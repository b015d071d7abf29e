import math
import random
import re
from collections import Counter

import numpy as np

from lorekeep.llm import lexical


def cut(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, k=20):
    bags = [(i, Counter(cut(t))) for i, t in docs]
    bags = [(i, b, sum(b.values())) for i, b in bags if b]
    N, L = len(bags), sum(n for *_, n in bags)
    df = Counter(t for _, b, _ in bags for t in b)
    asked = {}
    for item, t in items:
        if item is not None:
            asked.setdefault(item, Counter()).update(cut(t))
    out = []
    for item, terms in asked.items():
        scored = []
        for i, b, n in bags:
            m = 100 - 25 + 25 * n * N // L
            s = sum(q * math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (1000000000 * b[t] // (1000 * b[t] + 12 * m)) for t, q in terms.items() if b[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return Counter(out)


def rows_of(df):
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect())


ITEMS = "item_id long, text string"


def test_search_matches_brute_force(spark, odd, odd_rows, none, words):
    items = [(1, " ".join(odd_rows[0][1].split()[:40]).upper()), (2, odd_rows[0][1].split()[0] + " ünïcode ÀÉ"), (3, None), (4, "!? "), (None, "one"), (5, "one"), (5, "tail, tail"), (6, "nowhere_123456")]
    queries = spark.createDataFrame([(*r, 1.0) for r in items], ITEMS + ", score double")
    want = brute(odd_rows, items)
    assert rows_of(lexical.search(odd, queries)) == want
    assert rows_of(lexical.search(odd, queries, block=2, cells=1, query_rows=20)) == want
    assert lexical.search(none, queries).count() == 0 and lexical.search(odd, queries.limit(0)).count() == 0


def test_blocks_lose_no_document(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(400)]
    share = [1 / (i + 1) for i in range(400)]
    docs = [(i, " ".join(rng.choices(words, share, k=rng.randrange(5, 120)))) for i in range(900)]
    docs += [(2000 + i, docs[5][1]) for i in range(300)] + [(3000 + i, docs[6][1] + f" x{i}") for i in range(300)]
    items = [(i, " ".join(rng.choices(words, share, k=25))) for i in range(12)] + [(50, docs[5][1]), (51, docs[6][1]), (52, "w0 w1"), (53, "w399")]
    df, queries = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, ITEMS)
    assert rows_of(lexical.search(df, queries, block=8, cells=40_000)) == brute(docs, items)


def test_bounds_hold_and_blocks_are_skipped(spark, monkeypatch):
    seen = {}
    real = lexical.stored

    def keep(df, name):
        seen[name] = real(df, name)
        return seen[name]

    monkeypatch.setattr(lexical, "stored", keep)
    rng = random.Random(3)
    docs = [(i, " ".join(f"t{rng.randrange(60) + 60 * (i % 10)}" for _ in range(30))) for i in range(2000)]
    items = [(i, docs[i][1]) for i in range(10)]
    got = lexical.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, ITEMS), k=5, block=16)
    assert rows_of(got) == brute(docs, items, 5)
    blocks = seen["blocks"].collect()
    held = {r.row: dict(zip(r.terms, r.impacts, strict=True)) for r in seen["coded"].collect()}
    assert all(max(held[d].get(c, 0) for d in b.docs) == m for b in blocks[:200] for c, m in zip(b.coords, b.maxima, strict=True))
    in_lists = sum(len(b.docs) for b in blocks)
    assert seen["pairs"].count() < 2000 and sum(len(r["items"]) for r in seen["pairs"].collect()) < in_lists / 2


def test_clusters_hold_each_position_once():
    v = np.random.default_rng(1).normal(size=(500, lexical.DIMS)).astype(np.float32)
    parts = lexical._cluster(v, 20)
    assert sorted(np.concatenate(parts).tolist()) == list(range(500)) and max(map(len, parts)) <= 40
