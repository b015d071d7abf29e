"""Near-duplicates against all pairs by exact Jaccard."""

import random
import re
from itertools import combinations

import corpus_pipeline
from lorekeep import shared
from lorekeep.llm import components, minhash

SF = "/root/testdata/sf0.001"


def grams(text, size=5):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    return {" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute_roots(sets, least=0.8):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(len(sets)), 2):
        if sets[a] == sets[b] or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    return [find(i) for i in range(len(sets))]


def test_stage_reaches_pairs_of_jaccard_near_the_limit(spark, words):
    rng = random.Random(12)
    texts = []
    for k in range(60):  # a base, and copies with one to seven words changed far apart
        base = [rng.choice(words) for _ in range(160)]
        texts.append(" ".join(base))
        for changed in range(1, 8):
            copy = list(base)
            for j in range(changed):
                copy[20 * j + 10] = f"new{k}x{changed}x{j}"
            texts.append(" ".join(copy))
    want = brute_roots([grams(t) for t in texts])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == {i for i, r in enumerate(want) if i == r} and 60 < len(got) < 480


def test_crowded_buckets_are_compared_in_tiles(spark, words, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for k in range(90):  # one cloud of copies, some of them further apart than the limit
        copy = list(base)
        for j in rng.sample(range(120), rng.randint(0, 9)):
            copy[j] = f"w{k}x{j}"
        texts.append(" ".join(copy))
    want = brute_roots([grams(t) for t in texts])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    monkeypatch.setattr(minhash, "TILE", 7)
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(want)) and 1 < len(set(want)) < 60


def test_stage_matches_all_pairs_of_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.orderBy("doc_id").collect()
    want = brute_roots([grams(r.text) for r in rows])
    got = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()}
    assert got == {r.doc_id for i, r in enumerate(rows) if want[i] == i}


def test_stages_take_null_and_repeated_ids(spark, words):
    rng = random.Random(2)
    text = lambda: " ".join(rng.choice(words) for _ in range(60))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(None, a), (1, b), (1, b), (1, b.upper()), (1, c), (None, d), (None, d), (2, d), (None, e), (None, e + " more")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text.lower()[:60]) for r in corpus_pipeline.near_dedup(spark, docs, SF).collect()), key=str)
    assert got == sorted([(i, t[:60]) for i, t in ((None, a), (1, b), (1, c), (2, d), (None, e))], key=str)
    bad = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").limit(2).collect()]
    rows = [(None, bad[0]), (None, a), (3, bad[1]), (3, b), (4, c), (4, c)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in corpus_pipeline.decontaminate(spark, docs, SF).collect()), key=str)
    assert got == sorted([(None, a), (3, b), (4, c), (4, c)], key=str)


def test_steps_link_components_and_keep_one_table_of_edges(spark, words, monkeypatch):
    rng = random.Random(3)
    base = [rng.choice(words) for _ in range(120)]
    texts = []
    for k in range(60):  # a cloud of copies that no single step links
        copy = list(base)
        for j in rng.sample(range(120), rng.randint(0, 6)):
            copy[j] = f"w{k}x{j}"
        texts.append(" ".join(copy))
    runs = []

    def seen(edges):
        out = components.components(edges)
        ends = {x for r in edges.collect() for x in (r.u, r.v)}
        runs.append((ends, {r.node: r.root for r in out.collect()}))
        return out

    monkeypatch.setattr(minhash, "components", seen)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs).collect()}
    assert got == dict(enumerate(brute_roots([grams(t) for t in texts]))) and 2 <= len(runs) <= 4
    for i, (ends, _) in enumerate(runs):  # a node that has been linked to a smaller one does not come again
        assert not ends & {node for _, root in runs[:i] for node, r in root.items() if node != r}


def test_rounds_replace_each_other(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    before = len(shared._made)
    out = components.components(chain)
    assert {r.root for r in out.collect()} == {0} and out.count() == 41
    assert len([p for p in shared._made[before:] if "/edges-" in p]) == 1
