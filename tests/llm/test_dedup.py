import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

from lorekeep.llm import cdc, components, exact_dedup, simhash


def norm(t):
    return hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest()


def test_cuckoo_index_inserts_deletes_and_grows():
    index = exact_dedup.CuckooIndex(8)
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    assert all(index.insert(k, (False, i, i)) for i, k in enumerate(keys))
    assert index.resizes > 0 and index.size == 5000
    assert not index.insert(keys[7], (False, 1, 1), 2) and index.find(keys[7])[1:] == [(False, 1, 1), 3]
    assert all(index.delete(k) for k in keys[:100] if k != keys[7]) and not index.delete(keys[0])
    assert index.delete(keys[7], 2) and index.find(keys[7]) and index.delete(keys[7]) and index.find(keys[7]) is None
    assert all(index.find(k) for k in keys[100:]) and index.size == 4900


def test_exact_dedup_matches_brute_force(odd, odd_rows, none):
    got = exact_dedup.verdicts(odd).collect()
    groups = defaultdict(list)
    for i, t in odd_rows:
        groups[norm(t)].append(i)
    assert len(got) == len(odd_rows)
    for r in got:
        ids = groups[r.text_sha256]
        assert r.group_size == len(ids) and r.keep_id == min((i for i in ids if i is not None), default=None)
    assert Counter(r.text_sha256 for r in got if r.kept) == Counter(dict.fromkeys(groups, 1))
    assert exact_dedup.verdicts(none).count() == 0


def test_index_follows_changes(spark, odd):
    entries = spark.createDataFrame(exact_dedup.digests(odd).collect(), exact_dedup.ENTRY)
    index = exact_dedup.build_index(entries, 14)
    # a second copy of 10 comes, then both rows named 10 and the long one go; of the copies of 1 the kept one goes
    more = entries.where("keep_id = 10").withColumn("keep_row", exact_dedup.F.col("keep_row") + 1_000_000)
    gone = entries.where("keep_id IN (10, 7, 1)")
    live = entries.join(gone, ["digest", "keep_row"], "left_anti").select(*entries.columns).union(more)
    left = {r.keep_id: r.live for r in exact_dedup.change_index(index, more, gone, live, 14).collect()}
    assert left[10] == 1 and 7 not in left and 1 not in left and left[2] == 4
    again = exact_dedup.build_index(live, 14)
    assert sorted(map(str, again.collect())) == sorted(map(str, exact_dedup.change_index(index, more, gone, live, 14).collect()))


def brute_print(t, shingle):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
    if not w:
        return 0
    grams = [" ".join(w[i : i + shingle]) for i in range(max(1, len(w) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius):
    n = len(prints)
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(range(n), 2):
        if (prints[a][1] ^ prints[b][1]).bit_count() <= radius:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for i, (key, _) in enumerate(prints):
        if key is not None:
            least[find(i)].append(key)
    return [min(least[find(i)], default=None) for i in range(n)]


def test_simhash_matches_brute_force(odd, odd_rows, none):
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd, shingle=4, radius=4, blocks=7).collect())
    prints = [(i, brute_print(t, 4)) for i, t in odd_rows]
    assert got == Counter((i, f"{p:016x}", c) for (i, p), c in zip(prints, brute_components(prints, 4), strict=True))
    assert simhash.near_duplicates(none).count() == 0


def test_links_lose_nothing_even_in_tiles(spark):
    rng = random.Random(3)
    seeds = [rng.getrandbits(64) for _ in range(12)]
    prints = list({s ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for s in seeds for _ in range(60)})
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    want = brute_components(list(enumerate(prints)), 4)
    nodes = spark.createDataFrame(rows, "node long, fp long")
    for tile, blocks in ((8192, 6), (8, 7)):
        root = dict(components.components(simhash.links(nodes, 4, blocks, tile)).collect())
        assert [root.get(i, i) for i in range(len(prints))] == want


def test_components_of_a_random_graph(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, 7), (5, 399)]
    root = {}
    got = dict(components.components(spark.createDataFrame(edges, "u long, v long")).collect())
    nodes = {x for a, b in edges if a != b for x in (a, b)}
    near = defaultdict(set)
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    for n in sorted(nodes):
        if n not in root:
            todo = [n]
            while todo:
                x = todo.pop()
                if x not in root:
                    root[x] = n
                    todo += near[x]
    assert got == root


def test_shared_passages_are_found_and_clean_texts_left(spark, words, odd, none):
    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [text(50 + k % 20) for k in range(80)]
    short = text(40)
    rows = [(i, text(rng.randint(20, 300)), "c") for i in range(100)]
    for k, p in enumerate(passages):
        rows += [(1000 + 10 * k + j, f"{text(rng.randint(0, 90))} {p} {text(50)}", "c") for j in range(3)]
    rows += [(5000 + j, f"{text(30)} {short} {text(30)}", "c") for j in range(3)] + [(6000, passages[0] + " " + passages[0], "c")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start string")
    got = cdc.passages(df).collect()
    want = {1000 + 10 * k + j for k in range(80) for j in (1, 2)} | {6000}
    assert {r.doc_id for r in got} == want
    texts = {i: t.encode() for i, t, _ in rows}
    for r in got:
        assert r.n_words >= 50 and texts[r.doc_id][r.start + 8 : r.stop - 8] in texts[r.first_doc_id]
    assert cdc.passages(none).count() == 0 and {r.doc_id for r in cdc.passages(odd).collect()} <= {2, 3, 8}


def test_chunks_move_with_an_insertion(words):
    import numpy as np

    rng = random.Random(4)
    a = " ".join(rng.choice(words) for _ in range(3000)).encode()
    b = a[:5000] + b"XYZ inserted" + a[5000:]

    def cut(t):
        ends = cdc.cuts(np.frombuffer(t, np.uint8))
        return [t[x:y] for x, y in zip([0, *ends], ends, strict=False)]

    assert len(set(cut(b)) - set(cut(a))) <= 4
    assert b"".join(cut(a)) == a
    repeated = [cut(rng.randbytes(rng.randint(0, 200)) + b"again and " * 90) for _ in range(20)]
    assert set.intersection(*map(set, repeated))
    one_step, cdc.STEP = cdc.STEP, 777
    in_steps = cut(a)
    cdc.STEP = one_step
    assert in_steps == cut(a)


def test_query_names_are_registered():
    from lorekeep.llm.queries import ORACLES, QUERIES

    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 11)] and set(ORACLES) <= set(QUERIES)


def test_substring_passages_against_every_window_of_fifty_words(spark):
    docs = sorted((r.doc_id, r.text or "") for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect())
    first, want = {}, set()
    for d, t in docs:
        at = [m.span() for m in re.finditer(r"[^\x20\x09-\x0d]+", t)]
        windows = [xxhash.xxh3_64_intdigest(t[at[i][0] : at[i + 49][1]].encode()) for i in range(len(at) - 49)]
        if any(first.get(h, d) < d for h in windows):
            want.add(d)
        for h in windows:
            first.setdefault(h, d)
    texts = dict(docs)
    got = cdc.passages(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {r.doc_id for r in got}
    assert len(want) > 80 and len(want & found) >= 0.97 * len(want) and len(found - want) <= 0.01 * len(want)
    assert all(texts[r.doc_id].encode()[r.start : r.stop] in texts[r.first_doc_id].encode() for r in got)


def test_substring_spans_of_repeated_ids(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(500)]
    passage = " ".join(rng.choice(words) for _ in range(80))
    rows = [(1, passage)] + [(5, " ".join(rng.choice(words) for _ in range(30)) + f" {passage} " + " ".join(rng.choice(words) for _ in range(10 + i))) for i in range(6)]
    got = cdc.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {t.index(passage) for i, t in rows if i == 5}
    assert {r.doc_id for r in got} == {5} and want <= {r.start for r in got if r.n_words == 80}
