import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from lorekeep.llm import repeats


def brute(texts, least):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + least] for r in raws for p in range(len(r) - least + 1))
    out = []
    for r in raws:
        gone = np.zeros(len(r) + 1, bool)
        for p in range(len(r) - least + 1):
            if seen[r[p : p + least]] > 1:
                gone[p : p + least] = True
        spans = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        kept = np.frombuffer(r, np.uint8)[~gone[: len(r)]].tobytes()
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def rows_of(df):
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def made(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def texts(words):
    rng = random.Random(12)
    passage, line = made(rng, words, 130), made(rng, words, 60)
    base = made(rng, words, 400)
    rows = [made(rng, words, rng.randrange(5, 300)) for _ in range(60)]
    rows += [made(rng, words, 20) + " " + passage + " " + made(rng, words, rng.randrange(1, 60)) for _ in range(40)]
    rows += [passage[i * 7 :] + made(rng, words, 30) for i in range(30)]
    rows += [made(rng, words, 40) + passage[: len(passage) - i * 5] for i in range(30)]
    rows += [made(rng, words, 30) + line + made(rng, words, 30) for _ in range(20)]  # shorter than a repeat
    for i in range(25):  # near copies
        w = base.split()
        for _ in range(i):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append(" ".join(w))
    rows += [base, base, rows[0] * 3, "word " * 500, "a" * 1500, "a" * 400, "a" * 399, "é" * 300, None, "", rows[3][:400], rows[60][5:450] + rows[61][100:520]]
    return rows


def test_removals_match_brute_force(spark, texts):
    want = Counter((i, *x) for i, x in enumerate(brute(texts, 400)))
    df = spark.createDataFrame([(i, t, 3, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int, t1 string").repartition(5)
    assert rows_of(repeats.removals(df)) == want
    # crowded blocks are cut by offsets, down to single strings
    assert rows_of(repeats.removals(df, tile=3)) == want
    assert rows_of(repeats.removals(df, tile=1)) == want


def test_odd_rows(odd, odd_rows, none):
    want = Counter((i, *x) for (i, _), x in zip(odd_rows, brute([t for _, t in odd_rows], 400), strict=True))
    assert rows_of(repeats.removals(odd)) == want
    assert repeats.removals(none).count() == 0


def test_short_repeats_of_few_letters(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab") for _ in range(rng.randrange(0, 90))) for _ in range(120)]
    want = Counter((i, *x) for i, x in enumerate(brute(texts, 12)))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for tile in (4096, 6):
        assert rows_of(repeats.removals(df, least=12, gram=4, tile=tile)) == want


def test_groups_are_maximal_and_whole(spark, words):
    rng = random.Random(2)
    shared = made(rng, words, 40)[:150]
    texts = [made(rng, words, 30) + shared + made(rng, words, 30) for _ in range(6)] + [made(rng, words, 30) + shared[:110] + made(rng, words, 30) for _ in range(4)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    groups, spans = repeats.repeat_groups(df, least=100, gram=32)
    keyed = {(r.t1, r.t2): t for r, t in zip(df.orderBy("doc_id").select(*repeats._text_keys(repeats.F.col("text"))).collect(), texts, strict=True)}
    held = defaultdict(set)
    for r in groups.collect():
        held[r.g, r.no].add((keyed[r.t1, r.t2], r.start, r.length))
    assert held and spans.count() == 0
    sizes = Counter()
    for g in held.values():
        assert len({t[a : a + n] for t, a, n in g}) == 1
        (n,) = {n for *_, n in g}
        assert len({t[a - 1 : a] for t, a, _ in g}) > 1 and len({t[a + n : a + n + 1] for t, a, _ in g}) > 1
        sizes[len(g), n] += 1
    assert any(m == 10 and 108 <= n <= 112 for m, n in sizes) and any(m == 6 and n >= 149 for m, n in sizes)


def test_intervals_of_sorted_suffixes():
    assert sorted(repeats.intervals([3, 5, 5, 0, 2])) == [(0, 3, 3), (1, 3, 5), (4, 5, 2)]
    assert list(repeats.intervals([3, 5, 5, 0, 2], 4)) == [(1, 3, 5)]
