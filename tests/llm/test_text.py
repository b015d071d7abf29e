import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorekeep.llm import decontam, licenses, mixing, nbsvm

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, size):
    out = []
    for key, text in docs:
        w, hit, found = words_of(text), set(), set()
        for item, passage in items:
            b = words_of(passage)
            if item is None or not b:
                continue
            for i in range(max(1, len(b) - size + 1)):
                gram = b[i : i + size]
                for j in range(len(w) - len(gram) + 1):
                    if w[j : j + len(gram)] == gram:
                        hit |= set(range(j, j + len(gram)))
                        found.add(str(item))
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_matches_brute_force(spark, words, odd, odd_rows, none):
    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(words[:200]) for _ in range(n))
    items = [(1, text(30)), (2, text(13)), (3, text(5)), (4, words[0]), (5, None), (6, "!!"), (None, text(20)), (1, text(15))]
    docs = [(i, text(rng.randint(0, 60))) for i in range(40)] + [(100 + i, f"{text(20)}, {(t or '').upper()}. {text(3)}") for i, t in items if i] + odd_rows
    df = spark.createDataFrame([(i, t, "p") for i, t in docs], "doc_id long, text string, pos string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = [tuple(r) for r in decontam.decontaminate(df, bench).collect()]
    assert Counter(got) == Counter(brute(docs, items, 13))
    assert all(r.n_hit == 0 for r in decontam.decontaminate(odd, bench.limit(0)).collect())
    assert decontam.decontaminate(none, bench).count() == 0


def brute_near(docs, phrases, rarest, slop):
    out = set()
    for key, text in docs:
        w = words_of(text)
        for phrase in phrases:
            need, reach = Counter(phrase.split()), len(phrase.split()) + slop
            for p in (i for i, x in enumerate(w) if x == rarest[phrase]):
                for a in range(p - reach + 1, p + 1):
                    if not need - Counter(w[max(a, 0) : max(a + reach, 0)]):
                        out.add((key, p, phrase))
                        break
    return out


def test_proximity_matches_brute_force(spark, words):
    rng = random.Random(3)
    some = words[:30]
    items = [(k, " ".join(rng.choice(some) for _ in range(n))) for k, n in enumerate((3, 3, 4, 4, 5, 14, 1))]
    docs = [(i, " ".join(rng.choice(some) for _ in range(rng.randint(0, 120)))) for i in range(60)]
    for k, t in items:
        mixed = t.split()
        rng.shuffle(mixed)
        docs += [(100 + k, " ".join(words[100:110] + mixed + words[150:160])), (200 + k, " ".join(mixed[:2] + ["x"] * 4 + mixed[2:] + mixed[:1])), (300 + k, t)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    grams = decontam.windows(spark.createDataFrame(items, "item_id long, text string")).cache()
    terms = decontam.numbered_terms(grams)
    index = decontam.postings(df, terms)
    lists = decontam.ordered_windows(grams, terms, index)
    name = {r.tid: r.term for r in terms.collect()}
    rows = {r.pid: r for r in lists.collect()}
    rarest = {r.phrase: name[r.lists[0].tid] for r in rows.values()}
    ids = {r.row: r.id for r in index.where("tid IS NULL").collect()}
    for slop in (0, 3, 9):
        got = [(ids[r.row], r.pos, rows[r.pid].phrase) for r in decontam.proximity_matches(index, lists, slop).collect()]
        want = brute_near(docs, rarest, rarest, slop)
        assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_a_frequent_word_as_item_asks_for_no_other_list(spark, words):
    """A one-word item costs its own postings, which carry no text."""
    docs = spark.createDataFrame([(i, " ".join(["the", *words[:20]] * 5)) for i in range(40)], "doc_id long, text string")
    grams = decontam.windows(spark.createDataFrame([(1, "the")], "item_id long, text string"))
    terms = decontam.numbered_terms(grams)
    index = decontam.postings(docs, terms)
    assert index.count() == 40 * 5 + 40 and dict(index.dtypes) == {"row": "bigint", "tid": "bigint", "pos": "int", "id": "bigint"}
    assert decontam.phrase_matches(index, decontam.ordered_windows(grams, terms, index)).count() == 200


def test_classifier_holds_out_and_is_right(spark, odd, none):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    model = nbsvm.train(docs, labels)
    got = nbsvm.score(docs, model).join(labels, "doc_id").where("held_out").collect()
    right = np.mean([r.predicted == r.quality for r in got])
    good, bad = ([r.score for r in got if r.quality == k] for k in (1, 0))
    auc = np.mean([(g > b) + (g == b) / 2 for g in good for b in bad])
    assert len(got) > 50 and right >= 0.95 and auc >= 0.98
    scored = nbsvm.score(odd, model).collect()
    assert len(scored) == odd.count() and all(0 <= r.score <= 1 for r in scored)
    assert len({r.score for r in scored if r.doc_id in (4, 5)}) == 1
    assert nbsvm.score(none, model).count() == 0
    assert {r.score for r in nbsvm.score(odd, nbsvm.train(odd, labels.limit(0))).collect()} == {0.5}
    assert {r.score for r in nbsvm.score(odd, nbsvm.train(docs, labels.where("quality = 1"))).collect()} == {1.0}


def test_classifier_takes_odd_labels(spark, words):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choice(words[:50] if i % 2 else words[50:99]) for _ in range(40))) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    plain = [(i, i % 2) for i in range(300)]
    # null, foreign and contradicting labels (the smaller holds) change nothing but what they say
    odd = [*plain, (4, None), (5, 7), (None, 1), *((i, 1) for i in range(0, 300, 2))]
    one, two = (nbsvm.train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in (plain, odd))
    assert np.array_equal(one.weights, two.weights) and (one.bias, one.slope, one.offset) == (two.bias, two.slope, two.offset)
    assert all((one.score(t) >= 0.5) == bool(i % 2) for i, t in rows)


def test_features_of_long_texts_do_not_depend_on_steps(words, monkeypatch):
    rng = random.Random(7)
    text = "".join(rng.choice([*words[:90], "  ", "A" * 40, "1234567890" * 5, ". ", "é" * 30, "\n"]) for _ in range(3000))
    whole = nbsvm.features(text)
    data, seen = text.encode(), set()
    kinds = nbsvm.SHAPES[np.frombuffer(data, np.uint8)].tolist()
    run = [k for i, k in enumerate(kinds) if not i or kinds[i - 1] != k]
    for values, grams in ((list(data), ((1, 0x9E3779B1), (2, 0x85EBCA6B), (3, 0xC2B2AE35))), (run, ((4, 0x27D4EB2F), (6, 0x165667B1)))):
        for n, seed in grams:
            for i in range(len(values) - n + 1):
                h = seed
                for v in values[i : i + n]:
                    h = (h ^ v) * 0x01000193 & 0xFFFFFFFF
                seen.add((h * 0x9E3779B1 & 0xFFFFFFFF) >> 16)
    assert set(whole.tolist()) == seen
    for step in (1, 7, 31, 1000):
        monkeypatch.setattr(nbsvm, "STEP", step)
        assert np.array_equal(nbsvm.features(text), whole)
    every = np.arange(1 << 16)
    assert all(np.array_equal(nbsvm.unpacked(nbsvm.packed(x)), x) for x in (whole, every, every[:0], every[:2047], every[:2048])) and len(nbsvm.packed(every)) == 8192


def test_descent_reaches_the_optimum():
    rng = np.random.default_rng(0)
    y = np.arange(200) % 2
    rows = [nbsvm.packed(np.sort(rng.choice(50, 12, replace=False)) + (50 if k else 0)) for k in y]
    w, b, _ = nbsvm.dual_coordinate_descent(rows, np.ones(1 << 16), y)
    assert all((w[nbsvm.unpacked(x)].sum() + b > 0) == bool(k) for x, k in zip(rows, y, strict=True))
    # classes that overlap: the gap between primal and dual value closes
    rows = [nbsvm.packed(np.sort(rng.choice(60, 8, replace=False)) + (20 if k else 0)) for k in y]
    assert nbsvm.dual_coordinate_descent(rows, np.ones(1 << 16), y, rounds=600)[2] < 1e-2


def test_mixture_meets_budgets_and_targets(spark, words, odd, none):
    rng = random.Random(5)
    sizes = {"a": 600, "b": 150, "c": 40, None: 25}
    rows = [(k * 1000 + i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 30))), s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    total = Counter()
    for _, t, s in rows:
        total[s] += len(t.split())
    whole = sum(total.values())
    shares = [n / whole for n in total.values()]
    entropy = lambda a: -sum(p * np.log(p) for p in (lambda z: [x / sum(z) for x in z])([s**a for s in shares]))
    table = spark.createDataFrame(list(total.items()), "source string, tokens long")
    assert abs(entropy(mixing.exponent(table, entropy=1.1)) - 1.1) < 1e-6
    a = mixing.exponent(table, repetition=3.0)
    assert abs((max(shares) / min(shares)) ** (1 - a) - 3) < 1e-6
    got = mixing.mix(df, repetition=3.0, block_tokens=200).collect()
    count = Counter(r.doc_id for r in got)
    assert set(count) == {r[0] for r in rows} and max(count.values()) <= 3
    assert all(sorted(r._mix_pass for r in got if r.doc_id == i) == list(range(count[i])) for i in list(count)[::60])
    used, longest = Counter(), max(len(t.split()) for _, t, _ in rows)
    for r in got:
        used[r.source] += r._mix_tokens
    z = sum(s**a for s in shares)
    budget = max(n / (p**a / z) for n, p in zip(total.values(), shares, strict=True))
    for (s, _), p in zip(total.items(), shares, strict=True):
        assert -longest <= used[s] - budget * p**a / z <= 1
    # another seed, another order; blocks of all sources mixed; a block in one piece
    one, two = ([(r.doc_id) for r in mixing.in_order(mixing.mix(df, repetition=3.0, block_tokens=200, seed=k)).collect()] for k in (11, 12))
    assert sorted(one) == sorted(r.doc_id for r in got) and one != two
    blocks = [(r._mix_pass, r._mix_order, r.source, r._mix_block) for r in sorted(got, key=lambda r: (r._mix_pass, r._mix_order, r._mix_block, r._mix_at))]
    runs = [b for i, b in enumerate(blocks) if not i or blocks[i - 1] != b]
    assert len(runs) == len(set(blocks)) and sum(a[2] != b[2] for a, b in zip(runs, runs[1:])) > 5
    named = df.withColumns({"_mix_source": F.lit(3), "key": F.lit("k"), "row": F.lit("r"), "a.b": F.lit(1), "_mix_at": F.lit("mine")})
    kept = mixing.mix(named, repetition=3.0)
    assert {(r._mix_source, r.key, r.row, r["a.b"]) for r in kept.collect()} == {(3, "k", "r", 1)} and kept.columns[-5:] == mixing.OWN
    assert mixing.mix(none).count() == 0 and mixing.mix(odd).count() == odd.count()
    small = mixing.mix(df, budget=whole / 10, block_tokens=200)
    assert 0.05 * whole < sum(r._mix_tokens for r in small.collect()) <= whole / 10 + 4


def test_exponents_of_extreme_shares(spark):
    far = spark.createDataFrame([("a", 10**15), ("b", 9 * 10**14), ("c", 10)], "source string, tokens long")
    for target in (0.01, 0.3, 1.05):
        a = mixing.exponent(far, entropy=target)
        logs = np.log([1e15, 9e14, 10.0]) * a
        p = np.exp(logs - logs.max()) / np.exp(logs - logs.max()).sum()
        assert abs(-(p[p > 0] * np.log(p[p > 0])).sum() - target) < 1e-6
    same = spark.createDataFrame([("a", 5), ("b", 5), ("c", 0)], "source string, tokens long")
    assert mixing.exponent(same, entropy=math.log(2)) == 0.0 and mixing.exponent(far, repetition=1.0) == 1.0
    for table, options in ((same, {"entropy": 0.3}), (far, {"entropy": 1.2}), (far, {"repetition": 0.5})):
        with pytest.raises(ValueError):
            mixing.exponent(table, **options)
    docs = spark.createDataFrame([(i, "x " * (400 if i else 1), "b" if i else "s") for i in range(50)], "doc_id long, text string, source string")
    assert {r.doc_id for r in mixing.mix(docs, entropy=1e-6, budget=19_600).collect()} == set(range(1, 50))


def test_licences(spark, odd, none):
    texts = ["Some words.\nReleased under the MIT License.", "# Licensed under the Apache License,\n# Version 2.0. Then text", "a\nThis work is licensed under the GNU General Public License, version 3.\nb", "no software here", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r.licenses for r in licenses.scan(df).orderBy("doc_id").collect()] == ["MIT", "Apache-2.0", "GPL-3.0-only", "", ""]
    assert {r.licenses for r in licenses.scan(odd).collect()} == {""} and licenses.scan(none).count() == 0
