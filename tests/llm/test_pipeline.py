"""run() against a brute-force version of its stages."""

import re
import zlib
from array import array
from collections import Counter

from test_minhash import brute_roots, grams
from test_text import brute
from tokenizers import Tokenizer

import corpus_pipeline
from lorekeep.llm import mixing, nbsvm, tokens
from lorekeep.llm.shared import new_path

SF = "/root/testdata/sf0.001"


def test_run_matches_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = nbsvm.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    kept = [r for r in rows if model.score(r["text"]) >= 0.7]
    kept = sorted(kept, key=lambda r: r["doc_id"])
    kept = [r for i, (r, c) in enumerate(zip(kept, brute_roots([grams(r["text"]) for r in kept]), strict=True)) if i == c]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    flagged = {d[0] for d in brute([(r["doc_id"], r["text"]) for r in kept], items, 13) if d[5]}
    kept = [r for r in kept if r["doc_id"] not in flagged]
    assert 0 < len(kept) < len(rows) and flagged
    got = corpus_pipeline.run(spark, SF).collect()
    count = Counter(r.doc_id for r in got)
    assert set(count) == {r["doc_id"] for r in kept}
    # passes: every document once, a source's share up to half a pass more
    size = Counter()
    for r in kept:
        size[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    used = Counter()
    for r in kept:
        used[r["source"]] += count[r["doc_id"]] * len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    ratio = {s: used[s] / n for s, n in size.items()}
    assert max(count.values()) <= 2 and max(ratio.values()) <= 1.5 and min(ratio.values()) == 1.0
    library = Tokenizer.from_file(tokens.vocabulary_path())
    text = {r["doc_id"]: r["text"] for r in kept}
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        ids = [*library.encode(text[r.doc_id] or "", add_special_tokens=False).ids, 2]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(array("I", ids).tobytes()))
        at += len(ids)


def test_token_files_follow_the_mixture(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    path = new_path(spark, "mixed")
    corpus_pipeline.mix(spark, docs, SF).write.parquet(path)
    mixed = spark.read.parquet(path)
    got = [r.doc_id for r in corpus_pipeline.tokens(spark, mixed, SF).orderBy("start").collect()]
    want = [r for r in mixing.mix(docs, repetition=1.5).collect()]
    want.sort(key=lambda r: (r._mix_pass, r._mix_order, r._mix_block, r._mix_at))
    assert got == [r.doc_id for r in want] and got != sorted(got)


def test_stages_take_odd_rows(spark, odd, odd_rows):
    """Null and empty texts, null and repeated ids, clashing and dotted column names; no stage but the last drops a column."""
    docs = odd.withColumnRenamed("keep_id", "_keep_id").withColumnRenamed("lang", "a.b").withColumn("_mix_source", corpus_pipeline.F.lit("mine"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, SF)
        assert got.columns == docs.columns, name
        rows = got.collect()
        assert {(r.doc_id, r.text) for r in rows} <= set(odd_rows) and all(r["a.b"] == "en" and r._mix_source == "mine" for r in rows), name
        if name == "SimHash near-dedup":
            # copies, their likes and the longer one in one group; the three without words in another
            assert sorted(r.doc_id for r in rows) == [1, 4, 7, 9, 9, 10]
        elif name != "quality classifier":
            assert sorted(map(str, ((r.doc_id, r.text) for r in rows))) == sorted(map(str, odd_rows)), name
    got = corpus_pipeline.tokens(spark, docs, SF).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in odd_rows)


def test_stages_keep_the_columns_and_take_empty_tables(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns, name
        assert stage(spark, docs, SF).count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == 0
