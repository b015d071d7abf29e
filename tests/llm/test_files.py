import hashlib
import io
import random
import zlib
from array import array

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lorekeep.llm import dac, separator_scan, tokens, warc
from lorekeep.llm.shared import new_path


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def plain_library():
    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def by_text(encode, texts):
    ids, counts = encode(pa.array(texts))
    return [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]


def test_pieces_give_the_ids_of_whole_texts(library, plain_library, odd_rows):
    texts = [t or "" for _, t in odd_rows] + [" a", "a ", "\na", "a\n", "a\n\nb", "a \nb", " ", "\n", "a  b", "it's <|endoftext|> x", "　 a b", "a\tb c\x0b d", "x.\r\ny z w"]
    rng = random.Random(1)
    signs = ["a", "b ", " ", "\n", "  ", "\t", "'s", "1", "é", "\xa0", "\x85", "\x0b", "\0", "<|endoftext|>", "\r\n", ".", "the", " word", "\x1c"]
    texts += ["".join(rng.choice(signs) for _ in range(rng.randint(0, 14))) for _ in range(5000)]
    for plain, want in ((False, library), (True, plain_library)):
        encode = tokens.encoder.__wrapped__(tokens.vocabulary_path(), plain)
        for _ in range(2):  # from the library, then from the cache
            assert by_text(encode, texts) == [want(t) for t in texts]
    assert by_text(tokens.encoder(tokens.vocabulary_path()), ["a <|endoftext|> b", None]) == [[64, 220, 50256, 275], []]


def test_cache_drops_the_older_generation(monkeypatch, library, words):
    monkeypatch.setattr(tokens, "CACHED_CHARS", 500)
    encode = tokens.encoder.__wrapped__(tokens.vocabulary_path())
    rng = random.Random(4)
    for _ in range(30):
        texts = [" ".join(rng.choice(words[:400]) for _ in range(60)) for _ in range(3)]
        assert by_text(encode, texts) == [library(t) for t in texts]


def test_codes_round_trip_and_random_access():
    rng = np.random.default_rng(2)
    for ids in (np.array([], np.uint32), np.array([0, 255, 256, 65535, 65536, 2**32 - 1], np.uint32), rng.integers(0, 50_257, 5000, dtype=np.uint32)):
        codes = dac.Codes.encode(ids)
        assert np.array_equal(codes.decode(), ids)
        assert all(codes[int(i)] == ids[i] for i in rng.integers(0, max(1, len(ids)), 200) if len(ids))
    data = b"".join(dac.dump([3, None], [2, 1], np.array([7, 300, 2], np.uint32)))
    ids, sizes, codes = dac.load(data)
    assert ids == [3, None] and sizes.tolist() == [2, 1] and codes.decode().tolist() == [7, 300, 2]
    with pytest.raises(ValueError):
        dac.load(data[:-1] + bytes([data[-1] ^ 1]))


def test_token_files_hold_every_document_in_order(spark, odd, odd_rows, none, library):
    manifest = dac.write(odd, new_path(spark, "t"))
    got = sorted(dac.read(manifest).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in got]
    assert keys == sorted((i for i, _ in odd_rows), key=lambda i: (i is not None, i or 0))
    want = sorted((i is not None, i or 0, len(x := [*library(t), 2]), zlib.crc32(array("I", x).tobytes())) for i, t in odd_rows)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in got) == want
    text_of = {(len(x), zlib.crc32(array("I", x).tobytes())): x for _, t in odd_rows for x in [[*library(t), 2]]}
    ids_of, at = {}, 0
    for r in got:
        assert r.start == at
        ids_of[at] = text_of[r.n_tokens, r.ids_crc32]
        at += r.n_tokens
    every = [x for r in got for x in ids_of[r.start]]
    asked = [0, at - 1, *random.Random(1).sample(range(at), 300)]
    places = spark.createDataFrame([(i,) for i in [*asked, at, at + 10**9]], "position long")
    for span in (50, dac.FILE_TOKENS):
        found = dac.token_at(manifest, places, span)
        assert "NestedLoop" not in found._jdf.queryExecution().toString()
        assert sorted((r.position, r.token) for r in found.collect()) == sorted((i, every[i]) for i in asked)
    assert dac.encode_table(none).count() == 0


def test_separator_scan_stitches_blocks(spark, tmp_path):
    rng = random.Random(6)
    want = []
    for k in range(6):
        sizes = [rng.choice([0, 1, 5, 40, 300]) for _ in range(rng.randint(0, 30))]
        ids = [x for n in sizes for x in [*(rng.randrange(50_000) for _ in range(n)), separator_scan.SEPARATOR]]
        if k % 2:
            ids += [1] * 130  # no separator at the end
            sizes += [130]
        (tmp_path / f"{k}.ids").write_bytes(np.array(ids, "<u2").tobytes() + b"x" * (k % 2))
        want += [(f"{k}.ids", i, n) for i, n in enumerate(sizes)]
    files = separator_scan.list_files(spark, str(tmp_path))
    for block in (2, 62, 1 << 20):
        got = [(r.path.rsplit("/", 1)[1], r.ordinal, r.n_tokens) for r in separator_scan.scan(files, block_bytes=block).collect()]
        assert sorted(got) == sorted(want), block


def test_document_counts(odd, odd_rows, none, plain_library):
    got = sorted((str(r.doc_id), r.n_tokens) for r in separator_scan.document_counts(odd).collect())
    assert got == sorted((str(i), len(plain_library(t))) for i, t in odd_rows)
    assert separator_scan.document_counts(none).count() == 0
    with pytest.raises(Exception, match="does not fit"):
        separator_scan.document_counts(odd, dtype="<u1", separator=255)


def archive(n, packed=True):
    parts, pages = [], []
    for i in range(n):
        payload = (f"<p>{i} WARC/1.1\r\n" + "x" * (i * 37 % 2000)).encode()
        data = warc.record(i, f"http://a/{i}", payload, False, None, "2024-01-01T00:00:00Z")
        parts.append(warc._gzip(data) if packed else data)
        pages.append(payload)
    return parts, pages


class Bytes(io.BytesIO):
    def read_at(self, n, at):
        return self.getvalue()[at : at + n]


@pytest.mark.parametrize("packed", [True, False])
def test_salvage_recovers_what_follows_damage(packed):
    parts, pages = archive(40, packed)
    bad = {0, 7, 8, 21, 39}
    rng = random.Random(2)
    for i in bad:
        p = bytearray(parts[i])
        for _ in range(6):
            p[rng.randrange(12, len(p))] ^= 0x5A
        parts[i] = bytes(p[: len(p) - 9]) if i == 21 else bytes(p)
    data = b"junk" + b"".join(parts) + b"\x1f\x8b\x08tail"
    got = list(warc.salvage(Bytes(data), len(data)))
    assert [r["page_id"] for r in got if "gap" not in r] == [i for i in range(40) if i not in bad]
    assert all(r["payload"] == pages[r["page_id"]] for r in got if "gap" not in r)
    at = 0
    for r in got:
        assert r["offset"] == at
        at += r["length"]
    assert at == len(data) and sum("gap" in r for r in got) == 4
    assert list(warc.salvage(Bytes(b""), 0)) == []


def salvaged(data):
    return list(warc.salvage(Bytes(data), len(data)))


def test_valid_archives_of_other_writers_have_no_gap():
    parts, pages = archive(3, packed=False)
    both = salvaged(warc._gzip(parts[0] + parts[1]) + warc._gzip(parts[2]))
    assert [r.get("payload") for r in both] == pages and not any("gap" in r for r in both) and both[1]["length"] == 0 and both[1]["offset"] == 0
    sha = hashlib.sha1(pages[1]).hexdigest()
    said = warc._digest(pages[1]).encode()
    block = [x for x in parts[1].split(b"\r\n") if x.startswith(b"WARC-Block-Digest")][0]
    for change in (
        lambda d: d.replace(said, f"sha1:{sha}".encode()),
        lambda d: d.replace(said, f"sha1:{sha.upper()}".encode()),
        lambda d: d.replace(said, said.lower()),
        lambda d: d.replace(said, b"md5:abc"),
        lambda d: d.replace(b"WARC-Target-URI: http://a/1", b"WARC-Target-URI: http://a/1\r\n and\r\n\tmore"),
        lambda d: d.replace(block, b"WARC-Block-Digest: sha256:00"),
        lambda d: d.replace(b"X-Page-Id: 1", b"X-Page-Id: 1"),
    ):
        for data in (change(parts[1]), warc._gzip(change(parts[1]))):
            (r,) = salvaged(data)
            assert r["payload"] == pages[1] and r["payload_digest"] == sha and r["flaw"] is None
    assert salvaged(parts[1].replace(b"WARC-Target-URI: http://a/1", b"WARC-Target-URI: http://a/1\r\n and"))[0]["url"] == "http://a/1 and"
    assert salvaged(parts[1].replace(b"X-Page-Id: 1", b"X-Page-Id: own"))[0]["page_id"] is None
    for wrong in (b"sha1:" + b"A" * 32, b"sha1:???"):
        (r,) = salvaged(parts[1].replace(said, wrong))
        assert r["flaw"] and r["payload"] == pages[1] and r["payload_digest"] == sha


def test_bombs_and_wrong_blocks_are_gaps(monkeypatch):
    parts, pages = archive(2)
    monkeypatch.setattr(warc, "MOST", 1 << 20)
    got = salvaged(parts[0] + warc._gzip(b"WARC/1.1\r\n" + b"0" * (40 << 20)) + parts[1])
    assert [r.get("payload") for r in got] == [pages[0], None, pages[1]] and "inflates" in got[1]["gap"]
    plain, _ = archive(2, packed=False)
    got = salvaged(plain[0].replace(b"WARC/1.1\r\nx", b"").replace(b"<p>0", b"<p>9") + plain[1])
    assert ["gap" in r for r in got] == [True, False] and "block digest" in got[0]["gap"]


def test_archives_round_trip_with_revisits(spark):
    same = "y" * 1500
    rows = [(1, "u", same), (2, None, same), (3, "u\r\nx", "small"), (4, "u", "small"), (5, "", None), (None, "u", same), (6, "u", "é" * 900), (2, "u", same)]
    pages = spark.createDataFrame([(*r, "z") for r in rows], "page_id long, url string, html string, payload string")
    got = warc.archive(pages).collect()
    body = lambda h: (h or "").encode()
    want = [(i, len(body(h)), hashlib.sha1(body(h)).hexdigest(), "revisit" if h == same and i != 2 else "response", 2 if h == same and i != 2 else None) for i, _, h in rows]
    key = lambda r: tuple(map(str, r))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=key) == sorted(want, key=key)
    assert warc.archive(pages.limit(0)).count() == 0
    # one id with unequal payloads: each is judged by its own
    twice = spark.createDataFrame([(1, "u", same), (1, "u", same + "z"), (2, "u", same + "z")], "page_id long, url string, html string")
    assert sorted((r.page_id, r.payload_bytes, r.record_type, r.refers_to) for r in warc.archive(twice).collect()) == [(1, 1500, "response", None), (1, 1501, "revisit", 2), (2, 1501, "response", None)]
