"""Token-id files with directly addressable codes.

An id is cut into chunks of eight bits. Level 0 holds the lowest chunk of every
token, level 1 the next chunk of the tokens that have one, and so on. A bitmap
per level says which tokens continue, and a directory holds the number of set
bits before every 512 bits, so the place of a token's next chunk is one lookup
and one popcount: any token is read without decoding others.

A file holds consecutive documents in ascending id order: magic, header length,
JSON header, document ids, document sizes, then per level chunks, bitmap and
directory. Tasks write files under names of their own and the manifest is
written by Spark, so files of lost or repeated attempts are never read.

Defined cases: a null text has no ids but its end id; a special token's text in
a document gives that token's id, as the library's default is; a null id sorts first;
repeated ids are ordered by a hash of the text; an empty table gives no file and
an empty result; other columns of any name are ignored.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import new_path, open_fs, partitions, stored
from lorekeep.llm.tokens import encoder, slices, vocabulary_path

MAGIC = b"LKDAC001"
BLOCK = 512  # bits of a rank directory entry
#: Tokens after which a file is closed.
FILE_TOKENS = 4_000_000
FILES_A_TASK = 4
#: Bytes of text that one write task gets in the mean, unless the session asks for more tasks.
TASK_BYTES = 128 << 20
MANIFEST = "part long, seq long, path string, n_docs long, n_tokens long"


class Codes:
    """Directly addressable codes of a sequence of unsigned ids."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        self.levels = levels  # (chunks uint8, bitmap uint8, ranks uint32)

    @classmethod
    def encode(cls, ids: np.ndarray) -> Codes:
        levels, rest = [], ids.astype(np.uint64)
        while not levels or len(rest):
            chunks, more = (rest & 0xFF).astype(np.uint8), rest > 0xFF
            bitmap = np.packbits(more, bitorder="little")
            padded = np.zeros(-(-len(more) // BLOCK) * (BLOCK // 8), np.uint8)
            padded[: len(bitmap)] = bitmap
            ones = np.bitwise_count(padded).reshape(-1, BLOCK // 8).sum(axis=1, dtype=np.uint32)
            ranks = np.concatenate((np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)))
            levels.append((chunks, bitmap, ranks))
            rest = rest[more] >> np.uint64(8)
        return cls(levels)

    def __len__(self) -> int:
        return len(self.levels[0][0])

    def __getitem__(self, at: int) -> int:
        value = 0
        for k, (chunks, bitmap, ranks) in enumerate(self.levels):
            value |= int(chunks[at]) << 8 * k
            if not bitmap[at >> 3] >> (at & 7) & 1:
                return value
            begin = at // BLOCK * (BLOCK // 8)
            before = int(np.bitwise_count(bitmap[begin : at >> 3]).sum()) + int(bitmap[at >> 3] & ((1 << (at & 7)) - 1)).bit_count()
            at = int(ranks[at // BLOCK]) + before
        return value

    def decode(self) -> np.ndarray:
        """All ids, level by level."""
        out, at = np.zeros(len(self), np.uint32), np.arange(len(self))
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            out[at] |= chunks.astype(np.uint32) << np.uint32(8 * k)
            at = at[np.unpackbits(bitmap, count=len(chunks), bitorder="little").view(bool)]
        return out


def dump(doc_ids: list[int | None], sizes: list[int], ids: np.ndarray) -> list[bytes]:
    """The bytes of a file, in pieces."""
    codes = Codes.encode(ids)
    known = np.array([i is not None for i in doc_ids], np.uint8)
    parts = [np.array([i or 0 for i in doc_ids], "<i8"), known, np.array(sizes, "<u8")]
    for chunks, bitmap, ranks in codes.levels:
        parts += [chunks, bitmap, ranks.astype("<u4")]
    raw = [p.tobytes() for p in parts]
    header = {"docs": len(doc_ids), "tokens": len(ids), "chunk_bits": 8, "levels": [len(c) for c, _, _ in codes.levels], "sizes": [len(r) for r in raw], "crc32": reduce(lambda crc, r: zlib.crc32(r, crc), raw, 0)}
    head = json.dumps(header).encode()
    return [MAGIC, len(head).to_bytes(8, "little"), head, *raw]


def load(data: bytes) -> tuple[list[int | None], np.ndarray, Codes]:
    """Document ids, document sizes and codes of a file; raises on damage."""
    if data[:8] != MAGIC:
        raise ValueError("not a file of directly addressable codes")
    n = int.from_bytes(data[8:16], "little")
    header, body = json.loads(data[16 : 16 + n]), memoryview(data)[16 + n :]
    if zlib.crc32(body) != header["crc32"]:
        raise ValueError("checksum differs")
    ends = np.cumsum(header["sizes"])
    raw = [body[e - s : e] for s, e in zip(header["sizes"], ends, strict=True)]
    ids, known, sizes = np.frombuffer(raw[0], "<i8"), np.frombuffer(raw[1], np.uint8), np.frombuffer(raw[2], "<u8").astype(np.int64)
    levels = [tuple(np.frombuffer(raw[3 + 3 * k + j], t) for j, t in enumerate((np.uint8, np.uint8, "<u4"))) for k in range(len(header["levels"]))]
    return [i if k else None for i, k in zip(ids.tolist(), known.tolist(), strict=True)], sizes, Codes(levels)


def _writer(folder: str, vocabulary: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        fs, base = open_fs(folder)
        part, seq, total = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        sizes: list[int] = []
        held: list[np.ndarray] = []

        def close() -> pa.RecordBatch:
            nonlocal seq, total
            fs.create_dir(base, recursive=True)
            name = f"{part:06d}-{seq:06d}-{uuid.uuid4().hex}.dac"
            with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
                for piece in dump(doc_ids, sizes, np.concatenate(held)):
                    out.write(piece)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": f"{folder}/{name}", "n_docs": len(sizes), "n_tokens": total}], schema=pa.schema([("part", pa.int64()), ("seq", pa.int64()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]))
            seq, total = seq + 1, 0
            for x in (doc_ids, sizes, held):
                x.clear()
            return row

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in slices(batch.column(2).to_pylist()):
                ids, counts = encode(batch.column(1).slice(a, b - a))
                ends = np.cumsum(counts)
                ids = np.insert(ids, ends, end_id)
                ends += np.arange(1, len(ends) + 1)
                first = done = 0
                while first < len(ends):
                    # up to the document that fills the file
                    stop = min(len(ends), int(np.searchsorted(ends, done + FILE_TOKENS - total)) + 1)
                    doc_ids += keys[a + first : a + stop]
                    sizes += (counts[first:stop] + 1).tolist()
                    held.append(ids[done : ends[stop - 1]])
                    total, done, first = total + int(ends[stop - 1]) - done, int(ends[stop - 1]), stop
                    if total >= FILE_TOKENS:
                        yield close()
        if sizes:
            yield close()

    return run


def write(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, order: list[Column] | None = None) -> DataFrame:
    """Encode every text and write files in ascending id order, or in that of `order`; the manifest, with the number of ids before each file."""
    text = F.col(text_col).cast("string")
    keys = {f"_o{i}": c for i, c in enumerate(order or [F.col(id_col).cast("long"), F.xxhash64(text)])}
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"), *[c.alias(k) for k, c in keys.items()])
    size = rows.agg(F.sum("bytes")).first()[0] or 0
    rows = rows.repartitionByRange(partitions(df.sparkSession, size, TASK_BYTES), *keys).sortWithinPartitions(*keys).select("id", "text", "bytes")
    manifest = stored(rows.mapInArrow(_writer(folder, vocabulary or vocabulary_path(), end_id), MANIFEST), "dac-manifest")
    # two steps, so that no task orders more rows than there are write tasks or files in one of them
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = manifest.groupBy("part").agg(F.sum("n_tokens").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    within = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.join(parts, "part").withColumn("start", F.col("first") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0))).drop("first")


def _reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for path, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            fs, name = open_fs(path)
            with fs.open_input_file(name) as f:
                doc_ids, sizes, codes = load(f.read())
            ids, ends = memoryview(codes.decode().astype("<u4").tobytes()), np.cumsum(sizes)
            begins = ends - sizes
            crcs = [zlib.crc32(ids[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(begins + start), pa.array(sizes), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read(manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files of a manifest."""
    # a fixed number of tasks: rows are few and small, their files are not
    files = manifest.select("path", "start")
    files = files.repartition(partitions(manifest.sparkSession, files.count(), FILES_A_TASK), "path")
    return files.mapInArrow(_reader, "doc_id long, start long, n_tokens long, ids_crc32 long")


class Remote:
    """A file's codes, of which only the bytes asked for are read: its header, then a chunk, a bitmap block and a rank a level."""

    def __init__(self, file) -> None:
        if file.read_at(8, 0) != MAGIC:
            raise ValueError("not a file of directly addressable codes")
        n = int.from_bytes(file.read_at(8, 8), "little")
        header = json.loads(file.read_at(n, 16))
        begins = 16 + n + np.concatenate(([0], np.cumsum(header["sizes"])))
        self.file, self.places = file, begins[3:].tolist()

    def __getitem__(self, at: int) -> int:
        value, k = 0, 0
        while True:
            chunks, bitmap, ranks = self.places[3 * k : 3 * k + 3]
            value |= self.file.read_at(1, chunks + at)[0] << 8 * k
            begin = at // BLOCK * (BLOCK // 8)
            bits = self.file.read_at((at >> 3) - begin + 1, bitmap + begin)
            if not bits[-1] >> (at & 7) & 1:
                return value
            before = int.from_bytes(bits, "little") & ((1 << (at & 7) + 8 * (len(bits) - 1)) - 1)
            at = int.from_bytes(self.file.read_at(4, ranks + 4 * (at // BLOCK)), "little") + before.bit_count()
            k += 1


def token_at(manifest: DataFrame, positions: DataFrame, span: int = FILE_TOKENS) -> DataFrame:
    """(position, token) of global token positions (column `position`), each read by offset without decoding its file.

    Files and positions meet on the number of the `span` tokens they lie in; a position outside the files has no row.
    """
    at = F.explode(F.sequence(F.floor(F.col("start") / span), F.floor((F.col("start") + F.col("n_tokens") - 1) / span))).alias("cell")
    files = manifest.select("path", "start", (F.col("start") + F.col("n_tokens")).alias("stop"), at)
    asked = positions.select("position", F.floor(F.col("position") / span).alias("cell"))
    found = asked.join(files, "cell").where((F.col("position") >= F.col("start")) & (F.col("position") < F.col("stop"))).select("path", "position", (F.col("position") - F.col("start")).alias("at"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file, codes = None, None, None
        for batch in batches:
            tokens = []
            for name, at in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if name != path:
                    if file is not None:
                        file.close()
                    fs, local = open_fs(name)
                    file, path = fs.open_input_file(local), name
                    codes = Remote(file)
                tokens.append(codes[at])
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(tokens, pa.int64())], names=["position", "token"])
        if file is not None:
            file.close()

    return found.sortWithinPartitions("path").mapInArrow(fetch, "position long, token long")


def placed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Id and text of the rows of files with `_at`, their place: (length of the name, name, row number); None if `df` is not read from Parquet files.

    Files that Spark writes are named by their partition, so this is the order in which a sorted table was written.
    """
    try:
        meta = df.select(id_col, text_col, F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row"))
    except AnalysisException:
        return None
    number = F.split("name", "-")[1]
    return meta.select(id_col, text_col, F.struct(F.length(number).alias("long"), "name", "row").alias("_at"))


def encode_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, end_id: int = 2, order: list[Column] | None = None) -> DataFrame:
    """Write the files in the shared folder and read every document back."""
    return read(write(df, new_path(df.sparkSession, "dac"), id_col, text_col, vocabulary, end_id, order))
