"""Token counts of flat files that have no index, by a scan for end-of-document ids.

A file is nothing but ids of a fixed width; a document ends at each separator.
Files are cut into blocks, every block is searched with one vector comparison,
and documents that cross block borders are stitched by a prefix scan over the
blocks of a file: the tokens carried into a block are those since the last
separator before it.

Defined cases: ids after the last separator form a document of their own; two
separators in a row enclose an empty document; bytes at the end that do not make
a whole id are ignored; an empty file has no document; a null text is written as
an empty document; a special token's text is ordinary text here, so no document
holds a separator of its own; an id that does not fit the width raises.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lorekeep.llm.shared import new_path, open_fs, partitions, stored
from lorekeep.llm.tokens import encoder, slices, vocabulary_path

SEPARATOR = 50256
BLOCK_BYTES, FILE_BYTES, BLOCKS_A_TASK = 4 << 20, 64 << 20, 8


def write_flat(df: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, dtype: str = "<u2", vocabulary: str | None = None, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write each task's texts as flat id files in the order it reads them; (path, ordinal, id) of the rows written."""
    path = vocabulary or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, most = encoder(path, plain_specials=True), np.iinfo(dtype).max
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        out, name, ordinal, size = None, "", 0, 0
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for a, b in slices(batch.column(2).to_pylist()):
                names, ordinals = [], []
                ids, counts = encode(batch.column(1).slice(a, b - a))
                if max(separator, int(ids.max(initial=0))) > most:
                    raise ValueError(f"an id over {most} does not fit {dtype}")
                stops = np.cumsum(counts)
                ids, stops = np.insert(ids, stops, separator).astype(dtype), (stops + np.arange(1, len(stops) + 1)).tolist()
                for begin, stop in zip([0, *stops], stops, strict=False):
                    if out is None:
                        name, ordinal, size = f"{uuid.uuid4().hex}.ids", 0, 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = ids[begin:stop].tobytes()
                    out.write(data)
                    names.append(f"{folder}/{name}")
                    ordinals.append(ordinal)
                    ordinal, size = ordinal + 1, size + len(data)
                    if size >= file_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ordinals, pa.int64()), pa.array(keys[a:b], pa.int64())], names=["path", "ordinal", "id"])
        if out is not None:
            out.close()

    text = F.col(text_col).cast("string")
    rows = df.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.coalesce(F.octet_length(text), F.lit(0)).alias("bytes"))
    return stored(rows.mapInArrow(run, "path string, ordinal long, id long"), "flat-rows")


def list_files(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, bytes) of the files of a folder or pattern; contents are not read."""
    return spark.read.format("binaryFile").load(pattern).select("path", F.col("length").alias("bytes"))


def scan(files: DataFrame, separator: int = SEPARATOR, dtype: str = "<u2", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, ordinal, n_tokens) of every document of files (path, bytes); the separator is not counted."""
    width = np.dtype(dtype).itemsize
    block_ids = max(1, block_bytes // width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, block, count in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                fs, name = open_fs(path)
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(count * width, block * block_ids * width), dtype)
                at = np.flatnonzero(ids == separator)
                sizes = np.diff(at, prepend=-1) - 1
                tail = len(ids) - (int(at[-1]) + 1 if len(at) else 0)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block]), pa.array([len(at)]), pa.array([tail]), pa.array([sizes.tolist()], pa.list_(pa.int64()))], names=["path", "block", "found", "tail", "sizes"])

    ids = F.floor(F.col("bytes") / width)
    last = F.floor((ids - 1) / block_ids)
    blocks = files.where(ids > 0).select("path", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"), ids.alias("ids"))
    blocks = blocks.select("path", "block", F.least(F.lit(block_ids), F.col("ids") - F.col("block") * block_ids).cast("long").alias("count"))
    # a fixed number of tasks: rows are few and small, their blocks are not
    blocks = blocks.repartition(partitions(files.sparkSession, blocks.count(), BLOCKS_A_TASK), "path", "block")
    found = stored(blocks.mapInArrow(search, "path string, block long, found long, tail long, sizes array<long>"), "blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    run = found.select("path", "block", "found", "tail").withColumn("first", F.coalesce(F.sum("found").over(before), F.lit(0))).withColumn("tails", F.coalesce(F.sum("tail").over(before), F.lit(0)))
    # the tails since (and with) the last block before this one that has a separator
    run = run.withColumn("carry", F.col("tails") - F.coalesce(F.max(F.when(F.col("found") > 0, F.col("tails"))).over(before), F.lit(0)))
    is_last = F.row_number().over(Window.partitionBy("path").orderBy(F.col("block").desc())) == 1
    run = run.withColumn("open", F.when(is_last, F.col("tail") + F.when(F.col("found") > 0, F.lit(0)).otherwise(F.col("carry"))).otherwise(0))
    run = run.select("path", "block", "first", "carry", "open")
    whole = found.select("path", "block", "sizes").join(run, ["path", "block"])
    # the open end of a file is one more size in its last block
    sizes = F.when(F.col("open") > 0, F.concat("sizes", F.array(F.when(F.size("sizes") > 0, F.col("open")).otherwise(F.col("open") - F.col("carry"))))).otherwise(F.col("sizes"))
    docs = whole.select("path", "first", "carry", F.posexplode(sizes).alias("pos", "size"))
    n_tokens = F.col("size") + F.when(F.col("pos") == 0, F.col("carry")).otherwise(0)
    return docs.select("path", (F.col("first") + F.col("pos")).alias("ordinal"), n_tokens.alias("n_tokens"))


def document_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, n_tokens) of every row of `df`: written to flat files, which are then scanned."""
    spark = df.sparkSession
    folder = new_path(spark, "flat")
    rows = write_flat(df, folder, id_col, text_col, **options)
    if rows.isEmpty():
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_tokens"))
    names = rows.select(F.element_at(F.split("path", "/"), -1).alias("name"), "ordinal", "id")
    name = F.element_at(F.split("path", "/"), -1)
    files = list_files(spark, folder).withColumn("name", name)
    files = files.join(names.select("name").distinct(), "name", "left_semi").select("path", "bytes")
    counts = scan(files).select(name.alias("name"), "ordinal", "n_tokens")
    return names.join(counts, ["name", "ordinal"]).select(F.col("id").alias(id_col), "n_tokens")
