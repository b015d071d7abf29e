"""Source trees and session logs as tables of files, with sizes known before contents are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LISTED_BYTES = 5_000_000
# Folders and kinds of files that an inventory leaves out, and kinds that count as code.
SKIP_DIRS = [
    ".git", "__pycache__", "node_modules", ".venv", "venv", "env", "dist", "build", ".next", ".nuxt", "target", ".claude", ".idea", ".vscode", ".pytest_cache",
    "data", "datasets", "models", "checkpoints", "logs", "wandb", "outputs", "runs", "cache", ".cache", ".mypy_cache", ".ruff_cache", "htmlcov", ".tox", "site-packages",
]
SKIP_EXTS = [
    "pyc", "pyo", "pyd", "so", "dll", "exe", "bin", "jpg", "jpeg", "png", "gif", "ico", "woff", "ttf", "lock", "sum", "zip", "tar", "gz", "log", "csv", "tsv",
    "qasm", "npy", "npz", "pt", "pth", "ckpt", "h5", "hdf5", "parquet", "bak", "tmp", "pkl", "pickle", "onnx", "safetensors", "wav", "mp4", "pdf",
]
CODE_EXTS = ["py", "js", "ts", "tsx", "jsx", "rs", "go", "java", "cpp", "c", "h", "cu", "cuh", "cs", "rb", "php", "sh", "ps1", "r", "jl", "v", "sv", "vhd"]


def ext(path: Column | str) -> Column:
    return F.regexp_extract(path, r"[^/]\.(\w+)$", 1)


def listed(files: DataFrame, skip_dirs: list[str] | None = None, skip_exts: list[str] | None = None) -> DataFrame:
    """Files (path below the root, bytes) that an inventory reads: none below a skipped or hidden folder, none of a skipped kind."""
    dirs = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    skipped = F.exists(dirs, lambda d: d.startswith(".") | d.isin(SKIP_DIRS if skip_dirs is None else skip_dirs))
    return files.where(~skipped & ~ext("path").isin(SKIP_EXTS if skip_exts is None else skip_exts))


def read_tree(spark: SparkSession, root: str, cap: int | None = LISTED_BYTES, glob: str = "*") -> tuple[DataFrame, DataFrame]:
    """Files below a folder: (path, bytes, mtime, text, bad) and those over `cap` bytes (path, bytes), whose contents are never read.

    Bytes that are no UTF-8 become replacement characters and set `bad`.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    prefix = F.lit(root.rstrip("/").removeprefix("file://").removeprefix("file:"))
    path = F.regexp_replace("path", "^file:(//)?", "")
    path = F.when(path.startswith(prefix), path.substr(F.length(prefix) + 2, F.length(path))).otherwise(path)
    over = found.where(F.col("length") > cap) if cap is not None else found.limit(0)
    within = found.where(F.col("length") <= cap) if cap is not None else found
    text = F.col("content").cast("string")
    files = within.select(path.alias("path"), F.col("length").alias("bytes"), F.unix_timestamp("modificationTime").alias("mtime"), F.make_valid_utf8(text).alias("text"), (~F.is_valid_utf8(text)).alias("bad"))
    return files, over.select(path.alias("path"), F.col("length").alias("bytes"))


def read_lines(spark: SparkSession, root: str, cap: int | None = None, glob: str = "*.jsonl") -> DataFrame:
    """(path, seq, line, bad) of the files below a folder, of at most `cap` bytes each; seq is the order in a file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(root)
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes"), at.alias("seq"), F.col("value"))
    if cap is not None:
        rows = rows.where(F.col("bytes") <= cap)
    return rows.select("path", "seq", F.make_valid_utf8("value").alias("line"), (~F.is_valid_utf8("value")).alias("bad"))


def split_events(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines that are JSON objects with a type, and the others that are not blank, kept apart."""
    typed = F.from_json("line", "type string", {"mode": "PERMISSIVE"})["type"].isNotNull()
    kept = lines.where(F.trim("line") != "")
    return kept.where(typed), kept.where(~typed)


def totals(files: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Per group (null: one row): files, KiB, bytes of code, and the five commonest extensions with their counts."""
    by = by or []
    kinds = files.groupBy(*by, ext("path").alias("ext")).agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes"))
    code = F.col("ext").isin(CODE_EXTS)
    order = F.struct((-F.col("n")).alias("a"), F.col("ext").alias("e"))
    # one row per kind of file
    best = F.transform(F.slice(F.array_sort(F.collect_list(order)), 1, 5), lambda x: F.concat(x["e"], F.lit(":"), (-x["a"]).cast("string")))
    return kinds.groupBy(*by).agg(F.sum("n").alias("files"), F.round(F.sum("bytes") / 1024, 1).alias("kb"), F.coalesce(F.sum(F.when(code, F.col("bytes"))), F.lit(0)).alias("code_bytes"), F.array_join(best, ",").alias("top"))
