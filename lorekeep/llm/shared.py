"""What the corpus operators share: tables in the shared folder, files by URI, task counts."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import lru_cache

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession

from lorekeep.shared import cleared, drop, new_path, shared_dir, stored

__all__ = ["cleared", "drop", "forget", "kept_by_worker", "new_path", "open_fs", "partitions", "shared_dir", "small_batches", "stored"]


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI, for executors. A bare path is refused: Spark takes it as one of the cluster's file system, not as a local one."""
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:") :]
    if "://" not in uri:
        raise ValueError(f"{uri} has no file system; see lorekeep.shared.qualified")
    return pafs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def partitions(spark: SparkSession, rows: int, per_task: int) -> int:
    """Tasks for `rows`, `per_task` at most in the mean, and no fewer than the session asks for."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


@contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Whole texts go to Python at most `rows` at once in what is written inside the block, so that two tasks' batches fit beside the heap."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows if int(before) <= 0 else min(rows, int(before))))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_kept: list = []


def kept_by_worker(f: Callable) -> Callable:
    """`f` with its last results kept in a Python worker from task to task, until the worker turns to other work (`forget`)."""
    _kept.append(lru_cache(maxsize=2)(f))
    return _kept[-1]


def forget() -> None:
    """Drop what this worker keeps of other work, and give the memory back; tasks of a later stage run in the same process."""
    if any(f.cache_info().currsize for f in _kept):
        for f in _kept:
            f.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
            trim(0)
